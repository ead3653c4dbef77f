"""The engine: register tables, run queries of the dialect."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from .errors import ExecutionError
from .operators.emit import Emitter
from .plans.algebra import Query
from .plans.binder import bind
from .plans.parser import parse
from .plans.printer import plan_lines
from .sources.catalog import Catalog


class Engine:
    """strict_order: rows keep the order of the tables where it shows (ties, running frames, LIMIT), at the cost of ordinals."""

    def __init__(self, spark: SparkSession, strict_order: bool = False):
        self.spark, self.strict_order = spark, strict_order
        self.catalog = Catalog()

    def register(self, name: str, df: DataFrame) -> Engine:
        self.catalog.add(name, df)
        return self

    def table(self, name: str) -> DataFrame:
        """A table's visible columns under their own names, for DataFrame code."""
        return self.catalog.frame(name).toDF(*self.catalog.columns(name))

    def bind(self, text: str) -> Query:
        return bind(parse(text), self.catalog)

    def sql(self, text: str) -> DataFrame:
        """The result as a DataFrame; EXPLAIN gives one column, plan, a row for each line."""
        query = self.bind(text)
        if query.explain:
            return self.spark.createDataFrame([(line,) for line in self._explained(query)], "plan string").coalesce(1)
        return self._emitted(query)

    def collect(self, text: str) -> list[Row]:
        """The result's rows; errors of the rows' computation become ExecutionError."""
        try:
            return self.sql(text).collect()
        except (PySparkException, Py4JJavaError) as e:
            found = re.search(r"(?:\[USER_RAISED_EXCEPTION\] )([^\n]*? overflowed int64|scalar subquery at position \d+ returned more than one row)", str(e))
            if found:
                raise ExecutionError(found[1]) from None
            raise

    def explain(self, text: str) -> str:
        return "\n".join(self._explained(self.bind(text)))

    def _emitted(self, query: Query) -> DataFrame:
        return Emitter(self.catalog, self.strict_order).result(query)

    def _explained(self, query: Query) -> list[str]:
        """The bound plan, then what Catalyst made of it, with its ids taken out: the optimized plan with the size (and, where known, the rows) of each step, and the physical one."""
        execution = self._emitted(query)._jdf.queryExecution()
        cost = execution.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost"))
        plans = re.sub(r"#\d+L?|, \[?plan_id=\d+\]?|\[plan_id=\d+\]", "", cost)
        chosen, _, physical = plans.removeprefix("== Optimized Logical Plan ==\n").partition("\n\n== Physical Plan ==\n")
        physical = physical.rstrip()
        sections = (("bound logical plan:", plan_lines(query.plan)), ("optimized plan:", chosen.splitlines()), ("chosen plan:", physical.splitlines()))
        return ["EXPLAIN", *(line for head, lines in sections for line in (head, *("  " + x for x in lines)))]
