"""Named tables and the columns that the dialect sees of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.algebra import INT64, STRING

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def dialect_type(kind: T.DataType) -> str | None:
    """int64, string, or None for a type that the dialect doesn't have."""
    if isinstance(kind, _INTEGERS):
        return INT64
    return STRING if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) else None


class Catalog:
    """Registered tables. Columns of other types are hidden; names are case-sensitive."""

    def __init__(self):
        self._tables: dict[str, tuple[DataFrame, dict[str, str]]] = {}

    def add(self, name: str, df: DataFrame) -> None:
        if name in self._tables:
            raise ValueError(f"table already exists: {name}")
        seen: dict[str, str] = {}
        kept = []
        for i, field in enumerate(df.schema.fields):
            kind = dialect_type(field.dataType)
            if kind is None:
                continue
            if field.name in seen:
                raise ValueError(f"duplicate column in table {name}: {field.name}")
            seen[field.name] = kind
            kept.append(i)
        if not kept:
            raise ValueError(f"table {name} has no int64 or string column")
        # by position, so that names that differ only in case, or hold dots, stay apart
        placed = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
        columns = [F.col(f"_{i}").cast("bigint" if kind == INT64 else "string").alias(f"_{i}") for i, kind in zip(kept, seen.values())]
        self._tables[name] = placed.select(*columns), seen

    def columns(self, name: str) -> dict[str, str] | None:
        return self._tables[name][1] if name in self._tables else None

    def frame(self, name: str) -> DataFrame:
        """The table's visible columns, in the order of columns(name)."""
        return self._tables[name][0]

    def names(self) -> list[str]:
        return sorted(self._tables)


def parquet_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables stored as <folder>/<name>.parquet."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}
