"""The algebra as DataFrame operations.

Catalyst plans everything. What is done here is what Catalyst refuses or reads differently: correlated
blocks are worked out once for the distinct outer values that they depend on (``keys``), joined back by
null-safe equality; where a block is only a filtered FROM clause, it becomes a semi or anti join directly.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exact import checked_sum, halves, ordered, overflow, whole
from ..plans.algebra import (
    INT64, BoolTree, Comparison, Distinct, ExistsQuery, Filter, Group, InQuery, IsNull, Join, Limit, Node, Project, Query, Ref, ScalarQuery, Scan, Sort, Windows,
    outer_refs, refs, subqueries,
)
from .frame import Frame, all_of, fresh, same
from .running import any_order, number_of, running

_COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_MOST_ROWS = 2**31 - 1
_MAX, _MIN = 2**63 - 1, -(2**63)


@dataclass(frozen=True)
class _Place:
    """A count of the rows so far, as a window."""

    order: tuple
    function: str = "COUNT"
    frame: str = "ROWS"


class Emitter:
    """Emits one query. strict: keep the order of the tables' rows wherever it shows."""

    def __init__(self, catalog, strict: bool = False):
        self.catalog, self.strict = catalog, strict
        self.guards: list[DataFrame] = []  # strict: rows that exist only to fail, as scalar subqueries are worked out in any case

    def result(self, query: Query) -> DataFrame:
        frame = self.emit(query.plan, None)
        order = [*frame.sort, *(F.col(o).asc_nulls_first() for o in frame.ords)]
        df = frame.df
        for guard in self.guards:
            df = df.union(guard.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields)))
        df = df.orderBy(*order) if order else df
        return df.select(*(F.col(frame.outputs[o.name]).alias(o.name) for o in query.outputs))

    # --- nodes

    def emit(self, node: Node, base: Frame | None) -> Frame:
        """base: the outer values (keys) for which a subquery's plan is worked out."""
        return getattr(self, f"_{type(node).__name__.lower()}")(node, base)

    def _scan(self, node: Scan, base: Frame | None) -> Frame:
        names = {c: fresh() for c in self.catalog.columns(node.table)}
        df = self.catalog.frame(node.table).toDF(*names.values())
        ords = ()
        if self.strict:
            ords = (fresh(),)
            df = df.withColumn(ords[0], F.monotonically_increasing_id())
        cols = {(0, node.binding, c): p for c, p in names.items()}
        if base is None:
            return Frame(df, cols, ords=ords)
        outer = base.renamed()  # predicates on both turn this product into a join
        return Frame(outer.df.crossJoin(df), outer.cols | cols, outer.keys, ords)

    def _join(self, node: Join, base: Frame | None) -> Frame:
        left = self.emit(node.left, base)
        dependent = base is not None and bool(outer_refs(node.right))
        right = self.emit(node.right, base if dependent else None)
        nested = [p for p in node.on if any(subqueries(p))]
        plain = [p for p in node.on if not any(subqueries(p))]
        both = Frame(left.df, right.cols | left.cols, left.keys, (*left.ords, *right.ords))
        condition = all_of([*(self.condition(p, both) for p in plain), *(same(a, b) for a, b in zip(left.keys, right.keys))])
        if node.kind == "Inner":
            return self.filtered(both.with_df(left.df.join(right.df, condition, "inner")), nested)
        if not nested:
            return both.with_df(left.df.join(right.df, condition, "left"))
        # pairs that pass the subqueries too, then the preserved side once more, by its row number
        row, again = fresh(), fresh()
        numbered = left.df.withColumn(row, F.monotonically_increasing_id()) if not left.ords else left.df.withColumn(row, F.struct(*left.ords))
        pairs = self.filtered(both.with_df(numbered.join(right.df, condition, "inner")), nested)
        kept = [c for c in dict.fromkeys([*right.cols.values(), *right.ords]) if c in right.df.columns and c not in left.df.columns]
        found = pairs.df.select(F.col(row).alias(again), *kept)
        on = [same(row, again)]
        if left.keys and left.ords:
            copies = {k: fresh() for k in left.keys}
            found = pairs.df.select(F.col(row).alias(again), *(F.col(k).alias(c) for k, c in copies.items()), *kept)
            on += [same(k, c) for k, c in copies.items()]
        return both.with_df(numbered.join(found, all_of(on), "left"))

    def _filter(self, node: Filter, base: Frame | None) -> Frame:
        return self.filtered(self.emit(node.input, base), node.predicates)

    def _group(self, node: Group, base: Frame | None) -> Frame:
        out = self._grouped(self.emit(node.input, base), node)
        return out if base is None or node.keys else self._with_empty_groups(out, node, base)

    def _grouped(self, frame: Frame, node: Group) -> Frame:
        by = {k: fresh() for k in frame.keys}
        named = {r.key: fresh() for r in node.keys}
        calls = {a.name: fresh() for a in node.aggregates}
        first = fresh()
        outputs = []
        df = frame.df
        groups = [*(F.col(k).alias(n) for k, n in by.items()), *(F.col(frame.physical(r)).alias(named[r.key]) for r in node.keys)]
        for a in node.aggregates:
            v = None if a.argument is None else F.col(frame.physical(a.argument))
            if a.function == "COUNT":
                outputs.append(F.count(F.lit(1) if v is None else v).alias(calls[a.name]))
            elif a.function == "SUM" and frame.ords:
                df, total = self._sum_in_order(df, frame, node, a)
                outputs.append(total.alias(calls[a.name]))
            elif a.function == "SUM":
                outputs.append(checked_sum(v, a.name).alias(calls[a.name]))
            else:
                outputs.append((F.min if a.function == "MIN" else F.max)(v).alias(calls[a.name]))
        ords = ()
        if frame.ords and node.keys:
            outputs.append(F.min(F.struct(*frame.ords)).alias(first))
            ords = (first,)
        if outputs:
            df = df.groupBy(*groups).agg(*outputs) if groups else df.agg(*outputs)
        else:
            df = df.select(*groups).distinct()
        cols = {k: by.get(p, p) for k, p in frame.cols.items() if p in by} | named | {(0, "", n): c for n, c in calls.items()}
        return Frame(df, cols, tuple(by.values()), ords)

    @staticmethod
    def _with_empty_groups(out: Frame, node: Group, base: Frame) -> Frame:
        """A global aggregate has a row for each outer value, even where no row came in."""
        calls = {a.name: out.cols[0, "", a.name] for a in node.aggregates}
        outer = base.renamed()
        df = outer.df.join(out.df, all_of(same(a, b) for a, b in zip(outer.keys, out.keys)), "left")
        counts = {a.name for a in node.aggregates if a.function == "COUNT"}
        df = df.select(*outer.keys, *(F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) if n in counts else F.col(c) for n, c in calls.items()))
        return Frame(df, outer.cols | {(0, "", n): c for n, c in calls.items()}, outer.keys)

    def _sum_in_order(self, df: DataFrame, frame: Frame, node: Group, a) -> tuple[DataFrame, Column]:
        """A sum that fails where the running total leaves the 64 bits, in row order."""
        running, v = fresh(), F.col(frame.physical(a.argument)).cast("decimal(38,0)")
        parts = [F.col(c) for c in (*frame.keys, *(frame.physical(r) for r in node.keys))]
        window = Window.partitionBy(*parts).orderBy(*(F.col(o) for o in frame.ords)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumn(running, F.sum(v).over(window))
        bad = (F.max(running) > F.lit(_MAX)) | (F.min(running) < F.lit(_MIN))
        return df, F.when(bad, overflow(a.name)).otherwise(F.sum(v).cast("bigint"))

    def _windows(self, node: Windows, base: Frame | None) -> Frame:
        frame = self.emit(node.input, base)
        names = {w: fresh() for w in node.windows}
        alone: dict[str | None, list] = {}  # windows over one order of all rows, by their first order key; None: in any order
        for w in node.windows:
            if not frame.keys and self._in_one_group(w) and not self._summed_in_order(frame, w):
                first = frame.physical(w.order[0][0]) if w.order else frame.ords[0] if frame.ords else None
                alone.setdefault(first, []).append(w)
        shared, source = alone, frame.df
        for first, windows in shared.items():
            text = bool(windows[0].order) and windows[0].order[0][0].type != INT64
            key = any_order(source) if first is None else number_of(F.col(first) if windows[0].order else self._flat(frame.df, first), text)
            parts = [(w, names[w], self._order(frame, w), None if w.argument is None else F.col(frame.physical(w.argument)), [F.col(frame.physical(k)) for k, _ in w.order]) for w in windows]
            frame = frame.with_df(running(frame.df, source, parts, key))
        done = {w for windows in shared.values() for w in windows}
        whole = [w for w in node.windows if self._over_everything(frame, w)]
        if whole:  # one group: aggregates and their one row, instead of all rows in one task
            calls = (self._call(w, None if w.argument is None else F.col(frame.physical(w.argument)), None).alias(names[w]) for w in whole)
            frame = frame.with_df(frame.df.crossJoin(F.broadcast(frame.df.agg(*calls))))
            done.update(whole)
        for w in node.windows:
            if w not in done:
                frame = frame.with_df(self._window(frame, w, names[w]))
        return replace(frame, cols=frame.cols | {(0, "", w.name): name for w, name in names.items()})

    @staticmethod
    def _in_one_group(w) -> bool:
        """All rows in one order, given or not: buckets of its first key share the work."""
        ranked = w.function in ("ROW_NUMBER", "RANK", "DENSE_RANK")
        if w.partition or (w.frame == "PARTITION" and not ranked):
            return False
        return bool(w.order) or w.function == "ROW_NUMBER" or (w.frame == "ROWS" and not ranked)

    @staticmethod
    def _flat(df: DataFrame, ordinal: str) -> Column:
        """The first number of an ordinal, which may be a structure of some."""
        kind, column = df.schema[ordinal].dataType, F.col(ordinal)
        while hasattr(kind, "fields"):
            column, kind = column[kind.fields[0].name], kind.fields[0].dataType
        return column

    @staticmethod
    def _summed_in_order(frame: Frame, w) -> bool:
        """A sum of which only some totals show, while its rows' order is kept."""
        return bool(frame.ords) and w.function == "SUM" and w.frame != "ROWS"

    def _window_sum_in_order(self, frame: Frame, w, name: str, parts: list[Column], v: Column) -> DataFrame:
        """A sum that fails where a running total leaves the 64 bits: in row order, or among peers in the argument's order."""
        step, order = fresh(), [ordered(F.col(frame.physical(k)), down) for k, down in w.order]
        ranged = w.frame == "RANGE" and bool(order)
        first = [*order, v.asc_nulls_last()] if ranged else [F.col(o).asc() for o in frame.ords]
        up_to_here = (Window.unboundedPreceding, Window.currentRow)
        totals = F.sum(v.cast("decimal(38,0)")).over(Window.partitionBy(*parts).orderBy(*first).rowsBetween(*up_to_here))
        shown = Window.partitionBy(*parts).orderBy(*order).rangeBetween(*up_to_here) if ranged else Window.partitionBy(*parts)
        bad = (F.max(step).over(shown) > F.lit(_MAX)) | (F.min(step).over(shown) < F.lit(_MIN))
        out = F.when(bad, overflow(w.name)).otherwise(checked_sum(v, w.name, shown))
        return frame.df.withColumn(step, totals).withColumn(name, out).drop(step)

    def _over_everything(self, frame: Frame, w) -> bool:
        if self._summed_in_order(frame, w):
            return False
        return not frame.keys and not w.partition and w.function not in ("ROW_NUMBER", "RANK", "DENSE_RANK") and (w.frame == "PARTITION" or (w.frame == "RANGE" and not w.order))

    @staticmethod
    def _order(frame: Frame, w) -> list[Column]:
        """The order keys; where ties show, also the order of the rows, if it is kept."""
        order = [ordered(F.col(frame.physical(k)), down) for k, down in w.order]
        return order + [F.col(o).asc() for o in frame.ords] if w.function == "ROW_NUMBER" or (w.frame == "ROWS" and w.function not in ("RANK", "DENSE_RANK")) else order

    def _window(self, frame: Frame, w, name: str) -> DataFrame:
        parts = [F.col(c) for c in (*frame.keys, *map(frame.physical, w.partition))]
        by = self._order(frame, w)
        over = Window.partitionBy(*parts)
        v = None if w.argument is None else F.col(frame.physical(w.argument))
        if w.function in ("RANK", "DENSE_RANK") and not w.order:
            return frame.df.withColumn(name, F.lit(1).cast("bigint"))
        if w.function in ("ROW_NUMBER", "RANK", "DENSE_RANK"):
            call = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}[w.function]
            return frame.df.withColumn(name, call().over(over.orderBy(*(by or [F.lit(1)]))).cast("bigint"))
        if self._summed_in_order(frame, w):
            return self._window_sum_in_order(frame, w, name, parts, v)
        if w.frame == "PARTITION" or (w.frame == "RANGE" and not w.order):
            return frame.df.withColumn(name, self._call(w, v, over))
        over = over.orderBy(*(by or [F.lit(1)]))
        between = over.rowsBetween if w.frame == "ROWS" else over.rangeBetween
        return frame.df.withColumn(name, self._call(w, v, between(Window.unboundedPreceding, Window.currentRow)))

    def _call(self, w, v: Column | None, over) -> Column:
        if w.function == "SUM":
            return checked_sum(v, w.name, over)
        call = F.count(F.lit(1) if v is None else v) if w.function == "COUNT" else (F.min if w.function == "MIN" else F.max)(v)
        return call if over is None else call.over(over)

    def _project(self, node: Project, base: Frame | None) -> Frame:
        frame = self.emit(node.input, base)
        outputs = {o.name: fresh() for o in node.outputs}
        df = frame.df.select("*", *(frame.value(o.value).alias(outputs[o.name]) for o in node.outputs))
        return replace(frame, df=df, outputs=outputs)

    def _distinct(self, node: Distinct, base: Frame | None) -> Frame:
        frame = self.emit(node.input, base)
        kept = [*frame.keys, *frame.outputs.values()]
        cols = {k: p for k, p in frame.cols.items() if p in frame.keys}
        if not frame.ords:
            return replace(frame, df=frame.df.select(*kept).distinct(), cols=cols)
        first = fresh()
        return replace(frame, df=frame.df.groupBy(*kept).agg(F.min(F.struct(*frame.ords)).alias(first)), cols=cols, ords=(first,))

    def _sort(self, node: Sort, base: Frame | None) -> Frame:
        frame = self.emit(node.input, base)
        return replace(frame, sort=tuple(ordered(F.col(frame.physical(k)), down) for k, down in node.keys))

    def _limit(self, node: Limit, base: Frame | None) -> Frame:
        frame = self.emit(node.input, base)
        order = [*frame.sort, *(F.col(o).asc() for o in frame.ords)]
        nth = fresh()
        if frame.keys:
            over = Window.partitionBy(*frame.keys).orderBy(*(order or [F.lit(1)])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            place = F.row_number().over(over) if node.count <= _MOST_ROWS else F.count(F.lit(1)).over(over)  # row_number is an int
            return frame.with_df(frame.df.withColumn(nth, place).where(F.col(nth) <= node.count).drop(nth))
        if node.count <= _MOST_ROWS:
            return frame.with_df((frame.df.orderBy(*order) if order else frame.df).limit(node.count))
        return frame.with_df(self._numbered(frame, node, order, nth).where(F.col(nth) <= node.count).drop(nth))

    def _numbered(self, frame: Frame, node: Limit, order: list[Column], name: str) -> DataFrame:
        """Rows with their place as a bigint, for limits beyond what Spark's own takes."""
        keys = node.input.keys if isinstance(node.input, Sort) else ()
        if keys:
            first, down = frame.physical(keys[0][0]), keys[0][1]
            key = number_of(F.col(first), keys[0][0].type != INT64)
        else:
            down, key = False, self._flat(frame.df, frame.ords[0]) if frame.ords else any_order(frame.df)
        return running(frame.df, frame.df, [(_Place(((None, down),)), name, order, None, [])], key)

    # --- predicates

    def condition(self, p, frame: Frame) -> Column:
        """A predicate without subqueries."""
        if isinstance(p, BoolTree):
            left, right = self.condition(p.left, frame), self.condition(p.right, frame)
            return left & right if p.op == "AND" else left | right
        if isinstance(p, IsNull):
            v = frame.value(p.value)
            return v.isNotNull() if p.negated else v.isNull()
        return _COMPARE[p.op](frame.value(p.left), frame.value(p.right))

    def filtered(self, frame: Frame, predicates) -> Frame:
        plain = [self.condition(p, frame) for p in predicates if not any(subqueries(p))]
        if plain:
            frame = frame.with_df(frame.df.where(all_of(plain)))
        for p in predicates:
            if any(subqueries(p)):
                frame = self._kept(p, frame)
        return frame

    def _kept(self, p, frame: Frame) -> Frame:
        """The rows for which a conjunct with subqueries is true."""
        columns = frame.df.columns
        if isinstance(p, BoolTree) and p.op == "AND":
            return self._kept_one(p.right, self._kept_one(p.left, frame))
        if isinstance(p, ExistsQuery) or (isinstance(p, InQuery) and not isinstance(p.value, ScalarQuery)):
            return self._semi(p, frame)
        marked, condition = self._marked(p, frame)
        return frame.with_df(marked.df.where(condition).select(*columns))

    def _kept_one(self, p, frame: Frame) -> Frame:
        return self._kept(p, frame) if any(subqueries(p)) else frame.with_df(frame.df.where(self.condition(p, frame)))

    def _marked(self, p, frame: Frame) -> tuple[Frame, Column]:
        """The frame with what a predicate's subqueries give, and the predicate over it."""
        if isinstance(p, BoolTree):
            frame, left = self._marked(p.left, frame)
            frame, right = self._marked(p.right, frame)
            return frame, left & right if p.op == "AND" else left | right
        if isinstance(p, Comparison):
            frame, left = self._operand(p.left, frame)
            frame, right = self._operand(p.right, frame)
            return frame, _COMPARE[p.op](left, right)
        if isinstance(p, IsNull):
            frame, v = self._operand(p.value, frame)
            return frame, v.isNotNull() if p.negated else v.isNull()
        return self._mark(p, frame)

    def _operand(self, e, frame: Frame) -> tuple[Frame, Column]:
        if not isinstance(e, ScalarQuery):
            return frame, frame.value(e)
        looked_up = self._lookup(e.query, frame)
        if looked_up is not None:
            return looked_up
        sub = self._worked_out(e.query, frame)
        name, n, v = fresh(), fresh(), fresh()
        output = sub.outputs[e.query.outputs[0].name]
        message = f"{e.name} returned more than one row"
        failed = F.raise_error(F.lit(message)).cast("bigint" if e.type == "int64" else "string")
        # one value is its own maximum
        found = [F.count(F.lit(1)).alias(n), F.max(output).alias(v)]
        if not sub.keys:
            one = sub.df.limit(2).agg(*found).select(F.when(F.col(n) > 1, failed).otherwise(F.col(v)).alias(name))
            if self.strict:
                # Catalyst drops a subquery below a constant condition; this keeps its error
                self.guards.append(sub.df.limit(2).agg(F.count(F.lit(1)).alias(n)).where(F.when(F.col(n) > 1, failed).isNotNull()))
            return frame.with_df(frame.df.withColumn(name, one.scalar())), F.col(name)
        by = sub.df.groupBy(*sub.keys).agg(*found)
        joined = frame.df.join(by, self._matching(e.query, frame, sub), "left").drop(*sub.keys)
        return frame.with_df(joined), F.when(F.col(n) > 1, failed).otherwise(F.col(v))

    def _lookup(self, query: Query, frame: Frame) -> tuple[Frame, Column] | None:
        """One aggregate over rows whose columns equal outer ones: grouped by those columns once, and looked up."""
        project = query.plan
        if not query.correlations or not isinstance(project, Project) or not isinstance(project.input, Group) or project.input.keys:
            return None
        group, output = project.input, project.outputs[0].value
        call = next((a for a in group.aggregates if isinstance(output, Ref) and output.key == (0, "", a.name)), None)
        node, predicates = group.input, []
        while isinstance(node, Filter):
            predicates += node.predicates
            node = node.input
        if call is None or outer_refs(node) or (call.argument is not None and call.argument.depth):
            return None
        dependent = [p for p in predicates if any(r.depth for r in refs(p))]
        pairs = []
        for p in dependent:
            sides = (p.left, p.right) if isinstance(p, Comparison) and p.op == "=" else ()
            inner = [x for x in sides if isinstance(x, Ref) and not x.depth]
            outer = [x for x in sides if isinstance(x, Ref) and x.depth]
            if len(inner) != 1 or len(outer) != 1:
                return None
            pairs.append((inner[0], outer[0]))
        if call.function == "SUM" and frame.ords:
            return None  # sums in row order are checked for the outer rows that ask for them only
        rows = self.filtered(self.emit(node, None), [p for p in predicates if p not in dependent])
        keys = [fresh() for _ in pairs]
        v = None if call.argument is None else F.col(rows.physical(call.argument))
        parts = [fresh() for _ in range(2 if call.function == "SUM" else 1)]
        held = {"SUM": lambda: [F.sum(x) for x in halves(v)], "COUNT": lambda: [F.count(F.lit(1) if v is None else v)], "MIN": lambda: [F.min(v)], "MAX": lambda: [F.max(v)]}
        named = [F.col(rows.physical(r)).alias(k) for (r, _), k in zip(pairs, keys)]
        found = rows.df.groupBy(*named).agg(*(x.alias(p) for x, p in zip(held[call.function](), parts)))
        on = all_of(F.col(frame.physical(_inward(r))) == F.col(k) for k, (_, r) in zip(keys, pairs))
        joined = frame.df.join(found, on, "left").drop(*keys)
        if call.function == "SUM":
            out = whole(F.col(parts[0]), F.col(parts[1]), call.name)
        else:
            out = F.coalesce(F.col(parts[0]), F.lit(0).cast("bigint")) if call.function == "COUNT" else F.col(parts[0])
        return frame.with_df(joined), out

    # --- subqueries

    def _worked_out(self, query: Query, frame: Frame) -> Frame:
        """A subquery's rows, for each distinct outer value that it depends on."""
        if not query.correlations:
            return self.emit(query.plan, None)
        names = {r: fresh() for r in query.correlations}
        outer = frame.df.select(*(F.col(frame.physical(_inward(r))).alias(n) for r, n in names.items())).distinct()
        base = Frame(outer, {r.key: n for r, n in names.items()}, tuple(names.values()))
        return self.emit(query.plan, base)

    def _matching(self, query: Query, frame: Frame, sub: Frame) -> Column:
        return all_of(same(frame.physical(_inward(r)), k) for r, k in zip(query.correlations, sub.keys))

    def _semi(self, p, frame: Frame) -> Frame:
        """EXISTS, IN and their negations as a whole conjunct: rows stay or go, none is added."""
        direct = self._direct(p, frame)
        if direct is not None:
            return direct
        sub = self._worked_out(p.query, frame)
        on = self._matching(p.query, frame, sub)
        if isinstance(p, ExistsQuery):
            found = sub.df.select(*sub.keys).distinct() if sub.keys else sub.df.select(F.lit(1).alias(fresh())).limit(1)
            return frame.with_df(frame.df.join(found, on, "left_anti" if p.negated else "left_semi"))
        value, output = frame.value(p.value), sub.outputs[p.query.outputs[0].name]
        members = sub.df.select(*sub.keys, output)
        if not p.negated:
            return frame.with_df(frame.df.join(members, on & (value == F.col(output)), "left_semi"))
        columns = frame.df.columns
        frame, unknown = self._unknown(p, frame, sub, value)
        rest = frame.df.where(~unknown).select(*columns)
        return frame.with_df(rest.join(members.where(F.col(output).isNotNull()), on & (value == F.col(output)), "left_anti"))

    def _unknown(self, p: InQuery, frame: Frame, sub: Frame, value: Column) -> tuple[Frame, Column]:
        """Whether a membership can't be denied: it has a NULL on one side, and the set isn't empty."""
        n, known = fresh(), fresh()
        output = sub.outputs[p.query.outputs[0].name]
        sizes = [F.count(F.lit(1)).alias(n), F.count(output).alias(known)]
        if sub.keys:
            again = {k: fresh() for k in sub.keys}
            by = sub.df.groupBy(*(F.col(k).alias(a) for k, a in again.items())).agg(*sizes)
            on = all_of(same(frame.physical(_inward(r)), a) for r, a in zip(p.query.correlations, again.values()))
            df = frame.df.join(by, on, "left").drop(*again.values())
        else:
            df = frame.df.crossJoin(F.broadcast(sub.df.agg(*sizes)))  # one row
        return frame.with_df(df), (F.coalesce(F.col(n), F.lit(0)) > 0) & (value.isNull() | (F.col(known) < F.col(n)))

    def _mark(self, p, frame: Frame) -> tuple[Frame, Column]:
        """A column that says whether EXISTS, IN or their negation is true."""
        sub = self._worked_out(p.query, frame)
        flag = fresh()
        if isinstance(p, ExistsQuery):
            if sub.keys:
                found = sub.df.select(*sub.keys).distinct().withColumn(flag, F.lit(True))
                df = frame.df.join(found, self._matching(p.query, frame, sub), "left").drop(*sub.keys)
            else:
                df = frame.df.crossJoin(F.broadcast(sub.df.limit(1).agg((F.count(F.lit(1)) > 0).alias(flag))))
            held = F.coalesce(F.col(flag), F.lit(False))
            return frame.with_df(df), ~held if p.negated else held
        frame, value = self._operand(p.value, frame)
        output = sub.outputs[p.query.outputs[0].name]
        members = sub.df.select(*sub.keys, output).where(F.col(output).isNotNull()).distinct().withColumn(flag, F.lit(True))
        df = frame.df.join(members, self._matching(p.query, frame, sub) & (value == F.col(output)), "left").drop(*sub.keys, output)
        held = F.coalesce(F.col(flag), F.lit(False))
        frame = frame.with_df(df)
        if not p.negated:
            return frame, held
        frame, unknown = self._unknown(p, frame, sub, value)
        return frame, ~held & ~unknown

    def _direct(self, p, frame: Frame) -> Frame | None:
        """A correlated block that is a filtered FROM clause: one semi or anti join, without working out outer values."""
        if not p.query.correlations:
            return None
        node = p.query.plan
        while isinstance(node, (Distinct, Sort)):
            node = node.input
        if not isinstance(node, Project):
            return None
        output, node, predicates = node.outputs[0].value, node.input, []
        while isinstance(node, Filter):
            predicates += node.predicates
            node = node.input
        if not isinstance(node, (Scan, Join)) or outer_refs(node):
            return None
        dependent = [x for x in predicates if any(r.depth for r in refs(x))]
        if any(any(subqueries(x)) for x in dependent):
            return None
        inner = self.filtered(self.emit(node, None), [x for x in predicates if x not in dependent])
        around = {(d + 1, b, c): name for (d, b, c), name in frame.cols.items()}
        both = Frame(frame.df, around | inner.cols)
        on = [self.condition(x, both) for x in dependent]
        if isinstance(p, ExistsQuery):
            return frame.with_df(frame.df.join(inner.df, all_of(on), "left_anti" if p.negated else "left_semi"))
        value, member = frame.value(p.value), both.value(output)
        alike = value == member
        on.append(alike if not p.negated else alike | value.isNull() | member.isNull())
        return frame.with_df(frame.df.join(inner.df, all_of(on), "left_anti" if p.negated else "left_semi"))


def _inward(r: Ref) -> Ref:
    """A subquery's outer column, as the block around it names it."""
    return Ref(r.binding, r.column, r.type, r.depth - 1)
