"""A row-at-a-time reading of bound plans: the meaning that Spark's results are held against."""

from __future__ import annotations

import functools

from lodestar.errors import ExecutionError
from lodestar.plans.algebra import BoolTree, Comparison, Const, Distinct, ExistsQuery, Filter, Group, InQuery, IsNull, Join, Limit, Project, Ref, ScalarQuery, Scan, Sort, Windows, subqueries

COMPARE = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _bytes(v):
    return v.encode() if isinstance(v, str) else v


class Interpreter:
    def __init__(self, tables: dict[str, tuple[list[str], list[tuple]]]):
        self.tables = tables

    def run(self, query, env=()):
        return [tuple(row["", o.name] for o in query.outputs) for row in self.rows(query.plan, env)]

    def value(self, e, row, env):
        if isinstance(e, Const):
            return e.value
        if isinstance(e, Ref):
            return (row if e.depth == 0 else env[e.depth - 1])[e.binding, e.column]
        found = self.run(e.query, (row, *env))
        if len(found) > 1:
            raise ExecutionError(f"{e.name} returned more than one row")
        return found[0][0] if found else None

    def truth(self, p, row, env):
        if isinstance(p, BoolTree):
            a, b = self.truth(p.left, row, env), self.truth(p.right, row, env)
            if p.op == "AND":
                return False if a is False or b is False else None if a is None or b is None else True
            return True if a or b else None if a is None or b is None else False
        if isinstance(p, Comparison):
            a, b = self.value(p.left, row, env), self.value(p.right, row, env)
            return None if a is None or b is None else COMPARE[p.op](_bytes(a), _bytes(b))
        if isinstance(p, IsNull):
            return (self.value(p.value, row, env) is None) != p.negated
        if isinstance(p, ExistsQuery):
            return bool(self.run(p.query, (row, *env))) != p.negated
        assert isinstance(p, InQuery)
        v, members = self.value(p.value, row, env), [r[0] for r in self.run(p.query, (row, *env))]
        held = False if not members else None if v is None else True if v in members else None if None in members else False
        return held if not p.negated or held is None else not held

    def keep(self, predicates, row, env):
        return all([self.truth(p, row, env) is True for p in predicates])

    def eager(self, predicates):
        """Blocks that depend on nothing run once, whether or not a row asks for them."""
        for owner in (s for p in predicates for s in subqueries(p)):
            if isinstance(owner, ScalarQuery) and not owner.query.correlations:
                self.value(owner, {}, ())

    def rows(self, node, env):
        if isinstance(node, (Join, Filter)):
            self.eager(node.on if isinstance(node, Join) else node.predicates)
        if isinstance(node, Scan):
            names, rows = self.tables[node.table]
            return [{(node.binding, c): v for c, v in zip(names, r)} for r in rows]
        if isinstance(node, Join):
            left, right, out = self.rows(node.left, env), self.rows(node.right, env), []
            empty = dict.fromkeys(self.names(node.right))
            for a in left:
                found = [a | b for b in right if self.keep(node.on, a | b, env)]
                out += found or ([a | empty] if node.kind == "Left" else [])
            return out
        rows = self.rows(node.input, env)
        if isinstance(node, Filter):
            return [r for r in rows if self.keep(node.predicates, r, env)]
        if isinstance(node, Group):
            groups: dict[tuple, list] = {} if node.keys else {(): []}
            for r in rows:
                groups.setdefault(tuple(self.value(k, r, env) for k in node.keys), []).append(r)
            return [
                {(k.binding, k.column): v for k, v in zip(node.keys, key)} | {("", a.name): self.call(a.function, a.name, [None if a.argument is None else self.value(a.argument, r, env) for r in group], a.argument is None) for a in node.aggregates}
                for key, group in groups.items()
            ]
        if isinstance(node, Windows):
            rows = [dict(r) for r in rows]
            for w in node.windows:
                self.window(w, rows, env)
            return rows
        if isinstance(node, Project):
            return [r | {("", o.name): self.value(o.value, r, env) for o in node.outputs} for r in rows]
        if isinstance(node, Distinct):
            names = [k for k in (rows[0] if rows else {}) if k in self.outputs(node)]
            seen = {}
            for r in rows:
                seen.setdefault(tuple(r[k] for k in names), {k: r[k] for k in names})
            return list(seen.values())
        if isinstance(node, Sort):
            return self.sorted(rows, node.keys, env)
        assert isinstance(node, Limit)
        return rows[: node.count]

    def outputs(self, node):
        while not isinstance(node, Project):
            node = node.input
        return {("", o.name) for o in node.outputs}

    def names(self, node):
        if isinstance(node, Scan):
            return [(node.binding, c) for c in self.tables[node.table][0]]
        return [*self.names(node.left), *self.names(node.right)]

    def order(self, keys, env):
        """NULL is the largest value."""

        def compare(a, b):
            for k, down in keys:
                x, y = self.value(k, a, env), self.value(k, b, env)
                if x != y:
                    less = y is None or (x is not None and _bytes(x) < _bytes(y))
                    return -1 if less != down else 1
            return 0

        return functools.cmp_to_key(compare)

    def sorted(self, rows, keys, env):
        return sorted(rows, key=self.order(keys, env))

    def call(self, function, name, values, star):
        if function == "COUNT":
            return len(values) if star else sum(v is not None for v in values)
        values = [v for v in values if v is not None]
        if not values:
            return None
        if function != "SUM":
            return (min if function == "MIN" else max)(values, key=_bytes)
        total = 0
        for v in values:
            total += v
            if not -(2**63) <= total < 2**63:
                raise ExecutionError(f"{name} overflowed int64")
        return total

    def window(self, w, rows, env):
        groups: dict[tuple, list] = {}
        for r in rows:
            groups.setdefault(tuple(self.value(k, r, env) for k in w.partition), []).append(r)
        for group in groups.values():
            key = self.order(w.order, env)
            group = sorted(group, key=key)
            peers = [i for i in range(len(group)) if i == 0 or key(group[i - 1]) < key(group[i])] + [len(group)]
            values = [None if w.argument is None else self.value(w.argument, r, env) for r in group]
            for n, (a, b) in enumerate(zip(peers, peers[1:])):
                for i in range(a, b):
                    if w.function == "ROW_NUMBER":
                        out = i + 1
                    elif w.function == "RANK":
                        out = a + 1
                    elif w.function == "DENSE_RANK":
                        out = n + 1
                    elif w.frame == "ROWS":
                        out = self.call(w.function, w.name, values[: i + 1], w.argument is None)
                    elif w.frame == "RANGE":
                        # each peer group's arguments in rising order, so that ties never decide on an overflow
                        rising = lambda some: sorted(some, key=lambda v: (v is None, _bytes(v) if v is not None else 0))
                        frame = [v for x, y in zip(peers, peers[1 : n + 2]) for v in rising(values[x:y])] if w.function == "SUM" else values[:b]
                        out = self.call(w.function, w.name, frame, w.argument is None)
                    else:
                        out = self.call(w.function, w.name, values, w.argument is None)
                    group[i]["", w.name] = out
