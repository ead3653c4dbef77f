"""Small tables of a harbour: missing values, repeated rows, extreme integers, awkward strings. Row order matters."""

BIG = 2**63 - 1

TABLES = {
    # people and whom they answer to; pay may be open
    "crew": ("id bigint, boss bigint, pay bigint", [(11, None, 900), (12, 11, 450), (13, 11, 450), (14, 12, None), (15, 99, 120), (16, 13, 450)]),
    # either side may be missing, and both
    "gap": ("x bigint, y bigint", [(5, None), (None, 3), (7, 3), (None, None), (5, 8), (12, 5)]),
    # levels read at sites; site and level may be missing
    "reading": ("site bigint, unit bigint, level bigint", [(3, 1, -4), (None, 1, 6), (3, 2, None), (3, 1, None), (8, 2, 15), (None, 2, 6), (8, 2, 15), (8, 1, None), (None, 1, None)]),
    "dock": ("code bigint, meters bigint", [(None, 71), (21, 72), (22, 73), (None, 74), (21, 75), (24, 72)]),
    "ship": ("code bigint, tons bigint", [(21, 500), (None, 501), (23, 502), (21, 503), (24, None)]),
    "stamp": ("p bigint, q bigint", [(4, 1), (4, 1), (6, 2), (4, 3), (6, 2), (6, None), (6, None)]),
    "shift": ("id bigint, hours bigint", [(12, 8), (13, 4), (13, 6), (14, 8), (None, 2)]),
    "task": ("id bigint, job bigint", [(13, 300), (13, 310), (14, 320), (17, 310)]),
    "job": ("job bigint, weight bigint", [(300, 5), (310, 6), (310, 7), (999, 8)]),
    "nobody": ("id bigint, pay bigint", []),
    # totals that leave the 64 bits: at the end, on the way only, in one group of peers, downwards
    "flood": ("m bigint", [(BIG - 2,), (5,)]),
    "tide": ("m bigint", [(BIG,), (9,), (-40,)]),
    "swell": ("g bigint, m bigint", [(1, BIG - 3), (2, 5), (2, -9), (3, 2)]),
    "ebb": ("g bigint, m bigint", [(1, -BIG), (2, 6), (2, -8)]),
    "word": ("s string", [("mu",), ("",), ("it's",), (None,), ("Mu",), ("mú",), ("muon and more",), ("muon and most",)]),
    "flag": ("s string, n bigint", [("mu", 1), ("xi", 2), (None, 3), ("mu", 4), ("", 5)]),
    "sail": ("s string, n bigint", [(None, 10), ("", 11), ("mu", 12), ("rho", 13)]),
}


def columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def fill(engine, spark, tables=None):
    for name, (schema, rows) in (TABLES if tables is None else tables).items():
        engine.register(name, spark.createDataFrame(rows, schema).coalesce(1))
    return engine


class Schemas:
    """A catalog without data, for the binder alone."""

    def __init__(self, tables):
        self.tables = tables

    def columns(self, name):
        if name not in self.tables:
            return None
        return {c.split()[0]: "string" if c.endswith("string") else "int64" for c in self.tables[name][0].split(", ")}
