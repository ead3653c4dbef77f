"""Near-duplicate join on word shingles: MinHash LSH forest with exact verification.

Each text has a label in each of TREES trees: DEPTH MinHash values, in order. Sorted labels are the tree's prefix
trie: texts whose labels share a prefix lie side by side. The join climbs the tries from the leaves: texts whose
whole labels match meet first, then the matched prefix is shortened by one value at a time. Two texts meet once, in
the first tree in which they share the longest prefix that they share in any tree.

How far a text climbs follows from what it has found. A pair of similarity s has met by prefix length l with
p(s, l) = 1 - (1 - s**l)**TREES. After each step, a text adds up what it should still miss: (1 - p) / p for each link
found, at the link's estimated similarity, and 1 - p at the threshold for a link that it may not have seen at all. It
stops once that is at most 1 - target of its links (or of one link): texts amid many close copies stop on long
prefixes, texts alone climb until a pair at the threshold is found with the target probability. A stopped text still
meets those that climb on.

Texts that meet and whose signatures agree enough are candidates. Candidates never become rows: buckets are dealt to
cells of bounded blocks, and a cell names the texts of which it has candidates. Only these texts are sent there, and
their candidate pairs are verified exactly, on the sets of shingles. What comes back is, for each text, how many
documents it is linked to, and a spanning forest of the links. Copies (the same words in the same order) are one text
with a weight. Rows are told apart by their place in the input, never by their id.

Defined results: a text without words (null and empty ones too) has a class of its own and no links; texts
of fewer words than a shingle has are one shingle; a null id sorts after all others, and a class without an id has a
null class_id; rows that repeat an id and text are copies of each other; ``kept`` marks one row of each class, that
with the smallest id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, long_id, materialize, row_keys, ship, slices, table
from .text_features import shingles_of, word_hashes_of

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, TARGET = 20, 7, 0.9995
BLOCK = 512  # texts of one side of a comparison
LOSS = 1 / 1000  # share of the misses that the target allows which the comparison of signatures may add
_CHUNK = 1 << 15
_PAIRS = 1 << 14  # pairs whose signatures are compared at a time


def met_by(similarity: float | np.ndarray, length: int) -> float | np.ndarray:
    """The probability that a pair shares a prefix of this length in one of the trees."""
    return 1 - (1 - similarity**length) ** TREES


def shortest_prefix(threshold: float = THRESHOLD, target: float = TARGET) -> int:
    """Where every text stops: the longest prefix with which a pair at the threshold is found with the target probability."""
    return next((n for n in range(DEPTH, 1, -1) if met_by(threshold, n) >= target), 1)


def least_equal(threshold: float = THRESHOLD, target: float = TARGET, values: int = TREES * DEPTH) -> int:
    """The most equal signature values to ask for: a pair at the threshold has fewer with probability LOSS * (1 - target) at most."""
    below, k = 0.0, 0
    while k < values and (below := below + math.comb(values, k) * threshold**k * (1 - threshold) ** (values - k)) <= LOSS * (1 - target):
        k += 1
    return k


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of TREES * DEPTH minima for each (non-empty) set."""
    out = np.empty((len(sets), TREES * DEPTH), dtype=np.uint32)
    factor, shift = _factors()
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= _CHUNK):
            size += len(sets[hi])
            hi += 1
        h = np.concatenate(sets[lo:hi])
        h = ((h ^ (h >> np.uint64(33))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[lo : hi - 1])])
        for k in range(TREES * DEPTH):
            v = h * factor[k]
            v += shift[k]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            out[lo:hi, k] = np.minimum.reduceat(v, starts)
        lo = hi
    return out


def _sign_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, row key, id) to row key, id, digest of the words, number of shingles, and the labels of all trees, two bytes a value."""
    for b in batches:
        texts = b.column(0).to_pylist()
        for lo, hi in slices(texts, 1 << 21):
            words = word_hashes_of(texts[lo:hi])
            some = [i for i, w in enumerate(words) if len(w)]
            sets = shingles_of([words[i] for i in some], WORDS)
            labels = ((signatures(sets) * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype("<u2")
            digest, size, mark = [None] * (hi - lo), [0] * (hi - lo), [None] * (hi - lo)
            for k, i in enumerate(some):
                digest[i] = hashlib.blake2b(words[i].tobytes(), digest_size=16).digest()
                size[i], mark[i] = len(sets[k]), labels[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(1).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(mark, pa.binary())],
                names=["row_key", "id", "digest", "size", "mark"],
            )


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places, the smallest one that the links i to j connect it to."""
    up = np.arange(n)
    while True:
        a, b = up[i], up[j]
        apart = a != b
        if not apart.any():
            return up
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with the same values in the named columns, of sorted batches; many whole runs at once are not split."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(n).to_pylist() for n in names]
        edges = [i for i in range(1, b.num_rows) if any(k[i] != k[i - 1] for k in keys)]
        if held:
            last = tuple(held[-1].column(n)[-1].as_py() for n in names)
            if last != tuple(k[0] for k in keys):
                edges.insert(0, 0)
        start = 0
        for e in edges:
            if e > start:
                held.append(b.slice(start, e - start))
            if held:
                yield pa.Table.from_batches(held)
            held, start = [], e
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


class Cell:
    """Texts of one or two blocks of a bucket, and which pairs of them are candidates there."""

    def __init__(self, t: pa.Table, length: int, threshold: float, least: int):
        self.tree, self.length, self.threshold, self.least = t.column("tree")[0].as_py(), length, threshold, least
        self.sizes, self.active = t.column("size").to_numpy(), t.column("active").to_numpy(zero_copy_only=False)
        self.marks = np.frombuffer(b"".join(t.column("mark").to_pylist()), "<u2").reshape(t.num_rows, TREES, DEPTH)
        self.same = t.column("one")[0].as_py() == t.column("two")[0].as_py()
        side = t.column("side").to_numpy()
        self.one = np.arange(t.num_rows) if self.same else np.flatnonzero(side == 0)
        self.two = self.one if self.same else np.flatnonzero(side == 1)

    def candidates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that meet here and nowhere else: a text of the first block, one of the second, how many of their values are equal."""
        one, two = self.one, self.two
        large, small = self.sizes[one][:, None], self.sizes[two][None, :]
        fit = (small >= self.threshold * large) & (large >= self.threshold * small) & (self.active[one][:, None] | self.active[two][None, :])
        if self.same:
            fit &= np.tri(len(one), dtype=bool).T
            np.fill_diagonal(fit, False)
        # no pair that shares as long a prefix in an earlier tree, or a longer one in any tree
        for length, trees in ((self.length, self.tree), (self.length + 1, TREES if self.length < DEPTH else 0)):
            prefix = self._prefixes(length)
            for tree in range(trees):
                if not fit.any():
                    break
                a, b = prefix[one, tree], prefix[two, tree]
                fit &= (a[:, None, 0] != b[None, :, 0]) | (a[:, None, 1] != b[None, :, 1])
        i, j = np.nonzero(fit)
        i, j = one[i], two[j]
        flat = self.marks.reshape(len(self.marks), TREES * DEPTH)
        equal = np.concatenate([np.zeros(0, np.int64), *((flat[i[at : at + _PAIRS]] == flat[j[at : at + _PAIRS]]).sum(axis=1) for at in range(0, len(i), _PAIRS))])
        enough = equal >= self.least
        return i[enough], j[enough], equal[enough]

    def _prefixes(self, length: int) -> np.ndarray:
        """For each text and tree, a prefix as two numbers of four values each."""
        padded = np.zeros((len(self.marks), TREES, 8), "<u2")
        n = min(length, DEPTH)
        padded[:, :, :n] = self.marks[:, :, :n]
        return padded.view("<u8")


def _meet_task(length: int, threshold: float, least: int):
    """Cells, sorted, to the texts that have candidates there: how many likely links, and how many more each prefix length should miss."""

    share = np.arange(TREES * DEPTH + 1) / (TREES * DEPTH)
    p = np.stack([met_by(share, n) for n in range(1, DEPTH + 1)], axis=1)
    more = (1 - p) / np.maximum(p, 1e-300)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["prefix", "tree", "one", "two", "side", "digest", "active"]
        for t in _groups(batches, ("prefix", "tree", "one", "two")):
            if t.num_rows < 2:
                continue
            i, j, equal = Cell(t, length, threshold, least).candidates()
            if not len(i):
                continue
            needed = np.zeros(t.num_rows, bool)
            needed[i] = needed[j] = True
            link = share[equal] >= threshold
            ends, equal = np.concatenate([i[link], j[link]]), np.tile(equal[link], 2)
            found = np.bincount(ends, minlength=t.num_rows)
            missing = np.stack([np.bincount(ends, more[equal, n], t.num_rows) for n in range(DEPTH)], axis=1)
            kept = t.select(names).take(pa.array(np.flatnonzero(needed)))
            kept = kept.append_column("found", pa.array(found[needed])).append_column("missing", pa.array(missing[needed].tolist(), pa.list_(pa.float64())))
            yield from kept.combine_chunks().to_batches()

    return meet


def _common(one: list[np.ndarray], two: list[np.ndarray], same: bool) -> np.ndarray:
    """Numbers of common shingles, by matrix products over the shingles that several texts hold."""
    sets = one if same else [*one, *two]
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    held = np.bincount(column)
    keep = held[column] > 1
    row, column = row[keep], column[keep]
    total = np.zeros((len(one), len(one) if same else len(two)), dtype=np.float64)
    if not len(column):
        return total
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    for lo in range(0, int(column[-1]) + 1, 8192):
        a, b = np.searchsorted(column, [lo, lo + 8192])
        dense = np.zeros((len(sets), 8192), dtype=np.float32)
        dense[row[a:b], column[a:b] - lo] = 1
        total += dense @ dense.T if same else dense[: len(one)] @ dense[len(one) :].T
    return total


def _links(cell: Cell, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The candidates that are links: by matrix products where candidates are many, pair by pair where they are few."""
    i, j, _ = cell.candidates()
    sizes = np.array([len(x) for x in sets])
    if len(i) > 4 * len(sets):
        place = np.zeros(len(sets), int)
        place[cell.one] = np.arange(len(cell.one))
        if not cell.same:
            place[cell.two] = np.arange(len(cell.two))
        shared = _common([sets[k] for k in cell.one], [sets[k] for k in cell.two], cell.same)[place[i], place[j]]
    else:
        shared = np.array([_both(sets[a], sets[b]) for a, b in zip(i.tolist(), j.tolist())], dtype=np.float64)
    link = shared >= cell.threshold * (sizes[i] + sizes[j] - shared) - 1e-9
    return i[link], j[link]


def _both(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets have in common."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b))


def _verify_task(threshold: float, least: int):
    """Cells with their texts, sorted, to the links of each text and a forest of them."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ("prefix", "tree", "one", "two")):
            cell = Cell(t, len(t.column("prefix")[0].as_py()) // 2, threshold, least)
            sets = shingles_of(word_hashes_of(t.column("text").to_pylist()), WORDS)
            copies, names = t.column("copies").to_numpy(), t.column("digest").to_pylist()
            i, j = _links(cell, sets)
            if not len(i):
                continue
            links = np.zeros(t.num_rows, np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            some, root = np.flatnonzero(links), roots(t.num_rows, i, j)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in some], pa.binary()), pa.array([names[root[k]] for k in some], pa.binary()), pa.array(links[some])], names=["digest", "root", "links"]
            )

    return verify


def in_cells(df: DataFrame, key: list[str], count: Column, block: int) -> DataFrame:
    """Rows of a key dealt to the cells (one, two) of its blocks, so that every two rows of a key meet in exactly one cell."""
    blocks = F.ceil(count / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("digest"), blocks).cast("int")
    dealt = df.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("one"), 0).otherwise(1)
    return together(dealt.withColumn("side", side).drop("blocks", "own", "other"), key)


def together(cells: DataFrame, key: list[str]) -> DataFrame:
    """The rows of a cell side by side, in all shuffle partitions: the work of cells is far more than their bytes tell."""
    return cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key, "one", "two").sortWithinPartitions(*key, "one", "two", "side", "digest")


def connected(edges: DataFrame, name: str, rows: int, a: str = "a", b: str = "b") -> DataFrame:
    """(node, part): the smallest node that edges connect a node to. Smallest labels spread over edges and along themselves.

    rows: about how many nodes there may be.
    """
    both = materialize(edges.select(a, b).unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b))).distinct(), f"{name}-edges", rows)
    labels = materialize(both.groupBy(F.col(a).alias("node")).agg(F.min(b).alias("m")).select("node", F.least("node", "m").alias("part")), f"{name}-labels", rows)
    while True:
        near = both.join(labels.select(F.col("node").alias(b), "part"), b).groupBy(F.col(a).alias("node")).agg(F.min("part").alias("m"))
        spread = labels.join(near, "node").select("node", F.col("part").alias("was"), F.least("part", "m").alias("part"))
        up = labels.select(F.col("node").alias("part"), F.col("part").alias("upper"))
        new = materialize(spread.join(up, "part", "left").select("node", "was", F.least("part", F.coalesce("upper", "part")).alias("part")), f"{name}-labels", rows)
        done = new.where("part <> was").limit(1).count() == 0
        discard(labels)
        labels = new
        if done:
            discard(both)
            return labels.drop("was")


def climb(texts: DataFrame, threshold: float = THRESHOLD, target: float = TARGET, rows: int | None = None) -> DataFrame:
    """texts (digest, size, mark) to the cells in which they have candidates: prefix, tree, one, two, side, digest, active, found, missing."""
    least, floor = least_equal(threshold, target), shortest_prefix(threshold, target)
    prefix = lambda n: F.expr(f"substring(mark, {2 * DEPTH} * tree + 1, {2 * n})")
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    # a text that is alone on its shortest prefixes never meets another one
    entries = texts.select("digest", "mark", trees.alias("tree")).select("digest", "tree", prefix(floor).alias("prefix"))
    several = entries.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = materialize(entries.join(several, ["tree", "prefix"]).select("digest", "tree").join(texts.select("digest", "size", "mark"), "digest"), "members")
    still, met = members.withColumn("active", F.lit(True)), []
    for length in range(DEPTH, floor - 1, -1):
        placed = still.withColumn("prefix", prefix(length))
        sizes = placed.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n"), F.max("active").alias("any")).where("n > 1 and any").drop("any")
        cells = in_cells(placed.join(sizes, ["tree", "prefix"]), ["tree", "prefix"], F.col("n"), BLOCK).select("prefix", "tree", "one", "two", "side", "digest", "size", "mark", "active")
        schema = "prefix binary, tree int, one int, two int, side int, digest binary, active boolean, found long, missing array<double>"
        met.append(materialize(cells.mapInArrow(_meet_task(length, threshold, least), schema), f"met-{length}", rows))
        if length > floor:
            told = reduce(DataFrame.unionByName, met).groupBy("digest").agg(F.sum("found").alias("found"), F.sum(F.col("missing")[length - 1]).alias("missing"))
            stopped = told.where(F.col("missing") + (1 - met_by(threshold, length)) <= (1 - target) * F.greatest(F.col("found"), F.lit(1))).select("digest", F.lit(True).alias("stopped"))
            still = members.join(stopped, "digest", "left").withColumn("active", F.col("stopped").isNull()).drop("stopped")
    return reduce(DataFrame.unionByName, met)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", target: float = TARGET, row_key: str | None = None) -> DataFrame:
    """One row per input row: id, class_id (smallest id of its connected near duplicates), copy_id (smallest id of its copies), n_links, kept.

    row_key: a column that names each row, the same on every reading; it is then a column of the result too.
    """
    ship(docs.sparkSession)
    named = row_keys(docs) if row_key is None else docs.withColumn("row_key", F.col(row_key))
    rows = named.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), "row_key", long_id(id_col).alias("id"))
    key_type = rows.schema["row_key"].dataType.simpleString()
    signed = materialize(rows.mapInArrow(_sign_task, f"row_key {key_type}, id long, digest binary, size int, mark binary"), "signed")
    n_rows = signed.count()
    worded = signed.where(F.col("digest").isNotNull())
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row_key")).alias("first")  # ids in order, then rows without one
    copies = materialize(worded.groupBy("digest").agg(first, F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("mark").alias("mark")), "texts", n_rows)

    met = climb(copies.select("digest", "size", "mark"), threshold, target, n_rows).drop("found", "missing")
    asked = met.join(copies.select("digest", "size", "mark", "copies", F.col("first.row_key").alias("row_key")), "digest")
    cells = together(asked.join(rows.select("row_key", "text"), "row_key").drop("row_key"), ["prefix", "tree"])
    links = materialize(cells.mapInArrow(_verify_task(threshold, least_equal(threshold, target)), "digest binary, root binary, links long"), "links", n_rows)
    classes = connected(links.where("digest <> root"), "classes", n_rows, "digest", "root")

    counted = links.groupBy("digest").agg(F.sum("links").alias("links"))
    nodes = copies.select("digest", "first", "copies").join(counted, "digest", "left").join(classes.withColumnRenamed("node", "digest"), "digest", "left").withColumn("part", F.coalesce("part", "digest"))
    heads = nodes.groupBy("part").agg(F.min("first").alias("head"))
    links_of = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long")
    known = nodes.join(heads, "part").select("digest", F.col("head.id").alias("class_id"), F.col("head.row_key").alias("head"), F.col("first.id").alias("copy_id"), links_of.alias("n_links"))
    out = worded.select("id", "row_key", "digest").join(known, "digest").withColumn("kept", F.col("row_key") == F.col("head")).drop("digest", "head").unionByName(
        signed.where(F.col("digest").isNull()).select("id", "row_key", F.col("id").alias("class_id"), F.col("id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    )
    named_key = [] if row_key is None else [F.col("row_key").alias(row_key)]
    return out.select(F.col("id").alias(id_col), "class_id", "copy_id", "n_links", "kept", *named_key)


def op5_near_join(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_id", "n_links")
