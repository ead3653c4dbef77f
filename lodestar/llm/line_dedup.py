"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

State of an index, all written tables in the shared folder:

* ``refs``: (digest, doc_id), which document holds which line key, once per row and key;
* ``generations`` of counts: (shard, digest, n, owner), exact reference counts and the smallest holder; the newest
  row of a key holds, 0 says that it is gone;
* ``filters``: (shard, blob, keys, room), one cuckoo filter per shard over the keys that are counted there.

Inserting documents asks the filters first. A key that its filter doesn't know is new and written as it is; only keys
that a filter may know are looked up in the exact tables, and if there are none, those are not read at all. Deleting
documents takes their references away, and writes the new counts and owners of the keys that they held; keys without a
reference leave their filter. So any sequence of insertions and deletions gives what a fresh build of the remaining
documents would give. Where a filter is full, the index is rebuilt with shards and filters for twice its keys; many
generations are folded into one.

Defined results: a null or empty text is one empty line; a null doc_id is one more document that sorts
after every other; rows that repeat a doc_id count as one document; inserting a doc_id that the index holds already is
an error; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, long_id, materialize, row_keys, ship, table

MIN_POINTS = 10  # shorter keys are never dropped
SHARD_KEYS = 200_000  # keys a shard is planned for
COMBINE_KEYS = 200_000  # keys that a map task counts before it sends them on
GENERATIONS = 8  # tables of counts, and of references, before they are folded
LEAST_ROOM = 64  # keys that a filter has room for at least

PART_SCHEMA = "shard int, digest binary, n long, owner long"
FILTER_SCHEMA = "shard int, blob binary, keys long, room long"


def line_key(line: str) -> str:
    """The line stripped of ASCII white space with A-Z lower-cased."""
    key = line.strip(ASCII_SPACE)
    return key.lower() if key.isascii() else key.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def key_digest(key: str) -> bytes:
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; partial-key cuckoo hashing, deletions allowed."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * self.SLOTS * 0.9 < max(1, capacity):
            buckets *= 2
        self.mask = buckets - 1
        self.table = [[] for _ in range(buckets)]
        self.stash: list[tuple[int, int]] = []  # exact room for what finds no bucket
        self._turn = 0

    def _place(self, digest: bytes) -> tuple[int, int]:
        finger = int.from_bytes(digest[8:10], "little") or 1
        return finger, int.from_bytes(digest[10:16], "little") & self.mask

    def _other(self, bucket: int, finger: int) -> int:
        return (bucket ^ (finger * 0x5BD1E995)) & self.mask

    def contains(self, digest: bytes) -> bool:
        finger, a = self._place(digest)
        if finger in self.table[a]:
            return True
        b = self._other(a, finger)
        return finger in self.table[b] or (bool(self.stash) and ((a, finger) in self.stash or (b, finger) in self.stash))

    def add(self, digest: bytes) -> None:
        finger, a = self._place(digest)
        for bucket in (a, self._other(a, finger)):
            if len(self.table[bucket]) < self.SLOTS:
                self.table[bucket].append(finger)
                return
        bucket = a
        for _ in range(self.KICKS):
            self._turn = (self._turn + 1) % self.SLOTS
            slots = self.table[bucket]
            finger, slots[self._turn] = slots[self._turn], finger
            bucket = self._other(bucket, finger)
            if len(self.table[bucket]) < self.SLOTS:
                self.table[bucket].append(finger)
                return
        self.stash.append((bucket, finger))

    def remove(self, digest: bytes) -> bool:
        finger, a = self._place(digest)
        for bucket in (a, self._other(a, finger)):
            if finger in self.table[bucket]:
                self.table[bucket].remove(finger)
                return True
            if (bucket, finger) in self.stash:
                self.stash.remove((bucket, finger))
                return True
        return False

    @property
    def room(self) -> int:
        """Keys it is meant for at most."""
        return int((self.mask + 1) * self.SLOTS * 0.9)

    def to_bytes(self) -> bytes:
        flat = np.zeros((self.mask + 1, self.SLOTS), dtype="<u2")
        for i, slots in enumerate(self.table):
            flat[i, : len(slots)] = slots
        stash = np.array(self.stash, dtype="<u8").reshape(-1, 2)
        return np.array([self.mask, len(stash)], dtype="<u8").tobytes() + stash.tobytes() + flat.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        mask, n = (int(x) for x in np.frombuffer(blob, "<u8", 2))
        out = cls(1)
        out.mask = mask
        out.stash = [tuple(map(int, x)) for x in np.frombuffer(blob, "<u8", 2 * n, 16).reshape(-1, 2)]
        flat = np.frombuffer(blob, "<u2", offset=16 + 16 * n).reshape(-1, cls.SLOTS)
        out.table = [[x for x in row if x] for row in flat.tolist()]
        return out


def shard_of(digest: bytes, shards: int) -> int:
    return int.from_bytes(digest[:4], "little") % shards


def _smaller(a: int | None, b: int | None) -> int | None:
    """The smaller id; a null one is the largest."""
    return b if a is None else a if b is None else min(a, b)


def _keys_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, doc_id, row_key) to one row per document row and line key."""
    for b in batches:
        digests, at = [], []
        for i, text in enumerate(b.column(0).to_pylist()):
            keys = {k for k in map(line_key, text.split("\n")) if len(k) >= MIN_POINTS}
            digests += map(key_digest, keys)
            at += [i] * len(keys)
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), b.column(1).take(rows), b.column(2).take(rows)], names=["digest", "doc_id", "row_key"])


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, doc_id, row_key) of docs with row keys: the keys of each row's lines."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), long_id(id_col).alias("doc_id"), "row_key")
    return rows.mapInArrow(_keys_task, f"digest binary, doc_id long, row_key {rows.schema['row_key'].dataType.simpleString()}")


def _combine_task(n_shards: int):
    """Map side: counts and smallest holders before the shuffle, so that a very common line sends few rows."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            shard = [shard_of(k, n_shards) for k in keys]
            return pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(keys, pa.binary()), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([held[k][1] for k in keys], pa.int64())],
                names=["shard", "digest", "n", "owner"],
            )

        for b in batches:
            for d, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                e = held.get(d)
                if e is None:
                    held[d] = [1, i]
                else:
                    e[0] += 1
                    e[1] = _smaller(e[1], i)
            if len(held) >= COMBINE_KEYS:
                yield out()
                held.clear()
        if held:
            yield out()

    return combine


def _probe_task(key, parts: pa.Table, filters: pa.Table) -> pa.Table:
    """A shard's new counts, folded by key, and whether its filter may know them."""
    counts: dict[bytes, list] = {}
    for d, n, owner in zip(*(parts.column(c).to_pylist() for c in ("digest", "n", "owner"))):
        e = counts.get(d)
        if e is None:
            counts[d] = [n, owner]
        else:
            e[0] += n
            e[1] = _smaller(e[1], owner)
    cuckoo = CuckooFilter.from_bytes(filters.column("blob")[0].as_py()) if filters.num_rows else None
    keys = list(counts)
    return pa.table({
        "shard": pa.array([key[0].as_py()] * len(keys), pa.int32()),
        "digest": pa.array(keys, pa.binary()),
        "n": pa.array([counts[k][0] for k in keys], pa.int64()),
        "owner": pa.array([counts[k][1] for k in keys], pa.int64()),
        "maybe": pa.array([cuckoo is not None and cuckoo.contains(k) for k in keys], pa.bool_()),
    })


def _filter_task(key, changed: pa.Table, filters: pa.Table) -> pa.Table:
    """A shard's filter with the keys of n > 0 added and those of n = 0 taken out. A first filter has room for twice its keys."""
    digests, n = changed.column("digest").to_pylist(), changed.column("n").to_pylist()
    if filters.num_rows:
        cuckoo, held = CuckooFilter.from_bytes(filters.column("blob")[0].as_py()), filters.column("keys")[0].as_py()
    else:
        cuckoo, held = CuckooFilter(max(LEAST_ROOM, 2 * len(digests))), 0
    for d, x in zip(digests, n):
        if x:
            cuckoo.add(d)
            held += 1
        elif cuckoo.remove(d):
            held -= 1
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([cuckoo.to_bytes()], pa.binary()), "keys": pa.array([held], pa.int64()), "room": pa.array([cuckoo.room], pa.int64())})


def _reshard_task(shards: int):
    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [shard_of(k, shards) for k in b.column("digest").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(b.column(c) for c in ("digest", "n", "owner"))], names=["shard", "digest", "n", "owner"])

    return again


@dataclass(frozen=True)
class LineIndex:
    """An immutable index; insert and delete give new ones."""

    shards: int = 0
    refs: tuple[DataFrame, ...] = field(default=())
    generations: tuple[DataFrame, ...] = field(default=())
    filters: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        return cls().insert(docs, id_col, text_col)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """With more documents. Their ids must not be in the index yet."""
        return self.insert_keys(materialize(line_keys(row_keys(docs), id_col, text_col), "line-refs"))

    def insert_keys(self, keys: DataFrame) -> LineIndex:
        """With the documents of written line keys."""
        spark, new = keys.sparkSession, keys.select("digest", "doc_id")
        if self.refs:
            held = reduce(DataFrame.unionByName, self.refs).select(F.col("doc_id").alias("held"))
            again = new.select("doc_id").distinct().join(held, F.col("doc_id").eqNullSafe(F.col("held")), "left_semi").limit(1).collect()
            if again:
                raise ValueError(f"document {again[0]['doc_id']} is in the index already")
        n_refs = keys.count()
        shards = self.shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_refs // SHARD_KEYS))
        filters = self.filters if self.filters is not None else spark.createDataFrame([], FILTER_SCHEMA)
        parts = new.mapInArrow(_combine_task(shards), PART_SCHEMA)
        probed = materialize(parts.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_probe_task, PART_SCHEMA + ", maybe boolean"), "line-new", n_refs)
        maybe = probed.where("maybe").drop("maybe")
        changed = added = probed.where("not maybe").drop("maybe")
        if self.generations and maybe.limit(1).count():
            old = self._exact(maybe.select("digest")).select("digest", F.col("n").alias("old_n"), F.col("owner").alias("old_owner"))
            looked = materialize(maybe.join(old, "digest", "left"), "line-hits", n_refs)
            merged = looked.select("shard", "digest", (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"), F.least("owner", "old_owner").alias("owner"))
            changed, added = changed.unionByName(merged), added.unionByName(looked.where("old_n is null").select("shard", "digest", "n", "owner"))
        kept = added.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_filter_task, FILTER_SCHEMA)
        return LineIndex(shards, (*self.refs, new), (*self.generations, changed), materialize(kept, "line-filters"))._tidy()

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Without these documents."""
        if not self.refs:
            return self
        gone = materialize(ids.select(long_id(id_col).alias("gone")).distinct(), "line-gone")
        same = F.col("doc_id").eqNullSafe(F.col("gone"))
        every = reduce(DataFrame.unionByName, self.refs)
        left = tuple(r.join(gone, same, "left_anti") for r in self.refs)
        touched = materialize(every.join(gone, same, "left_semi").select("digest").distinct(), "line-touched")
        now = reduce(DataFrame.unionByName, left).join(touched, "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner"))
        counted = touched.join(now, "digest", "left").select("digest", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "owner")
        changed = materialize(counted.mapInArrow(_reshard_task(self.shards), PART_SCHEMA), "line-changed")
        kept = changed.where("n = 0").groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_filter_task, FILTER_SCHEMA)
        return LineIndex(self.shards, left, (*self.generations, changed), materialize(kept, "line-filters"))._tidy(deleted=True)

    def _tidy(self, deleted: bool = False) -> LineIndex:
        """Filters and shards for twice the keys where a filter is full; one table of counts and references where they are many."""
        refs, generations, filters, shards = self.refs, self.generations, self.filters, self.shards
        load = filters.agg(F.max(F.col("keys") - F.col("room")).alias("over"), F.sum("keys").alias("keys")).collect()[0]  # one row
        full = load["over"] is not None and load["over"] > 0
        if full or len(generations) > GENERATIONS:
            if full:
                shards = max(shards, -(-2 * load["keys"] // SHARD_KEYS))
            generations = (materialize(self._exact().mapInArrow(_reshard_task(shards), PART_SCHEMA), "line-counts", load["keys"]),)
            if full:
                none = filters.sparkSession.createDataFrame([], FILTER_SCHEMA)
                filters = materialize(generations[0].groupBy("shard").cogroup(none.groupBy("shard")).applyInArrow(_filter_task, FILTER_SCHEMA), "line-filters")
        if deleted or len(refs) > GENERATIONS:
            refs = (materialize(reduce(DataFrame.unionByName, refs), "line-refs"),)
        return LineIndex(shards, refs, generations, filters)

    def _exact(self, keys: DataFrame | None = None) -> DataFrame:
        """Exact counts (shard, digest, n, owner) of all keys or of these."""
        parts = [g if keys is None else g.join(keys, "digest", "left_semi") for g in self.generations]
        if len(parts) == 1:
            return parts[0].select("shard", "digest", "n", "owner").where("n > 0")
        every = reduce(DataFrame.unionByName, (g.select("shard", "digest", "n", "owner", F.lit(i).alias("generation")) for i, g in enumerate(parts)))
        newest = every.groupBy("digest").agg(F.max_by(F.struct("shard", "n", "owner"), "generation").alias("x"))
        return newest.select("x.shard", "digest", "x.n", "x.owner").where("n > 0")

    @property
    def counts(self) -> DataFrame:
        return self._exact().drop("shard")

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Per input row: id, n_lines, n_dropped, the text that stays."""
        named = row_keys(docs)
        return self.apply_keys(named, line_keys(named, id_col, text_col), id_col, text_col)

    def apply_keys(self, named: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The same for rows with row keys whose line keys are at hand. A very common key is a skewed join, which AQE splits."""
        several = self.counts.where("n > 1").select("digest", "owner")
        lost = keys.join(several, "digest").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
        drops = lost.groupBy("row_key").agg(F.collect_set("digest").alias("digests"))  # no more than the row's lines
        rows = named.select(long_id(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), "row_key")
        marked = rows.join(drops, "row_key", "left").select("doc_id", "text", "digests")
        return marked.mapInArrow(_apply_task, "doc_id long, n_lines long, n_dropped long, text string").withColumnRenamed("doc_id", id_col)


def _apply_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, digests in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            lines = text.split("\n")
            n_lines.append(len(lines))
            if digests:
                lost = set(digests)
                stay = [x for x in lines if len(k := line_key(x)) < MIN_POINTS or key_digest(k) not in lost]
                n_dropped.append(len(lines) - len(stay))
                text = "\n".join(stay)
            else:
                n_dropped.append(0)
            kept.append(text)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"]
        )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Build an index of the documents and apply it to them: each line is read once."""
    named = row_keys(docs)
    keys = materialize(line_keys(named, id_col, text_col), "line-refs")
    return LineIndex().insert_keys(keys).apply_keys(named, keys, id_col, text_col)


def op4_line_dedup(spark, sf_dir) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, row_no, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS row_no, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT l.*, r.k IS NOT NULL AND l.doc_id <> r.owner AS dropped FROM keyed l LEFT JOIN repeated r ON l.k = r.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id, row_no
"""
