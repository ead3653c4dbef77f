"""Exact dedup with a log-structured merge index of digests.

Map tasks fill bounded memtables (digest -> count, longest text, smallest identifier). A batch of rows is flushed as one
run: a written table of entries, sorted by digest and cut into shards by its first bits, and one Bloom filter for each
shard, in a folder of its own. Adding a batch reads nothing that is there already. Looking keys up asks the filters of
each run first and reads the entries of those runs only that may hold one of them. LEVEL_RUNS runs of a level are
compacted into one run of the next, with more shards as it grows; compaction adds counts and keeps, of the longest
text, the smallest identifier.

Rows whose digest is held by two or more are then compared byte for byte, in salted blocks, so that a digest collision
never joins different texts and a large group is no single task. Their texts are moved for that; a Bloom filter of those
digests, of bounded size, is sent to the rows and keeps nearly all other texts where they are. Its false positives are
taken out by the join that follows: a filter that is too full for its keys costs moves, never rows.

Defined results: a null text equals the empty text; a null id sorts after every id; rows that repeat
the same id and text count one by one in ``group_size`` and exactly one of them is kept; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, long_id, materialize, ship, table

MEMTABLE_ENTRIES = 100_000  # entries of a map task's memtable before it is flushed
SHARD_ROWS = 200_000  # keys a shard of a run is planned for
LEVEL_RUNS = 4  # runs of a level before they are compacted into one
VERIFY_BLOCK = 256  # rows of one digest that are byte-verified in one salted block
FILTER_WORDS = 8  # 64-bit words in a block of the filter that is sent to the rows; each key sets a bit of each
FILTER_KEYS = 32  # keys that one of its blocks is planned for: 0.06 % of other keys pass
FILTER_BLOCKS = 1 << 18  # its blocks at most, 17 MB of bits: beyond 8 million keys more of the others pass

ENTRY_SCHEMA = "shard int, digest binary, n long, longest long, keep_id long"
RUN_SCHEMA = f"kind string, {ENTRY_SCHEMA}, filter binary"
KEPT = ("digest", "n", "longest", "keep_id")


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


class BloomFilter:
    """Bits over digests; the digest itself supplies the hash values."""

    def __init__(self, n: int, bits_per_key: int = 12, hashes: int = 6):
        self.bits = np.zeros(-(-max(64, n * bits_per_key) // 8) * 8, dtype=bool)
        self.hashes = hashes

    def _places(self, digests: list[bytes]) -> np.ndarray:
        raw = np.frombuffer(b"".join((d * 16)[-16:] for d in digests), dtype="<u8").reshape(-1, 2)
        first, second = raw[:, 0] ^ (raw[:, 1] << np.uint64(7)), (raw[:, 1] ^ (raw[:, 0] >> np.uint64(31))) | np.uint64(1)
        steps = np.arange(self.hashes, dtype=np.uint64)
        return ((first[:, None] + steps * second[:, None]) % np.uint64(len(self.bits))).astype(np.int64)

    def add(self, digests: list[bytes]) -> None:
        self.bits[self._places(digests)] = True

    def may_hold(self, digests: list[bytes]) -> np.ndarray:
        return self.bits[self._places(digests)].all(axis=1)

    def to_bytes(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> BloomFilter:
        out = cls(1)
        out.bits = np.unpackbits(np.frombuffer(blob, np.uint8)).astype(bool)
        return out


def shard_of(digest: bytes, shards: int) -> int:
    """By the first bits, so that shards follow the order of digests. shards: a power of two."""
    return int.from_bytes((digest + bytes(4))[:4], "big") * shards >> 32


def shards_for(keys: int, least: int) -> int:
    shards = 1
    while shards < max(least, -(-keys // SHARD_ROWS)):
        shards *= 2
    return shards


def _memtable_task(shards: int):
    """Map side: rows (digest, n_points, id) into bounded memtables, flushed in the order of digests."""

    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def out() -> pa.RecordBatch:
            keys = sorted(held)
            n, longest, keep = (pa.array([held[k][i] for k in keys], pa.int64()) for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array([shard_of(k, shards) for k in keys], pa.int32()), pa.array(keys, pa.binary()), n, longest, keep], names=["shard", *KEPT])

        for b in batches:
            for d, length, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                e = held.get(d)
                if e is None:
                    held[d] = [1, length, i]
                else:
                    e[0] += 1
                    if length > e[1]:
                        e[1], e[2] = length, i
                    elif length == e[1] and i is not None and (e[2] is None or i < e[2]):
                        e[2] = i
            if len(held) >= MEMTABLE_ENTRIES:
                yield out()
                held.clear()
        if held:
            yield out()

    return flush


def _reshard_task(shards: int):
    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = [shard_of(k, shards) for k in b.column("digest").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *(b.column(c) for c in KEPT)], names=["shard", *KEPT])

    return again


def merged(t: pa.Table) -> pa.Table:
    """Entries folded by digest, in its order: counts add; of the longest text, the smallest id stays, a null one only if there is no other."""
    if not t.num_rows:
        return t
    t = t.sort_by([("digest", "ascending"), ("longest", "descending"), ("keep_id", "ascending")]).combine_chunks()
    d = t.column("digest").combine_chunks()
    starts = np.flatnonzero(np.r_[True, pc.not_equal(d.slice(1), d.slice(0, len(d) - 1)).to_numpy(zero_copy_only=False)])
    n = np.add.reduceat(t.column("n").to_numpy(), starts)
    out = t.take(pa.array(starts))
    return out.set_column(out.column_names.index("n"), "n", pa.array(n, pa.int64()))


def _run_task(t: pa.Table) -> pa.Table:
    """Reduce side: what a shard's memtables hold, merged into sorted entries, and their filter."""
    entries = merged(t.select(["shard", *KEPT]))
    digests = entries.column("digest").to_pylist()
    bloom = BloomFilter(len(digests))
    bloom.add(digests)
    n = entries.num_rows
    rows = entries.add_column(0, "kind", pa.array(["entries"] * n, pa.string())).append_column("filter", pa.nulls(n, pa.binary()))
    one = pa.table({"kind": ["filter"], "shard": entries.column("shard").slice(0, 1), "digest": pa.nulls(1, pa.binary()), "n": pa.nulls(1, pa.int64()), "longest": pa.nulls(1, pa.int64()), "keep_id": pa.nulls(1, pa.int64()), "filter": pa.array([bloom.to_bytes()], pa.binary())})
    return pa.concat_tables([rows, one.cast(rows.schema)])


def _maybe_task(key, keys: pa.Table, filters: pa.Table) -> pa.Table:
    if not filters.num_rows or not keys.num_rows:
        return keys.slice(0, 0).select(["shard", "digest"])
    bloom = BloomFilter.from_bytes(filters.column("filter")[0].as_py())
    return keys.filter(pa.array(bloom.may_hold(keys.column("digest").to_pylist()))).select(["shard", "digest"])


@dataclass(frozen=True)
class Run:
    """A written, sorted run with its filters."""

    rows: DataFrame
    shards: int
    keys: int
    level: int

    @property
    def entries(self) -> DataFrame:
        return self.rows.where("kind = 'entries'").select("shard", *KEPT)

    @property
    def filters(self) -> DataFrame:
        return self.rows.where("kind = 'filter'").select("shard", "filter")

    def may_hold(self, keys: DataFrame, n_keys: int) -> DataFrame:
        """The keys (digest) that a filter of this run doesn't rule out, with their shard. Only filters are read."""
        salts = max(1, -(-n_keys // (self.shards * SHARD_ROWS)))  # a large batch meets each filter in several tasks
        shards = self.shards

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([shard_of(k, shards) for k in d], pa.int32()), pa.array([k[-1] % salts for k in d], pa.int32()), b.column(0)], names=["shard", "salt", "digest"])

        asked = keys.select("digest").mapInArrow(placed, "shard int, salt int, digest binary")
        blooms = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return asked.groupBy("shard", "salt").cogroup(blooms.groupBy("shard", "salt")).applyInArrow(_maybe_task, "shard int, digest binary")


@dataclass(frozen=True)
class DigestIndex:
    """An immutable index, newest run first; ``add`` gives a new one."""

    runs: tuple[Run, ...] = field(default=())

    def add(self, rows: DataFrame) -> DigestIndex:
        """With a batch of rows (digest, n_points, id) as one more run. Older entries are read by compaction only."""
        ship(rows.sparkSession)
        count = rows.count()
        shards = shards_for(count, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        flushed = rows.select("digest", "n_points", "id").mapInArrow(_memtable_task(shards), ENTRY_SCHEMA)
        return DigestIndex((_written(flushed, shards, count, 0), *self.runs))._compacted()

    def _compacted(self) -> DigestIndex:
        runs, level = list(self.runs), 0
        while any(r.level >= level for r in runs):
            full = [r for r in runs if r.level == level]
            if len(full) >= LEVEL_RUNS:
                keys = sum(r.keys for r in full)
                shards = shards_for(keys, max(r.shards for r in full))
                dealt = reduce(DataFrame.unionByName, (r.entries.select(*KEPT) for r in full)).mapInArrow(_reshard_task(shards), ENTRY_SCHEMA)
                at = runs.index(full[0])
                runs = [r for r in runs if r.level != level]
                runs.insert(at, _written(dealt, shards, keys, level + 1))
            level += 1
        return DigestIndex(tuple(runs))

    def lookup(self, keys: DataFrame, n_keys: int) -> DataFrame | None:
        """The entries of these keys (digest), folded over all runs; None if no filter knows any of them."""
        found = []
        for run in self.runs:
            maybe = materialize(run.may_hold(keys, n_keys), "maybe", n_keys)
            if maybe.limit(1).count():
                found.append(run.entries.join(maybe, ["shard", "digest"], "left_semi").select(*KEPT))
        return folded(found) if found else None

    def entries(self) -> DataFrame:
        """All entries (digest, n, longest, keep_id)."""
        return folded([r.entries.select(*KEPT) for r in self.runs])


def _written(flushed: DataFrame, shards: int, keys: int, level: int) -> Run:
    return Run(materialize(flushed.groupBy("shard").applyInArrow(_run_task, RUN_SCHEMA), "run", keys, by="kind"), shards, keys, level)


def folded(parts: list[DataFrame]) -> DataFrame:
    """Entries of several runs as one for each digest. A single run is that already."""
    if len(parts) == 1:
        return parts[0]
    best = F.min(F.struct((-F.col("longest")).alias("shorter"), F.col("keep_id").isNull().alias("unnamed"), "keep_id")).alias("best")
    every = reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.sum("n").alias("n"), best)
    return every.select("digest", "n", (-F.col("best.shorter")).alias("longest"), "best.keep_id")


def _filter_places(digest: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A digest's block of the filter, and its bit in each of the block's words."""
    spread = F.xxhash64(digest, F.lit(1))
    return F.pmod(F.xxhash64(digest), F.lit(blocks)), [F.shiftright(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(FILTER_WORDS)]


def may_hold(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose digest is in keys (digest), and a few others. Only a filter of the keys moves, of bounded size, not the rows."""
    blocks = max(1, min(FILTER_BLOCKS, -(-keys.count() // FILTER_KEYS)))
    block, bits = _filter_places(F.col("digest"), blocks)
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(f"word{i}") for i, bit in enumerate(bits)]
    held = keys.groupBy(block.alias("block")).agg(*words)
    every = reduce(Column.__and__, (F.getbit(f"word{i}", bit) == 1 for i, bit in enumerate(bits)))
    return rows.withColumn("block", block).join(F.broadcast(held), "block").where(every).select(*rows.columns)


def _verify_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, salt, norm, salts, ...) sorted by the first two: number the different texts of each block. The first row of a text carries it."""
    at, seen = None, {}
    for b in batches:
        if not b.num_rows:
            continue
        digest, salt, text, salts = (b.column(i).to_pylist() for i in (0, 1, 2, 3))
        variant, leader = [], []
        for d, s, t, m in zip(digest, salt, text, salts):
            if (d, s) != at:
                at, seen = (d, s), {}
            known = seen.get(t)  # compares the bytes of equal hashes
            if known is None:
                known = seen[t] = len(seen)
                leader.append(t if m > 1 else None)
            else:
                leader.append(None)
            variant.append(known)
        names = [b.schema.names[i] for i in range(4, b.num_columns)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(3), pa.array(variant, pa.int32()), pa.array(leader, pa.string()), *(b.column(n) for n in names)], names=["digest", "salt", "salts", "local", "leader", *names]
        )


def _agree_task(t: pa.Table) -> pa.Table:
    """One digest's block leaders: the same text gets the same variant in all blocks."""
    seen: dict[str, int] = {}
    variant = [seen.setdefault(x, len(seen)) for x in t.column("leader").to_pylist()]
    return pa.table({"digest": t.column("digest"), "salt": t.column("salt"), "local": t.column("local"), "variant": pa.array(variant, pa.int32())})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, row_key: str | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``digest_bytes`` shortens the digest (tests use it to force collisions). ``row_key``: a column that names each
    row; it is then a column of the result too.
    """
    text, key = normalised(F.col(text_col)), [] if row_key is None else ["row_key"]
    rows = docs.select(
        long_id(id_col).alias("id"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"),
        text.alias("norm"),
        F.monotonically_increasing_id().alias("row"),  # tells rows apart that are equal in all else; compared within one written table only
        *([] if row_key is None else [F.col(row_key).alias("row_key")]),
    ).withColumn("digest", F.substring("sha", 1, digest_bytes))
    narrow = materialize(rows.drop("norm", "row"), "digests")
    n_rows = narrow.count()
    index = DigestIndex().add(narrow)
    several = materialize(index.entries().where("n > 1").select("digest", F.ceil(F.col("n") / VERIFY_BLOCK).cast("int").alias("salts")), "several", n_rows)

    single = narrow.join(several, "digest", "left_anti").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", *key)

    salt = F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")
    hits = may_hold(rows, several).join(several, "digest").select("digest", salt.alias("salt"), "norm", "salts", "id", "n_points", "sha", "row", *key)
    checked_schema = "digest binary, salt int, salts int, local int, leader string, id long, n_points long, sha binary, row long" + "".join(f", row_key {rows.schema['row_key'].dataType.simpleString()}" for _ in key)
    checked = materialize(hits.repartition("digest", "salt").sortWithinPartitions("digest", "salt").mapInArrow(_verify_task, checked_schema), "verified", n_rows)
    leaders = checked.where(F.col("leader").isNotNull()).select("digest", "salt", "local", "leader")
    # blocks of one digest whose texts differ: collisions only, so that what must be agreed on stays small
    differ = leaders.select("digest", "leader").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    agreed = leaders.join(differ, "digest", "left_semi").groupBy("digest").applyInArrow(_agree_task, "digest binary, salt int, local int, variant int")
    variants = checked.drop("leader").join(agreed, ["digest", "salt", "local"], "left").withColumn("variant", F.coalesce("variant", "local"))
    first = F.struct((-F.col("n_points")).alias("shorter"), F.col("id").isNull().alias("unnamed"), "id", "row")
    best = variants.groupBy("digest", "variant").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # one copy of a group's result for each of its salted blocks, so that a large group isn't joined in one task
    spread = best.join(several, "digest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    several_rows = variants.join(spread, ["digest", "variant", "salt"]).select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "sha", *key)
    named_key = [] if row_key is None else [F.col("row_key").alias(row_key)]
    return single.unionByName(several_rows).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), *named_key)


def op10_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n
  FROM documents
), r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS nth,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM r
"""
