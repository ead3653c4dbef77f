"""Packing token pieces into sequences of fixed length by linear grouping and best fit.

Documents become token pieces of at most ``capacity`` tokens (only longer documents are cut; the first
piece is the shorter one). What the driver sees is the histogram of piece lengths: ``capacity`` numbers,
whatever the input. From it a plan is made:

1. large lengths are sorted and cut into groups of equal cardinality, each rounded up to its largest;
2. over these few sizes, bin configurations are optimised (column generation on the linear programme, with
   a knapsack as pricing problem) and rounded down;
3. the configurations' slots are filled with actual pieces, largest first, so the room that rounding up had
   reserved is free again; the smallest slot of a configuration stays open, as its room is now larger;
4. what is left of the large ones, for those slots, then the small ones, go where they fit best, in falling
   order of length, and to a new bin if they fit nowhere.

Bins with the same content are one run of the plan, so its size does not follow the input. A piece's rank
among those of its length, computed over salted blocks, then says in which bin it lies and where.

Ids: those of the ``tokenizers`` vocabulary file, by a faster engine over the same vocabulary and merges
(tests compare both). It merges in the order of ids, so a file whose merges have another order is refused. ``encode_special_tokens`` is that library's switch: false, as in the library and in
the registered query, the strings of the file's added tokens are those tokens' ids; true, they are ordinary
text. Each document ends in ``end_id``.

Defined results: a null text is an empty one and gives one piece of the end id; rows that have no doc_id or
repeat one are packed as documents of their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import long_id, materialize, ship, slices, table

CAPACITY, END_ID = 1024, 2
GROUPS = 60  # few sizes: equal-cardinality groups of the large lengths
SMALL = (1 / 4, 1 / 3, 1 / 2)  # lengths up to this share of the capacity are small: the share with the fewest bins counts
BLOCK = 100_000  # pieces of one length that are ranked in one salted block

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"

_engines: dict[str, object] = {}


def engine(path: str):
    """Token ids by the vocabulary and merges of a byte-level ``tokenizers`` file."""
    if path not in _engines:
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, added = file["model"]["vocab"], file.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens that match more or less than their own text")
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        special = {t["content"] for t in added}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"])
        made = [vocab["".join(p)] for p in pairs]
        if made != sorted(made) or len(made) + 256 != len(ranks) or max(ranks[bytes([i])] for i in range(256)) >= min(made, default=256):
            raise ValueError(f"{path}: merges that are not in the order of ids")
        _engines[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})
    return _engines[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first one takes the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, encode_special_tokens: bool = True) -> DataFrame:
    """Token pieces of all documents: doc_id, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = engine(path)
        encode = own.encode_ordinary if encode_special_tokens else partial(own.encode, allowed_special="all")
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts, 1 << 22):
                out: list[list] = [[] for _ in range(5)]
                for i, text in zip(ids[lo:hi], texts[lo:hi]):
                    tokens = encode(text)
                    tokens.append(end_id)
                    raw = np.array(tokens, dtype="<u4")
                    for k, (start, length) in enumerate(cut(len(raw), capacity)):
                        for column, v in zip(out, (i, k, start, length, zlib.crc32(raw[start : start + length].tobytes()))):
                            column.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(long_id(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(task, PIECE_SCHEMA)


def grouped(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Lengths (descending, with counts) cut into groups of equal cardinality; each group's first is its size."""
    items = sorted(counts.items(), reverse=True)
    if len(items) <= groups:
        return [[[n, c]] for n, c in items]
    total, out, room = sum(counts.values()), [], 0
    per = -(-total // groups)
    for n, c in items:
        while c:
            if not room:
                out.append([])
                room = per
            take = min(c, room)
            out[-1].append([n, take])
            c, room = c - take, room - take
    return out


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best configuration of one bin: its price and how many of each size."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, p = sizes[order], prices[order]
    fits = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            value = best[c - s[:n]] + p[:n]
            k = int(value.argmax())
            if value[k] > best[c] + 1e-12:
                best[c], choice[c] = value[k], k
    content, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            content[order[choice[c]]] += 1
            c -= int(s[choice[c]])
    return float(best[capacity]), content


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, close: float = 2e-4, steps: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each (a fraction): column generation from single-size bins."""
    k = len(sizes)
    per = np.maximum(1, capacity // sizes).astype(float)
    columns, inverse, x = np.diag(per), np.diag(1 / per), demand / per
    for _ in range(steps):
        price = inverse.sum(axis=0)
        best, content = knapsack(sizes, np.maximum(price, 0), capacity)
        if best <= 1 + close:
            break
        step = inverse @ content
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = x - ratio[out] * step
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        columns[:, out] = content
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    return [(columns[:, j], float(x[j])) for j in range(k) if x[j] > 1e-9]


class Runs:
    """Runs of bins with the same content, by the room that is left in them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def add(self, n: int, content: list[tuple[int, int]]) -> None:
        if n:
            self.by_room.setdefault(self.capacity - sum(length * m for length, m in content), []).append((n, content))

    def best_fit(self, length: int, count: int) -> None:
        """Each of count equal pieces goes to the fullest bin that has room."""
        while count:
            room = next((r for r in range(length, self.capacity + 1) if self.by_room.get(r)), None)
            n, content = (-(-count // (self.capacity // length)), []) if room is None else self.by_room[room].pop()
            room = self.capacity if room is None else room
            each = room // length
            full = min(n, count // each)
            self.add(full, [*content, (length, each)])
            count, n = count - full * each, n - full
            if n and count:
                self.add(1, [*content, (length, count)])
                count, n = 0, n - 1
            if content:
                self.add(n, content)

    def all(self) -> list[tuple[int, list[tuple[int, int]]]]:
        return [run for room in sorted(self.by_room) for run in self.by_room[room]]


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs (number of bins, [(length, pieces of it in each bin)]) that hold all pieces: the best plan of those for each share."""
    return min((_plan(histogram, capacity, groups, share) for share in SMALL), key=lambda runs: sum(n for n, _ in runs))


def _plan(histogram: dict[int, int], capacity: int, groups: int, share: float) -> list[tuple[int, list[tuple[int, int]]]]:
    runs = Runs(capacity)
    runs.add(histogram.get(capacity, 0), [(capacity, 1)])
    left = {n: c for n, c in histogram.items() if n < capacity and c}
    large = {n: c for n, c in left.items() if n > capacity * share}
    supply = grouped(large, groups)
    if supply:
        sizes = np.array([g[0][0] for g in supply])
        demand = np.array([float(sum(c for _, c in g)) for g in supply])
        for content, times in sorted(configurations(sizes, demand, capacity), key=lambda x: -x[1]):
            need = {int(j): int(content[j]) for j in np.flatnonzero(content)}
            if sum(need.values()) > 1:  # the smallest slot stays open for the piece that fits the actual room best
                need[max(need)] -= 1
                need = {j: m for j, m in need.items() if m}
            bins = min([int(times + 1e-6), *(sum(c for _, c in supply[j]) // m for j, m in need.items())])
            while bins:
                once = min([bins, *(supply[j][0][1] // m for j, m in need.items())])
                filled: list[tuple[int, int]] = []
                for j, m in need.items():
                    wanted = m * max(1, once)
                    while wanted:
                        take = min(wanted, supply[j][0][1])
                        filled.append((supply[j][0][0], take // max(1, once)))
                        supply[j][0][1] -= take
                        wanted -= take
                        if not supply[j][0][1]:
                            supply[j].pop(0)
                runs.add(max(1, once), filled)
                bins -= max(1, once)
    rest: dict[int, int] = {n: c for n, c in left.items() if n not in large}
    for g in supply:
        for n, c in g:
            rest[n] = rest.get(n, 0) + c
    for n in sorted(rest, reverse=True):
        if rest[n]:
            runs.best_fit(n, rest[n])
    return runs.all()


def places(runs: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as intervals of ranks: by length and first rank, the first bin, pieces a bin, and offset."""
    rank: dict[int, int] = {}
    rows, first_bin = [], 0
    for n, content in runs:
        offset = 0
        for length, m in content:
            at = rank.get(length, 0)
            rows.append((length, at, first_bin, m, offset))
            rank[length] = at + n * m
            offset += length * m
        first_bin += n
    rows.sort()
    names = ("length", "rank", "bin", "each", "offset")
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(names)}


def ranked(rows: DataFrame, histogram: dict[int, int], block: int = BLOCK) -> DataFrame:
    """Written rows with their rank among those of the same length, by their number in the table. A length of many pieces is ranked in salted blocks."""
    spark = rows.sparkSession
    salts = spark.createDataFrame([(int(n), int(-(-c // block))) for n, c in histogram.items()], "length long, salts int")
    salted = rows.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1
    return salted.withColumn("nth", nth).join(before, ["length", "salt"]).withColumn("rank", F.col("nth") + F.coalesce("before", F.lit(0))).drop("salt", "salts", "nth", "before", "row")


def pack(token_pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to written token pieces, numbered by ``row``."""
    spark = token_pieces.sparkSession
    ship(spark)
    histogram = {r["length"]: r["n"] for r in token_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    plan = places(plan_bins(histogram, capacity, groups))
    step = 1 << 44
    shared = spark.sparkContext.broadcast(plan | {"key": plan["length"] * step + plan["rank"]})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(p["key"], length * step + rank, "right") - 1
            inside = rank - p["rank"][i]
            bins, offset = p["bin"][i] + inside // p["each"][i], p["offset"][i] + inside % p["each"][i] * length
            kept = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bins, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = ranked(token_pieces, histogram).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return placed.mapInArrow(task, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, encode_special_tokens: bool = True) -> DataFrame:
    cut_up = pieces(docs, path, id_col, text_col, capacity, encode_special_tokens=encode_special_tokens)
    numbered = materialize(cut_up.withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(numbered, capacity).withColumnRenamed("doc_id", id_col)


def op3_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), encode_special_tokens=False)
