"""Exact top-k inner products by sorted lists without random access.

Vectors are dealt into blocks. In a block, each component has a list of the vectors sorted by its value. A query reads
the lists of its positive components from the top and those of its negative ones from the bottom, all to the same depth,
slice by slice. A vector that no list has shown yet scores at most what the last values read add up to. Of those
seen, each has a lower bound (unread terms at the end of their list) and an upper bound (unread terms at the last value
read). A query stops reading when outsiders can't reach the k-th best score; of the vectors seen, those whose upper bound
reaches it then get their final scores, once they are few.

The k-th best score that counts is shared over all blocks: a first pass searches one block for all queries, and its k-th
scores are what the other blocks must reach, next to the k-th best lower bound of their own. A query need not look at
bounds before the depth at which outsiders fall below that score.

A task has one block of vectors and streams one block of queries through it, in bounded batches. Both sizes are in
numbers, so that tasks hold the same whatever the length of vectors. Vectors are copied once for each QUERY_VALUES numbers
of queries, queries once for each VECTOR_VALUES numbers of vectors.

Defined results: vectors that are null or hold a null, NaN or infinite component, and rows with a null id,
take no part; vectors of different lengths are padded with zeros; rows with a query's id are its own and
never its result; rows that repeat an id are each a result of their own for other ids; an id that is
queried by several rows is queried once, with the smallest of their vectors; scores beyond a long
are held at its ends; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, ship, table, tasks_for

K, SCALE, EVERY = 20, 64, 20
VECTOR_VALUES = QUERY_VALUES = 1 << 20  # numbers of one block of vectors, and of queries
LEAST_ROWS = 2048  # rows of a block that is only cut to keep tasks busy
BATCH = 256  # queries whose bounds are worked out at once
SLICES = 10  # lists are read in slices that double: to 2**-SLICES of them first
SEEDS = 512  # vectors that give a first score to reach where none is known
FEW = 0.2  # share of a block up to which those left are resolved at once

OUT_SCHEMA = "query_id long, vec_id long, score long"


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids (and earlier places)."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > edge)
        level = np.flatnonzero(scores == edge)
        level = level[np.argsort(ids[level], kind="stable")][: k - len(above)]
        among = np.concatenate([above, level])
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))][:k]


class SortedLists:
    """The lists of one block of vectors: ranks by component. ``read`` and ``resolved`` count list entries and final scores."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        by_value = np.argsort(-self.x, axis=0, kind="stable")
        self.rank = np.empty_like(by_value, dtype=np.int32)
        np.put_along_axis(self.rank, by_value, np.arange(len(ids), dtype=np.int32)[:, None], axis=0)
        self.sorted = np.take_along_axis(self.x, by_value, axis=0)
        self.read = self.resolved = 0

    def depths(self) -> list[int]:
        n = len(self.ids)
        return sorted({max(1, -(-n >> j)) for j in range(SLICES + 1)} | {n})

    def outside(self, depth: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """The most that a vector which no list has shown to this depth can score; up and down: q's positive and negative parts."""
        return up @ self.sorted[depth - 1] + down @ self.sorted[len(self.ids) - depth]

    def seen(self, depth: int) -> np.ndarray:
        """Places of the vectors that some list has shown to this depth."""
        return np.flatnonzero(((self.rank < depth) | (self.rank >= len(self.ids) - depth)).any(axis=1))

    def bounds(self, depth: int, rows: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries by rows) from the entries read to this depth."""
        n, x, rank = len(self.ids), self.x[rows], self.rank[rows]
        top, bottom = self.sorted[0], self.sorted[-1]
        read_top, read_bottom = rank < depth, rank >= n - depth
        lower = up @ np.where(read_top, x, bottom).T + down @ np.where(read_bottom, x, top).T
        if depth == n:
            return lower, lower
        upper = up @ np.where(read_top, x, self.sorted[depth - 1]).T + down @ np.where(read_bottom, x, self.sorted[n - depth]).T
        return lower, upper

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, reach: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(query's number, result ids, scores): those of the k best of this block that are not below the scores to reach."""
        n = len(self.ids)
        most = float(self.x.shape[1]) * float(np.abs(self.x).max(initial=0)) * float(np.abs(q).max(initial=0))
        if most >= 2.0**53:
            return self._exact(query_ids, q, k)
        kind = np.float32 if most < 2.0**24 else np.float64
        self.x, self.sorted = self.x.astype(kind), self.sorted.astype(kind)
        up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
        reach = np.full(len(q), -np.inf) if reach is None else reach.copy()
        self._seed(query_ids, up + down, k, reach)
        depths, out = self.depths(), []
        first = np.full(len(q), len(depths) - 1)
        for j in range(len(depths) - 2, -1, -1):  # bounds of outsiders fall with the depth
            first[self.outside(depths[j], up, down) < reach] = j
        waiting = np.zeros(0, dtype=int)
        for j, depth in enumerate(depths):
            waiting = np.concatenate([waiting, np.flatnonzero(first == j)])
            rows, left = self.seen(depth) if len(waiting) else None, []
            for at in range(0, len(waiting), BATCH):
                batch = waiting[at : at + BATCH]
                for i, low, high in zip(batch, *self.bounds(depth, rows, up[batch], down[batch])):
                    other = self.ids[rows] != query_ids[i]
                    low = low[other]
                    kth = max(reach[i], np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf)
                    stay = rows[other & (high >= kth)]
                    if depth < n and len(stay) > max(k, FEW * n):
                        left.append(i)
                        continue
                    self.read += depth * int(np.count_nonzero(q[i]))
                    self.resolved += len(stay)
                    scores = self.x[stay] @ (up[i] + down[i])
                    best = top_rows(scores.astype(np.int64), self.ids[stay], k)
                    best = best[scores[best] >= reach[i]]
                    out.append((int(i), self.ids[stay][best], scores[best].astype(np.int64)))
            waiting = np.array(left, dtype=int)
        return out

    def _seed(self, query_ids: np.ndarray, q: np.ndarray, k: int, reach: np.ndarray) -> None:
        """Scores to reach where none is known: the k-th of a few vectors."""
        unknown = np.flatnonzero(np.isneginf(reach))
        seeds = np.linspace(0, len(self.ids) - 1, min(SEEDS, len(self.ids))).astype(int)
        for at in range(0, len(unknown), BATCH):
            batch = unknown[at : at + BATCH]
            scores = np.where(self.ids[seeds][None, :] == query_ids[batch][:, None], -np.inf, q[batch] @ self.x[seeds].T)
            if scores.shape[1] >= k:
                reach[batch] = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]

    def _exact(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Values beyond the exact range of doubles: whole lists, in integers of any size."""
        x, out = np.array([[int(v) for v in row] for row in self.x.tolist()], dtype=object), []
        for j in range(len(q)):
            own = self.ids == query_ids[j]
            scores = [max(-(2**63), min(2**63 - 1, s)) for s in x[~own] @ np.array([int(v) for v in q[j].tolist()], dtype=object)]
            names = self.ids[~own]
            best = sorted(range(len(names)), key=lambda i: (-scores[i], names[i]))[:k]
            out.append((j, names[best], np.array([scores[i] for i in best], dtype=np.int64)))
        return out


def _matrix(t: pa.Table, width: int) -> np.ndarray:
    out = np.zeros((t.num_rows, width))
    for i, v in enumerate(t.column("v").to_pylist()):
        out[i, : len(v)] = v
    return out


def _cell_task(k: int):
    def cell(t: pa.Table) -> pa.Table:
        is_query = t.column("is_query").to_numpy(zero_copy_only=False)
        vectors, queries = t.filter(pa.array(~is_query)), t.filter(pa.array(is_query))
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        if not vectors.num_rows or not queries.num_rows:
            return empty
        width = max(1, *(len(v) for v in t.column("v").to_pylist()))
        query_ids = queries.column("id").to_numpy()
        reach = np.array([-np.inf if x is None else float(x) for x in queries.column("reach").to_pylist()])
        found = SortedLists(vectors.column("id").to_numpy(), _matrix(vectors, width)).search(query_ids, _matrix(queries, width), k, reach)
        if not found:
            return empty
        return pa.table({
            "query_id": pa.array(np.concatenate([np.full(len(ids), query_ids[j]) for j, ids, _ in found]), pa.int64()),
            "vec_id": pa.array(np.concatenate([ids for _, ids, _ in found]), pa.int64()),
            "score": pa.array(np.concatenate([s for _, _, s in found]), pa.int64()),
        })

    return cell


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the largest inner product with each query."""
    spark = vectors.sparkSession
    ship(spark)

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        good = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        return df.where(good).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))

    place = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    # by a number of the row, not by its id, which a third of all rows may share
    all_rows = materialize(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = materialize(usable(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    size = all_rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).collect()[0]
    n_queries, per = asked.count(), max(1, VECTOR_VALUES // max(1, size["width"] or 1))
    v_blocks = tasks_for(spark, size["n"], per, LEAST_ROWS)
    q_blocks = max(1, -(-n_queries // max(1, QUERY_VALUES // max(1, size["width"] or 1))))

    def cells(vb: Column, which: Column, queries: DataFrame, n_q: int) -> DataFrame:
        copied = F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))
        own = all_rows.select("id", "v", F.lit(None).cast("double").alias("reach"), F.lit(False).alias("is_query"), place("row", v_blocks).alias("vb"), copied.alias("qb")).where(which)
        asking = queries.select("id", "v", "reach", F.lit(True).alias("is_query"), vb.alias("vb"), place("id", n_q).alias("qb"))
        return own.unionByName(asking).groupBy("vb", "qb").applyInArrow(_cell_task(k), OUT_SCHEMA)

    first = cells(F.lit(0), F.col("vb") == 0, asked.withColumn("reach", F.lit(None).cast("double")), max(q_blocks, tasks_for(spark, n_queries, n_queries or 1, BATCH)))
    found = first = materialize(first, "first-block")
    if v_blocks > 1:
        kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("reach")).withColumnRenamed("query_id", "id")
        found = first.unionByName(cells(F.explode(F.sequence(F.lit(1), F.lit(v_blocks - 1))), F.col("vb") > 0, asked.join(kth, "id", "left"), q_blocks))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    grid = rows.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), whole))
    return top_k(grid, grid.where(F.col("vec_id") % EVERY == 0))


def whole(x: Column) -> Column:
    """floor(64 * x) as a double; what isn't finite stays as it is."""
    scaled = x * F.lit(float(SCALE))
    return F.when(F.abs(scaled) < F.lit(2.0**53), F.floor(scaled).cast("double")).otherwise(scaled)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
