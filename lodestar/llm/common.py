"""What the operators share: tables, written intermediate results, names of rows, code shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that contracts name as [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Rows of a written intermediate table that one task may hold at least.
ROWS_PER_FILE = 50_000

_shipped: dict[str, str] = {}
_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset: one of our own in local mode (tests), an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return f"file://{_own_dirs[app]}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path for one written table or archive set, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, *_at(spark, path))
    return path


def _delete(store, at) -> None:
    try:
        store.delete(at, True)
    except Exception:  # the JVM may be gone already; the folder is then the cluster's to clear
        pass


def materialize(df: DataFrame, name: str, rows: int | None = None, by: str | None = None) -> DataFrame:
    """Write once, read many: cuts lineage and survives lost executors.

    rows: about how many rows there may be, where the last step is a light one: it then runs in as many
    tasks as files of ROWS_PER_FILE rows are needed, so that small tables are not many small files.
    by: a column whose values have a folder each, so that reading one value leaves the others alone.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        _delete(*_at(t.sparkSession, t.written_at))


def row_keys(docs: DataFrame, key: str = "row_key") -> DataFrame:
    """docs with a name of each row, (file, number in it), which is the same on every reading.

    What isn't a plain reading of Parquet files is written first: a number given while it is worked out
    could be another one when a lost part is worked out again.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    relation = plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.simpleString(99).lower()
    named = docs if relation else materialize(docs, "rows")
    at = named.metadataColumn("_metadata")
    return named.withColumn(key, F.struct(at["file_path"].alias("file"), at["row_index"].alias("at")))


def tasks_for(spark: SparkSession, size: int, each: int, least: int = 1) -> int:
    """How many tasks do `size` of work, `each` a task; small work is dealt to all shuffle partitions, if each gets `least`."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // each), min(usual, -(-size // max(1, least))))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = os.path.realpath(tempfile.mkdtemp(prefix="lodestar-code-"))
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "lodestar_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped[app] = target


def long_id(column: str) -> Column:
    """An id as long; null stays null."""
    return F.col(column).cast("long")


def crc_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sampled(rows: DataFrame, kind: str, most: int) -> DataFrame:
    """Rows (row_key, id, kind) cut to at most so many of each kind: those with the smallest hash of id and place.

    rows is a written table; the kinds are few. Repeated ids are rows of their own, so that the bound holds for them too.
    """
    sizes = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    place = F.pmod(F.xxhash64("id", "row_key.at"), F.lit(1 << 30))
    # of a frequent kind, only small hashes reach the ranking: some four times as many rows as it keeps
    small = place < F.lit(4.0 * most + 100) / F.col("n") * F.lit(float(1 << 30))
    nth = F.row_number().over(Window.partitionBy(kind).orderBy(place, "id", "row_key"))
    return rows.join(F.broadcast(sizes), kind).where(small).withColumn("nth", nth).where(F.col("nth") <= most).select("row_key", kind)


def slices(texts: list[str], most_chars: int) -> Iterator[tuple[int, int]]:
    """Index ranges of texts with about most_chars characters each (one text at least)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        length = len(t or "")
        if size and size + length > most_chars:
            yield start, i
            start, size = i, 0
        size += length
    if start < len(texts):
        yield start, len(texts)
