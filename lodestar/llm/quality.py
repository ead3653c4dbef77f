"""Quality classifier: naive Bayes support vectors.

Indicators of hashed n-grams are scaled by their log-count ratio between the classes; a linear hinge-loss
model over them is fitted by dual coordinate descent.

Labels are learned from at most ``PER_CLASS`` labelled rows of each class, those with the smallest hash of id
and place (a documented bound of the fit; scoring reads every row and whole texts). The fit runs in
one task on that bounded sample: 2 * PER_CLASS rows of at most 2**BITS features of four bytes, 2.1 GB if every text had
every feature, some 10 MB in practice. Its model, of fixed size, is what the driver sends to all tasks.

Defined results: null and empty texts get the bias's score; a document with two different labels is not
learned from; if either class has no learnable row, every score is the share of label 1 (0.5 without any
label); a null doc_id is never learned from and counts as the empty text for the hold-out rule; rows are
scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, long_id, materialize, row_keys, sampled, ship, table
from .svm import fit_hinge
from .text_features import quality_features

BITS = 17  # hashed features: 2**BITS
PER_CLASS = 2000  # labelled documents of each class that the fit takes at most


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # already multiplied by the log-count ratios
    bias: float
    bits: int = BITS

    def score(self, text: str | None) -> float:
        x = quality_features(text or "", self.bits)
        margin = float(self.weights[x].sum()) / max(1.0, float(np.sqrt(len(x)))) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(2.0 * margin, -30, 30))))


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> QualityModel:
    """rows: distinct feature numbers of each document; labels: 0 or 1."""
    good = labels == 1
    if good.all() or not good.any():
        share = 0.5 if not len(labels) else float(good.mean())
        return QualityModel(np.zeros(1 << bits, np.float32), float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)) / 2, -15, 15)), bits)
    seen = np.ones((2, 1 << bits))
    for x, y in zip(rows, labels):
        seen[int(y), x] += 1
    seen /= np.array([[(~good).sum() + 2], [good.sum() + 2]])
    ratio = np.log(seen[1] / seen[0])
    values = [ratio[x] / max(1.0, np.sqrt(len(x))) for x in rows]
    balance = np.where(good, 1.0, good.sum() / max(1, (~good).sum()))
    w, bias = fit_hinge(rows, values, np.where(good, 1.0, -1.0), 1 << bits, weights=balance)
    return QualityModel((w * ratio).astype(np.float32), bias, bits)


def _features_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            x = quality_features(b.column(2)[i].as_py() or "", BITS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([x.tobytes()], pa.binary())], names=["one", "id", "label", "x"])


def _fit_task(t: pa.Table) -> pa.Table:
    t = t.sort_by([("id", "ascending"), ("x", "ascending")])
    rows = [np.frombuffer(x, np.int32) for x in t.column("x").to_pylist()]
    model = fit_rows(rows, np.array(t.column("label").to_pylist()))
    return pa.table({"weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": pa.array([model.bias], pa.float64())})


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    """Fit on at most per_class labelled rows of each class, outside the held-out third."""
    ship(docs.sparkSession)
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (crc_bucket(id_col, 3) != 1))
        .groupBy(long_id(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("top")).where("label = top").drop("top")
    )
    named = row_keys(docs).select("row_key", long_id(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = materialize(named.select("row_key", "id").join(known, "id").select("row_key", "id", "label"), "labelled")
    # at most 2 * per_class narrow rows: a bounded broadcast
    texts = named.join(F.broadcast(sampled(rows, "label", per_class)), "row_key").select("id", "label", "text")
    features = texts.mapInArrow(_features_task, "one int, id long, label int, x binary")
    got = features.groupBy("one").applyInArrow(_fit_task, "weights binary, bias double").collect()
    if not got:
        return fit_rows([], np.zeros(0, int))
    return QualityModel(np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"])


def score_column(spark, model: QualityModel, text: Column) -> Column:
    """The score of a text column, Arrow batch by Arrow batch."""
    shared = spark.sparkContext.broadcast(model)  # 2**BITS floats, whatever the input

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return score(text)


def op7_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return (
        docs.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), score_column(spark, model, F.col("text")).alias("score"))
        .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    )
