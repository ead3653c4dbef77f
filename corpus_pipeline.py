"""From raw documents to packed training sequences: five stages, each on all its predecessor kept.

Stages return whole rows of the documents that stay (the last one returns token pieces). ``run`` writes each
stage's rows to the shared folder and reads them again for the next.

Defined results: null texts are empty ones; quality scores them like any other text, language
identification rejects them as ``und``; a null doc_id sorts after all others; rows that repeat a doc_id, or
have none, are judged one by one, by their place in the table; empty tables stay
empty; extra columns, of any name, are carried along up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import materialize, row_keys, table
from lodestar.llm.exact_dedup import exact_dedup
from lodestar.llm.langid import UNDETERMINED, fit_languages, language_column
from lodestar.llm.near_join import near_duplicates
from lodestar.llm.packing import pack_documents
from lodestar.llm.quality import fit_quality, score_column

MIN_QUALITY = 0.5
MIN_LANGUAGE = 0.3

#: No SQL: two stages fit models, one is probabilistic, one optimises.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(score_column(spark, model, F.col("text")) >= MIN_QUALITY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts whose language can't be told."""
    told, name = language_column(spark, fit_languages(docs), F.col("text")), _unused(docs, "told")
    return docs.withColumn(name, told).where((F.col(f"{name}.lang_pred") != UNDETERMINED) & (F.col(f"{name}.score") >= MIN_LANGUAGE)).drop(name)


def _unused(docs: DataFrame, name: str) -> str:
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _kept(docs: DataFrame, judge: Callable[..., DataFrame]) -> DataFrame:
    """The rows that an operator keeps, found by their place in the table."""
    key = _unused(docs, "row_key")
    named = row_keys(docs, key)
    return named.join(judge(named, row_key=key).where("kept").select(key), key, "left_semi").drop(key)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row stays."""
    return _kept(docs, exact_dedup)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays."""
    return _kept(docs, near_duplicates)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents that are left, packed into sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), encode_special_tokens=False)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicate_groups),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
