"""Language identification by hierarchical discrimination.

A first stage of one-versus-one linear support vector machines tells language families apart; within the
chosen family, one-versus-one machines separate its languages. Features are hashed letter 1- to 3-grams of
the whole text, as relative frequencies under a square root.

The fit takes at most ``PER_LANG`` rows of each language, and of all together some ``FIT_ROWS`` (but ``LEAST_PER_LANG``
of each in any case), those with the smallest hash of id and place (a documented bound of the fit; prediction reads
every row and whole texts). Every language is learned: the more pairs there are, the narrower the features are hashed,
so that the model stays within ``WEIGHTS`` numbers (some 260 MB). The fitting task holds its rows' features, eight bytes each: 840 MB if
every text of the sample had every feature, some 20 MB in practice.

Defined results: a null text or one without a letter is ``und`` with score 0; if no language can be
learned, every text is ``und``; with one learned language every text with a letter is that one; a null
doc_id is never learned from and counts as the empty text for the hold-out rule; rows are predicted one by
one; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, long_id, materialize, row_keys, sampled, ship, table
from .svm import fit_hinge
from .text_features import has_letter, letter_counts

BITS = 15
LEAST_BITS = 8
PER_LANG, LEAST_PER_LANG, FIT_ROWS = 400, 20, 3200  # rows that the fit takes: of a language at most, at least, and in all
WEIGHTS = 2016 << BITS  # numbers of the model: the pairs of 64 languages without families at full width
UNDETERMINED = "und"

#: Families of languages by their codes; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "indic": ("hi", "bn", "mr", "ur", "ne", "pa", "gu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "am", "mt"),
    "uralic": ("fi", "et", "hu"),
}


def family_of(lang: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> str:
    return next((f for f, members in families.items() if lang in members), lang)


def pairs_of(langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> int:
    """How many pairs are told apart: of families, and of languages within each."""
    sizes = Counter(family_of(lang, families) for lang in langs)
    return sum(n * (n - 1) // 2 for n in [len(sizes), *sizes.values()])


def width(pairs: int) -> int:
    """The bits of a feature number with which the weights of so many pairs stay within WEIGHTS."""
    return max(LEAST_BITS, min(BITS, (WEIGHTS // max(1, pairs)).bit_length() - 1))


def vector(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values, of unit length."""
    counts = letter_counts(text, bits)
    x = np.flatnonzero(counts)
    v = np.sqrt(counts[x])
    return x, v / (np.sqrt(float(v @ v)) or 1.0)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...]  # families or languages of one family; a positive margin is the first
    weights: np.ndarray  # one row for each feature, one column for each pair
    bias: np.ndarray
    families: tuple[tuple[str, tuple[str, ...]], ...]
    bits: int = BITS

    def _vote(self, among: tuple[str, ...], margins: dict[tuple[str, str], float]) -> tuple[str, float]:
        """The one with the most pairwise wins, then the larger mean probability, then the name."""
        if len(among) == 1:
            return among[0], 1.0
        wins, share = dict.fromkeys(among, 0), dict.fromkeys(among, 0.0)
        for a, b in combinations(among, 2):
            p = 1.0 / (1.0 + np.exp(-np.clip(4.0 * margins[a, b], -30, 30)))
            wins[a if p >= 0.5 else b] += 1
            share[a] += p / (len(among) - 1)
            share[b] += (1 - p) / (len(among) - 1)
        best = min(among, key=lambda k: (-wins[k], -share[k], k))
        return best, float(share[best])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0
        v = np.sqrt(letter_counts(text, self.bits))
        margins = dict(zip(self.pairs, ((v @ self.weights) / (np.sqrt(float(v @ v)) or 1.0) + self.bias).tolist())) if self.pairs else {}
        families = dict(self.families)
        family, p = self._vote(tuple(families), margins)
        lang, q = self._vote(families[family], margins)
        return lang, p * q


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], bits: int = BITS, families: dict = FAMILIES) -> LanguageModel:
    known = tuple(sorted(set(langs)))
    groups: dict[str, list[str]] = {}
    for lang in known:
        groups.setdefault(family_of(lang, families), []).append(lang)
    of = np.array([family_of(x, families) for x in langs], dtype=object)
    own = np.array(langs, dtype=object)
    tasks = [(a, b, of) for a, b in combinations(groups, 2)] + [(a, b, own) for g in groups.values() for a, b in combinations(g, 2)]
    weights, bias = np.zeros((1 << bits, len(tasks)), np.float32), np.zeros(len(tasks))
    for k, (a, b, names) in enumerate(tasks):
        chosen = [i for i in range(len(rows)) if names[i] == a or names[i] == b]
        y = np.array([1.0 if names[i] == a else -1.0 for i in chosen])
        w, bias[k] = fit_hinge([rows[i][0] for i in chosen], [rows[i][1] for i in chosen], y, 1 << bits, cost=4.0, epochs=10)
        weights[:, k] = w
    return LanguageModel(known, tuple((a, b) for a, b, _ in tasks), weights, bias, tuple((f, tuple(g)) for f, g in groups.items()), bits)


def _features_task(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            text = b.column(2)[i].as_py()
            if not has_letter(text):
                continue
            x, v = vector(text, bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int32()), b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([x.astype(np.int32).tobytes()], pa.binary()), pa.array([v.astype(np.float32).tobytes()], pa.binary())],
                names=["one", "id", "lang", "x", "v"],
            )


def _fit_task(t: pa.Table, bits: int) -> pa.Table:
    import pickle

    t = t.sort_by([("lang", "ascending"), ("id", "ascending"), ("x", "ascending"), ("v", "ascending")])
    rows = [(np.frombuffer(x, np.int32), np.frombuffer(v, np.float32)) for x, v in zip(t.column("x").to_pylist(), t.column("v").to_pylist())]
    return pa.table({"model": pa.array([pickle.dumps(fit_rows(rows, t.column("lang").to_pylist(), bits))], pa.binary())})


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> LanguageModel:
    """Fit on a bounded number of rows of each language, outside the held-out quarter."""
    import pickle

    ship(docs.sparkSession)
    named = row_keys(docs).select("row_key", long_id(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (crc_bucket(id_col, 4) == 2).alias("held_out"))
    rows = materialize(named.where("id is not null and lang is not null and not held_out").select("row_key", "id", "lang"), "known-languages")
    langs = [r["lang"] for r in rows.select("lang").distinct().collect()]  # one row for each language
    bits, most = width(pairs_of(langs)), max(LEAST_PER_LANG, min(per_lang, FIT_ROWS // max(1, len(langs))))
    # at most that many narrow rows of each language
    texts = named.select("row_key", "id", "text").join(F.broadcast(sampled(rows, "lang", most)), "row_key").select("id", "lang", "text")
    features = texts.mapInArrow(partial(_features_task, bits=bits), "one int, id long, lang string, x binary, v binary")
    got = features.groupBy("one").applyInArrow(lambda t: _fit_task(t, bits), "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else LanguageModel((), (), np.zeros((0, 0), np.float32), np.zeros(0), ())


def language_column(spark, model: LanguageModel, text: Column) -> Column:
    """A struct (lang_pred, score) of a text column."""
    shared = spark.sparkContext.broadcast(model)  # bounded by WEIGHTS

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield pd.DataFrame([own.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(text)


def op9_language(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs)
    out = docs.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), language_column(spark, model, F.col("text")).alias("out"))
    return out.select("doc_id", "held_out", "out.lang_pred", "out.score")
