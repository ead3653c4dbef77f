"""Licence scan: Dice coefficient over word bigrams against licence templates.

Each unit (a document's whole text, and each of its lines) is normalised to words: A-Z in lower case,
everything but letters and digits a separator. A unit of n bigrams can only reach similarity t with a
template of m bigrams if m * t / (2 - t) <= n <= m * (2 - t) / t, so units meet only the templates of their
size, by an equality join on n with the templates' size table. Bigrams count as often as they occur.

All steps are DataFrame functions. The templates are a parameter of fixed size; nothing that grows with the
input is broadcast, and in ``license_scan`` each document's units are reduced to one row before the only shuffle.

Defined results: one row per input row, whatever its doc_id; licence
and line are null and the score 0 if no unit reaches the threshold; line 0 is the whole text, line 1 the first
line; ties go to the template's name, then to the smaller line; null and empty texts have no words and match
nothing; an empty table gives no rows; other columns are ignored.

``license_spans``, which the registered query is, looks at every span of a document's words, however it is
wrapped and whatever stands around it. A document goes on only with the templates of whose bigrams it holds
enough; spans then begin and end at one of these bigrams and follow the same size bounds. Of a template's spans
that share a word, the one with the best score stays, then of all that do, the one that shares most bigrams
with its template. Its results are as above, but for one row for each input row and licence found: the licence's
best score, and the line in which that span begins (0 if the span is the whole text).
OP2_SQL has single lines and whole texts only and one licence a document: it defines less than the query, and
the same where each document has one licence at most, on lines of its own, as in the test tables.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_keys, table
from .license_texts import TEMPLATES

THRESHOLD = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """The Python twin of the column functions, for templates (ASCII)."""
    return re.findall(r"[^\W_]+", text.lower())


def size_bounds(m: int, threshold: float) -> tuple[int, int]:
    """The numbers of bigrams with which a unit can reach the threshold on a template of m."""
    sizes = [n for n in range(1, int(m * 2 / threshold) + 2) if 2.0 * min(n, m) / (n + m) >= threshold]
    return (sizes[0], sizes[-1]) if sizes else (1, 0)


def template_rows(templates: dict[str, str], threshold: float) -> list[tuple]:
    """(n, name, m, distinct bigrams, their counts): one row for each size that a unit may have."""
    out = []
    for name, text in sorted(templates.items()):
        words = words_of(text)
        bigrams = Counter(f"{a} {b}" for a, b in zip(words, words[1:]))
        m = sum(bigrams.values())
        low, high = size_bounds(m, threshold)
        out += [(n, name, m, list(bigrams), list(bigrams.values())) for n in range(low, high + 1)]
    return out


def words_column(text: Column) -> Column:
    """The words of a text, as an array."""
    clean = F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(clean, " "), lambda w: w != F.lit(""))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, licence, score, line of its best match."""
    spark = docs.sparkSession
    rows = template_rows(TEMPLATES if templates is None else templates, threshold)
    by_size = spark.createDataFrame(rows, "n int, licence string, m int, grams array<string>, times array<int>")
    least, most = min((r[0] for r in rows), default=1), max((r[0] for r in rows), default=0)

    text = F.coalesce(F.col(text_col), F.lit(""))
    units = F.transform(F.concat(F.array(text), F.split(text, "\n")), lambda u, i: F.struct(i.alias("line"), words_column(u).alias("words")))
    possible = F.filter(units, lambda u: (F.size(u["words"]) > least) & (F.size(u["words"]) <= most + 1))
    unit = row_keys(docs).select(F.col(id_col).alias("doc"), F.col("row_key").alias("u"), F.explode_outer(possible).alias("unit")).select("doc", "u", "unit.line", "unit.words", (F.size("unit.words") - 1).alias("n"))
    grams = F.zip_with(F.slice("words", F.lit(1), F.greatest(F.col("n"), F.lit(0))), F.slice("words", F.lit(2), F.greatest(F.col("n"), F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    met = unit.withColumn("own", grams).join(F.broadcast(by_size), "n", "left")  # the templates' sizes: fixed, some thousand rows

    n, m = F.col("n"), F.col("m")
    spare = m - F.size("grams")  # repeats in the template
    at_most = F.size(F.array_intersect("own", "grams")) + spare
    shared = F.aggregate(
        F.arrays_zip("grams", "times"), F.lit(0), lambda acc, g: acc + F.least(g["times"], F.size(F.filter(F.col("own"), lambda x: x == g["grams"])))
    )
    score = F.when(F.lit(2.0) * at_most / (n + m) >= threshold, F.lit(2.0) * shared / (n + m))
    scored = met.select("doc", "u", "line", "licence", score.alias("score")).withColumn("score", F.when(F.col("score") >= threshold, F.col("score")))
    best = F.min(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("worse"), "licence", "line")))
    return (
        scored.groupBy("u", "doc").agg(best.alias("best"))
        .select(F.col("doc").alias(id_col), F.col("best.licence").alias("licence"), F.coalesce(-F.col("best.worse"), F.lit(0.0)).alias("score"), F.col("best.line").alias("line"))
    )


def grams_column(words: Column) -> Column:
    """The word bigrams of an array of words, in order."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def _apart(spans: Column, kind: str) -> Column:
    """Of sorted spans, those that share no word with an earlier one that stays."""
    return F.aggregate(
        spans, F.array().cast(kind), lambda kept, s: F.when(F.exists(kept, lambda k: (k["first"] <= s["last"] + 1) & (s["first"] <= k["last"] + 1)), kept).otherwise(F.concat(kept, F.array(s)))
    )


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and licence found anywhere in it: id, licence, score, line of its best span."""
    spark = docs.sparkSession
    counted = {name: Counter(f"{a} {b}" for a, b in zip(words, words[1:])) for name, words in ((k, words_of(v)) for k, v in sorted((TEMPLATES if templates is None else templates).items())) if len(words) > 1}
    sizes = [(name, c.total(), size_bounds(c.total(), threshold)[1], c.total() - len(c), list(c)) for name, c in counted.items()]
    by_name = spark.createDataFrame(sizes, "licence string, m int, most int, spare int, grams array<string>")
    by_gram = spark.createDataFrame([(name, g, n) for name, c in counted.items() for g, n in c.items()], "licence string, gram string, times int")
    reaches = lambda shared, m: 2.0 * shared / (shared + m) >= threshold  # a span that holds nothing else
    least = min((next(k for k in range(m + 1) if reaches(k, m)) - spare for _, m, _, spare, _ in sizes), default=0)
    known = sorted({g for c in counted.values() for g in c})

    rows = row_keys(docs).select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col("row_key").alias("u"))
    met = F.transform(F.array(words_column(F.col("text"))), lambda w: F.struct(w.alias("words"), F.array_distinct(F.filter(grams_column(w), lambda g: g.isin(known))).alias("met")))
    some = rows.select("doc", "u", "text", F.explode(F.filter(met, lambda x: F.size(x["met"]) >= max(1, least))).alias("x")).select("doc", "u", "text", "x.words", "x.met")
    pairs = some.join(F.broadcast(by_name), reaches(F.size(F.array_intersect("met", "grams")) + F.col("spare"), F.col("m")))

    lines = F.flatten(F.transform(F.split("text", "\n"), lambda t, i: F.array_repeat(i + 1, F.size(words_column(t)))))
    places = F.zip_with(grams_column(F.col("words")), lines, lambda g, line: F.struct(g.alias("gram"), line.alias("line")))
    placed = pairs.select("doc", "u", "licence", (F.size("words") - 1).alias("n"), F.posexplode(places).alias("at", "x")).select("doc", "u", "licence", "n", "at", "x.line", "x.gram").join(F.broadcast(by_gram), ["licence", "gram"])
    placed = placed.repartition("u")  # the steps up to a row's spans need no other exchange
    # with the place from which on a bigram is one more than the template has
    same = placed.groupBy("doc", "u", "licence", "n", "gram", "times").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("all"))
    spent = F.transform("all", lambda p, i: F.struct(p["at"].alias("at"), p["line"].alias("line"), F.coalesce(F.get("all", i - F.col("times"))["at"], F.lit(-1)).alias("before")))
    hits = same.select("doc", "u", "licence", "n", F.explode(spent).alias("hit")).groupBy("doc", "u", "licence", "n").agg(F.array_sort(F.collect_list("hit")).alias("hits"))

    def longer(state, first, x):
        size, shared = x["at"] - first["at"] + 1, state["shared"] + (x["before"] < first["at"]).cast("int")
        score = F.lit(2.0) * shared / (size + F.col("m"))
        better = (size <= F.col("most")) & (score > state["score"])
        return F.struct(
            shared.alias("shared"), F.when(better, score).otherwise(state["score"]).alias("score"),
            F.when(better, x["at"]).otherwise(state["last"]).alias("last"), F.when(better, shared).otherwise(state["common"]).alias("common"),
        )

    def best_from(h, i):
        none = F.struct(F.lit(0).alias("shared"), F.lit(0.0).alias("score"), F.lit(-1).alias("last"), F.lit(0).alias("common"))
        best = F.aggregate(F.slice("hits", i + 1, F.col("most")), none, lambda state, x: longer(state, h, x))
        return F.transform(F.array(best), lambda b: F.struct((-b["score"]).alias("worse"), h["at"].alias("first"), b["last"].alias("last"), b["common"].alias("common"), h["line"].alias("line")))[0]

    sized = hits.join(F.broadcast(by_name.select("licence", "m", "most")), "licence")
    spans = sized.select("doc", "u", "licence", "n", F.array_sort(F.filter(F.transform("hits", best_from), lambda s: -s["worse"] >= threshold)).alias("spans"))
    own = spans.select("doc", "u", "licence", "n", F.explode(_apart(F.col("spans"), "array<struct<worse:double,first:int,last:int,common:int,line:int>>")).alias("s"))
    ranked = F.struct((-F.col("s.common")).alias("fewer"), "s.worse", "licence", "s.first", "s.last", F.when((F.col("s.first") == 0) & (F.col("s.last") == F.col("n") - 1), 0).otherwise(F.col("s.line")).alias("line"))
    told = own.groupBy("doc", "u").agg(F.array_sort(F.collect_list(ranked)).alias("spans"))
    told = told.select("doc", "u", F.explode(_apart(F.col("spans"), "array<struct<fewer:int,worse:double,licence:string,first:int,last:int,line:int>>")).alias("s"))
    each = told.select("doc", "u", "s.licence", "s.worse", "s.line").unionByName(rows.select("doc", "u"), allowMissingColumns=True)
    best = each.groupBy("u", "doc", "licence").agg(F.min(F.struct("worse", "line")).alias("best"))
    named = F.collect_list(F.when(F.col("licence").isNotNull(), F.struct("licence", "best.worse", "best.line"))).alias("found")  # as many as templates
    out = best.groupBy("u", "doc").agg(named).select("doc", F.explode_outer("found").alias("s"))
    return out.select(F.col("doc").alias(id_col), "s.licence", F.coalesce(-F.col("s.worse"), F.lit(0.0)).alias("score"), "s.line")


def op2_licenses(spark, sf_dir) -> DataFrame:
    return license_spans(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NORMAL = r"list_filter(string_split(trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '')"

OP2_SQL = f"""
WITH templates(licence, body) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(TEMPLATES.items()))}),
t_words AS (SELECT licence, {_NORMAL.format("body")} AS words FROM templates),
t_grams AS (
  SELECT licence, len(words) - 1 AS m, g, count(*) AS c
  FROM (SELECT licence, words, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS g FROM t_words)
  GROUP BY ALL
),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT row_number() OVER () AS u, r, line, {_NORMAL.format("body")} AS words
  FROM (
    SELECT r, 0 AS line, text AS body FROM d
    UNION ALL
    SELECT r, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS body FROM d
  )
),
sized AS (SELECT u, r, line, len(words) - 1 AS n, words FROM units WHERE len(words) BETWEEN 2 AND 2 * (SELECT max(m) FROM t_grams)),
grams AS (
  SELECT u, g, count(*) AS c
  FROM (SELECT u, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS g FROM sized)
  GROUP BY ALL
),
scores AS (
  SELECT s.r, s.line, t.licence, 2.0::DOUBLE * sum(least(g.c, t.c)) / (s.n + t.m) AS score
  FROM sized s JOIN grams g ON s.u = g.u JOIN t_grams t ON g.g = t.g
  GROUP BY s.u, s.r, s.line, s.n, t.licence, t.m
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, licence, line) AS nth FROM scores WHERE score >= {THRESHOLD}::DOUBLE
)
SELECT d.doc_id, b.licence, coalesce(b.score, 0.0::DOUBLE) AS score, CAST(b.line AS INTEGER) AS line
FROM d LEFT JOIN best b ON b.r = d.r AND b.nth = 1
"""
