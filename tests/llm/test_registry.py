"""Every registered query against its SQL, and on tables with awkward rows: null, repeated and extreme ids, clashing columns."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, bad_text, brute_exact, brute_lines, brute_near, good_text, lang_text, words

from lodestar.llm import exact_dedup, langid, line_dedup, near_join, packing, quality, registry, text_features, warc
from lodestar.llm.svm import fit_hinge

SMALL = "/root/testdata/sf0.001"
TOP = 2**63 - 1


def values(rows):
    return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


def duck(folder, sql):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            part = f"{folder}/{name}" if os.path.isfile(f"{folder}/{name}") else f"{folder}/{name}/*.parquet"
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{part}'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_query_equals_its_sql(spark, name):
    names, want = duck(SMALL, registry.ORACLE_SQL[name])
    assert values(registry.QUERIES[name](spark, SMALL).select(*names).collect()) == values(want)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Documents and pages whose ids are null, repeated and the largest long; columns that operators use inside."""
    folder = str(tmp_path_factory.mktemp("awkward"))
    base = words(60, 1)
    texts = [None, "", base, base, base.replace("w", "W", 3), base + " more", "a line that repeats\nown line " + base, "a line that repeats\nanother line", " \t"]
    ids = [0, TOP, TOP, None, None, None, 7, 7, -(2**63)]
    rows = [(i, t, k, "x", 1.0, True) for k, (i, t) in enumerate(zip(ids, texts))]
    rows += [(None, "the same text of many rows without an id", 9, "x", 1.0, True)] * 40
    spark.createDataFrame(rows, "doc_id long, text string, row_key int, digest string, n double, kept boolean").repartition(3).write.parquet(f"{folder}/documents.parquet")
    page = "<p>" + "é" * 600
    pages = [(i, "u", h, 1) for i, h in [(1, page), (TOP, page), (TOP, page), (None, page), (None, page + "!"), (None, page + "!"), (3, None), (3, None), (2, "small")]]
    spark.createDataFrame(pages, "page_id long, url string, html string, file int").repartition(2).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", ["op2_licenses", "op4_line_dedup", "op6_warc"])
def test_awkward_rows_against_sql(spark, awkward, name):
    if name == "op4_line_dedup":
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{awkward}/documents.parquet").collect()]
        got = line_dedup.dedup_lines(spark.read.parquet(f"{awkward}/documents.parquet")).select("doc_id", "n_lines", "n_dropped", "text").collect()
        assert sorted(map(tuple, got), key=repr) == brute_lines(docs)
        return
    names, want = duck(awkward, registry.ORACLE_SQL[name])
    assert values(registry.QUERIES[name](spark, awkward).select(*names).collect()) == values(want)


def test_awkward_rows_exact_dedup(spark, awkward, monkeypatch):
    monkeypatch.setattr(exact_dedup, "VERIFY_BLOCK", 8)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{awkward}/documents.parquet").collect()]
    got = exact_dedup.op10_exact_dedup(spark, awkward)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_exact(docs)


def test_awkward_rows_near_join_and_packing(spark, awkward, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{awkward}/documents.parquet").collect()]
    got = near_join.near_duplicates(spark.read.parquet(f"{awkward}/documents.parquet")).collect()
    want = brute_near(list(enumerate(t for _, t in docs)))
    assert Counter(r.n_links for r in got) == Counter(n for _, n in want.values())
    assert sum(r.kept for r in got) == len({c for c, _ in want.values()})
    assert {r.class_id for r in got if r.n_links == 4} == {7} and (TOP, 4) in {(r.doc_id, r.n_links) for r in got}
    assert {r.class_id for r in got if r.doc_id == TOP and not r.n_links} == {TOP}  # a text without words
    monkeypatch.setattr(packing, "BLOCK", 4)
    pieces = packing.op3_packing(spark, awkward).collect()
    assert Counter(r.doc_id for r in pieces) == Counter(i for i, _ in docs)
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)


def test_pipeline_stages_keep_one_row_of_rows_without_ids(spark, awkward):
    import corpus_pipeline

    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    exact = corpus_pipeline.exact_duplicates(spark, docs, awkward)
    assert exact.columns == docs.columns
    texts = Counter("".join((r.text or "").split()) for r in exact.collect())
    assert set(texts.values()) == {1} and len(texts) == 7
    near = corpus_pipeline.near_duplicate_groups(spark, docs, awkward)
    assert near.columns == docs.columns and Counter(r.text for r in near.collect())["the same text of many rows without an id"] == 1
    assert sum(words(60, 1)[60:120] in (r.text or "") for r in near.collect()) == 1


def test_warc_records_are_whole(spark, awkward):
    """Members are readable one by one: HTTP messages, ids of their own, revisits that name a response."""
    folder = warc.make_folder(spark, "whole")
    index = warc.write_archives(spark.read.parquet(f"{awkward}/pages.parquet"), folder).collect()
    records = []
    for r in index:
        with open(f"{folder.removeprefix('file://')}/{r.file}", "rb") as f:
            f.seek(r.offset)
            records.append(warc.parse(zlib.decompress(f.read(r.length), 31))[0])
            f.seek(0)
            assert warc.parse(zlib.decompressobj(31).decompress(f.read()))[0]["WARC-Type"] == "warcinfo"
    assert len({r["WARC-Record-ID"] for r in records}) == len(records) == 9
    responses = {r["WARC-Record-ID"] for r in records if r["WARC-Type"] == "response"}
    assert all(r["WARC-Refers-To"] in responses for r in records if r["WARC-Type"] == "revisit")
    assert sum(r["WARC-Type"] == "revisit" for r in records) == 2 and {r["Content-Type"] for r in records} == {"application/http; msgtype=response"}


# --- op7 and op9 against plain versions


def plain_looks(text):
    """Words' looks and words, by Python's own string methods."""
    out, before = [], None
    for w in text.split():
        letters, uppers = sum(c.isalpha() for c in w), sum(c.isupper() for c in w)
        case = 0 if not uppers else 1 if uppers == letters > 1 else 2 if w[0].isupper() else 3
        mark = "" if w[-1].isalpha() or w[-1].isdigit() else w[-1]
        out.append((mark, case, letters > 0, min(len(w) - letters, 4), w.lower() == before))
        before = w.lower()
    grams = [(n, *out[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(out) - n + 1)]
    return Counter(grams + [(11, w.lower()) for w in text.split()])


def plain_letters(text):
    squeezed = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
    while "  " in squeezed:
        squeezed = squeezed.replace("  ", " ")
    return Counter(squeezed[i : i + n] for n in (1, 2, 3) for i in range(len(squeezed) - n + 1) if n > 1 or i)


TEXTS = ["w302x w320x from form", "One two, TWO two! x9 (y) z.", "ça  ÉTÉ\nlà? là? LÀ", "a", "7 8 ... 9", bad_text(3), good_text(4), bad_text(8), lang_text("de", 2) + " ÜBER-all 12 x"]


@pytest.mark.parametrize("chunk", [1 << 21, 7])
@pytest.mark.parametrize("grams, plain", [(text_features.quality_grams, plain_looks), (text_features.letter_grams, plain_letters)])
def test_features_are_the_plain_ones(monkeypatch, chunk, grams, plain):
    """The same n-grams, as often, and the same ones shared by texts; chunks change nothing."""
    monkeypatch.setattr(text_features, "_CHUNK", chunk)
    hashed = [Counter((k, int(x)) for k, h in grams(t) for x in h) for t in TEXTS]
    wanted = [plain(t) for t in TEXTS]
    assert [sorted(c.values()) for c in hashed] == [sorted(c.values()) for c in wanted]
    assert all(len(hashed[i].keys() & hashed[j].keys()) == len(wanted[i].keys() & wanted[j].keys()) for i in range(len(TEXTS)) for j in range(i))


def plain_descent(rows, y, cost, rounds=3000):
    """Dual coordinate descent over dicts, in order, until it stands."""
    w, alpha = {}, [0.0] * len(rows)
    for _ in range(rounds):
        for i, x in enumerate(rows):
            gradient = y[i] * sum(w.get(k, 0.0) * v for k, v in x.items()) - 1
            new = min(max(alpha[i] - gradient / sum(v * v for v in x.values()), 0.0), cost[i])
            for k, v in x.items():
                w[k] = w.get(k, 0.0) + (new - alpha[i]) * y[i] * v
            alpha[i] = new
    return w


def test_descent_and_scaling_are_the_plain_ones():
    r = random.Random(5)
    docs = [sorted(r.sample(range(12), r.randint(1, 5))) for _ in range(30)]
    y = [1 if sum(x) + r.random() * 8 > 18 else 0 for x in docs]
    model = quality.fit_rows([np.array(x) for x in docs], np.array(y), bits=4)
    share = {}
    for k in range(12):
        good, bad = (1 + sum(k in x for x, c in zip(docs, y) if c == label) for label in (1, 0))
        share[k] = math.log(good / (sum(y) + 2) / (bad / (len(y) - sum(y) + 2)))
    rows = [{**{k: share[k] / max(1.0, math.sqrt(len(x))) for k in x}, "bias": 1.0} for x in docs]
    cost = [1.0 if c else sum(y) / (len(y) - sum(y)) for c in y]
    sign = [1 if c else -1 for c in y]
    w = plain_descent(rows, sign, cost)
    goal = lambda w: sum(v * v for v in w.values()) / 2 + sum(c * max(0.0, 1 - s * sum(w.get(k, 0.0) * v for k, v in x.items())) for c, s, x in zip(cost, sign, rows))
    found, bias = fit_hinge([np.array(x) for x in docs], [np.array([rows[i][k] for k in x]) for i, x in enumerate(docs)], np.array(sign, float), 16, weights=np.array(cost))
    assert goal({**dict(enumerate(found)), "bias": bias}) <= goal(w) * 1.01
    assert all(abs(model.weights[k] - found[k] * share[k]) < 1e-5 for k in range(12)) and abs(model.bias - bias) < 1e-9


def test_language_vote_is_the_plain_one():
    langs = ["en", "de", "fr", "es", "zz"] * 12
    texts = [lang_text(x, i) if x != "zz" else words(9, i) for i, x in enumerate(langs)]
    model = langid.fit_rows([langid.vector(t) for t in texts], langs)
    assert len(model.pairs) == 3 + 1 + 1
    for t in texts[:20]:
        counts = text_features.letter_counts(t, langid.BITS)
        norm = math.sqrt(sum(counts))
        margin = {p: sum(model.weights[i, k] * math.sqrt(counts[i]) / norm for i in np.flatnonzero(counts)) + model.bias[k] for k, p in enumerate(model.pairs)}

        def vote(among):
            wins, share = Counter(), Counter()
            for a, b in margin:
                if a in among and b in among:
                    p = 1 / (1 + math.exp(-4 * margin[a, b]))
                    wins[a if p >= 0.5 else b] += 1
                    share[a] += p / (len(among) - 1)
                    share[b] += (1 - p) / (len(among) - 1)
            best = min(among, key=lambda k: (-wins[k], -share[k], k))
            return best, share[best] if len(among) > 1 else 1.0

        family, p = vote([f for f, _ in model.families])
        lang, q = vote(dict(model.families)[family])
        got = model.predict(t)
        assert got[0] == lang and abs(got[1] - p * q) < 1e-6


def test_samples_bound_rows_not_ids(spark):
    """One id on 3,000 rows: the fits take no more rows than they say, extra columns and repeated rows included."""
    docs = spark.createDataFrame([(1, good_text(i), "en", i, "x") for i in range(3000)] + [(i, bad_text(i), "de", i, "x") for i in range(7, 60)], "doc_id long, text string, lang string, label int, row_key string")
    labels = spark.createDataFrame([(1, 1, 0), *((i, 0, 0) for i in range(7, 60))] * 2, "doc_id long, quality int, toxic int")
    taken = []
    seen = quality.sampled
    quality.sampled = lambda rows, kind, most: taken.append((seen(rows, kind, most).groupBy(kind).count().collect(), most)) or seen(rows, kind, most)
    try:
        model = quality.fit_quality(docs, labels, per_class=5)
    finally:
        quality.sampled = seen
    assert taken[0][1] == 5 and all(r["count"] <= 5 for r in taken[0][0]) and len(taken[0][0]) == 2
    assert model.score(good_text(5000)) > 0.5 > model.score(bad_text(5001))
    assert langid.fit_languages(docs, per_lang=30).predict(good_text(1))[0] in ("en", "de")


def test_op7_and_op9_queries(spark, tmp_path):
    rows = [(i, good_text(i) if i % 3 else bad_text(i), ["en", "de"][i % 2], "s", 0) for i in range(120)] + [(None, None, None, None, None), (TOP, "", "en", "s", 0), (TOP, "", "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, modulus, rest in (("op7_quality", 3, 1), ("op9_language", 4, 2)):
        got = registry.QUERIES[name](spark, str(tmp_path)).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % modulus == rest) and 0 <= r.score <= 1 for r in got)
    assert spark.createDataFrame(rows, DOCS).where(F.col("doc_id").isNull()).count() == 1
