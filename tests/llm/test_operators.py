"""The operators against brute force, exact round trips and held-out accuracy, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import bpe, exact_dedup, langid, licenses, line_dedup, near_join, packing, quality, text_features, topk, warc
from lodestar.llm.svm import fit_hinge

WS = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASH = "doc_id long, text string, id long, digest string, keep_id string, n int, kept string, bucket int, part int, label int, score double, vec_id long"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


def awkward_texts():
    base = words(80, 1)
    near = base.split()
    near[40] = "changed"
    return [
        None, "", " \t\n", "a", "Aé\n", "same text here and there", "same  text here\nand there ", "same text here and there", base, base, " ".join(near),
        base.upper(), words(5000, 2), "日本語 テキスト", "one line repeated\none line repeated\nshort\n\tONE line repeated  ", "one line repeated\nother stuff here", "\x00\x01 <|endoftext|>",
        "x" * 50_000,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(awkward_texts())]
    rows += [(None, "same text here and there", None, None, None), (3, "a", "fr", "s", 1), (3, "a", "fr", "s", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(spark):
    return spark.createDataFrame([(i, t, 1, "d", "k", 2, "x", 3, 4, 1, 0.5, 9) for i, t in enumerate(awkward_texts())], CLASH)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- op10


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in WS)].append((i, len(t or "")))
    out = []
    for norm, members in groups.items():
        order = sorted(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, order[0][0], len(members), n == 0, sha) for n, (i, _) in enumerate(order)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(docs, digest_bytes):
    """One byte of digest makes most texts collide: only the byte comparison tells them apart."""
    got = exact_dedup.exact_dedup(docs, digest_bytes=digest_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_exact([(r.doc_id, r.text) for r in docs.collect()])


def test_exact_dedup_salted_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "VERIFY_BLOCK", 3)
    rows = [(i, ["p q", "pq ", "other", "more"][i % 4], "en", "s", 0) for i in range(60)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS).repartition(4), digest_bytes=1)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_exact([r[:2] for r in rows])


def shuffled_bytes(spark):
    """Bytes that all finished stages have written for a shuffle so far."""
    context, jvm = spark.sparkContext._jsc.sc(), spark._jvm
    context.listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = context.statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_exact_dedup_moves_few_texts(spark, tmp_path):
    """Where the groups are too many to broadcast, texts without a copy stay where they are."""
    r = random.Random(9)
    texts = ["%x" % r.getrandbits(80_000) for _ in range(300)]  # 20,000 characters each
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*texts, *texts[:6]])]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_bytes(spark)
        got = exact_dedup.op10_exact_dedup(spark, str(tmp_path)).collect()
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert sorted(map(tuple, got), key=repr) == brute_exact([r[:2] for r in rows])
    assert moved < 1_500_000 < sum(map(len, texts)) / 3


@pytest.mark.parametrize("most_blocks", [1, 1 << 18])
def test_exact_dedup_filter_loses_no_key(spark, monkeypatch, most_blocks):
    """A filter with room passes hardly any other key; one that is too full passes them all, and the result is the same."""
    monkeypatch.setattr(exact_dedup, "FILTER_BLOCKS", most_blocks)
    digests = [hashlib.sha256(b"%d" % i).digest() for i in range(6000)]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(digests)], "id long, digest binary")
    passed = exact_dedup.may_hold(rows, rows.where("id < 2000").select("digest"))
    assert passed.columns == rows.columns
    got = [r.id for r in passed.collect()]
    assert len(got) == len(set(got)) and set(range(2000)) <= set(got)
    assert len(got) == 6000 if most_blocks == 1 else len(got) < 2050
    docs = [(i, f"text {i % 700}" + " " * (i % 3), "en", "s", 0) for i in range(900)]
    result = exact_dedup.exact_dedup(spark.createDataFrame(docs, DOCS), digest_bytes=2)
    assert sorted(map(tuple, result.collect()), key=repr) == brute_exact([r[:2] for r in docs])


def test_exact_dedup_empty_and_extra_columns(nothing, clashing):
    assert exact_dedup.exact_dedup(nothing).collect() == []
    assert exact_dedup.exact_dedup(clashing).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def entry_rows(df):
    return {bytes(r.digest): (r.n, r.longest, r.keep_id) for r in df.collect()}


def test_digest_index_levels(spark, monkeypatch):
    """Batches in runs, runs in levels: the folded entries are those of all rows at once."""
    monkeypatch.setattr(exact_dedup, "LEVEL_RUNS", 2)
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 10)
    r = random.Random(3)
    index, truth = exact_dedup.DigestIndex(), {}
    for k in range(5):
        rows = [(bytes([r.randrange(40)]) * 32, r.randrange(3), r.choice([None, r.randrange(1000)])) for _ in range(30 * (k + 1))]
        index = index.add(spark.createDataFrame(rows, "digest binary, n_points long, id long"))
        for d, length, i in rows:
            n, best = truth.get(d, (0, None))
            truth[d] = (n + 1, min(x for x in [best, (-length, i is None, i or 0)] if x is not None))
    want = {d: (n, -best[0], None if best[1] else best[2]) for d, (n, best) in truth.items()}
    assert entry_rows(index.entries()) == want
    assert [(x.level, x.keys) for x in index.runs] == [(0, 150), (2, 300)] and index.runs[1].shards >= 30
    asked = spark.createDataFrame([(bytes([i]) * 32,) for i in range(20, 60)], "digest binary")
    assert entry_rows(index.lookup(asked, 40)) == {d: x for d, x in want.items() if d[0] >= 20}


def test_new_digests_read_no_entries(spark):
    """Adding a batch and looking up keys that no filter knows leave the older entries alone: they may be gone."""
    make = lambda low: spark.createDataFrame([(hashlib.sha256(b"%d" % i).digest(), 1, i) for i in range(low, low + 50)], "digest binary, n_points long, id long")
    index = exact_dedup.DigestIndex().add(make(0))
    shutil.rmtree(index.runs[0].rows.written_at.removeprefix("file://") + "/kind=entries")
    index = index.add(make(100))
    assert len(index.runs) == 2 and index.runs[0].entries.count() == 50
    assert index.lookup(make(500).select("digest"), 50) is None


# --- op4


def brute_lines(rows):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(WS))
    last = 2**64  # a null id
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(last if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(h := holders.get(key(x), ())) > 1 and min(h) != (last if i is None else i))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def test_line_dedup(docs):
    got = line_dedup.LineIndex.build(docs).apply(docs).select("doc_id", "n_lines", "n_dropped", "text")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_lines([(r.doc_id, r.text) for r in docs.collect()])


def test_line_dedup_is_reversible(spark):
    lines = [f"a common line number {i}" for i in range(6)]
    r = random.Random(5)
    rows = [(i, "\n".join(r.sample(lines, 3)), None, None, None) for i in range(12)]
    a, b = spark.createDataFrame(rows[:7], DOCS), spark.createDataFrame(rows[7:], DOCS)
    both = a.unionByName(b)
    state = lambda index: sorted((bytes(x.digest), x.n, x.owner) for x in index.counts.collect())
    index = line_dedup.LineIndex.build(a)
    more = index.insert(b)
    assert state(more) == state(line_dedup.LineIndex.build(both))
    assert sorted(map(tuple, more.apply(both).select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr) == brute_lines([x[:2] for x in rows])
    assert state(more.delete(b)) == state(index)
    assert state(more.delete(both)) == []
    gone = more.delete(a)
    assert state(gone) == state(line_dedup.LineIndex.build(b))
    kept = {bytes(x.digest) for x in gone.counts.collect()}
    cuckoos = [line_dedup.CuckooFilter.from_bytes(bytes(x.blob)) for x in gone.filters.collect()]
    assert all(any(c.contains(d) for c in cuckoos) for d in kept)
    with pytest.raises(ValueError, match="in the index already"):
        more.insert(b)
    assert state(more.delete(b).insert(b)) == state(more)


def test_new_lines_read_no_counts(spark):
    """Keys that their filter doesn't know need no exact table: it may be gone."""
    index = line_dedup.LineIndex.build(spark.createDataFrame([(i, f"a line of document {i}", None, None, None) for i in range(20)], DOCS))
    shutil.rmtree(index.generations[0].inputFiles()[0].removeprefix("file://").rpartition("/")[0])
    more = index.insert(spark.createDataFrame([(i, f"another line of document {i}", None, None, None) for i in range(100, 120)], DOCS))
    assert more.generations[1].count() == 20 and more.filters.agg(F.sum("keys")).collect()[0][0] == 40


def test_line_index_grows(spark, monkeypatch):
    """Ten times the keys: filters and shards are rebuilt, and everything is as in a fresh build."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 200)
    monkeypatch.setattr(line_dedup, "GENERATIONS", 3)
    make = lambda low, high: spark.createDataFrame([(i, f"a line of document {i}\na shared line {i % 7}\na shared line {i % 5}", None, None, None) for i in range(low, high)], DOCS)
    state = lambda index: sorted((bytes(x.digest), x.n, x.owner) for x in index.counts.collect())
    index = line_dedup.LineIndex.build(make(0, 40))
    first = index.shards
    for low in range(40, 800, 190):
        index = index.insert(make(low, low + 190))
    assert state(index) == state(line_dedup.LineIndex.build(make(0, 800)))
    assert index.shards > first and index.filters.where("keys > room").count() == 0
    index = index.delete(make(10, 790)).delete(make(790, 795))
    assert state(index) == state(line_dedup.LineIndex.build(make(0, 10).unionByName(make(795, 800))))


def test_line_dedup_empty_and_extra_columns(nothing, clashing):
    assert line_dedup.LineIndex.build(nothing).apply(nothing).collect() == []
    assert line_dedup.LineIndex.build(clashing).apply(clashing).count() == len(awkward_texts())


def test_cuckoo_filter():
    r = random.Random(1)
    keys = [r.randbytes(16) for _ in range(3000)]
    cuckoo = line_dedup.CuckooFilter(len(keys))
    for k in keys:
        cuckoo.add(k)
    again = line_dedup.CuckooFilter.from_bytes(cuckoo.to_bytes())
    assert all(again.contains(k) for k in keys)
    for k in keys[:1500]:
        assert again.remove(k)
    assert all(again.contains(k) for k in keys[1500:])
    assert sum(again.contains(k) for k in keys[:1500]) < 30
    small = line_dedup.CuckooFilter(1)  # far too small: the stash keeps it exact
    for k in keys[:40]:
        small.add(k)
    assert all(line_dedup.CuckooFilter.from_bytes(small.to_bytes()).contains(k) for k in keys[:40])


# --- op8


@pytest.fixture(scope="module")
def public():
    return pytest.importorskip("public_tokenizers")


def test_bpe_against_tiktoken(public):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(public.path("byte_bpe_50k.tiktoken"))
    truth = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.BytePairCodec(ranks, public.PATTERN)
    r = random.Random(2)
    texts = [t for t in awkward_texts() if t]
    texts += ["".join(r.choice(a) for _ in range(r.randrange(60))) for a in ("ab", "etaoin ", "abcdef \n\r\t", "éèßñ xyz", "日本 кот", "'s't'RE 09.,!", "\U0001f600a ") for _ in range(150)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == truth.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_bpe_appends_and_edits(public):
    encoder = bpe.PrefixEncoder(bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")))
    r = random.Random(4)
    piece, last = b"", [-1]
    for _ in range(60):
        if r.random() < 0.6:
            piece += r.choice([b"the", b"ing", b"x", b"ation", b"qu"])
            last = encoder.prefixes(piece, last)
        else:
            a = r.randrange(len(piece) + 1)
            piece, last = encoder.edited(piece, last, a, min(len(piece), a + r.randrange(4)), r.choice([b"", b"er", b"zz"]))
        assert last == encoder.prefixes(piece)
        assert b"".join(encoder.tokens[i] for i in encoder.read_back(piece, last)) == piece


def test_bpe_query(docs, nothing, clashing, public):
    path = public.path("byte_bpe_50k.tiktoken")
    got = rows_of(bpe.encode_documents(docs, path, public.PATTERN, ids=True))
    texts = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got) == texts
    assert all(hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] and len(r["ids"]) == 4 * r["n_tokens"] for r in got)
    assert bpe.encode_documents(nothing, path, public.PATTERN).collect() == []
    assert bpe.encode_documents(clashing, path, public.PATTERN).count() == len(awkward_texts())


# --- op3


def test_cut():
    assert packing.cut(1, 8) == [(0, 1)]
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece_once(seed):
    r = random.Random(seed)
    top = r.choice([40, 700, 1023])
    histogram = Counter(r.randint(1, top) for _ in range(r.choice([1, 30, 3000])))
    histogram[1024] = 5
    runs = packing.plan_bins(histogram)
    held = Counter()
    for n, content in runs:
        assert sum(length * m for length, m in content) <= 1024
        for length, m in content:
            held[length] += m * n
    assert held == histogram
    bins = sum(n for n, _ in runs)
    least = math.ceil(sum(length * n for length, n in histogram.items()) / 1024)
    fit = packing.Runs(1024)
    for length in sorted(histogram, reverse=True):
        fit.best_fit(length, histogram[length])
    assert least <= bins <= sum(n for n, _ in fit.all())


def test_configurations_beat_single_sizes():
    """Sizes that only fill a bin together: half of the bins of one size each."""
    runs = packing._plan({600: 100, 424: 100}, 1024, 10, 1 / 3)
    assert sum(n for n, _ in runs) == 100


def test_packing(docs, nothing, public, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    monkeypatch.setattr(packing, "BLOCK", 2)
    path = public.path("byte_bpe_50k.json")
    truth = tokenizers.Tokenizer.from_file(path)
    truth.encode_special_tokens = True
    got = rows_of(packing.pack_documents(docs, path, capacity=64))
    want = Counter()
    for r in docs.collect():
        ids = np.array(truth.encode(r.text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 64)):
            want[r.doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack_documents(nothing, path).collect() == []


@pytest.mark.parametrize("last_stage", [False, True])
def test_packing_of_added_tokens(spark, public, tmp_path, last_stage):
    """The query's and the pipeline's ids are those of an unchanged tokenizer, which finds its added tokens in texts."""
    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    truth = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = ["end of page <|endoftext|> next", end, end * 3, f"a{end}b", f"  {end}\n\n{end}  ", "<|endoftext|", f"<|{end}|>", f"x{end.upper()}", f"{words(1500, 7)}{end}{words(900, 8)}", "plain", ""]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(corpus_pipeline.packing(spark, docs, str(tmp_path)) if last_stage else packing.op3_packing(spark, str(tmp_path)))
    want = Counter()
    for i, t in enumerate(texts):
        ids = np.array(truth.encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


# --- op7 and op9


def test_hinge_separates():
    rows = [np.array([0, 2]), np.array([0]), np.array([1, 2]), np.array([1])] * 10
    y = np.array([1, 1, -1, -1] * 10)
    w, b = fit_hinge(rows, [np.ones(len(x)) for x in rows], y, 3)
    assert all((w[x].sum() + b) * v > 0.9 for x, v in zip(rows, y))


def good_text(i):
    return words(60, i, 3000).capitalize() + "."


def bad_text(i):
    r = random.Random(i)
    return [" ".join(w + r.choice(["%%%", "###"]) for w in words(40, i).split()), " ".join(["Same."] * 40), words(40, i).upper() + "!!"][i % 3]


def test_quality(spark, nothing):
    texts = {i: (bad_text(i) if i % 4 == 0 else good_text(i)) for i in range(240)}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()] + [(None, None, None, None, None), (999, "", "en", "s", 0)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in texts] + [(None, 1, 0), (5, 0, 0), (7777, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    got = {r.doc_id: r.score for r in docs.select("doc_id", quality.score_column(spark, model, F.col("text")).alias("score")).collect()}
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50 and sum((got[i] >= 0.5) == (i % 4 != 0) for i in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[None] == got[999]
    assert quality.fit_quality(docs, labels.limit(0)).score("anything") == 0.5
    assert quality.fit_quality(nothing, labels).score(None) == 0.5
    assert quality.fit_quality(docs, labels.where("quality = 1")).score("x") > 0.99


def test_quality_never_learns_from_held_out(spark):
    docs = spark.createDataFrame([(i, good_text(i), "en", "s", 0) for i in range(60)], DOCS)
    labels = spark.createDataFrame([(i, 0 if zlib.crc32(str(i).encode()) % 3 == 1 else 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert quality.fit_quality(docs, labels).score("x") > 0.99  # the held-out zeros are not seen


LANG_WORDS = {"en": "the and with shore thing water house", "de": "der und nicht mit schon wasser hausü", "fr": "le et avec chôse eau maison été", "es": "el y con cosa agua casa niño"}


def lang_text(lang, i):
    r = random.Random(f"{lang}{i}")
    return " ".join(r.choice(LANG_WORDS[lang].split()) for _ in range(r.randint(4, 40)))


def test_language(spark, nothing):
    rows = [(n, lang_text(lang, n), lang, "s", 0) for n, lang in enumerate(["en", "de", "fr", "es"] * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "123 ... !?" * 30, "en", "s", 0), (903, "кот " * 20, None, "s", 0), (None, "the", None, None, None)], DOCS)
    model = langid.fit_languages(docs)
    got = {r.doc_id: (r.o.lang_pred, r.o.score) for r in docs.select("doc_id", langid.language_column(spark, model, F.col("text")).alias("o")).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 30 and sum(got[i][0] == lang for i, _, lang, _, _ in held) / len(held) > 0.97
    assert [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903][0] in LANG_WORDS and all(0 <= s <= 1 for _, s in got.values())
    assert langid.fit_languages(nothing).predict("the and") == ("und", 0.0)
    assert langid.fit_languages(docs.where("lang = 'fr'")).predict("the and") == ("fr", 1.0)
    assert {f: set(m) for f, m in model.families} == {"germanic": {"en", "de"}, "romance": {"fr", "es"}}


def test_all_languages_are_learned(spark):
    """Seventy languages of a family each, also the rarest."""
    langs = [f"q{i:02}" for i in range(70)]

    def text(k, i):
        r = random.Random(k * 1000 + i)
        own = [f"{chr(97 + k % 24)}{chr(97 + k // 24 * 7 + j)}{chr(98 + k % 24)}" for j in range(4)]
        return " ".join(r.choice(own) for _ in range(20))

    n_of = lambda k: 14 if k < 64 else 10
    rows = [(k * 100 + i, text(k, i), lang, None, None) for k, lang in enumerate(langs) for i in range(n_of(k))]
    model = langid.fit_languages(spark.createDataFrame(rows, DOCS))
    assert set(model.langs) == set(langs)
    assert [model.predict(text(k, 500))[0] for k in range(70)] == langs
    assert model.weights.size <= langid.WEIGHTS


def test_letterless_text_of_many_chunks(monkeypatch):
    monkeypatch.setattr(text_features, "_CHUNK", 256)
    rows = [langid.vector(lang_text(lang, i)) for lang in ("en", "de") for i in range(8)]
    model = langid.fit_rows(rows, ["en"] * 8 + ["de"] * 8)
    assert [model.predict(x * 256 * 40) for x in ("7", " ", ".")] == [("und", 0.0)] * 3
    assert model.predict("7" * 256 * 40 + " " + lang_text("de", 9))[0] == "de"


def test_width_of_features():
    assert langid.width(0) == langid.width(6) == langid.width(2016) == langid.BITS
    assert all(n << langid.width(n) <= langid.WEIGHTS for n in range(1, 250_000, 997))
    assert langid.pairs_of(["en", "de", "fr", "es", "xx"]) == 3 + 1 + 1


# --- op1


def brute_topk(rows, k=20, queries=lambda i: i % 20 == 0):
    usable = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in usable:
        if queries(q):
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


def run_topk(df, k=20):
    grid = df.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), topk.whole))
    return {tuple(r) for r in topk.top_k(grid, grid.where(F.col("vec_id") % 20 == 0), k).collect()}


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_VALUES", 64 * 8)
    monkeypatch.setattr(topk, "QUERY_VALUES", 5 * 8)
    monkeypatch.setattr(topk, "SEEDS", 30)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.2, 8))]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 360)]  # one very common vector: ties go to smaller ids
    rows += [(400, None), (420, [1.0, None]), (440, [float("nan")] * 8), (441, [float("inf")] * 8), (None, [0.5] * 8), (460, []), (480, [1.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert run_topk(df) == brute_topk(rows)
    assert run_topk(df, 400) == brute_topk(rows, 400)
    assert run_topk(df.limit(0)) == set()


def test_topk_large_values(spark):
    rows = [(20, [3e5, 2.0**40]), (1, [1e9, -(2.0**41)]), (2, [5.0, 7.0])]
    assert run_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == {(q, n, i, max(-(2**63), min(2**63 - 1, s))) for q, n, i, s in brute_topk(rows)}


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(0, 9, (500, 6)))
    lists = topk.SortedLists(np.arange(500), x)
    q = np.round(rng.normal(0, 9, (4, 6)))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    for depth in (1, 60, 250, 500):
        rows = lists.seen(depth)
        low, high = lists.bounds(depth, rows, up, down)
        scores = q @ lists.x[rows].T
        assert (low <= scores).all() and (scores <= high).all()
        unseen = np.setdiff1d(np.arange(500), rows)
        outside = np.array([lists.outside(depth, u, d) for u, d in zip(up, down)])
        assert (q @ lists.x[unseen].T <= outside[:, None]).all()
    assert (low == high).all()


@pytest.mark.parametrize("reach", [None, 900.0])
def test_reading_stops_early(reach):
    """Long-tailed lists of which a query needs few: a small part of their entries is read, few scores are resolved."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.pareto(1.5, (4000, 12)) * 3)
    q = np.where(rng.random((20, 12)) < 0.25, np.floor(rng.random((20, 12)) * 5) + 1, 0)
    lists = topk.SortedLists(np.arange(4000), x)
    found = {j: (ids, scores) for j, ids, scores in lists.search(np.arange(20) - 50, q, 10, None if reach is None else np.full(20, reach))}
    for j in range(20):
        scores = lists.x @ q[j]
        want = [i for i in np.lexsort((np.arange(4000), -scores))[:10] if reach is None or scores[i] >= reach]
        assert found[j][0].tolist() == want and found[j][1].tolist() == scores[want].tolist()
    assert lists.read < 0.3 * 4000 * np.count_nonzero(q) and lists.resolved < 0.05 * 4000 * 20


# --- op2


def brute_license(text, threshold=0.8):
    best = None
    lines = (text or "").split("\n")
    for line, unit in enumerate([text or "", *lines]):
        w = [x for x in re.split(r"[^\w]+|_", "".join(c.lower() if c.isascii() else c for c in unit)) if x]
        own = Counter(zip(w, w[1:]))
        for name, body in sorted(licenses.TEMPLATES.items()):
            t = licenses.words_of(body)
            other = Counter(zip(t, t[1:]))
            total = sum(own.values()) + sum(other.values())
            score = 2 * sum((own & other).values()) / total if own else 0
            if score >= threshold and (best is None or (-score, name, line) < best):
                best = (-score, name, line)
    return (None, 0.0, None) if best is None else (best[1], -best[0], best[2])


def test_licenses(spark, docs, nothing, clashing):
    texts = [
        licenses.TEMPLATES["MIT"], "Copyright X\n" + licenses.TEMPLATES["MIT"], licenses.TEMPLATES["MIT"] + " of the and" * 3, "some words\nLicensed under CC BY-NC 4.0.\nmore", "licensed UNDER the apache license version 2 0",
        "Released under the MIT License. Released under the MIT License.", licenses.TEMPLATES["GPL-3.0-header"].replace("program", "library"), "Licensed under the", words(200, 9), "license",
    ]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: (r.licence, r.score, r.line) for r in licenses.license_scan(df).collect()}
    assert got == {i: brute_license(t) for i, t in enumerate(texts)}
    assert got[0][0] == "MIT" and got[3] == ("CC-BY-NC-4.0-notice", 1.0, 2)
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in licenses.license_scan(docs).collect()} == ids
    assert licenses.license_scan(nothing).collect() == []
    assert licenses.license_scan(clashing).columns == ["doc_id", "licence", "score", "line"]
    assert {r.licence for r in licenses.license_scan(df, {}).collect()} == {None}


def brute_spans(text, templates, threshold=0.8):
    """Every span of words against every template; of those that overlap, the one that shares most stays."""
    where = [(w, n) for n, line in enumerate((text or "").split("\n"), 1) for w in re.split(r"[^\w]+|_", "".join(c.lower() if c.isascii() else c for c in line)) if w]
    grams = [(a[0], b[0]) for a, b in zip(where, where[1:])]

    def apart(spans):
        kept = []
        for s in sorted(spans):
            if all(k[3] > s[4] + 1 or s[3] > k[4] + 1 for k in kept):
                kept.append(s)
        return kept

    spans = []
    for name, body in templates.items():
        t = licenses.words_of(body)
        other, own = Counter(zip(t, t[1:])), []
        for first in range(len(grams)):
            seen, shared = Counter(), 0
            for last in range(first, len(grams)):
                if last - first + 1 > 1.5 * other.total() + 1:
                    break  # no longer span reaches the threshold: test_size_bounds_lose_nothing
                seen[grams[last]] += 1
                shared += seen[grams[last]] <= other[grams[last]]
                score = 2 * shared / (last - first + 1 + other.total())
                if score >= threshold:
                    own.append((0, -score, name, first, last, shared))
        spans += [(-x[5], *x[1:5]) for x in apart(own)]
    best = {}
    for _, worse, name, first, last in apart(spans):
        line = 0 if (first, last) == (0, len(grams) - 1) else where[first][1]
        best[name] = min(best.get(name, (worse, line)), (worse, line))
    return {(name, -worse, line) for name, (worse, line) in best.items()} or {(None, 0.0, None)}


def wrapped(text, width=9, mark="# "):
    w = text.split()
    return "\n".join(mark + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def test_license_spans(spark, docs, nothing, clashing, tmp_path):
    t = licenses.TEMPLATES
    code = "\nimport os\n" + words(300, 21) + "\n"
    texts = [
        code + wrapped(t["Apache-2.0-header"]) + code, code + wrapped(t["GPL-3.0-header"].replace("program", "library"), 7, " * ") + code, f"{words(60, 22)} {t['MIT-notice']} {words(60, 23)}",
        code + t["MIT-notice"] + code + t["CC-BY-NC-4.0-notice"] + code + wrapped(t["Zlib"]), t["LGPL-3.0-notice"] + code + t["GPL-3.0-notice"].replace("public", "open"), "Released under the MIT License. Released under the MIT License.",
        t["GPL-3.0-notice"], "the software " * 300, t["MIT"] + " of the and" * 3, "Licensed under the", "license", "", None, wrapped(t["ISC"]).upper(),
    ]
    df = spark.createDataFrame([(i, x, None, None, None) for i, x in enumerate(texts)], DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = defaultdict(set)
    for r in licenses.op2_licenses(spark, str(tmp_path)).collect():
        assert r.doc_id is not None and (r.licence, r.score, r.line) not in got[r.doc_id]
        got[r.doc_id].add((r.licence, r.score, r.line))
    assert ("Apache-2.0-header", 1.0, 4) in got[0] and {x[0] for x in got[1]} == {"GPL-3.0-header"} and got[2] == {("MIT-notice", 1.0, 1)}
    assert {x[0] for x in got[3]} == {"MIT-notice", "CC-BY-NC-4.0-notice", "Zlib"}
    assert got == {i: brute_spans(x, t) for i, x in enumerate(texts)}
    found = licenses.license_spans(docs)
    assert Counter(r.doc_id for r in found.collect()) == Counter(r.doc_id for r in docs.collect())
    assert licenses.license_spans(nothing).collect() == []
    assert licenses.license_spans(clashing).columns == ["doc_id", "licence", "score", "line"]
    assert {r.licence for r in licenses.license_spans(df, {}).collect()} == {None}


def test_size_bounds_lose_nothing():
    for m in (1, 4, 37, 200):
        low, high = licenses.size_bounds(m, 0.8)
        assert all((low <= n <= high) == (2 * min(n, m) / (n + m) >= 0.8) for n in range(1, 3 * m))


# --- op6


def test_warc(spark):
    page, other = "<html>" + "x" * 1000, "<html>" + "yé" * 700
    rows = [(1, "http://a", page), (5, "http://b", page), (3, None, page), (2, "u", other), (9, "v\r\nx: y", "small"), (8, "w", "small"), (10, "n", None), (11, "e", ""), (None, "q", page), (4, "four", "z" * 999), (6, "six", "z" * 999)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = warc.make_folder(spark, "test-warc")
    index = warc.write_archives(df, folder)
    got = {r.page_id: r for r in warc.read_records(index, folder).collect()}
    assert len(got) == len(rows) == index.count()
    for i, url, html in rows:
        r, data = got[i], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        revisit = html == page and i != 5
        assert (r.record_type, r.refers_to) == (("revisit", 5) if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else data)
    some = warc.read_records(index.where("page_id in (2, 9)"), folder).collect()
    assert {r.page_id for r in some} == {2, 9}
    none = df.limit(0)
    assert warc.read_records(warc.write_archives(none, folder), folder).collect() == []


def test_warc_spans():
    assert list(warc.spans([(0, 10), (10, 5), (40, 5), (200, 50)], gap=30, most=60)) == [(0, 0, 45), (3, 200, 250)]
    assert list(warc.spans([(0, 10), (10, 100)], gap=30, most=60)) == [(0, 0, 10), (1, 10, 110)]
    assert list(warc.spans([])) == []


# --- op5


def brute_near(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links, up = Counter(), {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (root(i), links[i]) for i in sets}


def planted(n_groups=12, copies=6):
    r, rows = random.Random(8), []
    for g in range(n_groups):
        base = words(r.choice([30, 120, 300]), 1000 + g, 2000).split()
        for c in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = f"edit{r.randrange(99)}"
            rows.append((len(rows), " ".join(w).upper() if c % 3 == 2 else " ".join(w) + "."))
    return rows + [(500 + i, words(50, i, 5000)) for i in range(30)] + [(600, ""), (601, None), (602, "!!"), (603, "two words"), (604, "Two words!")]


@pytest.mark.parametrize("block", [512, 3])
def test_near_join(spark, monkeypatch, block):
    """Small blocks deal every bucket and part to many cells."""
    monkeypatch.setattr(near_join, "BLOCK", block)
    rows = planted()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_duplicates(df).collect()}
    want = brute_near(rows)
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) <= 0.02 * len(want), wrong  # the search finds a pair at the threshold with 99.8 %


def test_near_join_large_group(spark):
    base = words(100, 77, 5000).split()
    rows = [(i, " ".join([*base[: 10 + i % 60], f"v{i}", *base[10 + i % 60 :]])) for i in range(300)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_duplicates(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)).collect()}
    want = brute_near(rows)
    assert all(got[i][0] == want[i][0] for i in want)
    assert sum(n for _, n in got.values()) >= near_join.TARGET * sum(n for _, n in want.values())


def test_near_join_awkward(docs, nothing, clashing):
    got = near_join.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[8].class_id == by_id[9].class_id == by_id[10].class_id == by_id[11].class_id == 8
    assert by_id[8].n_links == 3 and by_id[None].class_id == 5 and by_id[0].n_links == 0
    assert near_join.near_duplicates(nothing).collect() == []
    assert near_join.near_duplicates(clashing).count() == len(awkward_texts())


def test_shortest_prefix_holds_the_target():
    assert near_join.shortest_prefix(0.8, 0.9995) == 5 and near_join.met_by(0.8, 5) >= 0.9995 > near_join.met_by(0.8, 6)
    assert near_join.shortest_prefix(0.99, 0.9) == near_join.DEPTH
    assert near_join.shortest_prefix(0.1, 0.9999) == 1


def test_texts_amid_close_copies_stop_on_long_prefixes(spark):
    """A text climbs until what it should still miss is little of what it has found; one alone climbs to the shortest prefix."""
    base = words(400, 31, 10**6).split()
    rows = [(i, " ".join([*base[: 9 + i], f"v{i}", *base[9 + i :]])) for i in range(150)]  # each pair shares 0.95 and more
    rows += [(1000 + i, " ".join([*words(200, 50, 10**6).split()[: 200 - 30 * i], *words(30 * i, 51, 10**6).split()])) for i in range(2)]
    texts = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    signed = near_join._sign_task([pa.RecordBatch.from_arrays([pa.array([t for _, t in rows]), pa.array([i for i, _ in rows]), pa.array([i for i, _ in rows])], names=["text", "row_key", "id"])])
    signed = spark.createDataFrame([tuple(r.values()) for b in signed for r in b.select(["digest", "size", "mark"]).to_pylist()], "digest binary, size int, mark binary")
    met = near_join.climb(signed).select(F.expr("length(prefix) div 2").alias("length"), "digest", "active").collect()
    digests = {bytes(r.digest): i for (i, _), r in zip(rows, signed.collect())}
    climbed = {i: min((r.length for r in met if digests[bytes(r.digest)] == i and r.active), default=None) for i, _ in rows}
    assert sum(climbed[i] >= 6 for i in range(150)) > 140
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_duplicates(texts).collect()}
    assert got == brute_near(rows)


def test_near_copies_without_ids(spark, monkeypatch):
    """Rows are told apart by place: what is sent to verification grows with the rows, not with pairs of them."""
    sent, cells = [], near_join.together
    monkeypatch.setattr(near_join, "together", lambda df, key: sent.append(df.count()) or cells(df, key) if "text" in df.columns else cells(df, key))
    base = words(300, 78, 5000).split()
    rows = [(None, " ".join([*base[: 10 + i], f"v{i}", *base[10 + i :]]), None, None, None) for i in range(200)]
    got = near_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert [(r.class_id, r.n_links) for r in got] == [(None, 199)] * 200 and sum(r.kept for r in got) == 1
    assert sum(sent) <= 200 * near_join.TREES


def test_long_chain_of_links(spark):
    """Each text is linked to the next ones only: one class, few links, whatever its length."""
    w = words(900, 79, 10**6).split()
    rows = [(i, " ".join(w[5 * i : 5 * i + 104])) for i in range(150)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_duplicates(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)).collect()}
    want = brute_near(rows)
    assert sum(got[i] != want[i] for i in want) <= 4


def test_near_join_at_a_lower_threshold(spark):
    """Pairs a little above a threshold of 0.5 are all linked; a fixed filter for 0.8 would throw them away."""
    assert near_join.least_equal() > 80 > near_join.least_equal(0.5)
    rows = []
    for k in range(20):
        w = words(100, 700 + k, 10**6).split()
        rows += [(2 * k, " ".join(w), None, None, None), (2 * k + 1, " ".join(w[:68]) + " " + words(32, 900 + k, 10**6), None, None, None)]
    got = near_join.near_duplicates(spark.createDataFrame(rows, DOCS), threshold=0.48).collect()
    assert sum(r.n_links for r in got) == 40 and all(r.class_id == r.doc_id // 2 * 2 for r in got)


def test_word_hashes_across_chunks(monkeypatch):
    text = words(500, 3) + " ÉtÉ " + "y" * 50
    whole = text_features.word_hashes(text)
    monkeypatch.setattr(text_features, "_CHUNK", 97)
    assert (text_features.word_hashes(text) == whole).all()
    assert (text_features.word_hashes("A-bÉ") == text_features.word_hashes("a Bé"[:1] + " bé")).all()


def test_word_hashes_tell_swapped_letters_apart():
    r, seen = random.Random(6), {}
    for w in {"".join(r.choice("abcdefw012345") for _ in range(r.randint(2, 6))) for _ in range(20_000)}:
        assert seen.setdefault(int(text_features.word_hashes(w)[0]), w) == w


def test_texts_side_by_side_are_hashed_as_alone(monkeypatch):
    texts = ["", "one two three four five six", "a", "\n\n", "Naïve — Ünïcode 12 34 x", "end", "start " * 40, " \t ", "one two three four five six"]
    for together in (1, 30, 1 << 17):
        monkeypatch.setattr(text_features, "_TOGETHER", together)
        words = text_features.word_hashes_of(texts)
        assert [w.tolist() for w in words] == [text_features.word_hashes(t).tolist() for t in texts]
        assert [s.tolist() for s in text_features.shingles_of(words)] == [text_features.shingles(w).tolist() for w in words]
    assert text_features.word_hashes_of([]) == text_features.shingles_of([]) == []


def test_roots_of_links():
    rng = random.Random(3)
    for n in (1, 2, 9, 60):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)] + [(k, k + 1) for k in range(n // 3)]
        want = list(range(n))
        for _ in range(n):
            for a, b in pairs:
                want[a] = want[b] = min(want[a], want[b])
        got = near_join.roots(n, np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int))
        assert got.tolist() == want
