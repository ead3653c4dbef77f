"""The pipeline's stages against brute force, on planted documents."""

import random
import zlib
from collections import Counter

import pytest
from test_operators import bad_text, brute_exact, good_text, lang_text

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    r = random.Random(1)
    texts = {}
    for i in range(160):
        lang = ["en", "de", "fr", "es"][i % 4]
        texts[i] = bad_text(i) if i % 5 == 0 else lang_text(lang, i) + " " + " ".join(lang_text(lang, i * 7 + k) for k in range(4)) + "."
    texts[200] = texts[1] + " "  # an exact copy that is longer
    texts[201] = texts[3].replace(" ", "  ", 1)
    near = texts[2].split()
    near[len(near) // 2] = "edited"
    texts[202] = " ".join(near)
    rows = [(i, t, ["en", "de", "fr", "es"][i % 4] if i < 160 else None, "s", len(t), r.randrange(9)) for i, t in texts.items()]
    rows += [(300, None, None, None, None, 1), (301, "123 456", "en", "s", 7, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep_id int").repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, folder)
        assert docs.columns == before.columns
        seen[name] = ({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in docs.collect()})
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    before, after = seen["quality"]
    clean = {i for i in before if i < 160 and i % 5}
    assert clean <= set(after) and not {i for i in after if i < 160 and i % 5 == 0}
    before, after = seen["language"]
    assert clean <= set(after) and not {300, 301} & set(after)
    before, after = seen["exact_duplicates"]
    assert set(after) == {r[0] for r in brute_exact(before.items()) if r[3]}
    assert 200 in after and 1 not in after
    before, after = seen["near_duplicates"]
    assert 2 in after and 202 not in after


def test_run(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in pieces}
    assert 200 in ids and not ids & {1, 202, 300, 301}
    assert max(Counter(r.sequence_id for r in pieces).values()) > 1
    assert zlib.crc32(b"") == 0 and good_text(1)  # helpers of the shared module are importable here


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
