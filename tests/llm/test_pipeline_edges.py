"""The whole pipeline, and operators by id, on odd and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import fingerprints, neardup, quality

TEXT = "The quick brown fox jumps over the lazy dog while the river runs slowly to the sea. " * 4
OTHER = "Nobody in the village had ever seen such a strange light above the hills before that night. " * 4
ODD = [(1, TEXT, "en", "a"), (1, OTHER, "en", "a"), (2, TEXT, "en", "b"), (None, TEXT, "en", "a"), (3, None, None, None), (4, "", "en", "a"), (5, "12 34 ...", "en", "a"), (6, OTHER + "word " * 30_000, "en", "b"), (7, OTHER, "en", None), (7, OTHER, "en", None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text").cast("long"), "score": F.lit("clash")})
    docs.write.parquet(f"{path}/full/documents.parquet")
    docs.limit(0).write.parquet(f"{path}/empty/documents.parquet")
    for name in ("full", "empty"):
        spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/{name}/labels.parquet")
    return path


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/empty").count() == 0
    rows = corpus_pipeline.run(spark, f"{folder}/full").collect()
    ids = {r["doc_id"] for r in rows}
    assert ids and not ids & {3, 4, 5}  # no letter
    assert sum(r["start"] == 0 and r["doc_id"] == 7 for r in rows) <= 1
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{folder}/full")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]


def test_one_id_with_different_texts(spark):
    docs = spark.createDataFrame([(1, TEXT), (1, OTHER), (2, TEXT), (3, OTHER), (4, "nothing like these at all, not one run of five words")], "doc_id long, text string")
    got = [tuple(r)[:2] for r in neardup.near_duplicates(docs).collect()]
    assert sorted(got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]  # rows of one id are one document, so they connect both texts
    prints = fingerprints.compare_edited(docs).collect()
    assert len(prints) == 5 and len({r["fingerprint"] for r in prints if r["doc_id"] == 1}) == 2


def test_equal_scores(spark):
    docs = spark.createDataFrame([(i, TEXT) for i in range(6)] + [(9, OTHER)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (9, 0)], "doc_id long, quality int")
    rated = quality.rate(docs, labels, F.lit(True)).collect()
    assert len({r["quality_score"] for r in rated if r["doc_id"] != 9}) == 1 and len(rated) == 7
