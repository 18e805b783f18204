"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns: each operator gives a defined result for them."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import bpe, chat, fingerprints, langid, licenses, neardup, packing, quality, tokencount, topk

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXT = "The quick brown fox jumps over the lazy dog. " * 3
ODD = [(1, TEXT, "en"), (1, TEXT, "en"), (2, None, "en"), (3, "", None), (None, TEXT, "en"), (4, "x " * 60_000, "en"), (5, "ß <|endoftext|> 1² 🙂", "de"), (6, "...", "de"), (1 << 60, TEXT, None)]
CLASHES = ("ids", "score", "lang_pred", "language", "class_id", "kept", "key", "quality_score", "bands", "N", "start", "Length")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1), (5, 0), (5, 1)], "doc_id long, quality int").withColumn("text", F.lit("clash"))


OPERATORS = {
    "bpe": lambda d, _: bpe.encode_decode(d, WORD),
    "tokencount": lambda d, _: tokencount.count_tokens(d, WORD),
    "fingerprints": lambda d, _: fingerprints.compare_edited(d),
    "sketches": lambda d, _: fingerprints.fingerprint(d),
    "langid": lambda d, _: langid.identify(d, F.lit(True)),
    "quality": lambda d, labels: quality.rate(d, labels, F.lit(True)),
    "licenses": lambda d, _: licenses.scan(d),
    "neardup": lambda d, _: neardup.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(spark, odd, labels, name):
    got = OPERATORS[name](odd, labels)
    assert sorted((r["doc_id"] or -1) for r in got.collect()) == sorted((r[0] or -1) for r in ODD)
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_packing(spark, odd):
    rows = packing.pack_documents(odd, BYTE).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ODD}
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 1)
    assert next(r["doc_tokens"] for r in rows if r["doc_id"] == 2) == 1
    assert packing.pack_documents(odd.limit(0), BYTE).count() == 0


def test_near_duplicates(spark, odd):
    got = {(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(odd).collect()}
    assert got == {(1, 1), (1 << 60, 1), (2, 2), (3, 2), (None, None), (4, 4), (5, 5), (6, 6)}
    kept = neardup.keep_representatives(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 4, 5, 6]


def test_language_without_letters(spark, odd):
    got = {r["doc_id"]: r["language"] for r in langid.identify(odd, F.col("lang").isNotNull()).collect()}
    assert all(tuple(got[i]) == ("und", 0.0) for i in (2, 3, 6)) and got[1]["lang_pred"] == "en"


def test_topk(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, []), (None, [1.0, 1.0]), (6, [1.0, 0.5]), (7, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"vec": F.lit(1), "block": F.lit(2), "score": F.lit(3)})
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") == 0).collect()))
    assert got == [(0, 1, 1, 65536), (0, 2, 6, 65536), (0, 3, 7, -65536)]
    assert topk.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_calls(spark):
    calls = spark.createDataFrame(
        [(1, 1, "a", "f", '{"x": 1}', None), (1, 2, "b", "f", '{"x": "no"}', "a"), (1, 3, "c", "g", "{}", "b"), (1, 4, "d", "f", "nonsense", "e"), (1, 5, "e", "f", '{"x": 2, "y": [1]}', "d"), (1, 6, "a", "f", "{}", None), (2, 1, None, "f", None, None)],
        "conv_id long, turn long, call_id string, name string, arguments string, after string",
    ).withColumn("level", F.lit("clash"))
    results = spark.createDataFrame([(1, 7, "a", "done"), (1, 8, "z", None), (None, 9, "a", "x")], "conv_id long, turn long, call_id string, content string")
    got = {(r["conv_id"], r["call_id"], r["kind"]): r for r in chat.link_calls(calls, results, {"f": {"x": ("integer", True)}}).collect()}
    assert len(got) == 9 and got[1, "a", "repeated_call"]["problems"] == "duplicate,missing:x"  # no row is lost
    assert (got[1, "a", "call"]["problems"], got[1, "a", "call"]["linked"], got[1, "a", "call"]["level"]) == ("duplicate", True, 0)
    assert got[1, "b", "call"]["problems"] == "kind:x" and got[1, "b", "call"]["level"] == 1
    assert got[1, "c", "call"]["problems"] == "tool" and got[1, "c", "call"]["level"] == 2
    assert got[1, "d", "call"]["problems"] == "cycle,arguments" and got[1, "e", "call"]["problems"] == "cycle,extra:y"
    assert got[2, None, "call"]["problems"] == "arguments"
    assert got[1, "a", "call"]["json"] == '{"arguments":{"x":1},"call_id":"a","name":"f","result":{"content":"done"}}'
    assert got[1, "z", "orphan"]["json"] == '{"call_id":"z","content":null}'
    assert chat.link_calls(calls.limit(0), results.limit(0), {"f": {}}).count() == 0


def test_stages_of_the_pipeline(spark, odd, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == odd.columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()
