"""One query for each text operator, over its whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, divergence, fingerprints, langid, licenses, neardup, packing, quality, setjoin, tokencount, topk, treaps
from .common import crc_bucket, table


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), budget=2048)


def packed_digests(docs: DataFrame) -> DataFrame:
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = crc_bucket("doc_id", 4)
    found = langid.identify(table(spark, sf_dir, "documents"), learn_from=bucket != 2)
    return found.select("doc_id", F.coalesce(bucket == 2, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")


def op10_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = crc_bucket("doc_id", 3)
    rated = quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=bucket != 1)
    return rated.select(
        "doc_id",
        F.coalesce(bucket == 1, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0, k=5)


OP1_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.vec, v.vec) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


#: The schema that the calls made from user turns are held against.
REPLY_SCHEMA = {"reply": {"text": ("string", True), "n_chars": ("integer", True), "urgent": ("boolean", False), "tag": ("string", False)}}


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a call of ``reply`` that waits for the user turn two before it; every other turn (a null role is
    not a user's) as the result of the turn before it.

    Some calls break the schema on purpose: no text where n_chars is divisible by 11, a number as tag where it is divisible by 7.
    """
    turns = table(spark, sf_dir, "conversations").withColumn("n_chars", F.length("text"))
    call_id = F.concat_ws(":", F.col("conv_id"), F.col("turn"))
    arguments = F.to_json(
        F.struct(
            F.when(F.col("n_chars") % 11 != 0, F.col("text")).alias("text"),
            "n_chars",
            F.when(F.col("text").contains("!"), F.lit(True)).alias("urgent"),
            F.when(F.col("n_chars") % 7 == 0, F.col("n_chars")).alias("tag"),
        )
    )
    calls = turns.where("role = 'user'").select(
        "conv_id", "turn", call_id.alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.concat_ws(":", F.col("conv_id"), F.col("turn") - 2).alias("after")
    )
    results = turns.where("role is null or role <> 'user'").select("conv_id", "turn", F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return chat.link_calls(calls, results, REPLY_SCHEMA)


OP2_SQL = """
WITH RECURSIVE u AS (SELECT conv_id, turn, text, length(text) AS n, to_json(text) AS j FROM conversations WHERE role = 'user'),
l AS (
  SELECT conv_id, turn, 0 AS level FROM u WHERE NOT EXISTS (SELECT 1 FROM u AS p WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2)
  UNION ALL SELECT u.conv_id, u.turn, l.level + 1 FROM l JOIN u ON u.conv_id = l.conv_id AND u.turn = l.turn + 2
), r AS (SELECT conv_id, turn, turn - 1 AS call, to_json(text) AS j FROM conversations WHERE role IS DISTINCT FROM 'user')
SELECT coalesce(u.conv_id, r.conv_id) AS conv_id, CAST(l.level AS BIGINT) AS level, coalesce(u.turn, r.turn) AS turn,
  concat(coalesce(u.conv_id, r.conv_id), ':', coalesce(u.turn, r.call)) AS call_id,
  CASE WHEN u.conv_id IS NULL THEN 'orphan' ELSE 'call' END AS kind,
  u.conv_id IS NOT NULL AND r.conv_id IS NOT NULL AS linked,
  CASE WHEN u.conv_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN n % 7 = 0 THEN 'kind:tag' END, CASE WHEN n % 11 = 0 THEN 'missing:text' END) END AS problems,
  CASE WHEN u.conv_id IS NULL THEN concat('{"call_id":"', r.conv_id, ':', r.call, '","content":', r.j, '}')
  ELSE concat('{"arguments":{"n_chars":', n, CASE WHEN n % 7 = 0 THEN concat(',"tag":', n) ELSE '' END, CASE WHEN n % 11 <> 0 THEN concat(',"text":', u.j) ELSE '' END,
    CASE WHEN contains(text, '!') THEN ',"urgent":true' ELSE '' END, '},"call_id":"', u.conv_id, ':', u.turn, '","name":"reply","result":',
    CASE WHEN r.conv_id IS NULL THEN 'null' ELSE concat('{"content":', r.j, '}') END, '}') END AS json
FROM u LEFT JOIN l USING (conv_id, turn) FULL JOIN r ON u.conv_id = r.conv_id AND u.turn = r.call
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = neardup.Scratch(spark).keep(treaps.build_index(table(spark, sf_dir, "documents")))
    return treaps.search(index, table(spark, sf_dir, "benchmark"), k=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_topk_search": op1_topk_search,
    "op2_tool_call_linking": op2_tool_call_linking,
    "op3_harmonic_packing": op3_harmonic_packing,
    "op4_fingerprints": op4_fingerprints,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_quality_ranking": op10_quality_ranking,
    "op11_source_divergence": op11_source_divergence,
    "op12_set_join": op12_set_join,
    "op13_lexical_search": op13_lexical_search,
}
ORACLE_SQL: dict[str, str] = {"op1_topk_search": OP1_SQL, "op2_tool_call_linking": OP2_SQL, "op9_license_scan": licenses.oracle_sql(), "op11_source_divergence": divergence.ORACLE_SQL, "op12_set_join": setjoin.ORACLE_SQL, "op13_lexical_search": treaps.ORACLE_SQL}
