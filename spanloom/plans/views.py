"""Genomic views over the test tables, as SQL that Spark and DuckDB both run.

Bounds are called ``s`` and ``e`` in SQL, ``start`` and ``end`` in the DataFrames. Everything is derived from keys, so both engines see the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "iv_a": "SELECT concat('chr', CAST(l_partkey % 24 AS STRING)) AS chrom, l_orderkey * 7 + l_linenumber * 13 AS s, l_orderkey * 7 + l_linenumber * 13 + CAST(l_quantity AS BIGINT) AS e FROM lineitem",
    "iv_b": "SELECT o_orderkey AS row_id, concat('chr', CAST(o_custkey % 24 AS STRING)) AS chrom, o_orderkey * 5 AS s, o_orderkey * 5 + 1 + o_orderkey % 60 AS e FROM orders",
    "variants": "SELECT event_id AS row_id, concat('chr', CAST(user_id % 24 AS STRING)) AS chrom, event_id * 3 + 1 AS pos, substr('ACGT', CAST(1 + event_id % 4 AS INT), 1) AS ref, substr('ACGT', CAST(1 + (event_id + 1 + user_id % 3) % 4 AS INT), 1) AS alt, event_type = 'purchase' AS label, CASE WHEN isnan(value) THEN NULL ELSE value END AS score, event_type AS subset FROM events",
    "pip": "SELECT l_partkey AS variant, l_suppkey AS study, l_returnflag AS method, CASE WHEN l_tax = 0.08 THEN NULL ELSE round(l_discount * 10, 2) END AS pip FROM lineitem",
    "seqs": "SELECT CAST(doc_id AS STRING) AS id, translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,\n', 'acgtacgtacgtacgtacgtacgtacACGTACGTACGTACGTACGTACGTACnNnN') AS raw FROM documents",
    "pairs": "SELECT CAST(floor(o_orderkey / CAST(2 AS DOUBLE)) AS BIGINT) AS match_group, o_orderkey % 2 = 1 AS label, o_totalprice AS score, -o_totalprice * o_orderkey AS other FROM orders",
    "scored": "SELECT documents.doc_id AS id, labels.quality = 1 AS label, CAST(documents.n_chars AS DOUBLE) AS score, documents.lang AS subset FROM labels JOIN documents ON labels.doc_id = documents.doc_id",
    "signal": "SELECT concat('chr', CAST(o_orderkey % 4 AS STRING)) AS chrom, o_orderkey * 10 AS s, o_orderkey * 10 + 10 AS e, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE round(o_totalprice / 100000 - 2, 4) END AS value FROM orders",
    "hits": "SELECT concat('q', CAST(l_orderkey % 1000 AS STRING)) AS query, concat('chr', CAST(l_suppkey % 24 AS STRING)) AS target, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey + CAST(l_quantity AS BIGINT) ELSE l_partkey END AS tstart, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_partkey + CAST(l_quantity AS BIGINT) END AS tend, round(l_extendedprice, 2) AS bits FROM lineitem",
    "gtf": """SELECT concat('chr', CAST(CAST(floor(p_partkey / CAST(4 AS DOUBLE)) AS BIGINT) % 24 AS STRING)) AS chrom, kind AS feature, p_partkey * 100 + 5 * part_of AS s, p_partkey * 100 + 40 + p_size - 5 * part_of AS e,
 CASE WHEN CAST(floor(p_partkey / CAST(4 AS DOUBLE)) AS BIGINT) % 2 = 0 THEN '+' ELSE '-' END AS strand,
 concat('gene_id "g', CAST(CAST(floor(p_partkey / CAST(8 AS DOUBLE)) AS BIGINT) AS STRING), '"; transcript_id "t', CAST(CAST(floor(p_partkey / CAST(4 AS DOUBLE)) AS BIGINT) AS STRING), '"; ',
  CASE CAST(floor(p_partkey / CAST(4 AS DOUBLE)) AS BIGINT) % 3 WHEN 0 THEN 'gbkey "mRNA"; transcript_biotype "mRNA"; gene_biotype "protein_coding";' WHEN 1 THEN concat('transcript_biotype "lnc_RNA"; gene_biotype "',
   CASE CAST(floor(p_partkey / CAST(4 AS DOUBLE)) AS BIGINT) % 11 WHEN 0 THEN 'transcribed_pseudogene";' WHEN 1 THEN 'lncRNA"; pseudo "true";' WHEN 2 THEN 'lncRNA"; partial "true";' WHEN 3 THEN 'lncRNA"; description "an NMD candidate";'
   WHEN 4 THEN 'lncRNA"; product "x, NMD candidate";' WHEN 5 THEN 'lncRNA"; product "LOW QUALITY RNA";' ELSE 'lncRNA";' END) ELSE 'transcript_biotype "TEC"; pseudo "true";' END,
  CASE WHEN kind = 'transcript' AND p_partkey % 5 = 0 THEN ' tag "Ensembl_canonical";' ELSE '' END) AS attribute
 FROM part CROSS JOIN (SELECT 'exon' AS kind, 0 AS part_of UNION ALL SELECT 'CDS', 1 UNION ALL SELECT 'transcript', 0) AS kinds WHERE kind = 'exon' OR (kind = 'CDS' AND p_size > 10) OR (kind = 'transcript' AND p_partkey % 4 = 0)""",
    "ens": """SELECT concat('chr', CAST(CAST(floor(p_partkey / CAST(8 AS DOUBLE)) AS BIGINT) % 24 AS STRING)) AS chrom, kind AS feature,
 CASE kind WHEN 'gene' THEN p_partkey * 100 WHEN 'transcript' THEN p_partkey * 100 ELSE p_partkey * 100 + 5 * part_of END AS s,
 CASE kind WHEN 'gene' THEN p_partkey * 100 + 790 WHEN 'transcript' THEN p_partkey * 100 + 390 ELSE p_partkey * 100 + 40 + p_size - 5 * part_of END AS e,
 CASE WHEN CAST(floor(p_partkey / CAST(8 AS DOUBLE)) AS BIGINT) % 2 = 0 THEN '+' ELSE '-' END AS strand,
 concat('gene_id "g', CAST(CAST(floor(p_partkey / CAST(8 AS DOUBLE)) AS BIGINT) AS STRING), '"; ',
  CASE WHEN kind = 'gene' THEN '' ELSE concat('transcript_id "t', CAST(CAST(floor(p_partkey / CAST(4 AS DOUBLE)) AS BIGINT) AS STRING), '"; transcript_biotype "',
   CASE CAST(floor(p_partkey / CAST(4 AS DOUBLE)) AS BIGINT) % 5 WHEN 0 THEN 'lncRNA' WHEN 1 THEN 'misc_RNA' ELSE 'protein_coding' END, '"; ') END,
  CASE WHEN kind = 'transcript' AND CAST(floor(p_partkey / CAST(4 AS DOUBLE)) AS BIGINT) % 3 <> 0 THEN 'tag "Ensembl_canonical"; ' ELSE '' END) AS attribute
 FROM part CROSS JOIN (SELECT 'exon' AS kind, 0 AS part_of UNION ALL SELECT 'CDS', 1 UNION ALL SELECT 'transcript', 0 UNION ALL SELECT 'gene', 0) AS kinds
 WHERE kind = 'exon' OR (kind = 'CDS' AND p_size > 10 AND p_partkey % 4 IN (1, 2)) OR (kind = 'transcript' AND p_partkey % 4 = 0) OR (kind = 'gene' AND p_partkey % 8 = 0)""",
    "cre": "SELECT o_orderkey AS row_id, concat('chr', CAST(o_custkey % 24 AS STRING)) AS chrom, o_orderkey * 6 AS s, o_orderkey * 6 + 150 + o_orderkey % 200 AS e, CASE CAST(floor(o_orderkey / CAST(3 AS DOUBLE)) AS BIGINT) % 4 WHEN 0 THEN 'PLS' WHEN 1 THEN 'dELS' WHEN 2 THEN 'pELS' ELSE 'CA-H3K4me3' END AS cre_class FROM orders",
    "gaps": "SELECT o_orderkey AS row_id, concat('chr', CAST(o_custkey % 24 AS STRING)) AS chrom, o_orderkey * 5 AS s, o_orderkey * 5 + 1 + o_orderkey % 60 AS e FROM orders WHERE o_orderkey % 60 > 50",
    "genes": "SELECT p_partkey AS gene, concat('chr', CAST(p_partkey % 24 AS STRING)) AS chrom, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, p_partkey * 40 AS s, p_partkey * 40 + 200 + p_size AS e FROM part",
}


def sql_for_duckdb(sql: str) -> str:
    """``sql`` behind the views that it names."""
    named: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            named.append(f"{name} AS ({VIEWS[name]})")
    head = "WITH " + ("RECURSIVE " if re.search(r"^\s*WITH RECURSIVE", sql) else "")
    rest = re.sub(r"^\s*WITH (RECURSIVE )?", ", ", sql)
    return (head + ", ".join(named) + (rest if rest != sql else " " + sql.strip())) if named else sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, as a DataFrame, a view's bounds renamed to ``start`` and ``end``."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "events", "documents", "labels", "part") if re.search(rf"\b{t}\b", sql)}
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}} AS {t}", sql)
    df = spark.sql(sql, **tables)
    return df.withColumnsRenamed({"s": "start", "e": "end"})
