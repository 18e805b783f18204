"""Choosing one record of several: best hits, one genome a family, the most telling errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import keep_first


def hits_to_intervals(hits: DataFrame) -> DataFrame:
    """Search hits (1-based, reversed on the minus strand) as 0-based intervals with a strand."""
    minus = F.col("tend") < F.col("tstart")
    return hits.withColumns({"start": F.least("tstart", "tend") - 1, "end": F.greatest("tstart", "tend"), "strand": F.when(minus, "-").otherwise("+")}).withColumnRenamed("target", "chrom")


def best_hit(hits: DataFrame) -> DataFrame:
    """One hit a query: the most bits, then by place."""
    return keep_first(hits, ["query"], F.desc("bits"), F.col("chrom"), F.col("start"), F.col("end"))


def one_per_family(rows: DataFrame, forced: Sequence[str], source_order: Sequence[str], level_order: Sequence[str]) -> DataFrame:
    """One leaf a family (null families go): forced leaves first, then by source, assembly level, contig N50 (larger first) and name."""
    def rank(c: str, order: Sequence[str]) -> Column:
        return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(c)), F.lit(0)), F.lit(len(order) + 1))
    return keep_first(rows.where("family is not null"), ["family"], (~F.col("leaf").isin(*forced)).cast("int"), rank("quality_source", source_order), rank("assembly_level", level_order), F.desc_nulls_last("contig_n50"), F.col("leaf"))


def worst_errors(df: DataFrame, n: int, label: str = "label", score: str = "score", key: str = "id") -> DataFrame:
    """The ``n`` highest-scoring negatives and lowest-scoring positives."""
    fp = df.where(~F.col(label)).orderBy(F.desc(score), key).limit(n).withColumn("error", F.lit("false_positive"))
    fn = df.where(F.col(label)).orderBy(F.asc(score), key).limit(n).withColumn("error", F.lit("false_negative"))
    return fp.unionByName(fn)


def best_of_family(metrics: DataFrame, family: str, value: str, name: str) -> DataFrame:
    return keep_first(metrics, [family], F.desc(value), F.col(name))


def project_records(records: DataFrame, sizes: DataFrame, least: int, most: int, size: int) -> DataFrame:
    """Cross-species projection: join chromosome sizes (unknown ones go), keep groups on one chromosome and strand with a span of a
    fitting length, and resize to ``size`` inside the chromosome."""
    from . import intervals
    from .aggregates import single_place_groups

    sized = records.drop("t_src_size").join(sizes.select(F.col("chrom").alias("t_chrom"), F.col("size").alias("t_src_size")), "t_chrom")
    spans = single_place_groups(sized).withColumnsRenamed({"t_start": "start", "t_end": "end"})
    kept = intervals.filter_size(spans, least, most).where(F.col("t_src_size") >= size)
    return intervals.clamp_resize(kept, size, "t_src_size").withColumnsRenamed({"start": "t_start", "end": "t_end"})
