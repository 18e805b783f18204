"""Grouped aggregates, rankings and set operations that the pipelines share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def nearest_rank(df: DataFrame, column: str, q: float) -> float | None:
    """The value at the nearest rank ``round(q * (n - 1))`` (halves up) of the sorted non-null values; None where there is none."""
    return ranks.quantiles(df, [], column, [q], nearest=True).first()["quantiles"][0]


def keep_first(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """One row a key: the first in ``order``, which should end in a full tie-break. By rank; Spark keeps only the first row of a key in each
    task before the shuffle, so a hot key is combined there."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def single_place_groups(records: DataFrame) -> DataFrame:
    """Groups ``query_name, species`` on one chromosome and strand, as their span."""
    out = records.groupBy("query_name", "species").agg(
        F.min("t_chrom").alias("t_chrom"), F.max("t_chrom").alias("_c"), F.min("t_strand").alias("t_strand"), F.max("t_strand").alias("_s"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.min("t_src_size").alias("t_src_size")
    )
    return out.where("t_chrom = _c and t_strand = _s").drop("_c", "_s")


def label_by_pip(df: DataFrame, key: Sequence[str], above: float, below: float, null_guard: bool = True, extra: Sequence[Column] = ()) -> DataFrame:
    """Label keys by their largest probability: over ``above`` true; under ``below`` false, with ``null_guard`` only where no row's is null; others go."""
    agg = df.groupBy(*key).agg(F.max("pip").alias("pip"), F.max(F.col("pip").isNull()).alias("_null"), *extra)
    negative = (F.col("pip") < below) & (~F.col("_null") if null_guard else F.lit(True))
    return agg.withColumn("label", F.when(F.col("pip") > above, True).when(negative, False)).where("label is not null").drop("_null")


def combine_methods(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer join on the key; each column is the mean of both sides, or the side that has one, with the larger gap as ``<column>_gap``."""
    left, right = a.select(*key, *[F.col(c).alias(f"_{c}_a") for c in columns]), b.select(*key, *[F.col(c).alias(f"_{c}_b") for c in columns])
    out = left.join(right, list(key), "full")
    for c in columns:
        x, y = F.col(f"_{c}_a"), F.col(f"_{c}_b")
        out = out.withColumn(c, F.coalesce((x + y) / 2, x, y)).withColumn(f"{c}_gap", F.abs(x - y)).drop(f"_{c}_a", f"_{c}_b")
    return out


def lookup_or_default(df: DataFrame, table: DataFrame, key: Sequence[str], column: str, default: float) -> DataFrame:
    return df.join(table.select(*key, column), list(key), "left").withColumn(column, F.coalesce(column, F.lit(default)))


def diagonal_union(*frames: DataFrame) -> DataFrame:
    """Union by name; a column that a frame lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_by_source(frames: Sequence[tuple[str, DataFrame]], key: Sequence[str]) -> DataFrame:
    """Union of named sources, one row a key, from the earliest source that has it."""
    whole = diagonal_union(*[f.withColumns({"source": F.lit(n), "_order": F.lit(i)}) for i, (n, f) in enumerate(frames)])
    rest = [c for c in whole.columns if c not in (*key, "_order")]
    return keep_first(whole, key, F.col("_order"), *[F.col(c).asc_nulls_last() for c in rest]).drop("_order")


def composition(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per group and each one's share of all."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_total"))
    return n.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0)


def matching_capacity(df: DataFrame, strata: Sequence[str], k: int) -> DataFrame:
    """Per stratum the positives, the negatives, and how many positives could get ``k`` negatives each."""
    n = df.groupBy(*strata).agg(F.sum(F.when(F.col("label"), 1).otherwise(0)).alias("n_pos"), F.sum(F.when(F.col("label"), 0).otherwise(1)).alias("n_neg"))
    return n.withColumn("capacity", F.least("n_pos", F.floor(F.col("n_neg") / k)))


def hits_per_query(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Distinct targets of every query, zero for those without a hit."""
    n = hits.groupBy("query").agg(F.countDistinct("target").alias("n_hits"))
    return queries.join(n, "query", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))


def summary(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column).cast("double")
    return df.agg(F.count(column).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("least"), F.max(c).alias("most"))


def quantile_buckets(df: DataFrame, group: Sequence[str], column: str, n: int, where: Column | None = None) -> DataFrame:
    """Bucket 0 .. n-1 of each row by its group's quantile edges (of the rows that fulfil ``where``); equal values share a bucket."""
    base = df if where is None else df.where(where)
    edges = ranks.quantiles(base, group, column, [i / n for i in range(1, n)]).withColumnRenamed("quantiles", "_edges")
    out = df.join(edges, list(group), "left")
    return out.withColumn("bucket", F.aggregate("_edges", F.lit(0), lambda s, e: s + (F.col(column) > e).cast("int"))).drop("_edges")


def width_buckets(df: DataFrame, group: Sequence[str], column: str, n: int) -> DataFrame:
    """Bucket of equal width between the group's least and greatest value; 0 where all are equal."""
    ends = df.groupBy(*group).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    place = F.floor(F.try_divide((F.col(column) - F.col("_low")) * F.lit(n), F.col("_high") - F.col("_low")))
    return df.join(ends, list(group), "left").withColumn("bucket", F.greatest(F.lit(0), F.least(F.lit(n - 1), F.coalesce(place, F.lit(0))))).drop("_low", "_high")


def quantile_cut(df: DataFrame, group: Sequence[str], column: str, n: int) -> DataFrame:
    """``bucket`` of each row between the distinct edges among its group's ``n`` quantiles, closed on the right, the first on both sides; repeated edges
    make one bucket less. Null for a null value."""
    edges = ranks.quantiles(df, group, column, [i / n for i in range(n + 1)]).withColumn("_edges", F.array_distinct("quantiles")).drop("quantiles")
    out = df.join(edges, list(group), "left")
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    place = F.aggregate(inner, F.lit(0), lambda s, e: s + (F.col(column) > e).cast("int"))
    return out.withColumn("bucket", F.when(F.col(column).isNotNull(), place)).drop("_edges")


def scheme_bins(df: DataFrame, subset: str, column: str, scheme: dict[str, Sequence[float] | int], local: Sequence[str], floor: float = 1e-10) -> DataFrame:
    """``bin`` by a scheme for each subset: a list of edges gives ``<first eight letters>:b0, ...`` (closed on the right), a number ``n`` gives ``ll:0 .. ll:n-1``,
    equal parts of the logarithm between the least and greatest value of the row's ``local`` group. Other subsets are ``UNKNOWN``."""
    from ..functions.columns import edge_bins

    log = F.log10(F.greatest(F.lit(floor), F.least(F.col(column), F.lit(1.0))))
    ends = df.groupBy(*local).agg(F.min(log).alias("_low"), F.max(log).alias("_high"))
    label = F.lit("UNKNOWN")
    for name, rule in scheme.items():
        if isinstance(rule, int):
            place = F.floor(F.try_divide(log - F.col("_low"), (F.col("_high") - F.col("_low")) / rule))
            own = F.concat(F.lit("ll:"), F.greatest(F.lit(0), F.least(F.lit(rule - 1), F.coalesce(place, F.lit(0)))))
        else:
            own = F.concat(F.lit(f"{name[:8]}:"), edge_bins(F.col(column), list(rule), right_closed=True))
        label = F.when(F.col(subset) == name, own).otherwise(label)
    return df.join(ends, list(local)).withColumn("bin", label).drop("_low", "_high")
