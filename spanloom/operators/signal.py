"""Signal tracks as runs ``chrom, start, end, value``; a gap is a missing row or a null or NaN value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .interval_joins import overlap_join


def known(track: DataFrame) -> DataFrame:
    return track.where(F.col("value").isNotNull() & ~F.isnan("value"))


def score_windows(windows: DataFrame, track: DataFrame, threshold: float) -> DataFrame:
    """Per window (unique ``row_id``): conserved bases, their share of the whole window, the mean over valid bases (null without any) and the valid bases."""
    pairs = overlap_join(windows.select("row_id", "chrom", "start", "end"), known(track))
    n = F.least("end", "end_b") - F.greatest("start", "start_b")
    agg = pairs.groupBy("row_id").agg(
        F.sum(F.when(F.col("value_b") >= threshold, n).otherwise(0)).alias("conserved_bases"), F.sum(n).alias("n_valid"), (F.sum(F.col("value_b").cast("double") * n) / F.sum(n)).alias("mean_score")
    )
    out = windows.join(agg.hint("merge"), "row_id", "left")
    return out.withColumns(
        {
            "conserved_bases": F.coalesce("conserved_bases", F.lit(0)).cast("int"),
            "n_valid": F.coalesce("n_valid", F.lit(0)).cast("int"),
            "proportion_conserved": (F.coalesce("conserved_bases", F.lit(0)) / (F.col("end") - F.col("start"))).cast("float"),
        }
    )


def values_at(points: DataFrame, track: DataFrame, pos: str = "pos") -> DataFrame:
    """The track's value at each 1-based position (null in gaps and on unknown chromosomes); ``row_id`` must be unique."""
    spots = points.select("row_id", "chrom", (F.col(pos) - 1).alias("start"), F.col(pos).alias("end"))
    hit = overlap_join(spots, known(track)).groupBy("row_id").agg(F.max("value_b").alias("value"))
    return points.join(hit.hint("merge"), "row_id", "left")


def histogram(track: DataFrame, low: float, high: float, n_bins: int) -> DataFrame:
    """Bases per bin of equal width; values are clipped into [low, high], the upper edge belongs to the last bin. Counts of parts add up."""
    width = (high - low) / n_bins
    v = F.greatest(F.lit(low), F.least(F.lit(high), F.col("value").cast("double")))
    bin_ = F.least(F.floor((v - low) / width), F.lit(n_bins - 1))
    return known(track).groupBy(bin_.cast("long").alias("bin")).agg(F.sum(F.col("end") - F.col("start")).alias("n"))


def merge_histograms(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("bin").agg(F.sum("n").alias("n"))


def _cumulative(hist: DataFrame, low: float, high: float, n_bins: int) -> DataFrame:
    """Bases at or above each bin's lower edge; at most ``n_bins`` rows."""
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    width = (high - low) / n_bins
    return hist.select("bin", "n", F.sum("n").over(down).alias("at_least"), (F.lit(low) + F.col("bin") * width).alias("edge"))


def count_at_least(hist: DataFrame, threshold: float, low: float, high: float, n_bins: int) -> DataFrame:
    """One row: bases at or above the threshold, linear inside its bin, rounded half to even."""
    width = (high - low) / n_bins
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(low) + (F.col("bin") + 1) * width - F.lit(threshold)) / width))
    return hist.agg(F.coalesce(F.bround(F.sum(F.col("n") * part)), F.lit(0.0)).cast("long").alias("count"))


def threshold_for_count(hist: DataFrame, target: DataFrame, low: float, high: float, n_bins: int) -> DataFrame:
    """The threshold that ``target`` (one row, ``count``) bases reach, linear inside the bin; ``low`` if there are fewer bases."""
    width = (high - low) / n_bins
    c = _cumulative(hist, low, high, n_bins).join(F.broadcast(target.select(F.col("count").cast("double").alias("goal"))))
    hit = c.where(F.col("at_least") >= F.col("goal")).agg(F.max_by(F.col("edge") + (F.col("at_least") - F.col("goal")) / F.col("n") * width, "bin").alias("threshold"))
    return hit.select(F.coalesce("threshold", F.lit(low)).alias("threshold"))


def calibrate(reference: DataFrame, cutoff: float, target: DataFrame, low: float, high: float, n_bins: int) -> DataFrame:
    """One row: the share of the reference's bases at or above ``cutoff`` and the threshold that gives the target track the same share."""
    a = count_at_least(reference, cutoff, low, high, n_bins).join(F.broadcast(reference.agg(F.sum("n").alias("total"))))
    share = a.select((F.col("count") / F.col("total")).alias("share"))
    goal = share.join(F.broadcast(target.agg(F.sum("n").alias("total")))).select("share", (F.col("share") * F.col("total")).alias("count"))
    return goal.select("share").join(F.broadcast(threshold_for_count(target, goal, low, high, n_bins)))


def anchor_profile(anchors: DataFrame, track: DataFrame, reach: int) -> DataFrame:
    """Mean value at each offset -reach .. reach (without 0) of ``chrom, pos, strand`` anchors, counted along the strand; gaps count 0.

    Each run of the track about an anchor adds its value where its offsets begin and takes it away behind them, so the profile is the running
    sum over the offsets, and no row stands for an anchor and an offset. Offsets before position 0 count for nothing."""
    spots = anchors.groupBy("chrom", "pos", "strand").agg(F.count("*").alias("times"))
    spots = spots.withColumns({"start": F.greatest(F.col("pos") - reach, F.lit(0)), "end": F.col("pos") + reach + 1}).where("end > 0")
    minus = F.coalesce(F.col("strand") == "-", F.lit(False))

    def events(rows: DataFrame, start, end, total, n) -> DataFrame:
        first = F.when(minus, F.col("pos") - end + 1).otherwise(start - F.col("pos"))
        last = F.when(minus, F.col("pos") - start).otherwise(end - 1 - F.col("pos"))
        both = F.array(F.struct(first.alias("offset"), total.alias("total"), n.alias("n")), F.struct((last + 1).alias("offset"), (-total).alias("total"), (-n).alias("n")))
        return rows.select(F.explode(both).alias("e")).select("e.*")

    times = F.col("times")
    found = overlap_join(spots, known(track))
    start, end = F.greatest("start", "start_b"), F.least("end", "end_b")
    changes = events(found, start, end, F.col("value_b").cast("double") * times, F.lit(0).cast("long")).union(events(spots, F.col("start"), F.col("end"), F.lit(0.0), times))
    per_offset = changes.groupBy("offset").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    line = Window.partitionBy(F.lit(0)).orderBy("offset")  # 2 * reach + 2 rows at most
    offsets = anchors.sparkSession.range(-reach, reach + 2).withColumnRenamed("id", "offset")
    sums = offsets.join(per_offset, "offset", "left").select("offset", F.sum(F.coalesce("total", F.lit(0.0))).over(line).alias("total"), F.sum(F.coalesce("n", F.lit(0))).over(line).alias("n"))
    return sums.where((F.col("offset") != 0) & (F.col("offset") <= reach) & (F.col("n") > 0)).select(F.col("offset").cast("int").alias("offset"), "n", (F.col("total") / F.col("n")).alias("mean"))
