"""Joins of intervals: overlap, coverage, nearest, and labels made from them.

Overlap joins are equi-joins on ``(chrom, bin)`` with bins of several widths. An interval lives at the level of the narrowest bins that are as
wide as itself, where it touches two at most, and stands in the bins that it touches at every wider level too. A pair is met at the
wider one of its two levels, in the one bin where the later of the two starts lies, so nothing is met twice, no interval makes more than
two rows a level, however long it is, and no chromosome is one task.

Joins of tables that grow with the input carry a merge hint: by their compressed size Spark takes tables of a million rows for small, and
would send them whole through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals
from .tiles import TILE, dealt, inside, with_carry, with_tile

#: Widths of bins, as powers of two. Intervals beyond the widest take as many of its bins as they touch.
LEVELS = (12, 16, 20, 24, 28)


def _binned(df: DataFrame, left: bool) -> DataFrame:
    """Rows with ``_bin``, one for each bin. A bin's number tells its level and whose own level it is: the left side's, where the right side
    is as narrow or narrower, or the right side's, where the left side is narrower."""
    length, last = F.col("end") - F.col("start"), F.greatest(F.col("start"), F.col("end") - 1)
    own = F.lit(len(LEVELS) - 1)
    for i in reversed(range(len(LEVELS) - 1)):
        own = F.when(length <= 1 << LEVELS[i], i).otherwise(own)
    bins = []
    for i, power in enumerate(LEVELS):
        touched = F.sequence(F.shiftright("start", power), F.shiftright(last, power))
        numbers = lambda side, t=touched, i=i: F.transform(t, lambda b: (b * 8 + i) * 2 + side)
        none = F.array().cast("array<bigint>")
        if left:
            bins.append(F.when(own == i, numbers(0)).when(own < i, numbers(1)).otherwise(none))
        else:
            bins += [F.when(own <= i, numbers(0)).otherwise(none), F.when(own == i, numbers(1)).otherwise(none)]
    typed = df.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})
    return typed.withColumn("_bin", F.explode(F.concat(*bins)))


def overlap_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs with ``a.start < b.end and b.start < a.end`` on one chromosome.

    Columns of ``b`` get the suffix ``_b``. ``how``: inner, or left_semi / left_anti, see ``_touched``.
    """
    if how != "inner":
        return _touched(a, b, how == "left_semi")
    right = _binned(b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns]).withColumnsRenamed({"start_b": "start", "end_b": "end"}), left=False)
    right = right.withColumnsRenamed({"start": "start_b", "end": "end_b", "_bin": "_bin_b"})
    left = _binned(a, left=True)
    meets = (F.col("chrom") == F.col("chrom_b")) & (F.col("_bin") == F.col("_bin_b")) & (F.col("start") < F.col("end_b")) & (F.col("start_b") < F.col("end"))
    power = F.element_at(F.array(*map(F.lit, LEVELS)), (F.pmod(F.shiftright("_bin", 1), F.lit(8)) + 1).cast("int"))
    later = F.call_function("shiftright", F.greatest("start", "start_b"), power)
    pairs = left.join(right.hint("merge"), meets & (F.shiftright("_bin", 4) == later))
    return pairs.drop("_bin", "_bin_b", "chrom_b")


def _touched(a: DataFrame, b: DataFrame, hit: bool, width: int = TILE) -> DataFrame:
    """Rows of ``a`` that overlap something of ``b``, or that don't.

    Of all ``b`` that start before a row's end, the one that reaches furthest tells: one pass along the axis, each row of both sides in it once."""
    lane = a.select("chrom", F.col("end").cast("long").alias("pos"), F.lit(0).alias("kind"), F.struct(*a.columns).alias("row"), F.lit(None).cast("long").alias("e"))
    known = b.where("chrom is not null and start is not null and end is not null")
    lane = lane.union(known.select("chrom", F.col("start").cast("long"), F.lit(1), F.lit(None).cast(lane.schema["row"].dataType), F.col("end").cast("long")))
    rows = dealt(with_carry(with_tile(lane, "pos", width), join="left", _reach=(F.max("e"), "max", "before")), "chrom", "_tile")
    reach = F.greatest("_reach", F.max("e").over(inside("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.withColumn("_far", reach).where("kind = 0").withColumn("_hit", F.coalesce(F.col("_far") > F.col("row.start"), F.lit(False)))
    return found.where(F.col("_hit") if hit else ~F.col("_hit")).select("row.*")


def covered_bases(windows: DataFrame, sets: DataFrame, names: Sequence[str], width: int = TILE) -> DataFrame:
    """``row_id`` and ``<name>_bp``, the bases of each window (unique ``row_id``) that the intervals of each set cover, which are ``name, chrom, start, end`` and disjoint inside a set.

    A window has the bases before its end without those before its start; both come from running sums along the axis, so no pairs are made."""
    point = lambda at, sign: F.struct(F.col(at).cast("long").alias("pos"), F.lit(sign).alias("sign"))
    asked = windows.select("row_id", "chrom", F.explode(F.array(point("start", -1), point("end", 1))).alias("x"))
    lane = asked.select("chrom", "x.pos", "row_id", "x.sign", F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("e"))
    lane = lane.union(sets.select("chrom", F.col("start").cast("long"), F.lit(None).cast(lane.schema["row_id"].dataType), F.lit(0), "name", F.col("end").cast("long")))
    of = lambda n, value: F.when(F.col("name") == n, value)
    bases, sums = F.col("e") - F.col("pos"), {}
    for i, n in enumerate(names):
        sums |= {f"_n{i}": (F.sum(of(n, bases)), "sum", "before"), f"_e{i}": (F.max(of(n, F.col("e"))), "max", "before")}
    rows = dealt(with_carry(with_tile(lane, "pos", width), **sums), "chrom", "_tile")
    line = inside("pos", "sign").rowsBetween(Window.unboundedPreceding, 0)
    before = {}
    for i, n in enumerate(names):
        upto = F.coalesce(f"_n{i}", F.lit(0)) + F.coalesce(F.sum(of(n, bases)).over(line), F.lit(0))
        ahead = F.greatest(F.lit(0), F.coalesce(F.greatest(f"_e{i}", F.max(of(n, F.col("e"))).over(line)) - F.col("pos"), F.lit(0)))
        before[n] = (upto - ahead).alias(f"_b{i}")
    points = rows.select("row_id", "sign", *before.values()).where("sign <> 0")
    return points.groupBy("row_id").agg(*[F.sum(F.col("sign") * F.col(f"_b{i}")).alias(f"{n}_bp") for i, n in enumerate(names)])


def numbered(df: DataFrame) -> DataFrame:
    """``row_id`` from the row's own columns and a count of equal rows before it, so that it stays the same when a task is run again."""
    order = Window.partitionBy(*df.columns).orderBy(F.lit(1))
    return df.withColumn("row_id", F.concat_ws("|", *df.columns, F.row_number().over(order)))


def coverage(a: DataFrame, b: DataFrame, name: str = "covered") -> DataFrame:
    """``a`` (with a unique ``row_id``) and how many of its bases the union of ``b`` covers."""
    pairs = overlap_join(a.select("row_id", "chrom", "start", "end"), intervals.merge(b))
    length = F.least("end", "end_b") - F.greatest("start", "start_b")
    summed = pairs.groupBy("row_id").agg(F.sum(length).alias(name))
    return a.join(summed.hint("merge"), "row_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def not_overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` (unique ``row_id``) that touch nothing of ``b``."""
    return overlap_join(a, b, "left_anti")


def within(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` (unique ``row_id``) that the union of ``b`` covers whole."""
    return coverage(a, b, "_covered").where(F.col("_covered") >= F.col("end") - F.col("start")).drop("_covered")


def nearest(points: DataFrame, targets: DataFrame, carry: str, width: int = TILE) -> DataFrame:
    """The distance of each point ``chrom, start, end`` to the nearest target and that target's ``carry``.

    Distance is 0 on overlap, else the gap ``max(start_b - end_a, start_a - end_b)`` (0 for neighbours that touch); ties go to the
    smaller ``carry``. Points on a chromosome without targets get nulls. One pass along the axis: before a point lies the target that
    reaches furthest, behind it the one that starts first.
    """
    extra = [c for c in points.columns if c not in ("chrom", "start", "end")]
    key = F.struct(*extra, "start", "end")
    lane = points.select("chrom", (F.col("end") - 1).alias("pos"), F.lit(1).alias("kind"), key.alias("point"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"), F.lit(None).cast(targets.schema[carry].dataType).alias("who"))
    lane = lane.union(targets.select("chrom", F.col("start"), F.lit(0), F.lit(None).cast(lane.schema["point"].dataType), "start", "end", carry))
    is_target = F.col("kind") == 0
    rows = with_carry(
        with_tile(lane, "pos", width),
        _reach=(F.max("e"), "max", "before"),
        _ahead=(F.min(F.when(is_target, F.struct(F.col("s"), F.col("who")))), "min", "after"),
    )
    past, rest = (inside(*order).rowsBetween(Window.unboundedPreceding, 0) for order in (("pos", "kind"), (F.desc("pos"), F.desc("kind"))))
    found = rows.select(
        "chrom",
        "kind",
        "point",
        F.greatest("_reach", F.max("e").over(past)).alias("reach"),
        F.coalesce(F.min(F.when(is_target, F.struct("s", "who"))).over(rest), "_ahead").alias("ahead"),
    ).where("kind = 1")
    start, end = F.col("point.start"), F.col("point.end")
    left = F.when(F.col("reach") > start, 0).otherwise(start - F.col("reach"))
    placed = found.select("chrom", "point", "reach", left.cast("long").alias("dl"), (F.col("ahead.s") - end).alias("dr"), F.col("ahead.who").alias("who_right"))
    # the name behind the furthest reach: an equi-join on (chrom, end) for points outside, the overlap join for points inside
    by_end = targets.groupBy(F.col("chrom").alias("c"), F.col("end").alias("at")).agg(F.min(carry).alias("who_left"))
    outside = placed.join(by_end.hint("merge"), (placed["chrom"] == by_end["c"]) & (placed["reach"] == by_end["at"]) & (placed["reach"] <= placed["point.start"]), "left")
    over = overlap_join(points.withColumn("_key", key), targets).groupBy("chrom", F.col("_key").alias("k")).agg(F.min(f"{carry}_b").alias("who_over"))
    named = outside.join(over.withColumnRenamed("chrom", "c2").hint("merge"), (F.col("chrom") == F.col("c2")) & (F.col("point") == F.col("k")), "left")
    distance = F.when(F.col("who_over").isNotNull(), 0).otherwise(F.least("dl", "dr"))
    who = F.when(F.col("who_over").isNotNull(), F.col("who_over")).when(F.col("dl") < F.col("dr"), F.coalesce("who_left", "who_right")).when(F.col("dl") > F.col("dr"), F.col("who_right")).otherwise(F.least("who_left", "who_right"))
    return named.select("chrom", start.alias("start"), end.alias("end"), *[F.col(f"point.{c}").alias(c) for c in extra], distance.cast("long").alias("distance"), who.alias(carry))


def bin_labels(windows: DataFrame, positives: DataFrame, bin_size: int, n_bins: int, threshold: float) -> DataFrame:
    """``labels``: for each of a window's bins whether at least ceil(threshold * bin_size) of its bases are covered; and how many are."""
    exact = F.when(F.col("end") - F.col("start") != bin_size * n_bins, F.raise_error(F.lit("window isn't n_bins bins long")).cast("int")).otherwise(F.lit(n_bins - 1))
    bins = windows.select("row_id", "chrom", "start", F.explode(F.sequence(F.lit(0), exact)).alias("bin"))
    bins = bins.select(F.struct("row_id", "bin").alias("row_id"), "chrom", (F.col("start") + F.col("bin") * bin_size).alias("start"), (F.col("start") + (F.col("bin") + 1) * bin_size).alias("end"))
    need = -(-int(round(threshold * bin_size * 1000)) // 1000)
    hit = coverage(bins, positives).select("row_id.row_id", "row_id.bin", (F.col("covered") >= need).cast("tinyint").alias("label"))
    labels = hit.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "label"))), lambda x: x["label"]).alias("labels"), F.sum("label").cast("long").alias("n_positive_bins"))
    return windows.join(labels.hint("merge"), "row_id")


def priority_labels(windows: DataFrame, regions: dict[str, DataFrame], functional: Sequence[str], gene_body: str, threshold: float) -> DataFrame:
    """Fractions of each window (unique ``row_id``) covered by each region, and one label.

    ``regions``: name to intervals. The label is the first of ``functional`` with any overlap, where the union of the functional regions
    covers at least ``threshold`` of the window, else ``background``. ``intron_frac`` is what the gene body has beside the functional
    regions and ``intergenic_frac`` what lies outside both, not below zero.
    """
    size = F.col("end") - F.col("start")
    tagged = None
    for name, region in regions.items():
        tags = F.explode(F.array(F.lit(name), F.lit("functional")) if name in functional else F.array(F.lit(name)))
        rows = region.select(tags.alias("region"), "chrom", "start", "end")
        tagged = rows if tagged is None else tagged.union(rows)
    names = [*regions, "functional"]
    summed = covered_bases(windows, intervals.merge(tagged, by=["region"]).withColumnRenamed("region", "name"), names)
    out = windows.join(summed.hint("merge"), "row_id", "left").withColumns({f"{n}_bp": F.coalesce(f"{n}_bp", F.lit(0)) for n in names})
    fractions = {f"{name}_frac": F.col(f"{name}_bp") / size for name in [*regions, "functional"]}
    out = out.withColumns(fractions)
    label = F.coalesce(*[F.when(F.col(f"{n}_bp") > 0, F.lit(n)) for n in functional], F.lit("background"))
    label = F.when(F.col("functional_frac") >= threshold, label).otherwise("background")
    intron = F.greatest(F.lit(0.0), F.col(f"{gene_body}_frac") - F.col("functional_frac"))
    outside = F.greatest(F.lit(0.0), 1.0 - F.greatest(F.col(f"{gene_body}_frac"), F.col("functional_frac")))
    return out.withColumns({"label": label, "intron_frac": intron, "intergenic_frac": outside}).drop(*[f"{n}_bp" for n in [*regions, "functional"]])


def top_quantile_windows(bins: DataFrame, q: float, size: int, score: str = "logit") -> DataFrame:
    """Windows of ``size`` about the bins at or above the nearest-rank quantile ``1 - q`` of ``score``, merged."""
    from .aggregates import nearest_rank

    cut = nearest_rank(bins, score, 1 - q)
    return intervals.merge(intervals.resize(bins.where(F.col(score) >= F.lit(cut)), size))
