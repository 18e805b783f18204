"""Interval algebra on ``chrom, start, end`` (0-based, half-open), as DataFrame functions.

Sets are merged and disjoint; lists keep their rows. Zero-length intervals and negative starts are legal, ``start > end`` is an error
where ``checked`` is applied.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tiles import TILE, cut_at_tiles, dealt, inside, stitched

COLUMNS = ["chrom", "start", "end"]
_BEFORE = (Window.unboundedPreceding, -1)


def checked(df: DataFrame) -> DataFrame:
    """Fail the query on a row whose start lies behind its end."""
    return df.withColumn("start", F.when(F.col("start") > F.col("end"), F.raise_error(F.lit("start > end")).cast("long")).otherwise(F.col("start")))


def merge(df: DataFrame, width: int = TILE, by: Sequence[str] = ()) -> DataFrame:
    """Union of overlapping and adjacent intervals: the canonical set, one for each value of ``by``. Null chromosomes or bounds are dropped.

    One shuffle by tile, and one of the few pieces at tile borders."""
    known = cut_at_tiles(df.select(*by, *COLUMNS).where("chrom is not null and start is not null and end is not null"), width)
    known = dealt(known, "chrom", "_tile")
    line = Window.partitionBy(*by, "chrom", "_tile").orderBy("start", "end")
    before = F.max("end").over(line.rowsBetween(*_BEFORE))
    own = known.withColumn("_new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = own.groupBy(*by, "chrom", "_tile", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return stitched(pieces, by, width)


def sweep(a: DataFrame, b: DataFrame, keep: Callable[[Column, Column], Column], width: int = TILE) -> DataFrame:
    """Where ``keep`` holds of the numbers of intervals of ``a`` and of ``b`` that lie over a base; it must be false of 0 and 0.

    In each tile only the places where ``keep`` changes stay; a stretch reaches from one that turns true to the next."""

    def bounds(df: DataFrame, x: int, y: int) -> DataFrame:
        pieces = cut_at_tiles(df.select(*COLUMNS).where("start < end"), width)
        ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("k")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("k")))
        return pieces.select("chrom", "_tile", F.explode(ends).alias("x")).select("chrom", "_tile", "x.pos", (F.col("x.k") * x).alias("xa"), (F.col("x.k") * y).alias("xb"))

    rows = dealt(bounds(a, 1, 0).union(bounds(b, 0, 1)), "chrom", "_tile")
    steps = rows.groupBy("chrom", "_tile", "pos").agg(F.sum("xa").alias("xa"), F.sum("xb").alias("xb"))
    line = inside("pos")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    depth = steps.select("chrom", "_tile", "pos", F.sum("xa").over(so_far).alias("da"), F.sum("xb").over(so_far).alias("db"))
    state = depth.select("chrom", "_tile", "pos", keep(F.col("da"), F.col("db")).alias("on"))
    turns = state.withColumn("was", F.coalesce(F.lag("on").over(line), F.lit(False))).where("on <> was")
    pieces = turns.withColumn("end", F.lead("pos").over(line)).where("on").select("chrom", "_tile", F.col("pos").alias("start"), "end")
    return stitched(pieces, (), width)


Rule = Callable[[Mapping[str, Column]], Column]


def sweep_many(sets: Mapping[str, DataFrame], rules: Mapping[str, Rule], width: int = TILE, name: str = "label") -> DataFrame:
    """``name, chrom, start, end``: for each of ``rules`` where it holds of the numbers of intervals that lie over a base, by set; none may hold of zeros.

    All sets go through one sweep, so however many sets and rules there are, each set is read once and shuffled once by tile."""
    rows = None
    for i, df in enumerate(sets.values()):
        pieces = cut_at_tiles(df.select(*COLUMNS).where("start < end"), width)
        ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("k")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("k")))
        own = pieces.select("chrom", "_tile", F.explode(ends).alias("x")).select("chrom", "_tile", "x.pos", F.lit(i).alias("set"), "x.k")
        rows = own if rows is None else rows.union(own)
    depth = [f"d{i}" for i in range(len(sets))]
    steps = dealt(rows, "chrom", "_tile").groupBy("chrom", "_tile", "pos").agg(*[F.sum(F.when(F.col("set") == i, F.col("k")).otherwise(0)).alias(d) for i, d in enumerate(depth)])
    so_far = inside("pos").rowsBetween(Window.unboundedPreceding, 0)
    depths = steps.select("chrom", "_tile", "pos", *[F.sum(d).over(so_far).alias(d) for d in depth])
    over = {key: F.col(d) for key, d in zip(sets, depth, strict=True)}
    found = depths.select("chrom", "_tile", "pos", F.explode(F.array(*[F.struct(F.lit(label).alias("label"), rule(over).alias("on")) for label, rule in rules.items()])).alias("x"))
    line = Window.partitionBy("label", "chrom", "_tile").orderBy("pos")
    turns = found.select("x.label", "chrom", "_tile", "pos", "x.on").withColumn("was", F.coalesce(F.lag("on").over(line), F.lit(False))).where("on <> was")
    pieces = turns.withColumn("end", F.lead("pos").over(line)).where("on").select("label", "chrom", "_tile", F.col("pos").alias("start"), "end")
    return stitched(pieces, ["label"], width).withColumnRenamed("label", name)


def inside_and_outside(base: DataFrame, within: Sequence[DataFrame], without: Sequence[DataFrame]) -> DataFrame:
    """What ``base`` and each of ``within`` cover and none of ``without`` does, in one sweep."""
    sets = {"base": base, **{f"in{i}": s for i, s in enumerate(within)}, **{f"out{i}": s for i, s in enumerate(without)}}

    def rule(over: Mapping[str, Column]) -> Column:
        return reduce(Column.__and__, [c == 0 if key.startswith("out") else c > 0 for key, c in over.items()])

    return sweep_many(sets, {"": rule}).select(*COLUMNS)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return merge(a.select(*COLUMNS).union(b.select(*COLUMNS)))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep(a, b, lambda da, db: (da > 0) & (db > 0))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """What ``a`` covers and ``b`` doesn't; intervals are split."""
    return sweep(a, b, lambda da, db: (da > 0) & (db == 0))


def complement(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Gaps of ``df`` on each chromosome of ``sizes`` (``chrom, size``)."""
    return subtract(sizes.select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end")), df)


def resize(df: DataFrame, size: int) -> DataFrame:
    """Exactly ``size`` bases about the middle: the left side moves by floor(d / 2), the right by the rest; d may be negative."""
    if size <= 0:
        raise ValueError("size must be positive")
    left = F.shiftright(F.lit(size) - (F.col("end") - F.col("start")), 1)
    return df.withColumns({"start": F.col("start") - left, "end": F.col("start") - left + F.lit(size)})


def expand_min_size(df: DataFrame, size: int) -> DataFrame:
    """At least ``size`` bases: both sides grow by ceil(deficit / 2), so an odd deficit gives one base more. Not merged."""
    pad = F.greatest(F.shiftright(F.lit(size) - (F.col("end") - F.col("start")) + 1, 1), F.lit(0))
    return df.withColumns({"start": F.col("start") - pad, "end": F.col("end") + pad})


def add_flank(df: DataFrame, n: int) -> DataFrame:
    return df.withColumns({"start": F.col("start") - n, "end": F.col("end") + n})


def add_random_shift(df: DataFrame, most: int, seed: int) -> DataFrame:
    """Shift every interval by a number in [-most, most] that depends on the seed and the interval alone."""
    by = F.pmod(F.xxhash64(F.lit(seed), "chrom", "start", "end"), F.lit(2 * most + 1)) - most
    return df.withColumns({"start": F.col("start") + by, "end": F.col("end") + by})


def clamp_resize(df: DataFrame, size: int, limit: str | Column = "size") -> DataFrame:
    """Exactly ``size`` bases about the middle, moved inward where the chromosome (``limit`` bases) ends; an error if it is shorter."""
    limit = F.col(limit) if isinstance(limit, str) else limit
    start = F.greatest(F.lit(0), F.least(F.floor((F.col("start") + F.col("end")) / 2) - size // 2, limit - size))
    start = F.when(limit < size, F.raise_error(F.lit("chromosome shorter than the window")).cast("long")).otherwise(start)
    return df.withColumns({"start": start, "end": start + size})


def filter_size(df: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Keep lengths in [least, most], both ends included."""
    length = F.col("end") - F.col("start")
    return df.where((length >= least if least is not None else F.lit(True)) & (length <= most if most is not None else F.lit(True)))


def tile(df: DataFrame, size: int, step: int) -> DataFrame:
    """Windows of ``size`` every ``step`` bases inside each interval; a partial tail is dropped. Other columns stay."""
    fits = df.where(F.col("end") - F.col("start") >= size)
    return fits.withColumn("start", F.explode(F.sequence(F.col("start"), F.col("end") - size, F.lit(step).cast("long")))).withColumn("end", F.col("start") + size)


def tile_chromosomes(sizes: DataFrame, size: int, exact: bool = False) -> DataFrame:
    """Neighbouring full windows of ``chrom, size`` rows; with ``exact`` a size that isn't a multiple fails the query."""
    end = F.col("size").cast("long")
    if exact:
        end = F.when(end % size != 0, F.raise_error(F.lit("size isn't a multiple of the window")).cast("long")).otherwise(end)
    return tile(sizes.select("chrom", F.lit(0).cast("long").alias("start"), end.alias("end")), size, size).select(*COLUMNS)


def flank_clamped(df: DataFrame, flank: int, limit: str = "size") -> DataFrame:
    """Flanks within [0, limit], empty ones dropped, named ``chrom:start-end``."""
    grown = df.withColumns({"start": F.greatest(F.col("start") - flank, F.lit(0)), "end": F.least(F.col("end") + flank, F.col(limit))}).where("start < end")
    return grown.withColumn("name", F.format_string("%s:%d-%d", "chrom", "start", "end"))


def accessors(df: DataFrame) -> DataFrame:
    """Number of intervals and bases in one row."""
    return df.agg(F.count("*").alias("n_intervals"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("total_size"))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same intervals, each as often."""
    return a.select(*COLUMNS).exceptAll(b.select(*COLUMNS)).isEmpty() and b.select(*COLUMNS).exceptAll(a.select(*COLUMNS)).isEmpty()
