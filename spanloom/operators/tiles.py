"""Sweeps along a coordinate axis without putting a whole chromosome into one task.

The axis is cut into tiles. Sets are swept after cutting their intervals at the tiles' borders, so each tile stands alone and only pieces
that touch a border are stitched together again, at most two a tile. Where rows need the rows before them, they are windowed inside
``(chrom, tile)``; what comes from the tiles before or after comes from one row a tile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a tile in bases.
TILE = 1 << 20


def with_tile(df: DataFrame, position: str, width: int = TILE) -> DataFrame:
    return df.withColumn("_tile", F.floor(F.col(position) / F.lit(width)))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as ``spark.sql.shuffle.partitions`` says. Without a number Spark joins tasks up to a compressed size, and
    sorted positions compress so well that a task of 64 MB sorts and groups gigabytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut_at_tiles(df: DataFrame, width: int = TILE) -> DataFrame:
    """Every interval as its pieces in the tiles that it reaches; one of no length stays in the tile of its start."""
    last = F.floor(F.greatest(F.col("start"), F.col("end") - 1) / F.lit(width))
    cut = df.withColumn("_tile", F.explode(F.sequence(F.floor(F.col("start") / F.lit(width)), last)))
    low, high = F.col("_tile") * width, (F.col("_tile") + 1) * width
    return cut.withColumns({"start": F.greatest("start", low), "end": F.least("end", high)})


def stitched(pieces: DataFrame, by: Sequence[str] = (), width: int = TILE) -> DataFrame:
    """``pieces`` (sorted and apart inside each tile) joined where they meet at a border: those at borders, at most two a tile, are windowed by
    chromosome, all others stay in lanes by tile. The input is read once, so chains of sweeps stay linear."""
    low, high = F.col("_tile") * width, (F.col("_tile") + 1) * width
    laned = pieces.withColumn("_lane", F.when((F.col("start") > low) & (F.col("end") < high), F.col("_tile")))
    laned = dealt(laned, *by, "chrom", "_lane")
    line = Window.partitionBy(*by, "chrom", "_lane").orderBy("start", "end")
    new = F.when(F.col("_lane").isNull() & (F.col("start") == F.lag("end").over(line)), 0).otherwise(1)
    islands = laned.withColumn("_new", new).withColumn("_island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy(*by, "chrom", "_lane", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.select(*by, "chrom", "start", "end")


def with_carry(df: DataFrame, join: str = "inner", **carries: tuple[Column, str, str]) -> DataFrame:
    """Add to every row of ``df`` (which has ``chrom`` and ``_tile``) one column per entry ``name=(aggregate, how, side)``: the tiles'
    ``aggregate`` folded by ``how`` (max, min, sum) over all tiles before (``side`` "before") or after the row's own. With a left ``join`` rows without a place stay."""
    per_tile = df.groupBy("chrom", "_tile").agg(*[a.alias(f"_{n}") for n, (a, _, _) in carries.items()])
    line = {"before": Window.partitionBy("chrom").orderBy("_tile"), "after": Window.partitionBy("chrom").orderBy(F.desc("_tile"))}
    spans = {side: w.rowsBetween(Window.unboundedPreceding, -1) for side, w in line.items()}
    folded = per_tile.select("chrom", "_tile", *[getattr(F, how)(f"_{n}").over(spans[side]).alias(n) for n, (_, how, side) in carries.items()])
    return df.join(folded, ["chrom", "_tile"], join)


def inside(*order: str | Column) -> Window:
    return Window.partitionBy("chrom", "_tile").orderBy(*order)
