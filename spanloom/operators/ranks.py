"""Running sums and exact quantiles over the values of a group, without one task for the group.

Values are dealt to cells by approximate quantiles of the whole column; sums of cells (at most ``CELLS`` a group) give what lies before each
cell, so only the rows of one cell are ever sorted together. Equal values are counted first and are one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells are found in two steps of ``SIDE`` comparisons.
SIDE = 32
CELLS = SIDE * SIDE


def cell_of(values: DataFrame, column: str) -> Column:
    """The cell of ``column``, 0 .. CELLS - 1, rising with the value; nulls are in cell 0."""
    cuts = sorted(set(values.select(F.col(column).cast("double").alias("v")).approxQuantile("v", [i / CELLS for i in range(1, CELLS)], 1 / (2 * CELLS))))
    if not cuts:
        return F.lit(0)
    blocks = [cuts[i : i + SIDE] for i in range(0, len(cuts), SIDE)]
    v, block = F.col(column).cast("double"), F.lit(0)
    for b in blocks[1:]:
        block = block + (v >= b[0]).cast("int")
    inside = F.size(F.filter(F.element_at(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), block + 1), lambda c: c <= v))
    return F.coalesce(block * SIDE + inside, F.lit(0))


def with_cells(df: DataFrame, counts: DataFrame, by: Sequence[str], column: str, sums: Sequence[str]) -> DataFrame:
    """``counts`` (one row per ``by`` and value of ``df``) with ``_cell`` and, for each of ``sums``, ``<s>_before`` the cell and ``<s>_all`` of the group."""
    celled = counts.withColumn("_cell", cell_of(df, column))
    per = celled.groupBy(*by, "_cell").agg(*[F.sum(s).alias(s) for s in sums])
    line, whole = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    offsets = per.select(
        *[F.col(k).alias(f"_at_{k}") for k in (*by, "_cell")],
        *[F.coalesce(F.sum(s).over(line), F.lit(0)).alias(f"{s}_before") for s in sums],
        *[F.sum(s).over(whole).alias(f"{s}_all") for s in sums],
        *[F.col(s).alias(f"{s}_cell") for s in sums],
    )
    same = F.lit(True)
    for k in (*by, "_cell"):
        same = same & F.col(k).eqNullSafe(F.col(f"_at_{k}"))
    return celled.join(offsets, same).drop(*[f"_at_{k}" for k in (*by, "_cell")])


def running(celled: DataFrame, by: Sequence[str], column: str, sums: Sequence[str]) -> DataFrame:
    """Rows of ``with_cells`` with ``<s>_upto``: the sum over the group's values up to and with the row's, nulls first."""
    line = Window.partitionBy(*by, "_cell").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    return celled.withColumns({f"{s}_upto": F.col(f"{s}_before") + F.sum(s).over(line) for s in sums}).drop("_cell", *[f"{s}_{x}" for s in sums for x in ("before", "cell")])


def running_sums(df: DataFrame, counts: DataFrame, by: Sequence[str], column: str, sums: Sequence[str]) -> DataFrame:
    """``counts`` with ``<s>_upto`` and ``<s>_all`` for each of ``sums``."""
    return running(with_cells(df, counts, by, column, sums), by, column, sums)


def quantiles(df: DataFrame, by: Sequence[str], column: str, qs: Sequence[float], nearest: bool = False) -> DataFrame:
    """Per group ``quantiles``, an array of doubles: the exact quantiles of the non-null values, interpolated, or with ``nearest`` the values
    at rank ``q * (n - 1)``, halves up. Groups without a value are left out; without groups that is one row of nulls."""
    values = df.select(*by, F.col(column).cast("double").alias("_v")).where("_v is not null")
    celled = with_cells(values, values.groupBy(*by, "_v").agg(F.count("*").alias("_n")), by, "_v", ["_n"])
    place = [F.lit(float(q)) * (F.col("_n_all") - 1) for q in qs]
    low = [F.floor(p + 0.5) if nearest else F.floor(p) for p in place]
    high = low if nearest else [F.ceil(p) for p in place]
    wanted = F.lit(False)  # only cells that hold a rank asked for are sorted
    for r in (*low, *high):
        wanted = wanted | ((r >= F.col("_n_before")) & (r < F.col("_n_before") + F.col("_n_cell")))
    at = lambda r: F.min(F.when(F.col("_n_upto") > r, F.col("_v")))
    picks = [x.alias(f"_{kind}{i}") for i in range(len(qs)) for kind, x in (("low", at(low[i])), ("high", at(high[i])))]
    found = running(celled.where(wanted), by, "_v", ["_n"]).groupBy(*by).agg(F.max("_n_all").alias("_n_all"), *picks)

    def value(i: int) -> Column:
        lo, hi = F.col(f"_low{i}"), F.col(f"_high{i}")
        return F.when(lo == hi, lo).otherwise((F.ceil(place[i]) - place[i]) * lo + (place[i] - F.floor(place[i])) * hi)

    return found.select(*by, F.array(*[value(i) for i in range(len(qs))]).alias("quantiles"))
