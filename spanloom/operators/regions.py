"""Region sets made by chains of interval operations: training recipes, validation sets, labelled regions, candidate placements.

A recipe names a source set and the steps that follow. Steps: ``size`` (keep lengths in a range), ``flank`` (grow both sides), ``expand``
(to a least length), ``resize`` (to a length about the middle), ``minus`` and ``and`` (another set by name). Growing steps merge again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import annotation, interval_joins, intervals
from .kept import kept
from .tiles import TILE, cut_at_tiles, dealt

#: Places of one lookup range, as a power of two.
WAYS = 16
#: Tries that every row makes at once; the others follow for rows that fit at none of these.
FEW = 2
#: Chromosomes and lengths that are broadcast at most.
LENGTHS = 1_000_000
#: Bases of a cell of draws; rows of up to an eighth of that are placed in cells of this width.
CELL = 1 << 17
#: Lengths for which a cell counts its starts.
GRID = 24
#: Rows of a chromosome that one task deals to cells.
LOT = 200_000
#: How often a cell's free bases may be asked for in one round.
CROWD = 4

Step = tuple
# What follows most sources in a recipe.
_TAIL = (("size", 20, 10_000), ("flank", 20), ("expand", 256), ("and", "defined"))
# Recipes by name, each a source and its steps.
RECIPES: dict[str, tuple[str, tuple[Step, ...]]] = {
    "v1": ("promoters_mrna_256", (("and", "defined"),)),
    "v3": ("cds", (("expand", 512), ("and", "defined"))),
    "v4": ("promoters_256", (("and", "defined"),)),
    "v5": ("cds", _TAIL),
    "v6": ("utr5", (("minus", "cds"), *_TAIL)),
    "v7": ("utr3", (("minus", "cds"), ("minus", "utr5"), *_TAIL)),
    "v8": ("ncrna", (("minus", "cds"), ("minus", "utr5"), ("minus", "utr3"), *_TAIL)),
    "v9": ("promoters_256", (("minus", "cds"), ("minus", "utr5"), ("minus", "utr3"), ("minus", "ncrna"), ("and", "defined"))),
    "v10": ("promoters_2048", (("minus", "cds"), ("minus", "utr5"), ("minus", "utr3"), ("minus", "ncrna"), ("and", "defined"))),
    "v11": ("promoters_mrna_2048", (("and", "defined"),)),
    "v12": ("utr3", _TAIL),
    "v13": ("upstream_512", (("and", "defined"),)),
    "v14": ("downstream_512", (("and", "defined"),)),
    "v15": ("downstream_256", (("and", "defined"),)),
    "v16": ("promoters_mrna_254", (("and", "defined"),)),
    "v17": ("els", (("resize", 255), ("and", "defined"))),
    "v18": ("els_conserved_20", (("resize", 255), ("and", "defined"))),
    "v19": ("predicted", ()),
    "v20": ("top_bins", (("minus", "exons"), ("and", "defined"))),
    "v30": ("projected_20", (("resize", 255), ("and", "scannable"))),
    "v31": ("projected_50", (("resize", 255), ("and", "scannable"))),
    "v32": ("projected_b_20", (("resize", 255), ("and", "scannable"))),
    "v33": ("projected_b_50", (("resize", 255), ("and", "scannable"))),
    "val_cds": ("cds", (("size", 20, 10_000), ("flank", 20), ("expand", 255), ("and", "defined"))),
    "val_utr5": ("utr5", (("size", 20, 10_000), ("flank", 20), ("expand", 255), ("and", "defined"))),
    "val_utr3": ("utr3", (("size", 20, 10_000), ("flank", 20), ("expand", 255), ("and", "defined"))),
    "val_ncrna": ("ncrna", (("size", 20, 10_000), ("flank", 20), ("expand", 255), ("and", "defined"))),
    "val_tss_pc": ("start_band_255", (("and", "defined"),)),
    "val_promoter": ("pls", (("resize", 255), ("and", "defined"))),
    "val_enhancer": ("els", (("resize", 255), ("and", "defined"), ("minus", "exons"))),
}
# Classes of candidate elements that are promoters, and those that are enhancers.
PROMOTER_CLASSES, ENHANCER_CLASSES = ("PLS",), ("dELS", "pELS")

Sets = Mapping[str, Callable[[], DataFrame]]


def build(recipe: str, sets: Sets) -> DataFrame:
    """The merged set of a recipe; ``sets`` makes each named set when it is needed."""
    if recipe not in RECIPES:
        raise ValueError(f"unknown recipe {recipe}: one of {sorted(RECIPES)}")
    source, steps = RECIPES[recipe]
    out, steps = sets[source](), list(steps)
    merged = False
    while steps:
        kind, *with_ = steps.pop(0)
        if kind in ("minus", "and"):  # with all that follow of this kind, one sweep
            asked = [(kind, with_[0])]
            while steps and steps[0][0] in ("minus", "and"):
                asked.append(steps.pop(0))
            out, merged = intervals.inside_and_outside(out, [sets[n]() for k, n in asked if k == "and"], [sets[n]() for k, n in asked if k == "minus"]), True
            continue
        if not merged:
            out, merged = intervals.merge(out), True
        if kind == "size":
            out = intervals.filter_size(out, *with_)
        elif kind == "flank":
            out = intervals.merge(intervals.add_flank(out, *with_))
        elif kind == "expand":
            out = intervals.merge(intervals.expand_min_size(out, *with_))
        else:
            out = intervals.merge(intervals.resize(out, *with_))
    return out if merged else intervals.merge(out)


def defined(sizes: DataFrame, undefined: DataFrame) -> DataFrame:
    """What of each chromosome (``chrom, size``) isn't undefined."""
    return intervals.complement(undefined, sizes)


def annotation_sets(ann: DataFrame, defined_: Callable[[], DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """Sources of the recipes from an annotation that says ``mRNA``."""
    mrna, cds = annotation.transcript_exons(ann), annotation.coding(ann)
    both = annotation.functional_transcript_exons(ann)
    out = {
        "cds": lambda: cds,
        "utr5": lambda: annotation.utr5(mrna, cds),
        "utr3": lambda: annotation.utr3(mrna, cds),
        "ncrna": lambda: annotation.ncrna_exons(ann),
        "exons": lambda: annotation.functional_exons(ann),
        "defined": defined_,
        "scannable": lambda: intervals.subtract(defined_(), annotation.functional_exons(ann)),
    }
    out |= {f"promoters_{n}": lambda n=n: annotation.promoters(both, n, n) for n in (256, 2048)}
    out |= {f"promoters_mrna_{n}": lambda n=n: annotation.promoters(mrna, n, n) for n in (254, 256, 2048)}
    out |= {f"{side}stream_{n}": lambda side=side, n=n: annotation.beside_cds(cds, n, side == "up") for side, n in (("up", 512), ("down", 512), ("down", 256))}
    return out


def validation_sets(ann: DataFrame, elements: DataFrame, defined_: Callable[[], DataFrame], biotypes: tuple[str, ...]) -> dict[str, Callable[[], DataFrame]]:
    """Sources of the validation recipes from canonical transcripts of an annotation that says ``protein_coding``, and candidate elements."""
    own = annotation.canonical(annotation.require_protein_coding(ann))
    exons, cds = annotation.exons_of_biotype(own), annotation.coding(own)
    return {
        "cds": lambda: cds,
        "utr5": lambda: annotation.utr5(exons, cds),
        "utr3": lambda: annotation.utr3(exons, cds),
        "ncrna": lambda: annotation.noncoding_exons(own, biotypes),
        "exons": lambda: annotation.exon_set(ann),
        "start_band_255": lambda: annotation.start_bands(exons, 255),
        "pls": lambda: elements.where(F.col("cre_class").isin(*PROMOTER_CLASSES)),
        "els": lambda: elements.where(F.col("cre_class").isin(*ENHANCER_CLASSES)),
        "defined": defined_,
    }


def conserved(windows: DataFrame, track: DataFrame, threshold: float, least: int) -> DataFrame:
    """Windows (unique ``row_id``) with at least ``least`` bases whose value reaches the threshold."""
    from . import signal

    return signal.score_windows(windows, track, threshold).where(F.col("conserved_bases") >= least).select(windows.columns)


def conserved_totals(windows: DataFrame, track: DataFrame, threshold: float) -> DataFrame:
    """One row: bases, conserved bases and their percentage over all windows."""
    from . import signal

    n, length = F.sum("conserved_bases"), F.sum(F.col("end") - F.col("start"))
    return signal.score_windows(windows, track, threshold).agg(F.count("*").alias("n_intervals"), length.alias("total_bases"), n.alias("conserved_bases"), (100.0 * n / length).alias("percent"))


def region_sets(ann: DataFrame, elements: DataFrame, defined_: DataFrame, start_radius: int, flank: int) -> DataFrame:
    """``region, chrom, start, end``: five labelled region sets and two for diagnosis (gene bodies, all exons), each inside the defined genome, from one sweep.

    Non-coding exons are those outside protein-coding ones; the start region is a band about all transcript starts with the 5' UTR;
    elements that aren't promoters are grown by ``flank``."""
    annotation.require_protein_coding(ann)
    coding_exons, cds = annotation.exons_of_biotype(ann), annotation.coding(ann)
    rest = elements.where(~F.col("cre_class").isin(*PROMOTER_CLASSES))
    bands, utr5 = annotation.start_bands(annotation.exons_of_biotype(ann, None), start_radius), annotation.utr5(coding_exons, cds)
    sets = {
        "cds": cds,
        "utr3": annotation.utr3(coding_exons, cds),
        "tss_region_and_utr5": bands.select(*intervals.COLUMNS).union(utr5.select(*intervals.COLUMNS)),
        "ccre_non_promoter": intervals.add_flank(rest, flank),
        "gene_body": annotation.gene_bodies(ann),
        "all_exons": annotation.exon_set(ann),
        "coding_exons": coding_exons,
        "defined": defined_,
    }
    own = [name for name in sets if name not in ("coding_exons", "defined")]
    rules = {name: lambda over, name=name: (over[name] > 0) & (over["defined"] > 0) for name in own}
    rules["ncrna_exon"] = lambda over: (over["all_exons"] > 0) & (over["coding_exons"] == 0) & (over["defined"] > 0)
    return intervals.sweep_many(sets, rules, name="region")


def windows_outside(sizes: DataFrame, undefined: DataFrame, size: int, step: int) -> DataFrame:
    """Windows of every chromosome (``chrom, size``), named ``win_<chrom>_<nine digits>`` by their number along it, without those that touch an
    undefined region; numbers count the dropped ones too."""
    whole = sizes.select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"))
    named = intervals.tile(whole, size, step).withColumn("row_id", F.format_string("win_%s_%09d", "chrom", F.floor(F.col("start") / step) + 1))
    return interval_joins.not_overlapping(named, undefined).select("chrom", "start", "end", F.col("row_id").alias("name"))


def outside_at_center(rows: DataFrame, others: DataFrame, size: int) -> DataFrame:
    """Rows (unique ``row_id``) whose ``size`` middle bases touch none of ``others``; their own columns stay."""
    center = intervals.resize(rows.select("row_id", "chrom", "start", "end"), size)
    return rows.join(interval_joins.not_overlapping(center, others).select("row_id").hint("merge"), "row_id", "left_semi").select(rows.columns)


def above_threshold(predictions: DataFrame, threshold: float, score: str = "logit") -> DataFrame:
    return intervals.merge(predictions.where(F.col(score) >= threshold))


def _spread(stretches: DataFrame, keys: list[str], ways: str) -> tuple[DataFrame, DataFrame]:
    """``stretches`` (``s`` and the number of ``ways``) with ``first``, the ways before each by ``keys``, once for each ``_bin`` of ways; and ``total`` by key."""
    cut = stretches.withColumn("_part", F.floor(F.col("s") / TILE))
    line = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(*keys, "_part").agg(F.sum(ways).alias("w")).withColumn("before", F.coalesce(F.sum("w").over(line), F.lit(0)))
    inner = Window.partitionBy(*keys, "_part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut.join(parts.drop("w").hint("merge"), [*keys, "_part"]).withColumn("first", F.col("before") + F.coalesce(F.sum(ways).over(inner), F.lit(0)))
    bins = F.sequence(F.shiftright("first", WAYS), F.shiftright(F.col("first") + F.col(ways) - 1, WAYS))
    return numbered.withColumn("_bin", F.explode(bins)), parts.groupBy(*keys).agg(F.sum("w").alias("total"))


def place_at_random(rows: DataFrame, free: DataFrame, seed: int, times: int = 1, tries: int = 16) -> DataFrame:
    """A place in the free stretches of its chromosome for each row (unique ``row_id``), of the row's length, ``times`` over.

    ``free``: disjoint stretches. A start is even over all starts that fit: of ``tries`` bases of the free stretches, each from a hash of seed, row
    and turn, the first one where the row fits is taken; the later tries are made for rows only that need them. Only rows for which none does are drawn by counting what
    fits, by chromosome and length. Lookups are equi-joins on (chromosome, range of numbers), so no chromosome is one task. Places may overlap or repeat. Rows that fit
    nowhere have a null place. Runs a few jobs while it is built.
    """
    rest = rows.select("row_id", "chrom", (F.col("end") - F.col("start")).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("turn"))
    stretches = free.where("`end` > start").select("chrom", F.col("start").alias("s"), (F.col("end") - F.col("start")).alias("room"))
    spread, total = _spread(stretches, ["chrom"], "room")
    ahead, drawn = F.col("at") - F.col("first"), None
    for first, last in ((0, min(tries, FEW)), (min(tries, FEW), tries)):
        if first == last or (drawn is not None and rest.isEmpty()):
            break
        tried = rest.join(F.broadcast(total), "chrom").withColumn("try", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        tried = tried.withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "row_id", "turn", "try"), F.col("total"))).withColumn("_bin", F.shiftright("at", WAYS))
        hit = tried.join(spread.hint("merge"), ["chrom", "_bin"]).where((ahead >= 0) & (ahead + F.greatest("n", F.lit(1)) <= F.col("room")))
        own = kept(hit.groupBy("row_id", "chrom", "n", "turn").agg(F.min_by(F.col("s") + ahead, "try").alias("start")))
        drawn = own if drawn is None else drawn.union(own)
        rest = kept(rest.join(own.select("row_id", "turn").hint("merge"), ["row_id", "turn"], "left_anti").select("row_id", "chrom", "n", "turn"))
    if not rest.isEmpty():
        lengths = kept(rest.select("chrom", "n").distinct())
        way = "broadcast" if lengths.count() <= LENGTHS else "merge"
        fits = stretches.join(lengths.hint(way), "chrom").where("room >= n").withColumn("ways", F.col("room") - F.col("n") + 1)
        spread, total = _spread(fits, ["chrom", "n"], "ways")
        counted = rest.join(total.hint(way), ["chrom", "n"]).withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "row_id", "turn"), F.col("total"))).withColumn("_bin", F.shiftright("at", WAYS))
        found = counted.join(spread.hint("merge"), ["chrom", "n", "_bin"]).where((ahead >= 0) & (ahead < F.col("ways"))).select("row_id", "turn", (F.col("s") + ahead).alias("start"))
        drawn = drawn.union(rest.join(found.hint("merge"), ["row_id", "turn"], "left").select(drawn.columns))
    return drawn.select("row_id", "chrom", "start", (F.col("start") + F.col("n")).alias("end"))


def _unbeaten(rows: pd.DataFrame) -> pd.DataFrame:
    """One cell's pieces of draws that no piece of a higher priority touches. Pieces are painted from the lowest priority to the highest: one that is still whole then is untouched."""
    rows = rows.sort_values(["_draw", "row_id"], ignore_index=True)
    low = int(rows["_from"].min())
    begin, end = rows["_from"].to_numpy() - low, rows["_to"].to_numpy() - low
    over = np.full(int(end.max()), -1)
    for i, (s, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        over[s:e] = i
    whole = np.bincount(over[over >= 0], minlength=len(rows)) == end - begin
    return rows[whole].assign(_bases=(end - begin)[whole])[["row_id", "chrom", "start", "end", "_bases"]]


def without_lower_touching(drawn: DataFrame, seed: int) -> DataFrame:
    """Of draws ``row_id, chrom, start, end`` (of some length) those that no draw of a higher priority, a hash of seed and row, touches.

    Of draws with one start only those stay that none as long or longer and of higher priority stands beside: the others are beaten, and what they touch that one touches too. So a cell
    of ``CELL`` bases has a few rows for each of its bases at most, however many draws crowd there, and no pairs are made."""
    top = drawn.groupBy("chrom", "start", "end").agg(F.max(F.struct(F.xxhash64(F.lit(seed), "row_id").alias("_draw"), "row_id")).alias("_top"))
    longer = F.max("_top").over(Window.partitionBy("chrom", "start").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    front = top.withColumn("_longer", longer).where(F.col("_longer").isNull() | (F.col("_top") > F.col("_longer"))).select("chrom", "start", "end", "_top.*")
    cells = front.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL))))
    cells = cells.withColumns({"_from": F.greatest("start", F.col("_cell") * CELL), "_to": F.least("end", (F.col("_cell") + 1) * CELL)})
    kinds = {f.name: f.dataType.simpleString() for f in drawn.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("row_id", "chrom", "start", "end")) + ", _bases long"
    whole = cells.groupBy("chrom", "_cell").applyInPandas(_unbeaten, schema)
    return whole.groupBy("row_id", "chrom", "start", "end").agg(F.sum("_bases").alias("_bases")).where("_bases = `end` - start").drop("_bases")


def _celled(stretches: DataFrame, width: int, shift: int) -> DataFrame:
    """``stretches`` cut at the borders of cells of ``width`` bases, ``shift`` bases before the multiples of ``width``; with the length ``room`` of each piece."""
    moved = stretches.select("chrom", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"))
    return cut_at_tiles(moved, width).select("chrom", F.col("_tile").alias("_cell"), (F.col("start") - shift).alias("start"), (F.col("end") - shift).alias("end"), (F.col("end") - F.col("start")).alias("room"))


def _to_cells(lengths: list[int]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """One lot of a chromosome's rows (length ``n``, hash ``_at``): each gets a ``_cell`` with a stretch as long, in proportion to the starts there for its length, or the next lower one
    of ``lengths`` (ascending); ``_known`` is false where no cell has one."""
    grid = np.array(lengths)

    def run(rows: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["widest", "_cell"], ascending=[False, True])
        sums = cells[[f"w{i}" for i in range(len(grid))]].to_numpy().cumsum(0)
        n = rows["n"].to_numpy()
        upto, which = np.searchsorted(-cells["widest"].to_numpy(), -n, side="right"), np.searchsorted(grid, n, side="right") - 1  # the first cells have a stretch of n bases
        known, cell = upto > 0, np.zeros(len(rows), dtype=np.int64)
        for i in np.unique(which[known]):
            own = known & (which == i)
            cell[own] = cells["_cell"].to_numpy()[np.searchsorted(sums[:, i], rows["_at"].to_numpy()[own] % sums[upto[own] - 1, i], side="right")]
        return rows[["row_id", "chrom", "n"]].assign(_cell=cell, _known=known)

    return run


def _settled(rows: pd.DataFrame, stretches: pd.DataFrame) -> pd.DataFrame:
    """One cell: rows by priority take a start each, even over all that fit in what is still free. Gives the rows, without a place where nothing fits, and what stays free."""
    rows, stretches = rows.sort_values(["_draw", "row_id"]), stretches.sort_values("start")
    k, m = len(stretches), len(rows)
    low, room = np.zeros(k + m, dtype=np.int64), np.zeros(k + m, dtype=np.int64)
    low[:k], room[:k] = stretches["start"], stretches["room"]
    start, found, least = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=bool), np.inf
    for i, (n, at) in enumerate(zip(rows["n"].tolist(), rows["_at"].tolist(), strict=True)):
        if n >= least:
            continue  # what is free only shrinks
        ways = np.maximum(room[:k] - (n - 1), 0).cumsum()
        if not ways[-1]:
            least = n
            continue
        at %= int(ways[-1])
        j = int(ways.searchsorted(at, side="right"))
        ahead = at - int(ways[j - 1]) if j else at
        start[i], found[i] = low[j] + ahead, True
        low[k], room[k], room[j] = start[i] + n, room[j] - ahead - n, ahead
        k += 1
    own = rows[["row_id", "chrom", "n"]].assign(start=start, end=start + rows["n"].to_numpy(), kind=np.where(found, "placed", "left"))
    free = pd.DataFrame({"chrom": rows["chrom"].iloc[0], "n": 0, "start": low[:k], "end": low[:k] + room[:k], "kind": "free"})[room[:k] > 0]
    return pd.concat([own, free.assign(row_id=own["row_id"].iloc[0])], ignore_index=True)


def place_apart(rows: DataFrame, free: DataFrame, seed: int) -> DataFrame:
    """A place in the free stretches of its chromosome for each row (unique ``row_id``), of the row's length; no two places overlap.

    In each round a row draws a cell of ``CELL`` bases, in proportion to the starts that fit there for its length (or one of ``GRID`` lengths just below). Inside a cell rows take their places one
    after the other, by a hash of seed and row, each even over all starts that fit in what is still free; those for which nothing is left there draw again, from cells where they
    fit. In every second round borders lie half a cell further, so what lies across one is seen too. Where rows ask for far more than a cell has, a share of
    them goes there and the others draw again. Rows over an eighth of a cell come first, in wider cells, and rows of no length come last, each beside or between the others' places.
    Rows that fit nowhere have a null place and draw no more, as what is free only shrinks. The result depends on rows and seed only. Runs a few jobs a round.
    """
    asked = kept(rows.select("row_id", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    sized = asked.where("`end` > start").select("row_id", "chrom", (F.col("end") - F.col("start")).alias("n"))
    kind = dict(sized.dtypes)["row_id"]
    open_, placed, turn, lot, cell = kept(intervals.merge(free)), None, 0, ["chrom", "_lot"], ["chrom", "_cell"]
    chance = lambda *what: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *map(F.lit, what), "row_id"), 1)
    step = reduce(Column.__add__, [(F.col("n") > (CELL >> 3 << 4 * i)).cast("int") for i in range(11)])
    for at, least, most in sorted(map(tuple, sized.groupBy(step.alias("step")).agg(F.min("n"), F.max("n")).collect()), reverse=True):
        width, need = CELL << 4 * at, sized.where(step == at)
        lengths = sorted({least, *np.geomspace(least, most, GRID).astype(np.int64).tolist()})
        while True:
            turn += 1
            cut = _celled(open_, width, turn % 2 * width // 2)
            widest = open_.groupBy("chrom").agg(F.max(F.col("end") - F.col("start")).alias("_widest"))
            lots = need.groupBy("chrom").agg((F.floor(F.count("*") / LOT) + 1).alias("_lots"))
            need = need.join(F.broadcast(widest.join(lots.hint("merge"), "chrom")), "chrom").where("n <= _widest")
            need = need.withColumns({"_lot": F.pmod(chance("lot"), "_lots"), "_at": chance("cell", turn)}).drop("_lots", "_widest")
            starts = [F.sum(F.greatest(F.col("room") - n + 1, F.lit(0))).alias(f"w{i}") for i, n in enumerate(lengths)]
            cells = kept(cut.where(F.col("room") >= least).groupBy(cell).agg(F.max("room").alias("widest"), F.sum("room").alias("bases"), *starts))
            by_lot = cells.join(F.broadcast(lots), "chrom").withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lots") - 1)))
            drawn = kept(dealt(need, *lot).groupBy(*lot).cogroup(dealt(by_lot, *lot).groupBy(*lot)).applyInPandas(_to_cells(lengths), f"row_id {kind}, chrom string, n long, _cell long, _known boolean"))
            if drawn.isEmpty():
                break
            seen = drawn.where("_known").groupBy(cell).agg(F.count("*").alias("rows"), F.sum("n").alias("asked"))
            share = F.greatest(CROWD * F.col("bases") / F.col("asked"), F.lit(64) / F.col("rows")).alias("_share")
            seen = kept(seen.join(cells.hint("merge"), cell).select(*cell, share))
            come = dealt(drawn.where("_known"), *cell).join(seen.hint("merge"), cell).withColumn("_comes", F.pmod(chance("share", turn), F.lit(1 << 30)) < F.col("_share") * (1 << 30))
            here = come.where("_comes").select("row_id", *cell, "n", F.xxhash64(F.lit(seed), "row_id").alias("_draw"), chance("start", turn).alias("_at"))
            wide = cut.where(F.col("room") >= least)
            own = dealt(wide, *cell).join(seen.hint("merge"), cell, "left_semi")
            done = kept(here.groupBy(cell).cogroup(own.groupBy(cell)).applyInPandas(_settled, f"row_id {kind}, chrom string, n long, start long, end long, kind string"))
            won = done.where("kind = 'placed'").select(asked.columns)
            placed = won if placed is None else placed.union(won)
            need = reduce(DataFrame.union, [df.select("row_id", "chrom", "n") for df in (done.where("kind = 'left'"), come.where("not _comes"), drawn.where("not _known"))])
            others = [cut.where(F.col("room") < least), wide.join(seen.hint("merge"), cell, "left_anti"), done.where("kind = 'free'")]
            open_ = kept(intervals.merge(reduce(DataFrame.union, [df.select(*intervals.COLUMNS) for df in others])))
    points = asked.where("`end` = start")
    if not points.isEmpty():
        own = kept(place_at_random(points, open_, seed * 1_000_003).where("start is not null"))
        placed = own if placed is None else placed.union(own)
    none = asked.select("row_id", "chrom", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    return none if placed is None else none.join(placed.select("row_id").hint("merge"), "row_id", "left_anti").select(placed.columns).union(placed)


def exclusion(positives: DataFrame, undefined: DataFrame) -> DataFrame:
    """Where no negative may lie."""
    return intervals.union(positives, undefined)


def labelled_composition(windows: DataFrame, by: str | Column = "label") -> DataFrame:
    from .aggregates import composition

    return composition(windows, [by])
