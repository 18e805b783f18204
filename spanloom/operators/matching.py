"""Matched controls: nearest unused negatives of each positive inside strata, and checks of the match."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics, ranks, tables
from .kept import kept

#: The rank that a free negative holds: later than every positive's.
FREE = 1 << 62


#: A share of the rows that lies about each quantile's place in its bracket, at most six times this.
NARROW = 1 / 4096


def robust_scales(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range (1 where it is 0) of each feature, exact: approximate quantiles give a bracket about each place, and only
    values inside the brackets are shuffled and ranked."""
    shares = (0.25, 0.5, 0.75)
    values = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    edges = values.approxQuantile(list(features), [min(1.0, max(0.0, q + x * NARROW)) for q in shares for x in (-2, 2)], NARROW)
    if not all(edges):
        return _scales_of_all(df, features)
    brackets = [(i, j, lo, hi) for i, e in enumerate(edges) for j, (lo, hi) in enumerate(zip(e[::2], e[1::2], strict=True))]
    counts = values.agg(
        *[F.count(f).alias(f"n_{i}") for i, f in enumerate(features)],
        *[F.count_if(F.col(features[i]) < lo).alias(f"below_{i}_{j}") for i, j, lo, _ in brackets],
        *[F.count_if(F.col(features[i]).between(lo, hi)).alias(f"in_{i}_{j}") for i, j, lo, hi in brackets],
    ).first()
    place = {(i, j): shares[j] * (counts[f"n_{i}"] - 1) for i, j, _, _ in brackets}
    first = {at: math.floor(p) - counts["below_%d_%d" % at] for at, p in place.items()}
    last = {at: math.ceil(p) - counts["below_%d_%d" % at] for at, p in place.items()}
    if any(first[at] < 0 or last[at] >= counts["in_%d_%d" % at] for at in place):
        return _scales_of_all(df, features)
    inside = F.array_compact(F.array(*[F.when(F.col(features[i]).between(lo, hi), F.struct(F.lit(3 * i + j).alias("_b"), F.col(features[i]).alias("_v"))) for i, j, lo, hi in brackets]))
    met = kept(values.select(F.inline(inside)).groupBy("_b", "_v").agg(F.count("*").alias("_n")))
    ranked = ranks.running_sums(met, met, ["_b"], "_v", ["_n"])
    at = lambda r: [F.min(F.when((F.col("_b") == 3 * i + j) & (F.col("_n_upto") > n), F.col("_v"))) for (i, j), n in r.items()]
    found = list(ranked.agg(*[c.alias(f"_{x}") for x, c in enumerate(at(first) + at(last))]).first())
    out = {}
    for (i, j), lo, hi in zip(place, found, found[len(place) :], strict=False):
        p = place[i, j]
        out[i, j] = lo if lo == hi else (math.ceil(p) - p) * lo + (p - math.floor(p)) * hi
    return {f: (out[i, 1], (out[i, 2] - out[i, 0]) or 1.0) for i, f in enumerate(features)}


def _scales_of_all(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """The same where brackets don't hold, as with few rows."""
    rows = ranks.quantiles(metrics.unpivot_scores(df, [], features), ["score_type"], "score", [0.25, 0.5, 0.75]).collect()
    at = {r["score_type"]: r["quantiles"] for r in rows}
    return {f: (at[f][1], (at[f][2] - at[f][0]) or 1.0) for f in features}


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` kept, with a number that rises with ``order`` (and has gaps): sorted in ranges, so neither a stratum nor a value is one task."""
    return kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))


#: Rows that are sent to every task at most.
FEW = 100_000


def _bounded(rows: int) -> Callable[[DataFrame], DataFrame]:
    """How a table of about ``rows`` rows joins a larger one."""
    return F.broadcast if rows <= FEW else lambda df: df.hint("merge")


#: Rows of a slab, about, and the strips that it is made of.
SLAB, STRIPS = 40_000, 4
#: Negatives of a cell, about; positives that have more than ``CROWD`` in sight, and lists that are made late, keep to the first ``LATE``.
CELL, CROWD, LATE = 8, 1024, 64


class _Negatives:
    """Negatives of one task by cells of their first two features, about as wide as high."""

    def __init__(self, x: np.ndarray, rank: np.ndarray, holder: np.ndarray, first: bool, last: bool):
        n = len(x)
        sides = [np.sort(x[:, i]) for i in range(min(2, x.shape[1]))]
        wide = [s[n * 9 // 10] - s[n // 10] or s[-1] - s[0] for s in sides]
        cells, across = max(1, n // CELL), 1
        if len(sides) == 1 or not wide[1]:
            across = cells
        elif wide[0]:
            across = int(min(cells, max(1.0, math.sqrt(cells * (wide[0] / wide[1])))))
        self.cuts = [np.unique(s[np.arange(1, c) * n // c]) for s, c in zip(sides, (across, cells // across), strict=False)]
        self.cuts += [np.zeros(0)] * (2 - len(self.cuts))
        self.high = len(self.cuts[1]) + 1
        at = self.cell(x, 0) * self.high + self.cell(x, 1)
        order = np.argsort(at, kind="stable")
        self.x, self.rank, self.holder = x[order], rank[order], holder[order].copy()
        self.start = np.searchsorted(at[order], np.arange((len(self.cuts[0]) + 1) * self.high + 1))
        self.ends = -np.inf if first else sides[0][0], np.inf if last else sides[0][-1]

    def cell(self, x: np.ndarray, i: int) -> np.ndarray:
        return np.searchsorted(self.cuts[i], x[:, i], side="right") if len(self.cuts[i]) else np.zeros(len(x), np.int64)

    def block(self, own: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
        """For each of ``own`` how far the cells up to ``m`` away let it see, and per row of cells whose it is, its first negative and their number."""
        sight, low, high = np.full(len(own), np.inf), [], []
        for i, cuts in enumerate(self.cuts):
            c = self.cell(own, i)
            a, z = np.maximum(c - m, 0), np.minimum(c + m, len(cuts))
            edge = np.concatenate([[self.ends[0] if i == 0 else -np.inf], cuts, [self.ends[1] if i == 0 else np.inf]])
            if i < own.shape[1]:
                sight = np.minimum(sight, np.minimum(own[:, i] - edge[a], edge[z + 1] - own[:, i]))
            low.append(a)
            high.append(z)
        lines = high[0] - low[0] + 1
        who = np.repeat(np.arange(len(own)), lines)
        line = (np.arange(len(who)) - np.repeat(np.cumsum(lines) - lines, lines) + low[0][who]) * self.high
        begin = self.start[line + low[1][who]]
        return np.maximum(sight, 0.0), who, begin, self.start[line + high[1][who] + 1] - begin

    def choices(self, own: np.ndarray, ranks: np.ndarray, block: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """Pairs of ``own`` and the negatives that would take it and are nearer than its sight, ``own``'s in order: numbers of both, distances."""
        sight, who, begin, number = block
        j = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number - begin, number)
        who = np.repeat(who, number)
        open_to = self.holder[j] > ranks[who]
        j, who = j[open_to], who[open_to]
        away = (self.x[j, 0] - own[who, 0]) ** 2
        for i in range(1, own.shape[1]):
            away += (self.x[j, i] - own[who, i]) ** 2
        near = away < sight[who] ** 2
        return who[near], j[near], away[near]

    def lists(self, own: np.ndarray, ranks: np.ndarray) -> dict[int, list[int]]:
        """Per rank its nearest negatives, nearest first, the smaller rank first at ties; none for those in a crowd, which look around when it's their turn."""
        block = self.block(own, 1)
        total = np.bincount(block[1], block[3], len(own))
        calm = np.flatnonzero(total <= CROWD)
        out: dict[int, list[int]] = {}
        for part in np.array_split(calm, max(1, int(total[calm].sum()) // 500_000)):
            who, j, away = self.choices(own[part], ranks[part], self.block(own[part], 1))
            order = np.lexsort((self.rank[j], away, who))
            upto = np.searchsorted(who[order], np.arange(len(part) + 1))
            found = j[order].tolist()
            out.update({r: found[a:z] for r, a, z in zip(ranks[part].tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True)})
        return out

    def late(self, own: np.ndarray, r: int, m: int) -> tuple[list[int], int]:
        """The first negatives that would take rank ``r`` now, from blocks that grow from ``m``, and the block's size; an empty list if nothing is sure."""
        own, ranks = own[None, :], np.array([r])
        while True:
            _, j, away = self.choices(own, ranks, self.block(own, m))
            if len(j) > LATE:
                far = np.partition(away, LATE - 1)[LATE - 1]
                nearer, same = np.flatnonzero(away < far), np.flatnonzero(away == far)
                same = same[np.argsort(self.rank[j[same]])[: LATE - len(nearer)]]
                pick = np.concatenate([nearer, same])
                j, away = j[pick], away[pick]
            if len(j) or m > max(len(c) for c in self.cuts):
                return j[np.lexsort((self.rank[j], away))].tolist(), m
            m *= 2


def _settle(k_columns: list[str], x_columns: list[str]):
    """One slab: its positives with open places propose to the nearest negatives that would take them, those of the strips beside it included. A negative
    takes a positive if it holds none or one of a later rank, which then proposes again. A positive that may have a nearer negative beyond the
    strips in sight waits for a wider view."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        label = rows["_label"].to_numpy(dtype=bool)
        x, rank, value = rows[x_columns].to_numpy(), rows["_rank"].to_numpy(), rows["_value"].to_numpy()
        first, last = bool(rows["_first"].iloc[0]), bool(rows["_last"].iloc[0])
        need, own = dict(zip(rank[label].tolist(), value[label].tolist(), strict=True)), x[label]
        place = dict(zip(need, range(len(need)), strict=True))
        todo, taken, wide = sorted(r for r in need if need[r] > 0), set(), False
        if label.all():
            todo, wide, q = [], not (first and last), None
        else:
            q = _Negatives(x[~label], rank[~label], value[~label], first, last)
            at = np.array([place[r] for r in todo], np.int64)
            lists = q.lists(own[at], np.array(todo, np.int64))
        queued, step, sizes = set(todo), {}, {}
        while todo:
            r = heapq.heappop(todo)
            queued.discard(r)
            while need[r] > 0:
                choices, i = lists.get(r, ()), step.get(r, 0)
                while i < len(choices) and q.holder[choices[i]] <= r:
                    i += 1
                if i == len(choices):
                    lists[r], sizes[r] = q.late(own[place[r]], r, sizes.get(r, 1))
                    step[r] = 0
                    if not lists[r]:
                        wide |= not (first and last)
                        break
                    continue
                j, step[r] = choices[i], i + 1
                before, q.holder[j] = int(q.holder[j]), r
                taken.add(j)
                need[r] -= 1
                if before in need:
                    need[before] += 1
                    if before not in queued:
                        queued.add(before)
                        heapq.heappush(todo, before)
        at = np.array(sorted(taken), np.int64)
        ranks, holders = (q.rank[at], q.holder[at]) if q else (at, at)
        out = pd.DataFrame({"_rank": np.append(ranks, [-1] * wide), "_holder": np.append(holders, [-1] * wide)}).astype("int64")
        return out.assign(_t=int(rows["_t"].iloc[0]), **{c: [rows[c].iloc[0]] * len(out) for c in k_columns})[[*k_columns, "_t", "_rank", "_holder"]]

    return run


def nearest_unused(rows: DataFrame, strata: Sequence[str], x: Sequence[str], k: int = 1, slab: int | None = None) -> DataFrame:
    """``strata``, ``_rank`` of a negative and ``_holder``, the rank of the positive that gets it: what the loop gives in which the positives of a stratum, in the order of
    their ranks, take their ``k`` nearest unused negatives, ties going to the smaller rank.

    ``rows``: ``strata``, ``_label``, ``_rank`` (unique in a stratum, from 0), the columns ``x`` (double). All negatives prefer the same order of positives, so the loop's
    result is the only stable one, and proposals in any order reach it. A stratum is cut to strips along the first of ``x``; a task has a slab of ``STRIPS``
    strips, about ``slab`` rows, and a strip on either side, and rounds go on while a positive lacks a negative: the first settles almost all, the next ones what
    met across a border. Every second round's slabs begin half a slab later, so that what met at a border is in one slab then. The view of a slab widens only where it must.
    There must be ``k`` negatives for each positive. Runs a few jobs a round."""
    slab, strata, x = slab or SLAB, list(strata), list(x)
    line = numbered(rows.select(*strata, "_label", "_rank", *x), [*strata, x[0], "_rank"], "_line")
    base = line.withColumn("_strip", F.floor(F.col("_line") / max(1, slab // STRIPS))).drop("_line")
    strips = base.groupBy(*strata, "_strip").agg(F.lit(1).alias("_one"))
    strips = strips.withColumns({"_i": F.row_number().over(Window.partitionBy(*strata).orderBy("_strip")) - 1, "_n": F.count("*").over(Window.partitionBy(*strata))})
    strips = kept(strips.select(*strata, "_strip", F.col("_i").cast("long").alias("_i"), "_n"))
    few = _bounded(strips.count())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*strata).schema.fields)
    holds, state, widths, turn = None, None, strips.select(*strata, "_i", F.lit(1).alias("_wide")), 0

    def valued(df: DataFrame) -> DataFrame:
        """``_value``: a positive's open places, a negative's holder."""
        df = df.withColumn("_held", F.lit(None).cast("long")) if state is None else df.join(state, [*strata, "_label", "_rank"], "left")
        return df.withColumn("_value", F.when(F.col("_label"), F.lit(k) - F.coalesce("_held", F.lit(0))).otherwise(F.coalesce("_held", F.lit(FREE)))).drop("_held")

    while True:
        shift = turn % 2 * (STRIPS // 2)
        task = strips.withColumn("_t", F.floor((F.col("_i") + shift) / STRIPS))
        waits = valued(base.where("_label")).where("_value > 0").select(*strata, "_strip").distinct()
        asked = task.join(widths, [*strata, "_i"]).groupBy(*strata, "_t").agg(F.max("_wide").alias("_wide"), F.max("_n").alias("_n"))
        active = kept(few(task).join(waits, [*strata, "_strip"]).select(*strata, "_t").distinct().join(asked, [*strata, "_t"]))
        if active.isEmpty():
            return holds if holds is not None else base.select(*strata, "_rank", F.lit(FREE).alias("_holder")).limit(0)
        begin = F.col("_t") * STRIPS - shift
        low, high = begin - F.col("_wide"), begin + STRIPS - 1 + F.col("_wide")
        seen = active.select(*strata, "_t", begin.alias("_begin"), (low <= 0).alias("_first"), (high >= F.col("_n") - 1).alias("_last"), F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.col("_n") - 1))).alias("_i"))
        seen = seen.withColumn("_own", F.col("_i").between(F.col("_begin"), F.col("_begin") + STRIPS - 1)).join(strips.drop("_n"), [*strata, "_i"]).drop("_i", "_begin")
        mine = valued(base.join(few(seen), [*strata, "_strip"]).where("not _label or _own")).select(*strata, "_t", "_first", "_last", "_label", "_rank", "_value", *x)
        found = kept(mine.groupBy(*strata, "_t").applyInPandas(_settle(strata, x), f"{schema}, _t long, _rank long, _holder long"))
        if found.isEmpty():
            raise ValueError("fewer negatives than positives ask for")
        new = found.where("_rank >= 0").select(*strata, "_rank", "_holder")
        holds = kept((new if holds is None else holds.union(new)).groupBy(*strata, "_rank").agg(F.min("_holder").alias("_holder")))
        own = holds.groupBy(*strata, F.col("_holder").alias("_rank")).agg(F.count("*").alias("_held")).withColumn("_label", F.lit(True))
        state = holds.withColumn("_label", F.lit(False)).withColumnRenamed("_holder", "_held").unionByName(own)
        wider = found.where("_rank < 0").select(*strata, "_t").join(active, [*strata, "_t"]).select(*strata, "_t", (F.col("_wide") * 2).alias("_wide"))
        widths = kept(widths.union(task.join(wider, [*strata, "_t"]).select(*strata, "_i", "_wide")).groupBy(*strata, "_i").agg(F.max("_wide").alias("_wide")))
        turn += 1


def match_features(pos: DataFrame, neg: DataFrame, key: Sequence[str], features: Sequence[str], strata: Sequence[str], k: int = 1) -> DataFrame:
    """Give each positive its ``k`` nearest unused negatives of the same stratum, positives in the order of ``key``.

    Negatives in strata without positives are dropped before features are scaled (median and quartile range over both). A stratum
    with too few negatives keeps its first ``n_neg // k`` positives by a hash of the key. Distance is Euclidean, ties go to the smaller
    key (unique in a stratum, within positives and within negatives). Nulls in features are an error. Returns all columns of both, ``label`` and ``match_group`` (the
    positive's key as text). No stratum is one task, see ``nearest_unused``; runs jobs while it is built.
    """
    for df, n in ((pos, "positives"), (neg, "negatives")):
        missing = [c for c in (*key, *features, *strata) if c not in df.columns]
        if missing:
            raise ValueError(f"{n} lack {missing}")
    strata, key = list(strata), list(key)
    places = kept(pos.select(*strata).distinct())
    usable = neg.join(_bounded(places.count())(places), strata, "left_semi")
    both = kept(pos.withColumn("label", F.lit(True)).unionByName(usable.withColumn("label", F.lit(False)), allowMissingColumns=True))
    nulls = both.agg(*[F.sum(F.col(f).isNull().cast("int")).alias(f) for f in features]).first()
    if any(nulls[f] for f in features):
        raise ValueError(f"nulls in {[f for f in features if nulls[f]]}")
    x = {f"_x{i}": (F.col(f).cast("double") - m) / s for i, (f, (m, s)) in enumerate(robust_scales(both, features).items())}
    rows = numbered(both.withColumns(x), [*strata, *[c for c in key if c not in strata], "label"], "_rank")
    room = rows.groupBy(*strata).agg(F.sum(F.col("label").cast("long")).alias("_p"), F.floor(F.sum((~F.col("label")).cast("long")) / k).alias("_most"))
    short = kept(room.where("_p > _most").drop("_p"))
    if not short.isEmpty():
        marked = rows.where("label").withColumn("_mark", F.xxhash64(F.concat_ws("|", *[F.col(c).cast("string") for c in key])))
        gone = tables.index_in_group(marked.join(short, strata), strata, ["_mark", "_rank"], "_turn").where("_turn >= _most").select(*strata, "_rank")
        rows = kept(rows.join(gone, [*strata, "_rank"], "left_anti"))
    holds = nearest_unused(rows.withColumnRenamed("label", "_label"), strata, list(x), k)
    label = F.concat_ws(":", *[F.col(c).cast("string") for c in key])
    groups = rows.where("label").select(*strata, F.col("_rank").alias("_holder"), label.alias("match_group"))
    negatives = rows.where("not label").join(holds, [*strata, "_rank"]).join(groups, [*strata, "_holder"])
    columns = [*both.columns, "match_group"]
    return rows.where("label").withColumn("match_group", label).select(columns).union(negatives.select(columns))


def matching_qc(pre: DataFrame, post: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Per subset the positives before and after and what was dropped; and per feature the better of its two average precisions, with its sign."""
    before = pre.where("label").groupBy("subset").agg(F.count("*").alias("n_input"))
    after = post.groupBy("subset").agg(F.sum(F.col("label").cast("long")).alias("n_kept"), F.avg(F.col("label").cast("double")).alias("baseline"))
    counts = before.join(after, "subset", "full").select("subset", F.coalesce("n_input", F.lit(0)).alias("n_input"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "baseline")
    counts = counts.withColumn("n_dropped", F.col("n_input") - F.col("n_kept")).withColumn("dropped_share", F.col("n_dropped") / F.nullif(F.col("n_input"), F.lit(0)))
    long = metrics.unpivot_scores(post, ["subset", "label"], features)
    up = metrics.ranking_metrics(long, ["subset", "score_type"]).select("subset", "score_type", F.col("auprc").alias("plus"))
    down = metrics.ranking_metrics(long.withColumn("score", -F.col("score")), ["subset", "score_type"]).select("subset", "score_type", F.col("auprc").alias("minus"))
    leak = up.join(down, ["subset", "score_type"]).select("subset", F.col("score_type").alias("feature"), F.greatest("plus", "minus").alias("auprc"), F.when(F.col("plus") >= F.col("minus"), 1).otherwise(-1).alias("sign"))
    return counts, leak


def gc_repeat_match(pos: DataFrame, neg: DataFrame, bins: int = 20, by_chrom: bool = True) -> DataFrame:
    """As many negatives as positives with like GC content and repeat share (columns ``id, gc, repeats``, and ``chrom``).

    First the n-th positive of a cell (chromosome, GC bin, repeat bin) takes its n-th negative, in the order of a hash of the id, by a join
    of ranks; then positives without one take the nearest unused negatives of the chromosome. Too few negatives is an error.
    """
    where = ["chrom"] if by_chrom else []
    place = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1))
    def ranked(df: DataFrame) -> DataFrame:
        cell = df.withColumns({"_g": place("gc"), "_r": place("repeats")})
        return cell.withColumn("_n", F.row_number().over(Window.partitionBy(*where, "_g", "_r").orderBy(F.xxhash64("id"), "id")))
    cell = [*where, "_g", "_r", "_n"]
    p, q = ranked(pos), ranked(neg)
    hit = p.select(F.col("id").alias("positive_id"), *cell).join(q, cell)
    rest_p = p.join(hit.select(F.col("positive_id").alias("id")), "id", "left_anti").withColumn("label", F.lit(True))
    rest_q = q.join(hit.select("id"), "id", "left_anti").withColumn("label", F.lit(False))
    columns = ["id", *where, "gc", "repeats"]
    left = rest_p.select(*columns, "label").union(rest_q.select(*columns, "label"))
    short = left.groupBy(*where).agg(F.sum(F.col("label").cast("long")).alias("p"), F.sum((~F.col("label")).cast("long")).alias("q")).where("p > q").first()
    if short:
        raise ValueError(f"{short['p']} positives, {short['q']} negatives left")
    strata = where or ["_all"]
    left = left if where else left.withColumn("_all", F.lit(1))
    ranked = numbered(left.withColumns({"_x0": F.col("gc").cast("double"), "_x1": F.col("repeats").cast("double")}), [*strata, "id", "label"], "_rank")
    holds = nearest_unused(ranked.withColumnRenamed("label", "_label"), strata, ["_x0", "_x1"])
    names = ranked.where("label").select(*strata, F.col("_rank").alias("_holder"), F.col("id").alias("positive_id"))
    second = ranked.where("not label").join(holds, [*strata, "_rank"]).join(names, [*strata, "_holder"]).select("positive_id", "id", "gc", "repeats", *where)
    return hit.select("positive_id", "id", "gc", "repeats", *where).union(second)
