"""Ranking metrics of scored, labelled rows: pairwise accuracy, average precision, AUROC, Spearman, curves, rollups, bootstrap.

Scores are grouped by distinct value first, so ties count together and the ordered windows run over one row per value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .kept import kept

GLOBAL, MACRO = "_global_", "_macro_avg_"


def unpivot_scores(df: DataFrame, keep: Sequence[str], scores: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keep), [*[F.col(s).cast("double").alias(s) for s in scores]], "score_type", "score")


def reject_nan(df: DataFrame, column: str = "score") -> DataFrame:
    """Fail the query on a null or NaN score."""
    c = F.col(column).cast("double")
    return df.withColumn(column, F.when(c.isNull() | F.isnan(c), F.raise_error(F.lit("NaN score")).cast("double")).otherwise(c))


def with_rollups(df: DataFrame) -> DataFrame:
    """Each row once in its subset and once in the global one."""
    return df.withColumn("subset", F.explode(F.array("subset", F.lit(GLOBAL))))


def pairwise_accuracy(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of groups (one positive, one negative each, else an error) whose positive scores higher; ties count half. Wald error."""
    pos, neg = F.when(F.col("label"), F.col("score")), F.when(~F.col("label"), F.col("score"))
    groups = reject_nan(df).groupBy(*by, "match_group").agg(F.max(pos).alias("p"), F.max(neg).alias("q"), F.count(pos).alias("np"), F.count(neg).alias("nq"))
    good = F.when((F.col("np") != 1) | (F.col("nq") != 1), F.raise_error(F.lit("a group needs one positive and one negative")).cast("double"))
    won = F.coalesce(good, F.when(F.col("p") > F.col("q"), 1.0).when(F.col("p") == F.col("q"), 0.5).otherwise(0.0))
    out = groups.groupBy(*by).agg(F.avg(won).alias("value"), F.count("*").alias("n_pairs"), F.sum((F.col("p") == F.col("q")).cast("long")).alias("n_ties"))
    return out.withColumn("se", F.sqrt(F.col("value") * (1.0 - F.col("value")) / F.col("n_pairs")))


def macro_average(per_subset: DataFrame, n_min: int, n: str = "n_pairs") -> DataFrame:
    """Mean over the subsets with at least ``n_min`` groups; its error is the root of the summed squares over their number."""
    own = per_subset.where((F.col("subset") != GLOBAL) & (F.col(n) >= n_min)).groupBy("score_type")
    return own.agg(F.avg("value").alias("value"), F.count("*").alias(n), F.sum("n_ties").alias("n_ties"), (F.sqrt(F.sum(F.col("se") * F.col("se"))) / F.count("*")).alias("se")).withColumn("subset", F.lit(MACRO))


def pairwise_metrics(df: DataFrame, n_min: int = 1) -> DataFrame:
    """``score_type, subset, value, se, n_pairs, n_ties`` per subset, globally and as macro average. A group may not straddle subsets."""
    straddles = F.when(F.count_distinct("subset") > 1, F.raise_error(F.lit("a group straddles subsets")).cast("string")).otherwise(F.min("subset"))
    home = df.groupBy("match_group").agg(straddles.alias("subset"))
    checked = df.drop("subset").join(home, "match_group")
    per = pairwise_accuracy(with_rollups(checked), ["score_type", "subset"])
    return per.unionByName(macro_average(per, n_min))


def _steps(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per distinct score the positives and rows at it and above it."""
    y = F.col("label").cast("int")
    n = reject_nan(df).groupBy(*by, "score").agg(F.sum(y).cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    r = ranks.running_sums(df, n, by, "score", ["p", "n"])
    tp, k = F.col("p_all") - F.col("p_upto") + F.col("p"), F.col("n_all") - F.col("n_upto") + F.col("n")
    return r.select(*by, "score", "p", "n", tp.alias("tp"), k.alias("k"), F.col("p_all").alias("all_p"), F.col("n_all").alias("all_n"))


def ranking_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``auprc`` (sum of recall steps times precision), ``auroc``, ``spearman``, ``n_pos``, ``n_neg``; null where a class is missing."""
    s = _steps(df, by)
    # mean rank of a value from below: rows below it, plus half of its own and a half
    low = F.col("all_n") - F.col("k") + (F.col("n") + 1.0) / 2.0
    s = s.withColumn("rank", low)
    P, N = F.max("all_p"), F.max("all_n")
    y_rank_pos, y_rank_neg = (F.max("all_n") - F.max("all_p")) + (F.max("all_p") + 1.0) / 2.0, (F.max("all_n") - F.max("all_p") + 1.0) / 2.0
    mean = (N + 1.0) / 2.0
    rank_sum = F.sum(F.col("p") * F.col("rank"))
    var_x = F.sum(F.col("n") * F.col("rank") * F.col("rank")) - N * mean * mean
    var_y = P * y_rank_pos * y_rank_pos + (N - P) * y_rank_neg * y_rank_neg - N * mean * mean
    cov = rank_sum * y_rank_pos + (N * mean - rank_sum) * y_rank_neg - N * mean * mean
    both = (P > 0) & (P < N)
    out = s.groupBy(*by).agg(
        F.when(P > 0, F.sum(F.col("p") * F.col("tp") / F.col("k")) / F.nullif(P, F.lit(0.0))).alias("auprc"),
        F.when(both, (rank_sum - P * (P + 1.0) / 2.0) / F.nullif(P * (N - P), F.lit(0.0))).alias("auroc"),
        F.when(both & (var_x > 0), cov / F.nullif(F.sqrt(F.abs(var_x * var_y)), F.lit(0.0))).alias("spearman"),
        P.cast("long").alias("n_pos"),
        (N - P).cast("long").alias("n_neg"),
    )
    return out


def precision_recall(df: DataFrame, by: Sequence[str] = (), closed: bool = False) -> DataFrame:
    """Precision and recall at each distinct score as threshold; ``closed`` adds the end of the curve, precision 1 and recall 0, with a null threshold."""
    s = _steps(df, by)
    curve = s.select(*by, F.col("score").alias("threshold"), (F.col("tp") / F.col("k")).alias("precision"), (F.col("tp") / F.nullif(F.col("all_p"), F.lit(0.0))).alias("recall"))
    if not closed:
        return curve
    end = curve.select(*by).distinct() if by else curve.limit(1)
    return curve.union(end.select(*by, F.lit(None).cast(curve.schema["threshold"].dataType), F.lit(1.0), F.lit(0.0)))


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact binomial probability, ties left out."""
    from math import comb

    n = wins + losses
    if not n:
        return 1.0
    return min(1.0, 2.0 * sum(comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n)


def average_precision(label: np.ndarray, score: np.ndarray, weight: np.ndarray | None = None) -> float:
    weight = np.ones(len(label)) if weight is None else weight
    order = np.argsort(-score, kind="stable")
    y, w, s = label[order] * weight[order], weight[order], score[order]
    last = np.append(np.flatnonzero(np.diff(s)), len(s) - 1)
    tp, k = np.cumsum(y)[last], np.cumsum(w)[last]
    if not len(tp) or tp[-1] == 0 or tp[-1] == k[-1]:
        return np.nan
    return float((np.diff(tp, prepend=0) * tp / np.maximum(k, 1e-300)).sum() / tp[-1])


#: Groups of a bucket of the resampling tree, about, and buckets of one of its nodes.
BUCKET_GROUPS, FAN = 1024, 1024


def _part(counts: np.ndarray, at: int, n: np.ndarray, key: Sequence[int]) -> np.ndarray:
    """How many of each draw's ``n`` picks fall to ``counts[at]``, by halving the range: a node of the tree deals its picks to its halves by
    binomials that depend on the key and the node alone, so every bucket sees the same draws."""
    lo, hi = 0, len(counts)
    run = np.append(0, np.cumsum(counts))
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([*key, lo, hi]).binomial(n, (run[mid] - run[lo]) / max(run[hi] - run[lo], 1))
        n, lo, hi = (left, lo, mid) if at < mid else (n - left, mid, hi)
    return n


def _weighted(by: Sequence[str], draws: int, seed: int):
    """Rows of one bucket with ``w``: how often each draw takes the row's group, after a one for the data itself."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        key = [seed, int(first["_key"])]
        picks = _part(np.array(first["_tops"]), int(first["_top"]), np.full(draws, int(first["_groups"])), key)
        picks = _part(np.array(first["_leaves"]), int(first["_leaf"]), picks, [*key, int(first["_top"])])
        names = sorted(set(rows["match_group"]))
        rng = np.random.default_rng([*key, int(first["_top"]), int(first["_leaf"]), 0])
        w = np.ones((draws + 1, len(names)), np.uint32)
        w[1:] = rng.multinomial(picks, np.full(len(names), 1 / len(names)))
        at = {g: i for i, g in enumerate(names)}
        return rows[[*by, "score", "_cell", "p", "n"]].assign(w=[np.ascontiguousarray(w[:, at[g]]).tobytes() for g in rows["match_group"]])

    return run


def _sums(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weighted positives and rows at each distinct score of ``rows``, from the highest down: a row for each score, a column for each draw."""
    rows = rows.sort_values("score", ascending=False)
    score, w = rows["score"].to_numpy(), np.stack([np.frombuffer(x, np.uint32) for x in rows["w"]])
    start = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
    return tuple(np.add.reduceat(w * rows[c].to_numpy()[:, None], start, dtype=np.float64) for c in ("p", "n"))


def bootstrap_auprc(df: DataFrame, by: Sequence[str], draws: int = 1000, seed: int = 0) -> DataFrame:
    """Average precision and its error from resampling whole match groups with replacement.

    Each draw takes as many groups as there are. The picks go down a tree of buckets of groups by binomials that are seeded by ``seed``, the group of
    ``by`` and the node, so a bucket finds its share of all draws by itself, deals it to its groups, and the draws don't depend on
    partitions. A row then carries its weights of all draws as one value; rows are summed inside cells of scores (``ranks.cell_of``), with what lies above
    a cell from the sums of cells, so the number of rows that are shuffled doesn't depend on ``draws``. A task holds the rows of one cell
    (a 1024th) with 4 bytes a draw. A draw without both classes counts for nothing. Runs three jobs while it is built.
    """
    by, y = list(by), F.col("label").cast("int")
    celled = reject_nan(df).withColumn("_cell", ranks.cell_of(df, "score"))
    cells = celled.groupBy(*by, "match_group", "score", "_cell").agg(F.sum(y).cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    groups = df.select(*by, "match_group").distinct()
    size = groups.groupBy(*by).agg(F.count("*").alias("_groups"))
    buckets = F.greatest(F.ceil(F.col("_groups") / BUCKET_GROUPS), F.lit(1))
    dealt = groups.join(size, by).withColumn("_bucket", F.pmod(F.xxhash64("match_group"), buckets))
    dealt = dealt.withColumns({"_top": F.shiftright("_bucket", 10), "_leaf": F.pmod("_bucket", F.lit(FAN))})
    leaf = dealt.groupBy(*by, "_top", "_leaf").agg(F.count("*").alias("_n"))
    in_order = lambda place: F.transform(F.array_sort(F.collect_list(F.struct(place, "_n"))), lambda x: x["_n"])
    # buckets of a node without groups don't stand in the lists, so places are ranks among those that do
    leaves = leaf.groupBy(*by, "_top").agg(in_order("_leaf").alias("_leaves"), F.array_sort(F.collect_list("_leaf")).alias("_leaf_ids"), F.sum("_n").alias("_n"))
    tops = leaves.groupBy(*by).agg(in_order("_top").alias("_tops"), F.array_sort(F.collect_list("_top")).alias("_top_ids"))
    nodes = leaves.drop("_n").join(tops, by)
    placed = dealt.join(nodes, [*by, "_top"]).withColumns({"_leaf": F.array_position("_leaf_ids", F.col("_leaf")) - 1, "_top": F.array_position("_top_ids", F.col("_top")) - 1})
    placed = placed.withColumn("_key", F.pmod(F.xxhash64(*by), F.lit(1 << 62))).drop("_leaf_ids", "_top_ids", "_bucket")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)
    rows = kept(cells.join(placed, [*by, "match_group"]).groupBy(*by, "_top", "_leaf").applyInPandas(_weighted(by, draws, seed), f"{schema}, score double, _cell int, p double, n double, w binary"))

    def totals(part: pd.DataFrame) -> pd.DataFrame:
        p, n = _sums(part)
        return part[[*by, "_cell"]].head(1).assign(p=p.sum(0).tobytes(), n=n.sum(0).tobytes())

    def before(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_cell", ascending=False)
        run = {c: np.cumsum(np.stack([np.frombuffer(x) for x in part[c]]), 0) for c in ("p", "n")}
        return part[[*by, "_cell"]].assign(**{f"{c}_above": [(x - np.frombuffer(own)).tobytes() for x, own in zip(run[c], part[c], strict=True)] for c in run}, p_all=run["p"][-1].tobytes(), n_all=run["n"][-1].tobytes())

    def steps(part: pd.DataFrame) -> pd.DataFrame:
        above, first = part[part["w"].isna()].iloc[0], part[[*by]].head(1)
        p, n = _sums(part[part["w"].notna()])
        tp, k = np.frombuffer(above["p_above"]) + np.cumsum(p, 0), np.frombuffer(above["n_above"]) + np.cumsum(n, 0)
        return first.assign(area=(p * tp / np.maximum(k, 1)).sum(0).tobytes(), p_all=above["p_all"], n_all=above["n_all"])

    def errors(part: pd.DataFrame) -> pd.DataFrame:
        area, p, n = np.stack([np.frombuffer(x) for x in part["area"]]).sum(0), np.frombuffer(part["p_all"].iloc[0]), np.frombuffer(part["n_all"].iloc[0])
        good = (p > 0) & (p < n)
        value = np.where(good, area / np.maximum(p, 1), np.nan)
        own = value[1:][good[1:]]
        return part[by].head(1).assign(value=value[0], se=np.std(own, ddof=1) if len(own) > 1 else np.nan, n_draws=len(own))

    summed = rows.groupBy(*by, "_cell").applyInPandas(totals, f"{schema}, _cell int, p binary, n binary")
    above = summed.groupBy(*by).applyInPandas(before, f"{schema}, _cell int, p_above binary, n_above binary, p_all binary, n_all binary")
    areas = rows.unionByName(above, allowMissingColumns=True).groupBy(*by, "_cell").applyInPandas(steps, f"{schema}, area binary, p_all binary, n_all binary")
    found = areas.groupBy(*by).applyInPandas(errors, f"{schema}, value double, se double, n_draws long")
    return found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("value", "se")})


def auprc_metrics(df: DataFrame, n_min: int = 30, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Like ``pairwise_metrics`` for average precision with bootstrap errors; ``n_groups`` counts match groups."""
    rolled = with_rollups(df)
    by = ["score_type", "subset"]
    n = rolled.groupBy(*by).agg(F.count_distinct("match_group").alias("n_groups"))
    per = bootstrap_auprc(rolled, by, draws, seed).drop("n_draws").join(n, by).withColumn("n_ties", F.lit(0).cast("long"))
    return per.unionByName(macro_average(per, n_min, "n_groups")).drop("n_ties")


def strand_average(df: DataFrame, by: Sequence[str] = ("variant_id",), transform=lambda c: c, before: bool = True) -> DataFrame:
    """One score a variant from its strands: averaged before or after ``transform``. Repeated strands and differing labels are errors."""
    score = transform(F.avg("score")) if before else F.avg(transform(F.col("score")))
    out = df.groupBy(*by).agg(score.alias("score"), F.count("*").alias("n"), F.count_distinct("strand").alias("strands"), F.min("label").alias("label"), F.max("label").alias("other"), F.min("subset").alias("subset"), F.min("match_group").alias("match_group"))
    ok = (F.col("n") == F.col("strands")) & (F.col("label") == F.col("other"))
    return out.withColumn("score", F.when(ok, F.col("score")).otherwise(F.raise_error(F.lit("repeated strand or differing labels")).cast("double"))).drop("n", "strands", "other")
