"""Aggregates, checks and table-shaping steps of the evaluation and dataset pipelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import ranks
from .sampling import draw, sample
from .tiles import inside, with_carry, with_tile


def joined_in_order(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, sep: str = "|") -> DataFrame:
    """Distinct non-null values of each key in the order of their first appearance, as one text."""
    first = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(F.struct(*order)).alias("_at"))
    own = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", value))).alias("x"))
    return own.select(*key, F.array_join(F.transform("x", lambda x: x[value].cast("string")), sep).alias(value))


def summary_with_quantiles(df: DataFrame, group: str, value: str, quantiles: Sequence[float]) -> DataFrame:
    """Per group number, total, mean, standard deviation, nearest-rank quantiles ``p1, p10, ...`` and the shares of all rows and of the total.

    Quantiles come from counts by distinct value, so equal values of a hot group are one row."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("c"))
    ranked = ranks.running_sums(df, counts, [group], value, ["c"]).withColumnsRenamed({"c_upto": "upto", "c_all": "n"})
    place = lambda q: F.floor(F.lit(q) * (F.col("n") - 1) + 0.5) + 1
    picks = [F.min(F.when(F.col("upto") >= place(q), F.col(value))).alias(f"p{round(q * 100)}") for q in quantiles]
    n, total = F.sum("c"), F.sum(F.col("c") * F.col(value))
    mean = total / n
    spread = F.sqrt(F.try_divide(F.sum(F.col("c") * F.col(value).cast("double") * F.col(value)) - total * mean, n - 1))
    out = ranked.groupBy(group).agg(n.alias("n"), total.alias("total"), mean.alias("mean"), spread.alias("sd"), *picks)
    whole = out.agg(F.sum("n").alias("_n"), F.sum("total").alias("_t"))
    return out.join(F.broadcast(whole)).withColumns({"n_share": F.col("n") / F.col("_n"), "total_share": F.col("total") / F.col("_t")}).drop("_n", "_t")


def wide_row(df: DataFrame, name_of: Mapping[str, str], source: str, value: str, order: Sequence[str]) -> DataFrame:
    """The long rows of each mapped source as ``<name>_<index>``, ``value``; the index counts a name's rows from 0 in ``order``. A source that
    isn't mapped is an error. Pivot the few names of one variant to get one wide row."""
    from ..functions.columns import mapped

    named = df.withColumn("_name", mapped(F.col(source), name_of, strict=True))
    return index_in_group(named, ["_name"], order).select(F.concat("_name", F.lit("_"), F.col("index")).alias("track"), value)


def index_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "index") -> DataFrame:
    """A row's number in its group, from 0. Where the first of ``order`` is a number, rows are dealt to cells of it (``ranks.cell_of``, which runs a
    job), so a hot group isn't sorted in one task."""
    celled = df.withColumn("_cell", ranks.cell_of(df, order[0]) if isinstance(df.schema[order[0]].dataType, NumericType) else F.lit(0))
    line = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = celled.groupBy(*group, "_cell").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(line), F.lit(0)))
    before = before.select("_before", *[F.col(c).alias(f"_at_{c}") for c in (*group, "_cell")])
    placed = celled.join(before, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in (*group, "_cell")]))
    index = F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_cell").orderBy(*order)) - 1
    return placed.withColumn(name, index).select(*df.columns, name)


def group_audit(df: DataFrame, group: str, size: int, one: Sequence[str], two: Sequence[str] = ()) -> DataFrame:
    """One row: groups, and how many break a rule: other than ``size`` rows, other than one value in ``one``, other than two in ``two``."""
    n = df.groupBy(group).agg(F.count("*").alias("_n"), *[F.count_distinct(c).alias(c) for c in (*one, *two)])
    bad = lambda c, k: F.sum((F.col(c) != k).cast("long"))
    return n.agg(F.count("*").alias("groups"), bad("_n", size).alias("bad_size"), *[bad(c, 1).alias(f"bad_{c}") for c in one], *[bad(c, 2).alias(f"bad_{c}") for c in two])


def likelihood_gap(df: DataFrame) -> DataFrame:
    """One row from ``ll_upper, ll_lower, n_upper, n_lower``: mean log likelihoods by token over all rows and their gap; a side without tokens is an error."""
    u, l, nu, nl = (F.sum(F.col(c).cast("double")) for c in ("ll_upper", "ll_lower", "n_upper", "n_lower"))
    some = lambda n: F.when(n > 0, n).otherwise(F.raise_error(F.lit("no tokens on one side")).cast("double"))
    out = df.agg(((u + l) / (some(nu) + some(nl))).alias("ll_all"), (u / some(nu)).alias("ll_upper"), (l / some(nl)).alias("ll_lower"), nu.cast("long").alias("n_upper"), nl.cast("long").alias("n_lower"))
    return out.withColumn("gap", F.col("ll_upper") - F.col("ll_lower"))


def class_weight(df: DataFrame, labels: str = "labels") -> DataFrame:
    """One row: negatives per positive over all entries of the label arrays."""
    ones = F.aggregate(labels, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return df.agg(F.sum(F.size(labels).cast("long") - ones).alias("n_neg"), F.sum(ones).alias("n_pos")).withColumn("weight", F.col("n_neg") / F.nullif(F.col("n_pos"), F.lit(0)))


def leakage_summary(per_query: DataFrame) -> DataFrame:
    """One row over ``query, n_hits``: least, greatest, mean and median hits and the share of queries with any."""
    n = F.col("n_hits")
    return per_query.agg(F.count("*").alias("n_queries"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.avg((n > 0).cast("double")).alias("share"))


def pivot_statistics(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Mean and median count of each value of ``column`` over the values of ``row``, a missing one counting 0; one line a value."""
    from .aggregates import pivot_counts

    wide = pivot_counts(df, row, column, values)
    long = wide.unpivot([row], list(values), column, "n")
    return long.groupBy(column).agg(F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"))


def tagged_union(parts: Mapping[str, DataFrame], name: str) -> DataFrame:
    out = None
    for tag, df in parts.items():
        own = df.withColumn(name, F.lit(tag))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def strict_join(left: DataFrame, right: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Left join of a unique key that must find a value for every row and may not multiply rows, else the query fails."""
    once = right.groupBy(*key).agg(F.count("*").alias("_n"), F.first(column).alias("_v"))
    found = left.join(once, list(key), "left")
    good = F.when((F.col("_n") == 1) & F.col("_v").isNotNull(), F.col("_v")).otherwise(F.raise_error(F.lit("a row has no or several partners")).cast(right.schema[column].dataType))
    return found.withColumn(column, good).drop("_n", "_v")


def side_by_side(left: DataFrame, right: DataFrame, order: Sequence[str]) -> DataFrame:
    """Columns of two tables that hold the same keys, aligned by the keys instead of by place; a key that one side lacks fails the query."""
    l, r = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    both = l.join(r, list(order), "full")
    return both.where(F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("tables aren't aligned")).cast("boolean")).otherwise(F.lit(True))).drop("_l", "_r")


def row_max(df: DataFrame, columns: Sequence[str], name: str = "score") -> DataFrame:
    return df.withColumn(name, F.array_max(F.array(*columns)))


def gaps_in_order(df: DataFrame, group: str) -> DataFrame:
    """Rows whose successor in the group begins before they end: none in a clean list of intervals."""
    rows = with_carry(with_tile(df.withColumn("chrom", F.col(group)), "start"), _next=(F.min("start"), "min", "after"))
    after = F.coalesce(F.lead("start").over(inside("start", "end")), "_next")
    return rows.withColumn("_after", after).where(F.col("_after") < F.col("end")).select(df.columns)


def value_set_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values that one table has and the other lacks, with the side that has them; empty for equal sets."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    return x.join(y, column, "left_anti").withColumn("side", F.lit("left")).union(y.join(x, column, "left_anti").withColumn("side", F.lit("right")))


def genome_dedup(genomes: DataFrame, rank: str, levels: Sequence[str], worst: str, most: int, excluded: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """One genome for each value of ``rank`` (rows without one go): priority accessions first, then better assembly level, smaller size, name.
    Excluded accessions, levels behind ``worst`` and genomes of at least ``most`` bases go."""
    level = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col("assembly_level"))
    kept = genomes.where(~F.col("accession").isin(*excluded) & F.col(rank).isNotNull() & (level > 0) & (level <= levels.index(worst) + 1) & (F.col("size") < most))
    order = F.struct((~F.col("accession").isin(*priority)).cast("int").alias("p"), level.alias("l"), F.col("size"), F.col("name"), F.col("accession"))
    best = kept.groupBy(rank).agg(F.min_by(F.struct(*genomes.columns), order).alias("g"))
    return best.select("g.*")


def genome_set(genomes: DataFrame, rank: str | None = None, value: str | None = None, accessions: Sequence[str] | None = None) -> DataFrame:
    """Genomes with a rank's value, or the listed accessions; an unknown accession is an error."""
    if accessions is None:
        return genomes.where(F.col(rank) == value)
    found = genomes.where(F.col("accession").isin(*accessions))
    unknown = set(accessions) - {r[0] for r in found.select("accession").distinct().collect()}
    if unknown:
        raise ValueError(f"unknown accessions: {sorted(unknown)}")
    return found


def species_split(parts: Mapping[str, DataFrame], chroms: Mapping[str, Sequence[str]], seed: int, key: Sequence[str], most: int | None = None, add_rc: bool = False) -> DataFrame:
    """Rows of each species on its split's chromosomes together, with ``species``; with ``add_rc`` reverse complements too (``strand``); at most
    ``most``, drawn by seed; ``order`` sorts them at random."""
    from ..functions.sequence import reverse_complement

    rows = tagged_union({s: df.where(F.col("chrom").isin(*chroms[s])) for s, df in parts.items()}, "species")
    if add_rc:
        both = F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("seq")), F.struct(F.lit("-").alias("strand"), reverse_complement("seq").alias("seq")))
        rows = rows.withColumn("_b", F.explode(both)).drop("seq").select("*", "_b.*").drop("_b")
        key = [*key, "strand"]
    key = ["species", *key]
    kept = rows if most is None else sample(rows, most, seed, *key)
    return kept.withColumn("order", draw(seed + 1, *key))


def conservation_metrics(df: DataFrame, n_min: int = 30) -> DataFrame:
    """Pairwise accuracy of each ``score_type`` with gaps scored 0, and how many scores were gaps (``n_nan``) of ``n_total``, per subset, globally and
    over the subsets of the macro average."""
    from . import metrics

    gap = F.col("score").isNull() | F.isnan("score")
    per = metrics.pairwise_metrics(df.withColumn("score", F.when(gap, 0.0).otherwise(F.col("score"))), n_min)
    counts = metrics.with_rollups(df.withColumn("_gap", gap.cast("long"))).groupBy("score_type", "subset").agg(F.sum("_gap").alias("n_nan"), F.count("*").alias("n_total"))
    enough = per.where((~F.col("subset").isin(metrics.GLOBAL, metrics.MACRO)) & (F.col("n_pairs") >= n_min)).select("score_type", "subset")
    macro = counts.join(enough, ["score_type", "subset"]).groupBy("score_type").agg(F.sum("n_nan").alias("n_nan"), F.sum("n_total").alias("n_total")).withColumn("subset", F.lit(metrics.MACRO))
    return per.join(counts.unionByName(macro), ["score_type", "subset"])


def leaderboard(metrics: DataFrame, methods: DataFrame, protocols: DataFrame) -> DataFrame:
    """Rows ``method_id, display, family, protocol, subset, value, se, n_pairs, n_ties`` of the registered methods.

    ``metrics``: ``model, score_type, split, subset, value, se`` and ``n_pairs, n_ties`` or ``n_groups`` (then ties count 0). ``methods``: ``id,
    display, family``; ``protocols``: ``family, protocol, score_type, split`` (null fits any). A method without rows for a protocol is left out."""
    for c in ("n_pairs", "n_groups", "n_ties"):
        if c not in metrics.columns:
            metrics = metrics.withColumn(c, F.lit(None).cast("long"))
    wanted = methods.join(F.broadcast(protocols), "family").withColumnRenamed("split", "_split")
    rows = metrics.join(F.broadcast(wanted), (F.col("model") == F.col("id")) & (metrics["score_type"] == wanted["score_type"]) & (F.col("_split").isNull() | (F.col("split") == F.col("_split"))))
    return rows.select(F.col("id").alias("method_id"), "display", "family", "protocol", "subset", "value", "se", F.coalesce("n_pairs", "n_groups").alias("n_pairs"), F.coalesce("n_ties", F.lit(0).cast("long")).alias("n_ties"))


def baseline_metrics(dataset: DataFrame, scores: DataFrame, key: Sequence[str]) -> DataFrame:
    """Average precision and AUROC, per subset and over all (``global``), of negated scores joined on the key; a row without a score is an error."""
    from . import metrics

    scored = strict_join(dataset, scores.withColumn("score", -F.col("score")), key, "score")
    both = scored.withColumn("subset", F.explode(F.array("subset", F.lit("global"))))
    out = metrics.ranking_metrics(both, ["subset"])
    return out.unpivot(["subset"], [F.col("auprc").alias("AUPRC"), F.col("auroc").alias("AUROC")], "metric", "value")


def validation_metrics(df: DataFrame, genome: str = "genome") -> DataFrame:
    """AUROC and average precision of every genome and over all of them (``_global_``)."""
    from . import metrics

    both = df.withColumn("subset", F.explode(F.array(F.col(genome), F.lit(metrics.GLOBAL))))
    return metrics.ranking_metrics(both, ["subset"]).select(F.col("subset").alias(genome), "auroc", "auprc")


def sign_tests(df: DataFrame, by: Sequence[str], tests: int | None = None) -> DataFrame:
    """Per ``by``: pairs, pairwise accuracy and the two-sided exact sign test over decided pairs, and that times the number of tests (1 at most).

    ``df``: ``match_group, label, score``. The tail of the binomial is summed in logarithms over at most as many terms as there are decided pairs."""
    pos, neg = F.max(F.when(F.col("label"), F.col("score"))), F.max(F.when(~F.col("label"), F.col("score")))
    pairs = df.groupBy(*by, "match_group").agg(pos.alias("p"), neg.alias("q")).where("p is not null and q is not null")
    n = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col("p") > F.col("q")).cast("long")).alias("wins"), F.sum((F.col("p") < F.col("q")).cast("long")).alias("losses"))

    @F.pandas_udf("double")
    def tail(wins, losses):
        import math

        import numpy as np
        import pandas as pd

        out = []
        for w, l in zip(wins, losses, strict=True):
            m = int(w + l)
            if not m:
                out.append(None)
                continue
            k = np.arange(int(min(w, l)) + 1)
            terms = np.concatenate([[0.0], np.cumsum(np.log(m - k[:-1]) - np.log(k[:-1] + 1))]) - m * math.log(2)
            top = terms.max()
            out.append(min(1.0, 2 * math.exp(top) * np.exp(terms - top).sum()))
        return pd.Series(out, dtype="float64")

    out = n.withColumn("accuracy", (F.col("wins") + 0.5 * (F.col("n") - F.col("wins") - F.col("losses"))) / F.col("n")).withColumn("p_value", tail("wins", "losses"))
    if tests:
        return out.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p_value") * tests))
    many = n.agg(F.count("*").alias("_tests"))
    return out.join(F.broadcast(many)).withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p_value") * F.col("_tests"))).drop("_tests")


def attached_sequences(rows: DataFrame, sequences: DataFrame, key: Sequence[str], length: int) -> DataFrame:
    """``rows`` with ``sequence`` by key; a missing or repeated one, or one of another length, fails the query."""
    out = strict_join(rows, sequences, key, "sequence")
    return out.withColumn("sequence", F.when(F.length("sequence") == length, F.col("sequence")).otherwise(F.raise_error(F.lit("sequence of another length")).cast("string")))


def labelled_sequences(fasta: DataFrame, label: int, genome: str, add_rc: bool = False) -> DataFrame:
    """Records ``id`` (chrom:start-end), ``seq`` as rows with coordinates, label and genome; with ``add_rc`` reverse complements too."""
    from ..functions.sequence import with_reverse_complements
    from ..sources.readers import split_id

    rows = split_id(fasta).select("id", "seq", "chrom", "start", "end")
    if add_rc:
        base = rows.drop("seq")
        both = with_reverse_complements(rows.select("id", "seq")).withColumn("_id", F.regexp_replace("id", "_[+-]$", ""))
        rows = both.join(base.withColumnRenamed("id", "_id"), "_id").drop("_id")
    return rows.withColumns({"label": F.lit(label), "genome": F.lit(genome)})


def plain_species(c: Column) -> Column:
    """A leaf's name without the ``_a`` or ``_b`` that tells doubles apart, underscores as blanks."""
    return F.translate(F.regexp_replace(c, "_[ab]$", ""), "_", " ")


def without_nulls(df: DataFrame) -> DataFrame:
    """Each row as JSON text; null fields are left out at every depth."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
