"""Small column expressions: strict maps, bins, clips, scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mapped(c: Column, table: Mapping[str, str], default: Column | None = None, strict: bool = False) -> Column:
    """Look up in a small table; a miss gives ``default``, or fails the query with ``strict``."""
    found = F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), c)
    if strict:
        return F.when(c.isNull(), None).otherwise(F.coalesce(found, F.raise_error(F.concat(F.lit("not in the table: "), c)).cast("string")))
    return found if default is None else F.coalesce(found, default)


def clip(c: Column, low: float, high: float) -> Column:
    """Between low and high; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def reaches(c: Column, threshold: float) -> Column:
    """``c >= threshold`` where NaN and null reach nothing."""
    return F.coalesce(~F.isnan(c) & (c >= threshold), F.lit(False))


def group_one(c: Column, pattern: str) -> Column:
    """The first group of the first match, null without a match."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def folded_frequency(c: Column) -> Column:
    """Minor allele frequency."""
    return F.least(c, 1.0 - c)


def with_prefix(c: Column, prefix: str = "chr") -> Column:
    return F.when(c.startswith(prefix), c).otherwise(F.concat(F.lit(prefix), c))


def edge_bins(c: Column, edges: Sequence[float], right_closed: bool = False, outside: str = "OOR") -> Column:
    """``b0, b1, ...``: bins closed on the left, the last on both sides (or closed on the right, the first on both); else ``outside``."""
    last, out = len(edges) - 2, F.lit(None).cast("string")
    cases = []
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        if right_closed:
            inside = ((c >= low) if i == 0 else (c > low)) & (c <= high)
        else:
            inside = (c >= low) & ((c <= high) if i == last else (c < high))
        cases.append(F.when(inside & ~F.isnan(c.cast("double")), F.lit(f"b{i}")))
    return F.coalesce(*cases, out, F.lit(outside))


def subset_bins(subset: Column, c: Column, edges_of: Mapping[str, Sequence[float]], otherwise: str = "NA", label: bool = False) -> Column:
    """Bins whose edges depend on the subset; ``label`` puts the subset's first eight letters before the bin."""
    names = [s[:8] for s in edges_of]
    if label and len(set(names)) < len(names):
        raise ValueError("two subsets begin alike")
    cases = []
    for name, edges in edges_of.items():
        own = edge_bins(c, edges)
        cases.append(F.when(subset == name, F.concat(F.lit(f"{name[:8]}:"), own) if label else own))
    return F.coalesce(*cases, F.lit(otherwise))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x))


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp((x - top).cast("double")))
    return F.transform(logits, lambda x: x - top - F.log(total))


def kl_divergence(log_p: Column, log_q: Column) -> Column:
    return F.aggregate(F.zip_with(log_p, log_q, lambda p, q: F.exp(p) * (p - q)), F.lit(0.0), lambda s, x: s + x)


def js_divergence(log_p: Column, log_q: Column) -> Column:
    middle = F.zip_with(log_p, log_q, lambda p, q: F.log((F.exp(p) + F.exp(q)) / 2.0))
    return (kl_divergence(log_p, middle) + kl_divergence(log_q, middle)) / 2.0


def assert_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def score_transforms(score: Column) -> dict[str, Column]:
    """What a log-likelihood ratio is turned to before it is ranked, by name."""
    return {"minus_llr": -score, "abs_llr": F.abs(score)}
