"""Deterministic samples, caps, splits and shards: order comes from a hash of the row's key, never from partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task may sort.
SORTED = 100_000
# Chromosomes whose alternation makes the split.
CHROMOSOMES = [*map(str, range(1, 23)), "X", "Y"]


def draw(seed: int, *key: str) -> Column:
    """A hex text that orders rows at random for a seed, the same in every engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def sample(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` rows without replacement: those with the smallest draws, ``key`` telling rows apart.

    The last draw is bracketed by counts of draw prefixes (16^3 a pass) until at most ``SORTED`` rows share its prefix; rows before that
    prefix are kept by a filter, and only those with it are sorted."""
    marked = df.withColumn("_draw", draw(seed, *key))
    prefix, left = "", max(n, 0)
    while len(prefix) < 30:
        inside = marked.where(F.col("_draw").startswith(prefix)).groupBy(F.substring("_draw", len(prefix) + 1, 3).alias("p")).count()
        share = 0
        for p, share in sorted(map(tuple, inside.collect())):
            if share >= left:
                prefix += p
                break
            left -= share
        else:
            return df  # fewer than n rows
        if share <= SORTED:
            break
    rest = marked.where(F.col("_draw").startswith(prefix)).orderBy("_draw", *key).limit(left)
    return marked.where(F.col("_draw") < prefix).unionByName(rest).drop("_draw")


def cap_groups(df: DataFrame, group: Sequence[str], most: int, seed: int, *key: str, salts: int = 16) -> DataFrame:
    """At most ``most`` rows a group. Ranks inside salted parts of a group first, so that a hot group is cut down before it meets in one task."""
    marked = df.withColumn("_draw", draw(seed, *key)).withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(salts)))
    for part in ([*group, "_salt"], list(group)):
        marked = marked.withColumn("_rank", F.row_number().over(Window.partitionBy(*part).orderBy("_draw", *key))).where(F.col("_rank") <= most)
    return marked.drop("_draw", "_salt", "_rank")


def cap_background(df: DataFrame, positive: Column, fraction: float, seed: int, *key: str) -> DataFrame:
    """All positives and floor(fraction * positives / (1 - fraction)) of the others."""
    n = df.where(positive).count()
    return df.where(positive).unionByName(sample(df.where(~positive), int(fraction * n / (1 - fraction)), seed, *key))


def chromosome_split(df: DataFrame, prefix: str = "") -> DataFrame:
    """``split``: train for the 1st, 3rd, ... chromosome of 1..22, X, Y, test for the others; further chromosomes get null."""
    train, test = [prefix + c for c in CHROMOSOMES[::2]], [prefix + c for c in CHROMOSOMES[1::2]]
    return df.withColumn("split", F.when(F.col("chrom").isin(train), "train").when(F.col("chrom").isin(test), "test"))


def shard_bounds(total: int, n: int) -> list[tuple[int, int]]:
    """Bounds of ``n`` shards as even as can be, the longer ones first."""
    base, more = divmod(total, n)
    at, out = 0, []
    for i in range(n):
        out.append((at, at + base + (i < more)))
        at = out[-1][1]
    return out


def with_shard(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """Shuffle and cut into ``n`` shards of even size: ``shard`` and ``place``, the row's 0-based place in the whole order.

    Places come from ranks among draws with a common prefix and the counts of the prefixes before it. Prefixes are as long as it takes for
    about ``SORTED`` rows each, and are counted within their first three digits, so no task sorts the whole table or all prefixes."""
    digits = 3
    total = df.count()
    while 16**digits * SORTED < total and digits < 32:
        digits += 1
    marked = df.withColumn("_draw", draw(seed, *key)).withColumn("_prefix", F.substring("_draw", 1, digits))
    per = marked.groupBy("_prefix").agg(F.count("*").alias("_n")).withColumn("_head", F.substring("_prefix", 1, 3))
    line = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    heads = per.groupBy("_head").agg(F.sum("_n").alias("_n"))
    heads = heads.select("_head", F.coalesce(F.sum("_n").over(line(Window.orderBy("_head"))), F.lit(0)).alias("_skip"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    inner = F.coalesce(F.sum("_n").over(line(Window.partitionBy("_head").orderBy("_prefix"))), F.lit(0))
    offsets = per.withColumn("_inner", inner).join(F.broadcast(heads), "_head").select("_prefix", (F.col("_skip") + F.col("_inner")).alias("_before"), "_total")
    placed = marked.join(offsets, "_prefix").withColumn("place", F.col("_before") + F.row_number().over(Window.partitionBy("_prefix").orderBy("_draw", *key)) - 1)
    base, more = F.floor(F.col("_total") / n), F.col("_total") % n
    long_part = more * (base + 1)
    shard = F.when(F.col("place") < long_part, F.floor(F.col("place") / (base + 1))).otherwise(more + F.floor((F.col("place") - long_part) / F.greatest(base, F.lit(1))))
    return placed.withColumn("shard", shard.cast("int")).drop("_draw", "_prefix", "_before", "_total")
