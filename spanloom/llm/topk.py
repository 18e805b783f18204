"""Exact top-k search by inner product over a pivot-distance index.

Vectors get one more coordinate that brings all of them to the same length M, queries a zero there; then the distance of a
query to a vector is ``sqrt(|q|^2 + M^2 - 2 score)`` and the highest scores are the nearest neighbours. Every vector is keyed
by its nearest pivot and its distance to it, and vectors of one pivot are stored in blocks of neighbouring distances
(annuli), sorted inside. A query starts in the annulus where its own vector lies; the k-th score found there bounds the radius
it has to look in, and by the triangle inequality only annuli, and only the parts of them, that this radius reaches can hold
a better vector. The pivots come from a bounded sample; every vector is indexed, and results are exact for any pivots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_share
from .neardup import Scratch

PIVOTS = 64
#: Vectors that pivots are chosen from: those with the smallest hashes of their ids.
PIVOT_SAMPLE = 2048
RINGS = 64
#: Vectors in a block, and queries in a block of queries, at most about.
BLOCK_MIN, BLOCK_MAX, QUERY_BLOCK = 256, 4096, 256
#: Distances are floating point; bounds are widened by this share of M.
SLACK = 1e-6


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id`` and ``vec``, each component x as floor(scale * x) with x as double; without null ids, null or empty vectors and those
    that hold a null or a component that isn't finite. Rows that repeat id and vector are one."""
    wide = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(F.col(vector_column), lambda x: x.cast("double")).alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = wide.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.coalesce(finite, F.lit(False)))
    return usable.select("vec_id", F.transform("x", lambda x: F.floor(x * float(scale))).alias("vec")).distinct()


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres of the sample: far apart at first, then moved to the mean of what is nearest to them."""
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    pivots = sample[chosen]
    for _ in range(4):
        near = ((pivots**2).sum(1) - 2 * sample @ pivots.T).argmin(1)
        pivots = np.array([sample[near == i].mean(0) if (near == i).any() else pivots[i] for i in range(len(pivots))])
    return pivots


class Space:
    """Distances in the space with one more coordinate. ``limit``: the largest squared length M^2 of a vector."""

    def __init__(self, limit: float, dim: int, wide: bool) -> None:
        self.limit, self.dim, self.kind = limit, dim, "<i8" if wide else "<i4"
        self.slack = SLACK * max(1.0, np.sqrt(limit))

    def matrix(self, column) -> np.ndarray:
        out = np.zeros((len(column), self.dim), np.int64)
        for row, v in zip(out, column, strict=True):
            row[: len(v)] = v
        return out

    def packed(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(-1, self.dim).astype(np.int64)

    def lifted(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(0, self.limit - (x**2).sum(1)))[:, None]])

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T))

    def queries(self, v: np.ndarray) -> np.ndarray:
        return np.hstack([v.astype(np.float64), np.zeros((len(v), 1))])

    def scores(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Exact integer products: in floating point where no sum can leave its exact range."""
        if self.limit < 2.0**52:
            return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
        return q @ v.T

    def radius(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance from each query to a vector of this score."""
        squared = (q.astype(np.float64) ** 2).sum(1) + self.limit - 2 * score
        return np.where(np.isfinite(score), np.sqrt(np.maximum(0, squared)), np.inf)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of one row, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _plan(counts: list[tuple[int, int, int]], most: int, least: int) -> dict[tuple[int, int], tuple[int, int]]:
    """Blocks for cells (group, ring, n) in order: small neighbouring rings of a group share a block, a large ring has several.
    Returns for each cell its first block and number of blocks."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    block, held, group = -1, 0, None
    for g, ring, n in sorted(counts):
        if g != group or held + n > most or held >= least:
            block, held, group = block + 1, 0, g
        parts = -(-n // most)
        out[g, ring] = (block, parts)
        held += n
        if parts > 1:
            block, held = block + parts - 1, most
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of every query among all other rows.

    ``is_query``: a condition on ``vec_id``. Returns ``query_id``, ``rank`` (int, from 1), ``vec_id``, ``score``; ties go to the
    smaller ``vec_id``; all rows if there are fewer than ``k``. Vectors that are null or empty, hold a null or a component that
    isn't finite, or have no id take no part; shorter vectors count as padded with zeros. Rows that repeat id and vector are one;
    a row with the query's own id is never its result. An empty table, or no query, gives no rows. Other columns aren't read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    whole = scratch.keep(integer_vectors(vectors, id_column, vector_column))
    squared = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = whole.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), F.max(squared).alias("limit")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    space = Space(float(facts["limit"]), facts["dim"], facts["limit"] >= 2.0**61)
    taken = whole.withColumn("place", hash_share("vec_id", 1)).where(F.col("place") < 1.5 * PIVOT_SAMPLE / facts["n"]).orderBy("place", "vec_id").limit(PIVOT_SAMPLE)
    sample = [r["vec"] for r in taken.collect()] or [r["vec"] for r in whole.limit(1).collect()]
    centres = choose_pivots(space.lifted(space.matrix(sample)), pivots)
    ring_width = max(1e-9, 2 * np.sqrt(space.limit) / RINGS)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = space.matrix(batch["vec"])
                away = space.distances(space.lifted(v), centres)
                near = away.argmin(1)
                dist = away[np.arange(len(v)), near]
                yield pd.DataFrame({"vec_id": batch["vec_id"], "pivot": near, "dist": dist, "ring": (dist / ring_width).astype(np.int64), "vec": [x.tobytes() for x in v.astype(space.kind)]})

    keyed = scratch.keep(whole.mapInPandas(assign, "vec_id long, pivot int, dist double, ring int, vec binary"))

    def blocked(rows: DataFrame, group: str, ring: str, most: int, least: int) -> DataFrame:
        cells = [(r[0], r[1], r["n"]) for r in rows.groupBy(F.col(group).alias("g"), F.col(ring).alias("r")).agg(F.count("*").alias("n")).collect()]
        plan = _plan(cells, most, least)  # at most PIVOTS * (RINGS + 1) cells

        @F.pandas_udf("int")
        def block_of(g: pd.Series, r: pd.Series, vec_id: pd.Series) -> pd.Series:
            spread = (vec_id.to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            return pd.Series([first + int(s) % parts for (first, parts), s in zip(map(plan.__getitem__, zip(g, r, strict=True)), spread, strict=True)])

        return rows.withColumn("block", block_of(F.col(group), F.col(ring), F.col("vec_id")))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["dist", "vec_id"])
        dist = rows["dist"].to_numpy()
        return pd.DataFrame(
            {"block": rows["block"].iloc[:1].array, "pivot": rows["pivot"].iloc[:1].array, "low": dist[:1], "high": dist[-1:], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "dists": [dist.tobytes()], "vecs": [b"".join(rows["vec"])]}
        )

    packed = "block int, pivot int, low double, high double, ids binary, dists binary, vecs binary"
    most = int(min(BLOCK_MAX, max(BLOCK_MIN, facts["n"] // PIVOTS)))
    index = scratch.keep(blocked(keyed, "pivot", "ring", most, most // 2).groupBy("block").applyInPandas(pack, packed))
    asked = keyed.where(is_query).withColumn("all", F.lit(0))
    queries = scratch.keep(blocked(asked, "all", "pivot", QUERY_BLOCK, QUERY_BLOCK // 2).groupBy("block").applyInPandas(pack, packed).select(F.col("block").alias("q_block"), F.col("pivot").alias("home"), ((F.col("low") + F.col("high")) / 2).alias("own"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs")))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k-th score of every query in its first annulus, and the part of each pivot's distances that it leaves open."""
        for batch in batches:
            for row in batch.itertuples():
                q, q_ids, ids = space.packed(row.q_vecs), np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.ids, np.int64)
                score = np.where(q_ids[:, None] == ids, -np.inf, space.scores(q, space.packed(row.vecs)))
                kth = np.sort(score, 1)[:, -k] if score.shape[1] >= k else np.full(len(q), -np.inf)
                reach = space.radius(q, kth)[:, None] + space.slack
                away = space.distances(space.queries(q), centres)
                yield pd.DataFrame({"q_block": row.q_block, "pivot": np.arange(len(centres)), "least": (away - reach).min(0), "greatest": (away + reach).max(0), "kth": [kth.tobytes()] * len(centres)})

    shells = index.select("block", "pivot", "low", "high")
    middle = F.abs(F.col("own") - (F.col("low") + F.col("high")) / 2)
    # every pivot has vectors but perhaps those of queries only: then the block of the queries is there itself
    home = queries.join(shells, queries["home"] == shells["pivot"]).groupBy("q_block").agg(F.min_by("block", F.struct(middle, "block")).alias("block"))
    opened = scratch.keep(home.join(queries, "q_block").join(index.select("block", "ids", "vecs"), "block").select("q_block", "q_ids", "q_vecs", "ids", "vecs").mapInPandas(start, "q_block int, pivot int, least double, greatest double, kth binary"))
    reached = opened.join(shells, "pivot").where((F.col("high") >= F.col("least")) & (F.col("low") <= F.col("greatest"))).select("q_block", "block", "kth")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                q, q_ids, kth = space.packed(row.q_vecs), np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.kth, np.float64)
                dist, away = np.frombuffer(row.dists, np.float64), space.distances(space.queries(q), centres[[row.pivot]])[:, 0]
                reach = space.radius(q, kth) + space.slack
                on = np.flatnonzero((away - reach <= dist[-1]) & (away + reach >= dist[0]))
                if not len(on):
                    continue
                a, b = np.searchsorted(dist, (away - reach)[on].min()), np.searchsorted(dist, (away + reach)[on].max(), "right")
                ids = np.frombuffer(row.ids, np.int64)[a:b]
                score = space.scores(q[on], space.packed(row.vecs)[a:b])
                out = []
                for i, own in zip(on, score, strict=True):
                    good = np.flatnonzero((own >= kth[i]) & (ids != q_ids[i]))
                    for j in good[_best(own[good], ids[good], k)]:
                        out.append((q_ids[i], ids[j], own[j]))
                if out:
                    yield pd.DataFrame(np.array(out, np.int64), columns=["query_id", "vec_id", "score"])

    found = reached.join(queries, "q_block").join(index, "block").select("q_ids", "q_vecs", "kth", "pivot", "ids", "dists", "vecs").mapInPandas(scan, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
