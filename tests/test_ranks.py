"""Quantiles, running sums and samples against plain versions, hot groups, ties and nulls among them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import ranks, sampling


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    values = [("hot", rng.choice([1.5, 2.0, rng.gauss(0, 100), None])) for _ in range(3000)] + [("small", 7.0), (None, 3.0), (None, 4.0), ("none", None)]
    return spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(values)], "id long, g string, v double")


def test_quantiles(rows):
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    plain = {}
    for r in rows.where("v is not null").collect():
        plain.setdefault(r["g"], []).append(r["v"])
    for nearest in (False, True):
        got = {r["g"]: r["quantiles"] for r in ranks.quantiles(rows, ["g"], "v", qs, nearest).collect()}
        assert set(got) == set(plain)
        for g, v in plain.items():
            want = [sorted(v)[int(q * (len(v) - 1) + 0.5)] for q in qs] if nearest else np.quantile(v, qs)
            assert np.allclose(got[g], want)


def test_quantiles_without_groups_and_without_rows(rows):
    every = [r["v"] for r in rows.where("v is not null").collect()]
    assert np.isclose(ranks.quantiles(rows, [], "v", [0.3]).first()["quantiles"][0], np.quantile(every, 0.3))
    assert ranks.quantiles(rows.where("false"), [], "v", [0.3]).first()["quantiles"] == [None]
    assert ranks.quantiles(rows.where("false"), ["g"], "v", [0.3]).count() == 0


def test_running_sums(rows):
    some = rows.where("g = 'hot'")
    counts = some.groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {r["v"]: (r["n_upto"], r["n_all"]) for r in ranks.running_sums(some, counts, ["g"], "v", ["n"]).collect()}
    values = [r["v"] for r in some.collect()]
    n_null = sum(v is None for v in values)
    assert got == {v: (n_null if v is None else n_null + sum(w is not None and w <= v for w in values), len(values)) for v in set(values)}


def test_sample_is_the_head_of_all_draws(rows, monkeypatch):
    order = [r["id"] for r in rows.orderBy(sampling.draw(9, "id"), "id").collect()]
    for most in (100_000, 1):
        monkeypatch.setattr(sampling, "SORTED", most)
        for n in (0, 1, 37, 2999, len(order), len(order) + 5):
            assert sorted(r["id"] for r in sampling.sample(rows, n, 9, "id").collect()) == sorted(order[:n])
    assert sampling.sample(rows.where("false"), 3, 9, "id").count() == 0


def test_places_with_long_prefixes(rows, monkeypatch):
    order = [r["id"] for r in rows.orderBy(sampling.draw(5, "id"), "id").collect()]
    for most in (100_000, 0.01):
        monkeypatch.setattr(sampling, "SORTED", most)
        placed = sampling.with_shard(rows, 7, 5, "id").orderBy("place").collect()
        assert [r["id"] for r in placed] == order
        assert [r["place"] for r in placed] == list(range(len(order)))
