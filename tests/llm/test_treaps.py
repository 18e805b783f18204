"""Treaps keep both orders, a search equals scoring every document, ranges are pruned, odd rows have a defined result."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import treaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    tf = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in tf), sum(sum(c.values()) for c in tf)
    df = Counter(t for c in tf for t in c)
    queries = defaultdict(Counter)
    for item, text in items:
        queries[item].update(terms(text))
    out = set()
    for item, query in queries.items():
        found = []
        for (doc_id, _), c in zip(docs, tf, strict=True):
            m = 25 + 75 * sum(c.values()) * n_docs // max(n_terms, 1)
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in query.items() if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out |= {(item, i, x[3], -x[0]) for i, x in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize(("block", "leaf", "passes"), [(8 << 20, 256, 500_000), (2000, 4, 7), (200, 1, 500_000)])
def test_plain(spark, monkeypatch, tmp_path, block, leaf, passes):
    monkeypatch.setattr(treaps, "PASS_TERMS", passes)
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(60)] + ["Ärger", "ÄRGER", "x1", "日本"])
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(1, 60), p=None))) for i in rng.permutation(300)]
    docs += [(7, docs[0][1]), (None, docs[1][1]), (None, docs[1][1]), (400, None), (401, ""), (402, "..."), (403, "w1 " * 20_000), (404, docs[2][1])]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(20)] + [(1, "w1 w1 W2"), (None, "w3"), (50, None), (51, "nowhere"), (52, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("term", "Block", "score")})
    treaps.build_index(frame, block).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    got = [tuple(r) for r in treaps.search(index, asked, k=5, leaf=leaf).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(docs, items, 5)
    assert treaps.search(treaps.build_index(frame.limit(0)), asked).count() == 0
    assert treaps.search(index, asked.limit(0)).count() == 0


def test_orders_and_pruning():
    rng = np.random.default_rng(8)
    n = 4000
    lists = [np.sort(rng.choice(n, m, replace=False)) for m in (3000, 40, 900, 1)]
    impact = np.concatenate([rng.integers(1, 5 if i == 2 else 1000, len(x)) for i, x in enumerate(lists)])
    block = treaps.Block(n, np.concatenate(lists), impact, np.cumsum([len(x) for x in lists]))

    def walk(i):
        if i < 0:
            return []
        for child, low in ((block.left[i], True), (block.right[i], False)):
            if child >= 0:
                assert block.impact[child] <= block.impact[i] and (block.doc[child] < block.doc[i]) == low
        return walk(block.left[i]) + [int(block.doc[i])] + walk(block.right[i])

    assert [walk(r) for r in block.root] == [x.tolist() for x in lists]
    weight = np.array([3, 50, 7, 900])
    docs, scores, scored = block.best(np.arange(4), weight, 10)
    every = block.scores(weight, np.arange(4), 0, n)
    best = np.lexsort((np.arange(n), -every))[:10]
    assert docs.tolist() == best.tolist() and scores.tolist() == every[best].tolist()
    assert scored < n / 2
