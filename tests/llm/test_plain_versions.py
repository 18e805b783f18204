"""Operators against plain versions of their methods: out-of-place ranking, pairwise logistic regression, shingle sets, all pairs."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import fingerprints, langid, neardup, quality
from tests.conftest import LARGER


def grams_of(text):
    """n-grams of one to three letters; a blank marks each edge of a word and isn't counted alone or in the middle."""
    padded = " " + "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " ".join(padded.split())
    if not padded:
        return Counter()
    padded = f" {padded} "
    out = Counter(c for c in padded if c != " ")
    out.update(padded[i : i + 2] for i in range(len(padded) - 1))
    out.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    return out


def top(counts, n):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], [len(x[0])] + [ord(c) for c in x[0]]))][:n]


def plain_language(text, profiles, size):
    own = top(grams_of(text), size)
    if not own:
        return "und", 0.0
    away = {lang: sum(abs(i - ranks[g]) if g in ranks else size for i, g in enumerate(own)) for lang, ranks in profiles.items()}
    best = min(sorted(away), key=away.get)
    return best, 1 - away[best] / (size * len(own))


def test_language_by_plain_ranking(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = docs.where("doc_id % 5 = 0").select("doc_id", "text", "lang").collect()
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {}
    for lang, text in {(r["lang"], r["text"]) for r in rows if r["lang"] is not None and r["text"] is not None}:
        counts.setdefault(lang, Counter()).update(grams_of(text))
    profiles = {lang: {g: i for i, g in enumerate(top(c, 400))} for lang, c in counts.items()}
    got = {r["doc_id"]: r["language"] for r in langid.identify(some, F.lit(True)).collect()}
    for r in rows:
        want = plain_language(r["text"] or "", profiles, 400)
        assert got[r["doc_id"]]["lang_pred"] == want[0] and got[r["doc_id"]]["score"] == pytest.approx(want[1], abs=1e-9)


def test_language_ties(spark):
    docs = spark.createDataFrame([(1, "aa", "y"), (2, "aa", "x"), (3, "aa", None), (4, "zz", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: tuple(r["language"]) for r in langid.identify(docs, F.lit(True)).collect()}
    assert got[3] == ("x", 1.0) and got[4][0] == "x" and got[4][1] < 0.2


def test_ranking_by_gradient():
    """The fit's weights are where a plain gradient of the pairwise logistic loss vanishes, and its threshold cuts off the share of bad rows."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, len(quality.FEATURES)))
    good = x[:, 0] - 0.5 * x[:, 3] + rng.normal(size=300) > -0.2
    model = quality.fit(x, good)
    z = (x - x.mean(0)) / (x.std(0) + 1e-9)
    best, worst = np.flatnonzero(good), np.flatnonzero(~good)
    pairs = [(best[k % len(best)], b) for k, b in enumerate(np.repeat(worst, quality.RIVALS))]
    w = np.zeros(x.shape[1])
    d = np.array([z[a] - z[b] for a, b in pairs])
    for _ in range(4000):
        gradient = d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - quality.RIDGE * w
        w = w + 0.5 * gradient
    assert model["weights"] == pytest.approx(w, abs=1e-3)
    assert ((z @ w) < model["threshold"]).sum() == len(worst)


def test_scores_are_the_models(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    rows = docs.where("doc_id % 7 = 0").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["quality_score"] for r in quality.rate(docs, labels, F.lit(True)).where("doc_id % 7 = 0").collect()}
    for r in rows:
        s = float((np.array(quality.features(r["text"] or "")) - model["mean"]) / model["scale"] @ model["weights"] - model["threshold"])
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-s)), abs=1e-9)


def test_one_kind_of_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "doc_id long, text string")
    for label, above in ((1, True), (0, False)):
        labels = spark.createDataFrame([(1, label)], "doc_id long, quality int")
        assert all((r["quality_score"] > 0.5) == above for r in quality.rate(docs, labels, F.lit(True)).collect())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["quality_score"] > 0.5 for r in quality.rate(docs, none, F.lit(True)).collect())


def test_sketches():
    rng = random.Random(2)
    for n, shared, m in ((50, 20, 60), (2000, 1500, 500), (5000, 100, 4000), (400, 400, 0)):
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), shared)) | {rng.getrandbits(64) for _ in range(m)}
        own = [np.array(sorted(s), np.uint64) for s in (a, b)]
        sa, sb = (fingerprints.sketch(x) for x in own)
        assert fingerprints.from_text(fingerprints.to_text(sa)).tolist() == sa.tolist()
        half = [fingerprints.sketch(p) for p in np.array_split(own[0], 3)]
        merged = fingerprints.merge(fingerprints.merge(half[2], half[0]), half[1])
        assert merged.tolist() == sa.tolist()
        assert fingerprints.resemblance(sa, sb) == pytest.approx(len(a & b) / len(a | b), abs=0.15)
        assert fingerprints.containment(sa, sb) == pytest.approx(len(a & b) / len(a), abs=0.25)
        assert fingerprints.distinct(sa) == pytest.approx(len(a), rel=0.35)
    empty = np.zeros(0, np.uint64)
    assert fingerprints.containment(empty, sa) == 1.0 and fingerprints.resemblance(empty, empty) == 1.0 and len(fingerprints.from_text("")) == 0


def test_recall_in_a_large_group(spark):
    """One large group of near copies, one passage in many documents, and pairs: of all pairs at 0.8 or more at least nine in ten end up in one class,
    and no class joins what isn't connected by such pairs."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    passage = [f"p{i}" for i in range(60)]

    def changed(words, n):
        out = list(words)
        for i in rng.sample(range(len(words)), n):
            out[i] = f"n{rng.getrandbits(40)}"
        return out

    texts = [changed(base, rng.randint(0, 6)) for _ in range(400)]
    texts += [[f"o{k}_{i}" for i in range(60)] + passage for k in range(200)]
    for k in range(60):
        own = [f"u{k}_{i}" for i in range(120)]
        texts += [own, changed(own, rng.randint(1, 4))]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = [Counter(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for t in texts]
    df = Counter(x for c in counts for x in c)
    sets = [{x: n * math.sqrt(1 + math.log(len(texts) / df[x])) for x, n in c.items()} for c in counts]

    def similar(i, j):
        both = sum(min(w, sets[j][x]) for x, w in sets[i].items() if x in sets[j])
        return both / (sum(sets[i].values()) + sum(sets[j].values()) - both)

    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    near = [(i, j) for i, j in combinations(range(len(texts)), 2) if not sets[i].keys().isdisjoint(sets[j]) and similar(i, j) >= 0.8]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near:
        root[find(j)] = find(i)
    found = sum(got[i] == got[j] for i, j in near)
    assert found >= 0.9 * len(near) > 1000
    assert all(find(i) == find(got[i]) for i in got)
