"""Near-duplicate classes of chains and large groups, against all pairs of documents that share a band."""

import math
import random
from collections import defaultdict
from itertools import combinations

import pytest

from spanloom.llm import neardup

WORDS = 120


def edited(words, n, rng):
    """``words`` with ``n`` of them replaced, each far from the others."""
    out = list(words)
    for i in rng.sample(range(5, len(words) - 5, 5), n):
        out[i] = f"new{rng.getrandbits(48)}"
    return out


def tails(rng):
    """Copies with one edit, all alike, and of each a further copy that is near no other document."""
    base = [f"w{i}" for i in range(WORDS)]
    core = [edited(base, 1, rng) for _ in range(150)]
    return core + [edited(c, 2, rng) for c in core]


def chains(rng):
    """Chains in which only neighbours are near enough."""
    out = []
    for k in range(60):
        words = [f"c{k}_{i}" for i in range(WORDS)]
        for _ in range(6):
            out.append(words)
            words = edited(words, 2, rng)
    return out


def couples(rng):
    """Many documents that are all somewhat alike, each near one other only."""
    base = [f"w{i}" for i in range(WORDS)]
    first = [edited(base, 3, rng) for _ in range(500)]
    return first + [edited(x, 2, rng) for x in first]


def check_classes(spark, make):
    rng = random.Random(5)
    rows = [(i, " ".join(w)) for i, w in enumerate(make(rng))]
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(order[i], text) for i, text in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    common = neardup.common_shingles(docs)
    ids = [i for i, _ in rows]
    sets = dict(zip(ids, (neardup.weighted(h, common) for h in neardup.hashed([t for _, t in rows])), strict=True))
    buckets = defaultdict(list)
    for r in neardup.band_table(docs, common).collect():
        for key in r["bands"]:
            buckets[key].append(r["doc_id"])
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in {tuple(sorted(p)) for own in buckets.values() for p in combinations(own, 2)}:
        if top(a) != top(b) and neardup.similarity(sets[a], sets[b]) >= neardup.SIMILARITY:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    wrong = [i for i in ids if got[i] != top(i)]
    assert not wrong, f"{len(wrong)} of {len(ids)} in another class"


@pytest.mark.parametrize("make", [tails, chains])
def test_matched_and_unmatched(spark, make):
    check_classes(spark, make)


def test_large_buckets(spark):
    check_classes(spark, couples)


def test_small_corpus_has_idf(spark):
    docs = spark.createDataFrame([(i, f"one two three four five six{i}") for i in range(10)], "doc_id long, text string")
    shingles, idf = neardup.common_shingles(docs)
    assert len(shingles) == 11
    assert sorted(idf) == pytest.approx([1.0] + [(1 + math.log(10)) ** 0.5] * 10)


def test_a_passage_in_few_documents_links_nothing(spark):
    """40 of 2000 documents share a passage of 104 words beside 12 words of their own: by TF-IDF they are at 0.76, so each stays alone."""
    passage = " ".join(f"p{i}" for i in range(104))
    rows = [(i, passage + " " + " ".join(f"own{i}_{k}" for k in range(12))) for i in range(40)]
    rows += [(i, " ".join(f"t{i}_{k}" for k in range(60))) for i in range(40, 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["class_id"] == r["doc_id"] for r in neardup.near_duplicates(docs).collect())


def test_frequencies_over_blocks(spark, monkeypatch):
    """Every shingle of at least a thousandth of 5000 documents has its exact weight, whatever block it is in."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(5000):
        at = int(rng.paretovariate(0.7)) % 300
        rows.append((i, " ".join(words[at : at + 8] + [f"o{i}_{k}" for k in range(6)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    df = defaultdict(int)
    for _, text in rows:
        for h in set(next(neardup.hashed([text])).tolist()):
            df[h] += 1
    shingles, idf = neardup.common_shingles(docs.repartition(3))
    assert dict(zip(shingles.tolist(), idf.tolist(), strict=True)) == pytest.approx({h: math.sqrt(1 + math.log(5000 / n)) for h, n in df.items() if n >= 5})
