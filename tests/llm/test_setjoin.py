"""Components of exact set joins against all pairs: random edits, chains, hot groups, tiny tiles and groups, odd rows."""

import random
import re
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import setjoin

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set()


def plain(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    above = {}
    for i, s in enumerate(sets):
        for g in s:
            above.setdefault(g, []).append(i)
    for i, j in {p for own in above.values() for p in combinations(own, 2)}:
        both = len(sets[i] & sets[j])
        if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
            root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(((doc_id, len(s), least.get(top(i))) for i, ((doc_id, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def edited(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(words)), n):
        out[i] = f"n{rng.getrandbits(40)}"
    return out


def corpus(rng):
    """Copies in chains, one large group at all distances from its centre, couples that are all somewhat alike, short sets, a passage in many texts."""
    texts = []
    for k in range(40):
        words = [f"c{k}_{i}" for i in range(rng.choice([9, 14, 40, 120, 400]))]
        for _ in range(4):
            texts.append(words)
            words = edited(words, max(1, len(words) // 100), rng) if rng.random() < 0.7 else words[: -max(1, len(words) // 40)]
    base = [f"b{i}" for i in range(150)]
    texts += [edited(base, rng.randint(0, 4), rng) for _ in range(150)]
    wide = [f"w{i}" for i in range(200)]
    first = [edited(wide, 4, rng) for _ in range(120)]
    texts += first + [edited(x, 2, rng) for x in first]
    texts += [[rng.choice("xyz") for _ in range(rng.randint(1, 12))] for _ in range(150)]
    texts += [[f"o{k}_{i}" for i in range(20)] + [f"p{i}" for i in range(60)] for k in range(60)]
    rng.shuffle(texts)
    return [(i * 3 % 1009, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
def test_plain(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(setjoin, "TILE", 8)
        monkeypatch.setattr(setjoin, "GROUP", 5)
    rows = corpus(random.Random(6))
    got = setjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from all of them at once "
    rows = [(1, text), (1, "another text of a few words only"), (2, text.upper()), (None, text), (None, "alone words here now"), (3, None), (4, ""), (5, " \t\r\n"), (6, "one two"), (7, "ONE  two"), (8, "one"), (9, "a\x00b c d"), (10, "ÄB c d"), (11, "äB c d")]
    rows += [(12, "x " * 60_000), (13, "x y z w"), (14, text * 400), (15, text * 400 + "more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("node", "Digest", "label", "grams", "n", "size")})
    assert sorted((tuple(r) for r in setjoin.jaccard_components(docs).collect()), key=repr) == plain(rows)
    assert setjoin.jaccard_components(docs.limit(0)).count() == 0


def test_linked_sets_share_a_part():
    rng = random.Random(2)
    classes = setjoin.size_classes((90, 100), 1 << 14)
    assert all(b == a * 100 // 90 + 1 for a, b in zip(classes, classes[1:], strict=False))
    for n in [9, 10, 11, 18, 19, 20, 35, 80, 300, 1100] * 30:
        a = [f"{rng.getrandbits(40)} x y" for _ in range(n)]
        most = n * 10 // 90
        lose = rng.randint(0, n // 10)
        b = a[lose:] + [f"{rng.getrandbits(40)} x y" for _ in range(max(most - lose - lose * 10 // 90, 0))]
        x, y = (set(next(setjoin.gram_sets(pa.array([" ".join(s)]), 3)).tolist()) for s in (a, b))
        if x != y and 100 * len(x & y) >= 90 * len(x | y):
            import numpy as np

            keys = [set(setjoin.part_keys(np.array(sorted(s), np.uint64), (90, 100), classes).tolist()) for s in (x, y)]
            assert keys[0] & keys[1]
