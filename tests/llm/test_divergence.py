"""Distances of sources against plain counting, slices that share a hash, odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import divergence
from spanloom.llm.common import utf8_buffer

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["Äpfel und ÄPFEL, Bäume; 12und\x00und", "", None, "the THE the\tquick brown-fox", "日本 und 日本", "...", "the fox " * 3000, "Ǆ ǆ the"]


def plain(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), {(lang, source) for _, lang, source in rows}
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = sorted(s for g, s in groups if g == lang)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in own}

        def p(count, n):
            return 1 + 1_000_000_000 * (count + 5) // (n + 5 * len(kept))

        share = {s: {t: p(counts[lang, s][t], total[s]) for t in kept} for s in own}
        pairs = [(sum(abs(share[source][t] - share[s][t]) for t in kept), s) for s in own if s != source]
        terms = [(share[source][t] - p(sum(counts[lang, s][t] for s in own), sum(total.values())), t) for t in kept if counts[lang, source][t]]
        for part, found in (("pair", pairs), ("term", [x for x in terms if x[0] > 0])):
            for i, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or i <= top:
                    out.add((lang, source, part, item, value, i))
    return out


@pytest.mark.parametrize(("blocks", "rows_of_sources", "min_docs"), [(100_000, 512, 2), (3, 2, 1), (8192, 512, 500)])
def test_plain(spark, monkeypatch, blocks, rows_of_sources, min_docs):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", blocks)
    monkeypatch.setattr(divergence, "SOURCE_ROWS", rows_of_sources)
    rng = np.random.default_rng(4)
    rows = [(TEXTS[i], [None, "en", "de", ""][j], [None, "s1", "Ä", "a", ""][k]) for i, j, k in rng.integers(0, (8, 4, 5), (60, 3))]
    rows += [("only here", "xx", "one"), (None, "yy", "none")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("term", "value", "n", "Block")})
    got = [tuple(r) for r in divergence.divergence(docs, min_docs=min_docs, top=3).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, min_docs, 3)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_slices_that_share_a_hash():
    data, offsets = utf8_buffer(pa.array(["aa bb aa", "bb c cc aa c"]))
    folded, start, end = divergence.tokens(data, offsets)
    for digest in (lambda b: 7, lambda b: len(b), lambda b: b[0]):
        group, first = divergence.group_slices(folded, start, end, digest)
        words = [bytes(folded[a:b]) for a, b in zip(start, end, strict=True)]
        assert len(first) == len(set(words))
        assert [words[first[g]] for g in group] == words


def test_share_is_exact():
    rng = np.random.default_rng(1)
    total = rng.integers(1, 9 * 10**13, 1000)
    count = (total * rng.random(1000)).astype(np.int64)
    assert divergence.share(count, total, 10**9).tolist() == [10**9 * int(c) // int(t) for c, t in zip(count, total, strict=True)]
