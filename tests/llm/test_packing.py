"""Harmonic bins: every token in one place, no padding, documents whole unless they close a bin."""

import random

import pytest

from spanloom.llm import packing

CAPACITY = 2048


def cut(piece, at):
    doc, start, length = piece
    return (doc, start, at), (doc, start + at, length - at)


def packed(lengths, wait):
    bins = packing.Bins(CAPACITY, 7, cut, wait)
    rows = [r for i, n in enumerate(lengths) for r in bins.add((i, 0, n))]
    assert len(bins.waiting) <= wait + 40
    return rows, rows + list(bins.end())


CORPORA = {
    "mixed": lambda rng: [min(60_000, 1 + int(rng.lognormvariate(6, 1.3))) for _ in range(4000)],
    "short": lambda rng: [rng.randint(1, 300) for _ in range(4000)],
    "halves": lambda rng: [700] * 1000,
    "odd": lambda rng: [1100, 20] * 500 + [2048, 4096, 2049, 1, 1],
    "one": lambda rng: [5],
    "none": lambda rng: [],
}


@pytest.mark.parametrize("name", CORPORA)
@pytest.mark.parametrize("wait", [0, 32])
def test_bins(name, wait):
    lengths = CORPORA[name](random.Random(4))
    before_end, rows = packed(lengths, wait)
    sequences, documents = {}, {}
    for doc, start, length, sequence, offset in rows:
        assert length > 0
        sequences.setdefault(sequence, []).append((offset, length, doc))
        documents.setdefault(doc, []).append((start, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(documents[doc]):
            assert start == at
            at += length
        assert at == n
    assert sorted(sequences) == list(range(7, 7 + len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at == CAPACITY or at & (at - 1) == 0
    # of the bins filled before the end, each has j whole documents, or ends, of its class j and one piece that closes it
    closed = {r[3] for r in before_end}
    whole = {d for d, parts in documents.items() if len(parts) == 1}
    for s in closed:
        *own, last = sorted(sequences[s])
        classes = {CAPACITY // n for _, n, _ in own}
        if len(own):
            (j,) = classes if len(classes) == 1 else (None,)
            assert j == len(own) or (j is not None and CAPACITY // last[1] == j == len(own) + 1)
    if name == "mixed":
        short = [d for d, n in enumerate(lengths) if n <= CAPACITY // 2]
        assert len(whole & set(short)) >= 0.75 * len(short)
