"""Words of any length in seconds, and budgets against every prefix."""

import random
import struct
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanloom.llm import bpe, packing, tokencount

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzeeeaaaooo"
    return ["".join(rng.choice(letters) for _ in range(1_000_000)), "x" * 300_000, "ab " + "".join(rng.choice("acgt") for _ in range(5_000)) + " end", "é" * 2_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()


def test_codec(docs, texts):
    began = time.time()
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_decode(docs, WORD).collect()}
    took, t = time.time() - began, library(WORD)
    for i, text in enumerate(texts):
        ids = t.encode(text, add_special_tokens=False).ids
        assert bytes(got[i]) == struct.pack(f"<{len(ids)}I", *ids)
    assert took < 120


def test_counts(docs, texts):
    began = time.time()
    got = {r["doc_id"]: r for r in tokencount.count_tokens(docs, WORD, 2048).collect()}
    took, t = time.time() - began, library(WORD)
    for i, text in enumerate(texts):
        assert got[i]["n_tokens"] == len(t.encode(text, add_special_tokens=False).ids)
    first = got[0]
    assert first["fit_words"] == 0 and first["fit_tokens"] == 2048 == len(t.encode(texts[0][: first["fit_bytes"]], add_special_tokens=False).ids)
    assert all(len(t.encode(texts[0][: first["fit_bytes"] + k], add_special_tokens=False).ids) > 2048 for k in range(1, 30))
    assert took < 120


def test_packing(docs, texts):
    began = time.time()
    rows = packing.pack_documents(docs, BYTE).collect()
    t = library(BYTE)
    for i, text in enumerate(texts):
        assert sum(r["length"] for r in rows if r["doc_id"] == i) == len(t.encode(text, add_special_tokens=False).ids) + 1
    assert time.time() - began < 120


@pytest.mark.parametrize("budget", [0, 1, 2, 3, 5, 8])
def test_budget_against_every_prefix(budget):
    with open(WORD, encoding="utf-8") as source:
        table = tokencount.PrefixTable(bpe.Vocabulary.read(WORD), source.read())
    rng, t = random.Random(budget), library(WORD)
    syllables = ["tion", "un", "qu", "zx", "é", "über", "straw", "berry", "12", "ing", "ly", "x", "日本"]
    for _ in range(25):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4))]
        own = [w for word in words for w in table.split.words(word)]
        (n, k, part, held), = table.count([" ".join(words)], budget)
        count = lambda ws: sum(len(t.encode(w, add_special_tokens=False).ids) for w in ws)
        plain = [table.split.bytes_of(w).decode() for w in own]
        best = (0, 0, 0)
        for i in range(len(own) + 1):
            whole = count(plain[:i])
            if whole <= budget:
                best = (i, 0, whole)
                for m in range(1, len(plain[i]) if i < len(own) else 0):
                    more = whole + count([plain[i][:m]])
                    if more <= budget:
                        best = (i, len(plain[i][:m].encode()), more)
        assert n == count(plain) and (k, part, held) == best
