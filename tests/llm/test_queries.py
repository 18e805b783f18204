"""Each text query against SQL, a brute-force version or held-out labels, over whole small tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict
from functools import cache
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanloom.llm import neardup, queries
from tests.conftest import LARGER, SMALL
from tests.oracle import check


@cache
def rows_of(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").collect()


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], LARGER)


def test_topk_brute_force(spark):
    vectors = {r["vec_id"]: np.floor(256 * np.array(r["embedding"], np.float64)).astype(np.int64) for r in rows_of(spark, SMALL, "embeddings")}
    ids = np.array(sorted(vectors))
    matrix = np.array([vectors[i] for i in ids])
    want = []
    for q in ids[ids % 50 == 0]:
        score = matrix @ vectors[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:5]
        want += [(q, k, ids[i], score[i]) for k, i in enumerate(order, 1)]
    got = queries.op1_topk_search(spark, SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def packing_holds(documents, pieces, most_padding=0.02):
    """Every id lies in one piece, sequences are gapless, and padding is a small share."""
    encode = tokenizer("byte_bpe_50k.json")
    whole = {r["doc_id"]: encode.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in documents}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(whole)
    for doc_id, ids in whole.items():
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{p['length']}I", *ids[at : at + p["length"]]))
            at += p["length"]
        assert at == len(ids)
    used = padded = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        used += at
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded <= most_padding * used


def test_packing(spark):
    packing_holds(rows_of(spark, LARGER, "documents"), queries.op3_harmonic_packing(spark, LARGER).collect())


def words_of(text):
    return re.findall("[0-9a-z_\x80-\U0010ffff]+", text.lower())


def shingles_of(text, n=5):
    words = words_of(text)
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else Counter([tuple(words)] if words else [])


def test_fingerprints(spark):
    documents = sorted(rows_of(spark, LARGER, "documents"), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, LARGER).collect()}
    assert len(got) == len(documents)
    prints, off = defaultdict(set), []
    for r, after in zip(documents, documents[1:] + documents[:1], strict=True):
        text, other, mine = r["text"] or "", after["text"] or "", got[r["doc_id"]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        assert mine["n_chars"] == len(text)
        assert mine["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints[text].add(mine["fingerprint"])
        for likeness, b in ((mine["near_edited"], edited), (mine["near_next"], other)):
            x, y = set(shingles_of(text)), set(shingles_of(b))
            off.append(abs(likeness - (len(x & y) / len(x | y) if x | y else 1.0)))
    assert all(len(p) == 1 for p in prints.values()) and len(set().union(*prints.values())) >= 0.95 * len(prints)
    assert max(off) < 0.2 and np.mean(off) < 0.03


def test_bpe_codec(spark):
    t = tokenizer("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in queries.op5_bpe_codec(spark, LARGER).collect()}
    for r in rows_of(spark, LARGER, "documents"):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        mine = got[r["doc_id"]]
        assert mine["n_tokens"] == len(ids)
        assert mine["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_counts(spark):
    t = tokenizer("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in queries.op7_token_counts(spark, LARGER).collect()}
    for r in rows_of(spark, LARGER, "documents"):
        text = r["text"] or ""
        n, mine = len(t.encode(text, add_special_tokens=False).ids), got[r["doc_id"]]
        assert (mine["n_bytes"], mine["n_tokens"], mine["over_limit"]) == (len(text.encode()), n, n > 2048)


def weights_of(texts):
    sets = [shingles_of(t) for t in texts]
    df = Counter(s for x in sets for s in x)
    return [{s: n * np.sqrt(1 + np.log(len(texts) / df[s])) for s, n in x.items()} for x in sets]


def brute_classes(documents, threshold=0.8):
    """Smallest id of each document's class: equal texts, and all pairs of shingle sets that are near enough."""
    texts = [r["text"] or "" for r in documents]
    weights, above = weights_of(texts), defaultdict(list)
    for i, w in enumerate(weights):
        for s in w:
            above[s].append(i)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def tie(i, j):
        a, b = sorted((root(i), root(j)), key=lambda k: documents[k]["doc_id"])
        parent[b] = a

    first = {}
    for i, t in enumerate(texts):
        tie(first.setdefault(t, i), i)
    for i, j in {p for own in above.values() for p in combinations(own, 2)}:
        a, b = weights[i], weights[j]
        both = sum(min(v, b[s]) for s, v in a.items() if s in b)
        if both / (sum(a.values()) + sum(b.values()) - both) >= threshold:
            tie(i, j)
    return {r["doc_id"]: documents[root(i)]["doc_id"] for i, r in enumerate(documents)}


@pytest.mark.parametrize("sf_dir", [SMALL, LARGER])
def test_near_duplicates(spark, sf_dir):
    documents = rows_of(spark, sf_dir, "documents")
    got = {r["doc_id"]: r for r in queries.op6_near_duplicates(spark, sf_dir).collect()}
    want = brute_classes(documents)
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["class_id"]) for i, r in got.items())


def test_language_id(spark):
    texts = {r["doc_id"]: r for r in rows_of(spark, LARGER, "documents")}
    got = queries.op8_language_id(spark, LARGER).collect()
    assert len(got) == len(texts)
    right = Counter()
    for r in got:
        d = texts[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in d["text"] or ""):
            assert r["lang_pred"] == "und"
        elif r["held_out"] and d["lang"]:
            right[r["lang_pred"] == d["lang"]] += 1
    assert right[True] >= 0.95 * right.total() > 0


def test_quality_ranking(spark):
    labels = {r["doc_id"]: r["quality"] for r in rows_of(spark, LARGER, "labels")}
    got = queries.op10_quality_ranking(spark, LARGER).collect()
    assert len(got) == len(rows_of(spark, LARGER, "documents"))
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert sum(a == b for a, b in held) >= 0.85 * len(held) > 0


def test_pipeline(spark):
    """The stages one by one, each over all that the one before kept, against the queries and the brute-force classes."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    language = {r["doc_id"]: r for r in queries.op8_language_id(spark, SMALL).collect()}
    scores = {r["doc_id"]: r["score"] for r in queries.op10_quality_ranking(spark, SMALL).collect()}
    kept = [r for r in docs.collect() if language[r["doc_id"]]["lang_pred"] != "und" and language[r["doc_id"]]["score"] >= c.LEAST_LIKENESS]
    after = c.STAGES[0][1](spark, docs, SMALL)
    assert after.columns == docs.columns and sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in kept)
    after = spark.createDataFrame(kept, docs.schema)
    good = c.STAGES[1][1](spark, after, SMALL)
    rows = good.collect()
    assert good.columns == docs.columns and 0 < len(rows) < len(kept)
    same = {r["doc_id"] for r in rows} ^ {r["doc_id"] for r in kept if scores[r["doc_id"]] >= 0.5}
    assert len(same) <= 0.05 * len(kept)  # the model is learned from what is left, not from all
    one = c.STAGES[2][1](spark, spark.createDataFrame(rows, docs.schema), SMALL)
    assert one.columns == docs.columns
    left = one.collect()
    assert sorted(r["doc_id"] for r in left) == sorted(i for i, first in brute_classes(rows).items() if i == first)
    packing_holds(left, c.run(spark, SMALL).collect(), most_padding=0.05)


def test_similarity_is_weighted_jaccard():
    a, b = "one two three four five six seven", "one two three four five six eight"
    wa, wb = weights_of([a, b])
    none = (np.zeros(0, np.uint64), np.zeros(0))
    ha, hb = (neardup.weighted(h, none) for h in neardup.hashed([a, b]))
    assert len(wa) == len(ha[0]) == len(hb[0]) == 3
    assert neardup.similarity(ha, hb) == pytest.approx(2 / 4)
