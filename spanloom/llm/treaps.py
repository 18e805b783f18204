"""Ranked lexical search by inverted treaps.

The index is a table: documents are dealt to blocks of bounded text, and each term of a block is a row with the ordinals of the
documents that hold it, in order of their ids, and its occurrences in each; one more row of the block has the ids and lengths.

A search reads only the rows of its terms. In a block, each term's postings become a treap: a binary search tree by document and a heap
by impact, what one occurrence list adds to a document's score. All treaps of a query are walked together over ranges of documents. The
roots that lie in a range bound the score of any document there, so the most promising range is taken first and the walk
ends when no range's sum of maxima reaches the k-th best score. A range is split at the document of its heaviest root, which is
scored, and each treap steps down to its root within either half; what is left of a few documents is scored at once. Equal impacts are
ordered at random in the heap, so that ties don't make lists of the trees.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, runs_of, utf8_buffer
from .divergence import count_run
from .neardup import Scratch

#: A-Z as a-z, other letters, digits and bytes of non-ASCII characters as they are, all else 0.
FOLDED = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 or b >= 0x80 else 0 for b in range(256)], np.uint8)
#: Bytes of text of one block; a longer text is one by itself.
BLOCK_BYTES = 8 << 20
#: Ranges of at most so many documents are scored at once.
LEAF = 256
#: Terms, with repeats, of the queries that one pass over the index answers; more are answered in more passes.
PASS_TERMS = 500_000

INDEX = "term string, block long, docs array<int>, counts array<int>, ids array<long>, lengths array<int>"


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values, kind))


def _block_rows(block: int, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Index rows of one block."""
    order = pc.sort_indices(ids, null_placement="at_end")
    ids, n = ids.take(order), len(order)
    doc, terms, term, count, _ = count_run(*utf8_buffer(texts.take(order)), np.arange(n), FOLDED)
    lengths = np.zeros(n, np.int64)
    np.add.at(lengths, doc, count)
    kinds = dict(zip(("docs", "counts", "ids", "lengths"), (pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True))

    def batch(terms: pa.Array, **lists: pa.Array) -> pa.RecordBatch:
        full = [lists.get(c, pa.nulls(len(terms), pa.list_(k))) for c, k in kinds.items()]
        return pa.RecordBatch.from_arrays([terms, pa.array(np.full(len(terms), block)), *full], names=["term", "block", *kinds])

    yield batch(pa.nulls(1, pa.string()), ids=pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), lengths=_lists(lengths, np.array([n]), pa.int32()))
    by_term = np.lexsort((doc, term))
    ends = np.searchsorted(term[by_term], np.arange(len(terms)), "right")
    if len(terms):
        yield batch(pa.array(terms, pa.string()), docs=_lists(doc[by_term], ends, pa.int32()), counts=_lists(count[by_term], ends, pa.int32()))


def _indexed(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text")
            for a, b in runs_of(utf8_buffer(texts)[1], block_bytes):
                yield from _block_rows(block, batch.column("doc_id").slice(a, b - a), texts.slice(a, b - a))
                block += 1

    return run


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The inverted index of ``docs`` (``doc_id``, ``text``; null text is empty) in the columns of ``INDEX``: for each block a row without
    term, with the ids and lengths of its documents, and a row for each of its terms. Write it to a table before searching."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_indexed(block_bytes), INDEX)


def treap(priority: list[int], first: int, left: list[int], right: list[int]) -> int:
    """Sets the children of the nodes ``first``, ``first + 1``, ... so that they are in order of index and heap-ordered by
    ``priority``; returns the root. No child is -1."""
    spine: list[int] = []
    for i in range(first, first + len(priority)):
        below, own = -1, priority[i - first]
        while spine and priority[spine[-1] - first] < own:
            below = spine.pop()
        left[i] = below
        if spine:
            right[spine[-1]] = i
        spine.append(i)
    return spine[0]


class Block:
    """The treaps of one block: node ``i`` is a posting, ``doc[i]`` its document and ``impact[i]`` its heap order."""

    def __init__(self, n_docs: int, doc: np.ndarray, impact: np.ndarray, ends: np.ndarray) -> None:
        self.n_docs, self.doc, self.impact = n_docs, doc.astype(np.int64), impact
        width = np.diff(np.append(0, ends))
        self.place = np.repeat(np.arange(len(ends)), width) * n_docs + self.doc  # by term, then by document
        chance = (mix64(np.arange(len(doc), dtype=np.uint64)) >> np.uint64(44)).astype(np.int64)
        order = ((impact << 20) | chance).tolist()
        left, right = [-1] * len(doc), [-1] * len(doc)
        begin = ends - width
        self.root = np.array([treap(order[a:b], a, left, right) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)], np.int64)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)

    def within(self, nodes: np.ndarray, weight: np.ndarray, term: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each subtree's root among the documents ``[lo, hi)``; subtrees without one go."""
        while len(nodes):
            at = self.doc[nodes]
            low, high = at < lo, at >= hi
            if not (low.any() or high.any()):
                break
            nodes = np.where(low, self.right[nodes], np.where(high, self.left[nodes], nodes))
            there = nodes >= 0
            if not there.all():
                nodes, weight, term = nodes[there], weight[there], term[there]
        return nodes, weight, term

    def scores(self, weight: np.ndarray, term: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Whole scores of the documents ``[lo, hi)``."""
        a, b = np.searchsorted(self.place, term * self.n_docs + lo), np.searchsorted(self.place, term * self.n_docs + hi)
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = np.zeros(hi - lo, np.int64)
        np.add.at(out, self.doc[at] - lo, np.repeat(weight, n) * self.impact[at])
        return out

    def best(self, term: np.ndarray, weight: np.ndarray, k: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` documents of the highest scores above 0, first documents at ties, their scores, and how many documents were scored."""
        docs, found, least, scored = [], [], 1, 0
        pool = np.zeros(0, np.int64)
        ranges, turn = [], 0

        def offer(lo: int, hi: int, nodes: np.ndarray, w: np.ndarray, t: np.ndarray) -> None:
            nonlocal turn
            nodes, w, t = self.within(nodes, w, t, lo, hi)
            bound = int((w * self.impact[nodes]).sum())
            if bound >= least:
                turn += 1
                heapq.heappush(ranges, (-bound, turn, lo, hi, nodes, w, t))

        def take(lo: int, scores: np.ndarray) -> None:
            nonlocal least, pool, scored
            scored += len(scores)
            good = np.flatnonzero(scores >= least)
            if len(good):
                docs.append(good + lo)
                found.append(scores[good])
                pool = np.append(pool, scores[good])
                if len(pool) >= k:
                    pool = np.partition(pool, len(pool) - k)[len(pool) - k :]
                    least = max(int(pool[0]), 1)

        offer(0, self.n_docs, self.root[term], weight, term)
        while ranges and -ranges[0][0] >= least:
            _, _, lo, hi, nodes, w, t = heapq.heappop(ranges)
            if hi - lo <= leaf:
                take(lo, self.scores(w, t, lo, hi))
                continue
            cut = int(self.doc[nodes[np.argmax(w * self.impact[nodes])]])
            take(cut, self.scores(w, t, cut, cut + 1))
            offer(lo, cut, nodes, w, t)
            offer(cut + 1, hi, nodes, w, t)
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), scored
        doc, score = np.concatenate(docs), np.concatenate(found)
        top = np.lexsort((doc, -score))[:k]
        return doc[top], score[top], scored


def norms(lengths: np.ndarray, n_docs: int, n_terms: int, slope: int = 75) -> np.ndarray:
    """``100 - slope + (slope * length * n_docs) div n_terms`` of each length, in whole numbers of any size."""
    known, at = np.unique(lengths, return_inverse=True)
    return np.array([100 - slope + slope * int(n) * n_docs // n_terms for n in known], np.int64)[at]


def _searched(vocabulary: list[str], weight: list[int], items: list[tuple[int, list[int], list[int]]], n_docs: int, n_terms: int, k: int, leaf: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_head = pc.is_null(table["term"])
        heads, body = table.filter(is_head), table.filter(pc.invert(is_head))
        out: list[list] = [[], [], []]
        if len(body) and not len(heads):
            raise ValueError("write the index to a table before searching it")
        if len(body):
            ids, lengths = heads["ids"].combine_chunks().flatten(), heads["lengths"].combine_chunks().flatten().to_numpy()
            known = pc.index_in(body["term"], value_set=pa.array(vocabulary, pa.string())).to_numpy().astype(np.int64)
            row = np.full(len(vocabulary), -1)
            row[known] = np.arange(len(known))
            lists = body["docs"].combine_chunks()
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            doc, tf = lists.flatten().to_numpy(), body["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * norms(lengths, n_docs, n_terms)[doc])
            block, per_term = Block(len(ids), doc, impact, ends), np.array(weight, np.int64)
            for item, terms, repeats in items:
                terms = np.array(terms, np.int64)
                w = per_term[terms] * np.array(repeats, np.int64)
                here = (row[terms] >= 0) & (w > 0)
                docs, scores, _ = block.best(row[terms[here]], w[here], k, leaf)
                out[0] += [item] * len(docs)
                out[1] += ids.take(pa.array(docs)).to_pylist()
                out[2] += scores.tolist()
        return pa.table({"item": pa.array(out[0], pa.int32()), "doc_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8_buffer(batch.column("text"))
        owner, terms, term, n, _ = count_run(data, offsets, np.arange(len(batch)), FOLDED)
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(owner)), pa.array(terms, pa.string()).take(pa.array(term)), pa.array(n.astype(np.int64))], names=["item_id", "term", "n"])


def search(index: DataFrame, items: DataFrame, k: int = 10, leaf: int = LEAF) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score`` of the ``k`` best documents of each item; equal scores by rising id.

    ``index``: a table of ``build_index``. ``items``: ``item_id`` (a whole number), ``text``; the texts of rows that share an id, null too,
    are one query, null text is empty, and an item without a document of a score above 0 has no rows. Every row of the indexed documents is
    ranked, also such as repeat an id; those without an id stand behind all others of their score.

    Scores are whole numbers: a term weighs ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and its ``tf`` occurrences in a document of
    norm ``m`` have the impact ``10^9 * tf div (1000 * tf + 8 * m)``. Runs one job to weigh the terms and one to search for each
    ``PASS_TERMS`` terms of the queries: only those, with their document counts, are on the driver and sent to tasks.
    """
    spark = index.sparkSession
    heads = index.where("term is null")
    n_docs, n_terms = heads.agg(F.sum(F.size(F.filter("lengths", lambda n: n > 0))), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = Scratch(spark).keep(asked.mapInArrow(_terms, "item_id long, term string, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n")))
    passes = -(-asked.count() // PASS_TERMS)
    found = None
    for p in range(passes if n_terms else 0):
        queries: dict[int | None, dict[str, int]] = {}
        for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).toLocalIterator():
            queries.setdefault(r["item_id"], {})[r["term"]] = r["n"]
        wanted = spark.createDataFrame([(t,) for t in sorted({t for q in queries.values() for t in q})], "term string")
        rows = index.where("term is not null").join(F.broadcast(wanted), "term", "left_semi")  # at most PASS_TERMS terms, or one item's
        df = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum(F.size("docs")).alias("df")).toLocalIterator()}
        vocabulary = sorted(df)
        at = {t: i for i, t in enumerate(vocabulary)}
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in vocabulary]
        names = list(queries)
        coded = [(i, [at[t] for t in queries[x] if t in at], [n for t, n in queries[x].items() if t in at]) for i, x in enumerate(names)]
        hits = rows.unionByName(heads).groupBy("block").applyInArrow(_searched(vocabulary, weight, coded, n_docs, n_terms, k, leaf), "item int, doc_id long, score long")
        named = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")
        hits = hits.join(F.broadcast(named), "item").select("item_id", "doc_id", "score")
        found = hits if found is None else found.union(hits)
    if found is None:
        found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _sql_terms(text: str) -> str:
    return f"unnest(regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, text FROM documents),
t AS (SELECT i, doc_id, {_sql_terms("text")} AS term FROM d),
tf AS (SELECT i, doc_id, term, count(*) AS tf FROM t GROUP BY i, doc_id, term),
n AS (SELECT i, sum(tf) AS n FROM tf GROUP BY i),
s AS (SELECT count(*) AS n_docs, sum(n) AS n_terms FROM n),
q AS (SELECT item_id, term, count(*) AS r FROM (SELECT item_id, {_sql_terms("text")} AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf CROSS JOIN s WHERE term IN (SELECT term FROM q) GROUP BY term),
p AS (
  SELECT tf.doc_id, tf.i, tf.term, w.w * CAST((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n.n * s.n_docs) // s.n_terms)) AS BIGINT) AS part
  FROM tf JOIN w USING (term) JOIN n ON n.i = tf.i CROSS JOIN s
),
x AS (SELECT q.item_id, p.i, p.doc_id, CAST(sum(q.r * p.part) AS BIGINT) AS score FROM q JOIN p USING (term) GROUP BY q.item_id, p.i, p.doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
