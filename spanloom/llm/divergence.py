"""How far the wording of each source lies from its language's and from that of the language's other sources, in exact integers.

Terms are cut in bytes. A table of 256 entries folds A-Z and blanks every byte that belongs to no term, so the ends of all terms of
a run of documents come from one comparison over their concatenated UTF-8 buffers. xxhash groups the slices, and every slice is
compared byte by byte with the first of its group; a slice that only shares the hash gets a group of its own.

Counts of a run are one CSR matrix of documents and terms, summed by ``reduceat`` to (language, source) rows with occurrences and
documents, which Spark adds up. Terms in enough documents of a language are kept with their counts by source, dealt to blocks of
bounded size, and each block is again a CSR matrix, of sources and terms: a row's distance to all other rows comes from one
``reduceat`` over the cells, as a term that neither row holds adds the same constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import runs_of, utf8_buffer
from .neardup import Scratch

#: A-Z as a-z, other letters and bytes of non-ASCII characters as they are, all else 0.
_FOLDED = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256)], np.uint8)
#: Bytes of text that are counted as one matrix; a longer text is one by itself.
RUN_BYTES = 4 << 20
#: Cells (term and source) of one block, about.
BLOCK_CELLS = 8192
#: Sources whose rows one task compares with all sources of the language.
SOURCE_ROWS = 512


def tokens(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = _FOLDED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``data`` by the table ``fold``, which gives 0 for what belongs to no term, and where the terms of the texts that ``offsets`` delimit start and end."""
    folded = fold[data]
    inside = folded != 0
    cut = np.zeros(len(data) + 1, bool)  # whether a text starts here
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:-1]
    return folded, np.flatnonzero(start), np.flatnonzero(end) + 1


def group_slices(folded: np.ndarray, start: np.ndarray, end: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """The group of each slice, and the index of each group's first slice. Slices of a group are equal byte by byte."""
    text = folded.tobytes()
    hashes = np.fromiter((digest(text[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    size, model = end - start, first[group]
    same = size == size[model]
    n = np.where(same, size, 0)  # slices of another length differ anyway
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    equal = folded[np.repeat(start, n) + at] == folded[np.repeat(start[model], n) + at]
    if not equal.all():
        same[np.unique(np.repeat(np.arange(len(n)), n)[~equal])] = False
    if not same.all():
        known: dict[bytes, int] = {}
        first = first.tolist()
        for i in np.flatnonzero(~same).tolist():
            word = text[start[i] : end[i]]
            if word not in known:
                known[word] = len(first)
                first.append(i)
            group[i] = known[word]
        first = np.array(first)
    return group, first


def count_run(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, fold: np.ndarray = _FOLDED) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences and documents of each term for each owner: (owner, terms, term of each cell, occurrences, documents).

    ``owner``: a small number for each text."""
    folded, start, end = tokens(data, offsets, fold)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, [], none, none, none
    group, first = group_slices(folded, start, end)
    text = folded.tobytes()
    terms = [text[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    doc = np.searchsorted(offsets, start, "right") - 1
    # CSR matrix of documents and terms: cells in order of document, with the term and the number of occurrences
    cell, tf = np.unique(doc * len(terms) + group, return_counts=True)
    # rows of one owner are added up
    key = owner[cell // len(terms)] * len(terms) + cell % len(terms)
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at] // len(terms), terms, key[at] % len(terms), np.add.reduceat(tf[order], at), np.diff(np.append(at, len(key)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8_buffer(batch.column("text"))
        langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        owner = langs.indices.to_numpy().astype(np.int64) * max(len(sources.dictionary), 1) + sources.indices.to_numpy()
        for a, b in runs_of(offsets, RUN_BYTES):
            own, terms, term, n, docs = count_run(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], owner[a:b])
            if len(own):
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.dictionary.take(pa.array(own // len(sources.dictionary))),
                        sources.dictionary.take(pa.array(own % len(sources.dictionary))),
                        pa.array(terms, pa.string()).take(pa.array(term)),
                        pa.array(n.astype(np.int64)),
                        pa.array(docs.astype(np.int64)),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )


def share(count: np.ndarray, total: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * count / total) for 0 <= count <= total, exact in 64 bits for totals up to 9e13 and scales up to 1e9."""
    high, low = 10 ** (len(str(scale)) // 2), scale // 10 ** (len(str(scale)) // 2)
    a, rest = np.divmod(count * high, total)
    return a * low + rest * low // total


def _away_from(p: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Sum of |p - x| for each x of ``points``."""
    p = np.sort(p)
    run = np.append(0, np.cumsum(p))
    k = np.searchsorted(p, points)
    return points * k - run[k] + (run[-1] - run[k]) - points * (len(p) - k)


def _block(scale: int, smoothing: int, top: int, source_rows: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_head = pc.is_null(table["term"])
        heads, body = table.filter(is_head), table.filter(pc.invert(is_head))
        order = np.argsort(np.array(heads["source"].to_pylist(), object))
        names = heads["source"].take(pa.array(order)).combine_chunks()
        n, v, lang_n = (heads[c].to_numpy()[order] for c in ("n", "v", "lang_n"))
        total = np.maximum(n + smoothing * v, 1)
        terms = np.array(body["term"].to_pylist(), object)
        lists = body["sources"].combine_chunks()
        width = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) if len(terms) else np.zeros(0, np.int64)
        flat = lists.flatten() if len(terms) else pa.array([], pa.string())
        source = pc.index_in(flat, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        count = body["counts"].combine_chunks().flatten().to_numpy().astype(np.int64) if len(terms) else np.zeros(0, np.int64)
        term = np.repeat(np.arange(len(terms)), width)
        q = np.zeros(len(terms), np.int64)
        if len(terms):
            of_term = np.add.reduceat(count, np.cumsum(width) - width)
            q = 1 + share(of_term + smoothing, np.maximum(lang_n[:1] + smoothing * v[:1], 1), scale)
        # CSR matrix of sources and terms
        by_source = np.argsort(source, kind="stable")
        source, term, count = source[by_source], term[by_source], count[by_source]
        ptr = np.searchsorted(source, np.arange(len(names) + 1))
        p = 1 + share(count + smoothing, total[source], scale)
        absent = 1 + share(np.full(len(names), smoothing), total, scale)
        held = np.flatnonzero(np.diff(ptr))
        by_name = np.argsort(np.argsort(np.array([t.encode() for t in terms], object))) if len(terms) else terms
        out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}
        lang, _, chunk = (k.as_py() for k in key)
        name = names.to_pylist()
        for g in range(chunk * source_rows, min((chunk + 1) * source_rows, len(name))):
            mine = slice(ptr[g], ptr[g + 1])
            row = np.full(len(terms), absent[g])
            row[term[mine]] = p[mine]
            away = (len(terms) - (ptr[g + 1] - ptr[g])) * np.abs(absent - absent[g]) + _away_from(p[mine], absent)
            if len(held):
                here = row[term]
                away[held] += np.add.reduceat(np.abs(p - here) - np.abs(absent[source] - here), ptr[held])
            others = [h for h in range(len(name)) if h != g]
            out["source"] += [name[g]] * len(others)
            out["part"] += ["pair"] * len(others)
            out["item"] += [name[h] for h in others]
            out["value"] += away[others].tolist()
            more = p[mine] - q[term[mine]]
            best = np.lexsort((by_name[term[mine]].astype(np.int64), -more))[:top] if len(more) else np.zeros(0, np.int64)
            best = best[more[best] > 0]
            out["source"] += [name[g]] * len(best)
            out["part"] += ["term"] * len(best)
            out["item"] += terms[term[mine][best]].tolist()
            out["value"] += more[best].tolist()
        return pa.table(
            {"lang": pa.array([lang] * len(out["value"]), pa.string()), **{k: pa.array(x, pa.int64() if k == "value" else pa.string()) for k, x in out.items()}}
        )

    return run


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, smoothing: int = 5, scale: int = 1_000_000_000) -> DataFrame:
    """Distances between the sources of each language, and the terms that a source uses more than its language.

    ``docs``: ``text``, ``lang``, ``source``, where null counts as empty; other columns aren't read and every row is a document. Terms
    are runs of letters and of non-ASCII characters, with A-Z folded; a language keeps those in at least ``min_docs`` of its
    documents. A kept term's share in a source or language is ``p = 1 + floor(scale * (count + smoothing) / (all + smoothing * kept))``.

    Returns ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``. Part ``pair``: ``item`` is another source of the language and
    ``value`` the sum of the differences of both shares over all kept terms. Part ``term``: ``item`` is a kept term that occurs in the
    source and has a larger share there than in the language, ``value`` how much larger, up to rank ``top``. Ranks go by falling value,
    then by rising item. Sources without a term take part; a language without kept terms has distances of 0; a language with a single
    source has no pairs; an empty table gives no rows. The result has a row for each two sources of a language, so it grows with
    the square of their number, and so does the work; a task holds the rows of at most 512 sources.
    """
    scratch = Scratch(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    cells = read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # at most one cell a source: a list is as long as the sources of a language
    listed = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells")).where(F.col("docs") >= min_docs)
    kept = scratch.keep(listed.select("lang", "term", F.col("cells.source").alias("sources"), F.col("cells.n").alias("counts")))
    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"), F.count("*").alias("cells"))
    groups = read.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").fillna(0, ["n", "cells"])
    groups = scratch.keep(groups)
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("cells").alias("cells"), F.count("*").alias("sources_n"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").select(
        "lang",
        "lang_n",
        F.coalesce("v", F.lit(0)).alias("v"),
        F.greatest(F.ceil(F.col("cells") / BLOCK_CELLS), F.lit(1)).alias("blocks"),
        F.ceil(F.col("sources_n") / SOURCE_ROWS).alias("chunks"),
    )
    langs = scratch.keep(langs)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    terms = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), chunk.alias("chunk"), "term", "sources", "counts")
    heads = groups.drop("cells").join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    heads = heads.select("lang", "block", chunk.alias("chunk"), "source", "n", "v", "lang_n")
    dealt = terms.unionByName(heads, allowMissingColumns=True)
    found = dealt.groupBy("lang", "block", "chunk").applyInArrow(_block(scale, smoothing, top, SOURCE_ROWS), "lang string, source string, part string, item string, value long")
    found = scratch.keep(found)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(best).select("lang", "source", "part", "item", "value", "rank")


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, '{LETTERS}', '{LETTERS.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
v AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS n FROM (SELECT DISTINCT lang FROM d) AS g LEFT JOIN k ON k.lang = g.lang GROUP BY g.lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 5)) // (CAST(gn.n AS HUGEINT) + 5 * v.v) AS p,
    1 + (1000000000 * (CAST(k.n AS HUGEINT) + 5)) // (CAST(v.n AS HUGEINT) + 5 * v.v) AS q
  FROM gn JOIN v ON v.lang = gn.lang JOIN k ON k.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term
),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
) WHERE part = 'pair' OR rank <= 50
"""
