"""Exact Jaccard join of word n-gram sets by skipping along set relations.

Who can have a partner. A set is cut by hash into parts, as many as its size class allows differences and a few more, so that two linked
sets have an equal part that isn't empty. Sets without a part in common with another set leave here; equal sets are one from the
start. Sets of a size that allows no difference link with their equals only.

Index. The n-grams of what stays are ordered by the number of sets that hold them, and each set is listed under the first of them, as
many as two linked sets need to meet. A list entry has the set's size and the n-gram's position in it: from the first common n-gram on
both sets must hold what is missing to the threshold, so a position bounds the overlap.

Answers. In each list one set leads: the one that meets most others. Every member is compared with its leader in tasks of bounded
size, and its answer (how far it is from the leader, and the component that links give so far) decides what is left to do: members of the
leader's component need no comparison with each other, and as the Jaccard distance is a metric, members whose distances to the leader
differ by more than a link allows can't be linked. A list whose members are all of one component is skipped. The others are cut into
blocks by size, by what a position leaves, by distance to the leader and by component, and a block meets only such blocks as these
bounds don't rule out, block by block, then row by row without the sets, then whole sets in the list of their first common n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, runs_of, utf8_buffer, word_hashes, word_shingles
from .divergence import tokens
from .neardup import BROADCAST_ROWS, Scratch, components

#: A-Z as a-z; 0 for space and the control characters from tab to carriage return, which part words; a zero byte belongs to a word.
_FOLDED = np.array([0 if b == 0x20 or 0x09 <= b <= 0x0D else b + 32 if 0x41 <= b <= 0x5A else b or 0xFF for b in range(256)], np.uint8)
RUN_BYTES = 1 << 20
#: Parts beyond those that a link can change; a set with no more empty parts need not be found by one.
SPARE = 2
#: Sets, and n-grams of all sets together, on one side of a tile; a list of up to twice as many is one tile.
TILE, TILE_GRAMS = 512, 500_000
#: Members of a leader in one task.
GROUP = 512


def gram_sets(texts: pa.Array, words: int = 3) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams of ``words`` words."""
    data, offsets = utf8_buffer(texts)
    for a, b in runs_of(offsets, RUN_BYTES):
        at = offsets[a : b + 1] - offsets[a]
        folded, start, end = tokens(data[offsets[a] : offsets[b]], at, _FOLDED)
        grams, begin = word_shingles(word_hashes(folded, start, end), np.searchsorted(start, at), words)
        for i in range(b - a):
            yield np.unique(grams[begin[i] : begin[i + 1]])


def size_classes(threshold: tuple[int, int], most: int) -> np.ndarray:
    """The least size of each class up to size ``most``; a linked pair lies in one class or in neighbouring ones."""
    num, den = threshold
    least = [1]
    while least[-1] <= most:
        least.append(least[-1] * den // num + 1)
    return np.array(least)


def part_keys(grams: np.ndarray, threshold: tuple[int, int], classes: np.ndarray) -> np.ndarray:
    """Keys of the parts of a set: two linked sets that aren't equal share one."""
    num, den = threshold
    k = int(np.searchsorted(classes, len(grams), "right")) - 1
    keys = []
    for c in (k - 1, k):  # the class of the smaller set of a pair
        differ = ((int(classes[c + 1]) - 1) * (den - num)) // num if c >= 0 else 0
        if not differ:
            continue
        n = differ + 1 + SPARE
        part = (grams % np.uint64(n)).astype(np.int64)
        total, held = np.zeros(n, np.uint64), np.zeros(n, bool)
        np.add.at(total, part, mix64(grams ^ np.uint64(0x9E3779B97F4A7C15)))
        held[part] = True
        key = mix64(total + mix64(np.arange(n, dtype=np.uint64) + np.uint64(c << 32)))
        keys.append(key[held] if n - held.sum() <= SPARE else key)
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _marked(words: int, threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = size_classes(threshold, 1 << 12)
        for batch in batches:
            n, digest, keys = [], [], []
            for grams in gram_sets(batch.column("text"), words):
                if len(grams) >= classes[-1]:
                    classes = size_classes(threshold, 2 * len(grams))
                n.append(len(grams))
                digest.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                keys.append(part_keys(grams, threshold, classes).view(np.int64) if len(grams) else np.zeros(0, np.int64))
            ends = np.append(0, np.cumsum([len(k) for k in keys]))
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), listed], names=["doc_id", "n_shingles", "digest", "keys"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(gram_sets(batch.column("text"), words))
            ends = np.append(0, np.cumsum([len(g) for g in found]))
            grams = pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))
            digest = pa.array([xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None for g in found], pa.binary())
            yield pa.RecordBatch.from_arrays([digest, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), grams)], names=["digest", "grams"])

    return run


def _held(rows: DataFrame) -> DataFrame:
    """``rows`` of two columns of long, to be broadcast where their number is bounded."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def candidates(marked: DataFrame, scratch: Scratch) -> DataFrame:
    """``digest`` of the sets that share a part with another set."""
    parts = marked.where("size(keys) > 0").select(F.explode("keys").alias("key"), F.xxhash64("digest").alias("own"), "digest")
    shared = parts.groupBy("key").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a < b").select("key")
    shared = scratch.keep(shared)
    return scratch.keep(parts.join(_held(shared), "key", "left_semi").select("digest").distinct())


def index_lists(sets: DataFrame, threshold: tuple[int, int], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The index (``gram``, ``node``, ``size``, ``pos``, ``at``), lists of two and more only, and for each ``node`` its listed n-grams in order (``firsts``);
    ``pos`` is a gram's position among all grams of its set, ``at`` among the listed ones."""
    num, den = threshold
    grams = sets.select("node", "size", F.explode("grams").alias("gram"))
    common = scratch.keep(grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"))
    # a set's grams: bounded by its text
    ordered = grams.join(common, "gram").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    alone = F.col("size") - F.size("g")  # grams of no other set come first
    prefix = F.col("size") - F.ceil(F.col("size") * num / den) + 1
    firsts = ordered.select("node", "size", alone.alias("alone"), F.slice("g", F.lit(1), F.greatest(prefix - alone, F.lit(0)).cast("int")).alias("g")).where("size(g) > 0")
    firsts = scratch.keep(firsts.select("node", "size", "alone", F.col("g.gram").alias("firsts")))
    entries = firsts.select("node", "size", "alone", F.posexplode("firsts").alias("at", "gram")).select("gram", "node", "size", (F.col("alone") + F.col("at")).alias("pos"), "at")
    lists = entries.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    return scratch.keep(entries.join(lists, "gram")), firsts.select("node", "firsts")


def _to_leader(threshold: tuple[int, int]):
    num, den = threshold

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows["node"] == rows["leader"]
        of_leader = np.sort(rows.loc[head, "grams"].iloc[0])
        rows = rows[~head]
        both = np.array([len(np.intersect1d(of_leader, g, assume_unique=True)) for g in rows["grams"]], np.int64)
        either = np.array([len(g) for g in rows["grams"]], np.int64) + len(of_leader) - both
        return pd.DataFrame({"a": rows["node"].array, "b": rows["leader"].array, "away": 1 - both / either, "linked": den * both >= num * either})

    return run


def compare_with_leaders(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int], scratch: Scratch) -> DataFrame:
    """``pairs`` (``node``, ``leader``) with the distance of their sets and whether they are linked. A leader's set goes once to each group of members."""
    groups = F.ceil(F.col("n") / GROUP)
    heads = scratch.keep(pairs.groupBy("leader").agg(F.count("*").alias("n")))
    members = pairs.join(heads, "leader").select("leader", F.pmod(F.xxhash64("node"), groups).alias("group"), "node")
    leaders = heads.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("group"), F.col("leader").alias("node"))
    rows = members.union(leaders).join(sets.select("node", "grams"), "node")
    # a group without members gives no rows
    return scratch.keep(rows.groupBy("leader", "group").applyInPandas(_to_leader(threshold), "a long, b long, away double, linked boolean"))


def _possible(rows: pd.DataFrame, threshold: tuple[int, int]) -> np.ndarray:
    """Which rows of a tile may be linked with which, by component, size, position and distance to the leader."""
    num, den = threshold
    side, label, away, size = (rows[c].to_numpy() for c in ("side", "label", "away", "size"))
    rest = size - rows["pos"].to_numpy()
    both = size[:, None] + size
    may = (label[:, None] != label) & (np.abs(away[:, None] - away) <= (1 - num / den) * 1.000001)
    may &= (den * np.minimum(size[:, None], size) >= num * np.maximum(size[:, None], size)) & ((num + den) * np.minimum(rest[:, None], rest) >= num * both)
    return may & ((side[:, None] < side) if 0 < side.sum() < len(side) else np.triu(np.ones_like(may), 1))


def _tile_links(rows: pd.DataFrame, threshold: tuple[int, int]) -> pd.DataFrame:
    """Links of a tile, as many as connect what isn't connected yet. A pair is compared in the list of its first common n-gram."""
    num, den = threshold
    may = _possible(rows, threshold)
    node, label, size, at = (rows[c].to_numpy() for c in ("node", "label", "size", "at"))
    label, links = label.copy(), []
    _, place = np.unique(np.concatenate(rows["grams"].tolist()), return_inverse=True)
    start = np.append(0, np.cumsum(size)[:-1])
    early = [f[:i] for f, i in zip(rows["firsts"], at, strict=True)]
    _, early_place = np.unique(np.concatenate([*early, np.zeros(0, np.int64)]), return_inverse=True)
    early_start = np.append(0, np.cumsum(at))
    held, held_early = np.zeros(place.max() + 1, bool), np.zeros(len(early_place) + 1, bool)
    for i in np.flatnonzero(may.any(1)):
        against = np.flatnonzero(may[i] & (label != label[i]))
        if not len(against):
            continue
        own, own_early = place[start[i] : start[i] + size[i]], early_place[early_start[i] : early_start[i + 1]]
        held[own], held_early[own_early] = True, True
        both = np.add.reduceat(held[place].astype(np.int64), start)[against]
        met = np.append(0, np.cumsum(held_early[early_place]))
        held[own], held_early[own_early] = False, False
        first = met[early_start[against + 1]] == met[early_start[against]]
        for j in against[first & (den * both >= num * (size[i] + size[against] - both))]:
            if label[j] != label[i]:
                links.append((node[i], node[j]))
                label[label == label[j]] = label[i]
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def rest_links(members: DataFrame, sets: DataFrame, firsts: DataFrame, threshold: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Links (``a``, ``b``) between members of a list that aren't connected yet, as many as connect them.

    ``members``: ``gram``, ``node``, ``size``, ``pos``, ``at``, ``away``, ``label``, ``main`` (whether the label is the leader's)."""
    num, den = threshold
    wide = (1 - num / den) * 1.000001
    members = members.join(members.groupBy("gram").agg(F.count("*").alias("n"), F.sum("size").alias("grams_n"), F.min("label").alias("one"), F.max("label").alias("other")).where("one < other").select("gram", "n", "grams_n"), "gram")
    rest = F.col("size") - F.col("pos")
    members = scratch.keep(
        members.withColumns(
            {
                "ring": F.floor(F.col("away") / wide).cast("int"),
                "grade": F.floor(F.log("size") * float(0.999 / np.log(den / num))).cast("int"),  # sizes of linked sets are of one grade or of neighbouring ones
                "left": F.floor(16 * rest * den / num / F.col("size")).cast("int"),
            }
        )
    )
    part = ["ring", "grade", "left", "main"]
    chunks = F.ceil(F.greatest(F.count("*") / TILE, F.sum("size") / TILE_GRAMS)).cast("int")
    large = members.where((F.col("n") > 2 * TILE) | (F.col("grams_n") > 2 * TILE_GRAMS))
    blocks = large.groupBy("gram", *part).agg(chunks.alias("chunks"), F.max(rest).alias("rest"), F.min("size").alias("least"))
    # rings, grades and what is left are few whatever the list's length
    blocks = blocks.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct(*part, "chunks", "rest", "least"))).alias("blocks"))
    own = F.filter("blocks", lambda b: (b["ring"] == F.col("ring")) & (b["grade"] == F.col("grade")) & (b["left"] == F.col("left")) & (b["main"] == F.col("main")))[0]
    dealt = large.join(blocks, "gram").withColumn("own", own).withColumn("chunk", F.pmod(F.xxhash64("node", "gram"), F.col("own.chunks")).cast("int"))

    def meets(b):
        near = (F.abs(b["ring"] - F.col("ring")) <= 1) & (F.abs(b["grade"] - F.col("grade")) <= 1) & ~(b["main"] & F.col("main"))
        return near & ((num + den) * F.least(b["rest"], F.col("own.rest")) >= num * (b["least"] + F.col("own.least")))

    def name(b, chunk):
        return F.array(b["ring"], b["grade"], b["left"], b["main"].cast("int"), chunk)

    def tile(b, j):
        mine, its = name(F.col("own"), F.col("chunk")), name(b, j)
        return F.struct(F.when(mine <= its, F.concat(mine, its)).otherwise(F.concat(its, mine)).alias("tile"), F.when(mine <= its, 0).otherwise(1).alias("side"))

    tiles = F.flatten(F.transform(F.filter("blocks", meets), lambda b: F.transform(F.sequence(F.lit(0), b["chunks"] - 1), lambda j: tile(b, j))))
    fields = ["gram", "node", "size", "pos", "at", "away", "label"]
    dealt = dealt.select(*fields, F.explode(tiles).alias("t")).select(*fields, "t.tile", "t.side")
    whole = members.where((F.col("n") <= 2 * TILE) & (F.col("grams_n") <= 2 * TILE_GRAMS)).select(*fields, F.array().cast("array<int>").alias("tile"), F.lit(0).alias("side"))

    def some(rows: pd.DataFrame) -> pd.DataFrame:
        may = _possible(rows, threshold)
        return rows[may.any(0) | may.any(1)]

    light = whole.union(dealt)
    open_ = scratch.keep(light.groupBy("gram", "tile").applyInPandas(some, light.schema))
    full = open_.join(sets.select("node", "grams"), "node").join(firsts, "node")
    return scratch.keep(full.groupBy("gram", "tile").applyInPandas(lambda rows: _tile_links(rows, threshold), "a long, b long"))


def link_sets(sets: DataFrame, threshold: tuple[int, int], scratch: Scratch) -> DataFrame:
    """``node`` and ``label`` (the least node it is connected to) of every set of ``sets`` (``node``, ``size``, ``grams``) that is linked with another."""
    entries, firsts = index_lists(sets, threshold, scratch)
    central = entries.groupBy("node").agg(F.sum("n").alias("meets"))
    leaders = entries.join(central, "node").groupBy("gram").agg(F.max_by("node", F.struct("meets", "node")).alias("leader"))
    led = scratch.keep(entries.join(leaders, "gram").where("node <> leader"))
    first = compare_with_leaders(led.select("node", "leader").distinct(), sets, threshold, scratch)
    links = first.where("linked").select("a", "b")
    labels = components(links, scratch)
    members = led.where("n > 2").join(first.select(F.col("a").alias("node"), F.col("b").alias("leader"), "away"), ["node", "leader"])
    members = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = labels.select(F.col("node").alias("leader"), F.col("label").alias("of_leader"))
    members = members.join(heads, "leader", "left").withColumn("main", F.coalesce(F.col("label") == F.coalesce("of_leader", "leader"), F.lit(False)))
    rest = rest_links(members.select("gram", "node", "size", "pos", "at", "away", "label", "main"), sets, firsts, threshold, scratch)
    if rest.isEmpty():
        return labels
    return components(links.union(rest), scratch)


def jaccard_components(docs: DataFrame, words: int = 3, threshold: tuple[int, int] = (90, 100)) -> DataFrame:
    """``doc_id``, ``n_shingles`` (the size of its set) and ``component_id`` (the smallest id that links reach) of every row of ``docs``.

    ``docs``: ``doc_id``, ``text``; other columns aren't read. A text's words are its runs of bytes other than space and tab to carriage return, with
    A-Z folded; its set holds its distinct runs of ``words`` words, or all its words where there are fewer. Two sets are linked when ``den *
    intersection >= num * union`` for ``threshold = (num, den)``; sets without words, null and empty texts are linked with nothing. Every row is
    a document of its own, so rows that share an id need not be linked; rows without an id link others, and their component is null if
    no document with an id is in it. An empty table gives no rows. N-grams are compared by 64-bit hashes, sets by 128 bits.
    """
    num, den = threshold
    scratch = Scratch(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = scratch.keep(read.mapInArrow(_marked(words, threshold), "doc_id long, n_shingles long, digest binary, keys array<long>"))
    wanted = candidates(marked, scratch)
    marked = marked.select("doc_id", "n_shingles", "digest")
    sets = read.select("text").mapInArrow(_sets(words), "digest binary, grams array<long>").join(_held(wanted), "digest", "left_semi")
    sets = sets.groupBy("digest").agg(F.first("grams").alias("grams")).select("digest", F.monotonically_increasing_id().alias("node"), F.size("grams").cast("long").alias("size"), "grams")
    sets = scratch.keep(sets)
    labels = link_sets(sets.select("node", "size", "grams"), threshold, scratch)
    own = marked.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    own = scratch.keep(own.join(labels.join(sets.select("node", "digest"), "node").select("digest", "label"), "digest", "left").where("n > 1 or label is not null"))
    together = own.where("label is not null").groupBy("label").agg(F.min("least").alias("reached"))
    reached = scratch.keep(own.join(together, "label", "left").select("digest", F.coalesce("reached", "least").alias("component_id")))
    return marked.join(reached, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT i, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) ELSE [array_to_string(w, ' ')] END)) AS g FROM d WHERE len(w) > 0),
n AS (SELECT i, count(*) AS n FROM s GROUP BY i),
p AS (SELECT a.i, b.i AS j, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g WHERE a.i < b.i GROUP BY a.i, b.i),
l AS (SELECT p.i, p.j FROM p JOIN n AS x ON x.i = p.i JOIN n AS y ON y.i = p.j WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT i, i AS j FROM d UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.j)
SELECT any_value(d.doc_id) AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(t.doc_id) AS component_id
FROM r JOIN d ON d.i = r.i JOIN d AS t ON t.i = r.j LEFT JOIN n ON n.i = r.i GROUP BY r.i
"""
