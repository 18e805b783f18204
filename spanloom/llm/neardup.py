"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF word shingles.

Weights. A shingle weighs ``tf * idf`` with ``idf = sqrt(1 + ln(N / df))``. Every shingle of at least a thousandth of all documents
has its exact frequency; rarer ones weigh as if they were in a thousandth, so up to 1000 documents every weight is exact. Of shingles
whose frequency must be known there are at most 1000 times as many as a document has on average, however large the corpus is.
They are counted in two passes: one finds candidates from blocks of documents (what is common in the corpus is common in some
block, and what blocks leave out is bounded), one counts the candidates.

Signature. For each of ``bands * rows`` hash functions every shingle draws two gamma variates and an offset from its hash;
the shingle with the smallest resulting value, with its quantised weight, is the sample. Two documents agree in a sample
with the probability of their weighted Jaccard similarity. Documents that agree in all rows of a band meet in a bucket.

Links. In a bucket each document is compared to the bucket's leader; documents fairly but not sufficiently near to it, to
three more leaders; then all that are not yet connected to each other, but for those that the distances to the leader rule out,
in tiles of bounded size. Every comparison is of the whole texts. Classes are the connected components of the links, with exact
copies beside them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed, mix64, slices

BANDS, ROWS = 12, 4
SIMILARITY = 0.8
#: Shingles in at least this share of all documents have their own weight.
COMMON = 1 / 1000
#: Documents and bytes of text on one side of a tile; a bucket of up to twice as many is one tile.
TILE, TILE_BYTES = 512, 4 << 20
#: Rows up to which an id list is broadcast (16 bytes each); longer ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of rows that go to a Python worker at once while a table is kept; Spark's own bound is larger.
ARROW_BYTES = "16m"
#: Documents of a block; shingles that are counted at once; distinct ones at which a block is closed before it is full.
_BLOCK_DOCS, _BLOCK_SHINGLES, _BLOCK_DISTINCT = 2048, 500_000, 4_000_000
#: Members of a leader that are compared with it in one run.
GROUP = 512


class Scratch:
    """Tables written once to the shared folder of the session, to cut lineage and to be read more than once."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if root is None:  # only where no cluster names a shared folder, as in tests
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        self.folder = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path, name = f"{self.folder}/{self.count}", "spark.sql.execution.arrow.maxBytesPerBatch"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, ARROW_BYTES)
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(name, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_last(self, df: DataFrame) -> DataFrame:
        """Like ``keep``, and delete all tables kept before: nothing may read them any more."""
        out = self.keep(df)
        for i in range(1, self.count):
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{i}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        return out


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def common_shingles(texts: DataFrame, share: float = COMMON, scratch: Scratch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of the shingles in at least ``share`` of all documents, and their idf weights. Exact counts over all rows."""

    Counts = tuple[np.ndarray, np.ndarray]

    def merged(a: Counts | None, b: Counts | None) -> Counts:
        """Two sorted lists of shingles and their numbers as one; the sort has two runs to merge."""
        if a is None or b is None:
            return a or b
        every, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(every, kind="stable")
        every, n = every[order], n[order]
        start = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        return every[start], np.add.reduceat(n, start, dtype=np.int32)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw: list[np.ndarray] = []
        block: Counts | None = None
        full: Counts | None = None  # a block that waits for what follows, so that the last one isn't small
        docs = size = total = 0

        def closed(block: Counts, singles: bool) -> pd.DataFrame:
            found, n = block
            many = n > (not singles)  # a full block leaves out what it has once
            return pd.DataFrame({"shingle": found[many].view(np.int64), "n": n[many].astype(np.int64)})

        def counted(raw: list[np.ndarray]) -> Counts | None:
            found, n = np.unique(np.concatenate(raw), return_counts=True) if raw else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return (found, n.astype(np.int32)) if len(found) else None

        for batch in batches:
            for h in hashed(batch["text"].tolist()):
                raw.append(np.unique(h))
                docs, size, total = docs + 1, size + len(raw[-1]), total + 1
                if size >= _BLOCK_SHINGLES or docs >= _BLOCK_DOCS:
                    block = merged(block, counted(raw))
                    raw, size = [], 0
                if block and docs >= _BLOCK_DOCS:
                    if full:
                        yield closed(full, singles=False)
                    full, block, docs = block, None, 0
                elif block and len(block[0]) >= _BLOCK_DISTINCT:
                    yield closed(block, singles=True)
                    block, docs = None, 0
        block = merged(block, counted(raw))
        if full or block:
            yield closed(merged(full, block), singles=not full)
        yield pd.DataFrame({"shingle": [None], "n": [total]}).astype({"shingle": "Int64"})

    # a task with few documents would have to give all its shingles, so tasks are joined until each has a block or two
    tasks = max(texts.count() // (2 * _BLOCK_DOCS), 1)
    lower = texts.select("text").coalesce(tasks).mapInPandas(blocks, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    lower = (scratch or Scratch(texts.sparkSession)).keep(lower)
    total = lower.where("shingle is null").agg(F.sum("n")).first()[0] or 0
    likely = lower.where(F.col("shingle").isNotNull() & (F.col("n") >= (share - 1 / _BLOCK_DOCS) * total)).select("shingle")
    candidates = np.sort(likely.toArrow().column("shingle").to_numpy().view(np.uint64))
    if not len(candidates):
        return np.zeros(0, np.uint64), np.zeros(0)

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(candidates), np.int64)
        for batch in batches:
            for h in hashed(batch["text"].tolist()):
                own = np.unique(h)
                at = np.minimum(np.searchsorted(candidates, own), len(candidates) - 1)
                n[at[candidates[at] == own]] += 1
        hit = np.flatnonzero(n)
        yield pd.DataFrame({"at": hit, "n": n[hit]})

    known = texts.select("text").mapInPandas(exact, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") >= share * total).toArrow()
    at, df = known.column("at").to_numpy(), known.column("n").to_numpy()
    order = np.argsort(at)
    return candidates[at[order]], _idf(total / df[order], share)


def _idf(rarity: np.ndarray | float, share: float = COMMON) -> np.ndarray | float:
    return np.sqrt(1 + np.log(np.minimum(rarity, 1 / share)))


def weighted(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], share: float = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct shingles, sorted, and their weights."""
    shingle, tf = np.unique(hashes, return_counts=True)
    weight = tf * float(_idf(1 / share, share))
    if len(common[0]) and len(shingle):
        at = np.minimum(np.searchsorted(common[0], shingle), len(common[0]) - 1)
        hit = common[0][at] == shingle
        weight[hit] = tf[hit] * common[1][at[hit]]
    return shingle, weight


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; 1 for two texts without shingles."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    either = float(a[1].sum() + b[1].sum()) - both
    return both / either if either else 1.0


#: -ln of the midpoints of 2^16 equal parts of (0, 1); two of these add up to a gamma(2, 1) variate.
_NEG_LOG = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def signature(shingle: np.ndarray, weight: np.ndarray, functions: int) -> np.ndarray:
    """The sample (hash of shingle and quantised weight) of each hash function; the text must have a shingle."""
    keys = mix64(np.arange(1, functions + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    least = np.full(functions, np.inf, np.float32)
    best = np.zeros(functions, np.uint64)
    log_weight = np.log(weight).astype(np.float32)
    step = 2048
    for a in range(0, len(shingle), step):
        own = shingle[a : a + step]
        h = own[None, :] ^ keys[:, None]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        part = (h ^ (h >> np.uint64(29))).view(np.uint16).reshape(functions, len(own), 4)
        r = _NEG_LOG[part[:, :, 0]] + _NEG_LOG[part[:, :, 1]]
        c = _NEG_LOG[part[:, :, 2]] + _NEG_LOG[part[:, :, 3]]
        h *= np.uint64(0x9E3779B97F4A7C15)
        beta = (h >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_weight[a : a + step] / r + beta)
        value = np.log(c) - r * (t - beta + 1)
        at = value.argmin(1)
        row = np.arange(functions)
        lower = value[row, at] < least
        least[lower] = value[row, at][lower]
        drawn = mix64(own[at] + t[row, at].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        best[lower] = drawn[lower]
    return best


def band_keys(best: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + best.reshape(bands, rows)[:, r])
    return key.view(np.int64)


def band_table(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id`` and the band keys of every text that has a shingle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, out = batch["doc_id"].to_numpy(), []
            keep = []
            for i, h in enumerate(hashed(batch["text"].tolist())):
                if len(h):
                    keep.append(ids[i])
                    out.append(band_keys(signature(*weighted(h, common), bands * rows), bands, rows))
            yield pd.DataFrame({"doc_id": np.array(keep, np.int64), "bands": pd.Series(out, dtype=object)})

    return texts.mapInPandas(run, "doc_id long, bands array<long>")


def exact_copies(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id`` and ``first``, the smallest id with the same text, for every id that isn't the first."""
    marked = texts.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), F.octet_length("text").alias("n_bytes"))
    key = ["h1", "h2", "n_bytes"]
    groups = scratch.keep(marked.groupBy(*key).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return scratch.keep(marked.join(groups, key).where("doc_id <> first").select("doc_id", "first").distinct())


def _verified(pairs: DataFrame, texts: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``pairs`` of ids (``a``, ``b``) with the weighted Jaccard ``similarity`` of their whole texts.

    The members ``a`` of one ``b`` are dealt to runs of about ``GROUP``, and the text of ``b`` goes once to each run, so a document that leads
    many is neither one task nor copied for each of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = head = None
        for batch in batches:
            b, part, ids, is_head, texts_ = (batch[c].tolist() for c in ("b", "part", "doc_id", "head", "text"))
            for i, j in slices(texts_):
                found = []
                for k, h in zip(range(i, j), hashed(texts_[i:j]), strict=True):
                    own = weighted(h, common)
                    if is_head[k]:
                        place, head = (b[k], part[k]), own
                    elif place == (b[k], part[k]):
                        found.append((ids[k], b[k], similarity(own, head)))
                    else:
                        raise ValueError("a member without its leader before it")
                yield pd.DataFrame(found, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})

    parts = F.ceil(F.col("n") / GROUP)
    heads = pairs.groupBy("b").agg(F.count("*").alias("n"))
    members = pairs.join(heads, "b").select("b", F.pmod(F.xxhash64("a"), parts).alias("part"), F.col("a").alias("doc_id"), F.lit(False).alias("head"))
    leaders = heads.select("b", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("b").alias("doc_id"), F.lit(True).alias("head"))
    rows = members.union(leaders).join(texts.select("doc_id", "text"), "doc_id").select("b", "part", "doc_id", "head", "text")
    return rows.repartition("b", "part").sortWithinPartitions("b", "part", F.desc("head")).mapInPandas(run, "a long, b long, similarity double")


def _linked(rows: pd.DataFrame, common: tuple[np.ndarray, np.ndarray], threshold: float) -> pd.DataFrame:
    """Links of one tile: side 0 against side 1, or all against all where there is one side. Only such as connect what isn't connected yet."""
    side, label, away = (rows[c].to_numpy() for c in ("side", "label", "away"))
    ids, texts = rows["doc_id"].to_numpy(), rows["text"].tolist()
    label, cross, links = label.copy(), 0 < side.sum() < len(side), []
    maybe = (label[:, None] != label) & (np.abs(away[:, None] - away) <= _ring_width(threshold))
    bands = np.stack(rows["bands"].tolist())
    here = int(np.flatnonzero((bands == rows["key"].iloc[0]).any(0))[0])
    for p in range(here):  # a pair is tried in the first bucket that it shares
        maybe &= bands[:, p][:, None] != bands[:, p]
    maybe &= (side[:, None] < side) if cross else np.triu(np.ones_like(maybe), 1)
    used = np.flatnonzero(maybe.any(0) | maybe.any(1))
    if len(used):
        sets = [weighted(h, common) for h in hashed([texts[i] for i in used])]
        _, place = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True)
        weight, ends = np.concatenate([w for _, w in sets]), np.cumsum([len(x) for x, _ in sets])
        total, at, dense = np.array([w.sum() for _, w in sets]), {d: k for k, d in enumerate(used)}, np.zeros(place.max() + 1)
        for i in np.flatnonzero(maybe.any(1)):
            against = np.array([at[j] for j in np.flatnonzero(maybe[i] & (label != label[i]))], np.int64)
            if not len(against):
                continue
            a = at[i]
            own = slice(ends[a] - len(sets[a][0]), ends[a])
            dense[place[own]] = weight[own]
            both = np.add.reduceat(np.minimum(dense[place], weight), np.append(0, ends[:-1]))[against]  # every document here has a shingle
            dense[place[own]] = 0
            for b in against[both / (total[a] + total[against] - both) >= threshold - 1e-9]:
                j = used[b]
                if label[j] != label[i] and similarity(sets[a], sets[b]) >= threshold:
                    links.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _ring_width(threshold: float) -> float:
    return (1 - threshold) * 1.001


def tile_links(members: DataFrame, texts: DataFrame, keyed: DataFrame, common: tuple[np.ndarray, np.ndarray], scratch: Scratch, threshold: float) -> DataFrame:
    """Links (``a``, ``b``) inside buckets, as many as connect all that are alike and not connected yet.

    ``members``: ``key``, ``doc_id``, ``away`` (distance to the bucket's leader), ``label`` (component so far), ``main`` (whether that
    is the leader's). One minus the weighted Jaccard similarity is a metric, so two documents whose distances to the leader differ
    by more than the allowed distance can't be linked. A large bucket is cut by rings of that distance and by ``main``, each part
    into chunks, and chunks of the same or neighbouring rings meet in a tile, but for two of ``main``, which are connected. Tiles
    are bounded in documents and bytes and hold no row per pair; every pair that isn't ruled out so is tried, in the first bucket
    that its documents share.
    """
    placed = members.join(texts.select("doc_id", F.octet_length("text").alias("n_bytes")), "doc_id")
    placed = scratch.keep(placed.withColumn("part", (2 * F.floor(F.col("away") / _ring_width(threshold)) + F.col("main").cast("int")).cast("int")))
    parts = placed.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))
    chunks = F.ceil(F.greatest(F.col("n") / TILE, F.col("n_bytes") / TILE_BYTES, F.lit(1))).cast("int")
    sizes = parts.groupBy("key").agg(
        F.sum("n").alias("n"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum(F.when(F.col("part") % 2 == 0, 1)).alias("others"),
        F.map_from_entries(F.collect_list(F.struct("part", chunks.alias("chunks")))).alias("parts"),  # at most two parts a ring, and rings are few
    )
    whole = (F.col("n") <= 2 * TILE) & (F.col("n_bytes") <= 2 * TILE_BYTES)
    chunk = F.pmod(F.xxhash64("doc_id", "key"), F.element_at("parts", F.col("part"))).cast("int")
    near = F.filter(F.map_keys("parts"), lambda q: ((q % 2 == 0) | (F.col("part") % 2 == 0)) & (F.abs(F.floor(q / 2) - F.floor(F.col("part") / 2)) <= 1))

    def tile(q, j):
        mine = (F.col("part") < q) | ((F.col("part") == q) & (F.col("chunk") <= j))
        low, high = F.array("part", "chunk"), F.array(q, j)
        return F.struct(F.when(mine, F.concat(low, high)).otherwise(F.concat(high, low)).alias("tile"), F.when(mine, 0).otherwise(1).alias("side"))

    tiles = F.flatten(F.transform(near, lambda q: F.transform(F.sequence(F.lit(0), F.element_at("parts", q) - 1), lambda j: tile(q, j))))
    one = F.array(F.struct(F.array(*[F.lit(-1)] * 4).alias("tile"), F.lit(0).alias("side")))
    dealt = placed.drop("n_bytes").join(sizes.where("n > 1 and others > 0"), "key").withColumn("chunk", chunk)
    dealt = scratch.keep(dealt.select("key", "doc_id", "away", "label", F.explode(F.when(whole, one).otherwise(tiles)).alias("t")).select("key", "doc_id", "away", "label", "t.tile", "t.side"))
    full = dealt.join(texts.select("doc_id", "text"), "doc_id").join(keyed, "doc_id")
    return scratch.keep(full.groupBy("key", "tile").applyInPandas(lambda rows: _linked(rows, common, threshold), "a long, b long"))


def links(texts: DataFrame, copies: DataFrame, scratch: Scratch, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Verified links (``a``, ``b``) between different texts, enough to connect all that are found alike."""
    common = common_shingles(texts, scratch=scratch)
    keyed = scratch.keep(band_table(texts, common, bands, rows).join(copies.select("doc_id"), "doc_id", "left_anti"))
    places = keyed.select("doc_id", F.explode("bands").alias("key"))
    shared = scratch.keep(places.join(places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"))
    # the leader is the document that meets most others in its buckets: of a group of copies, one near the middle
    central = shared.groupBy("doc_id").agg(F.sum("n").alias("meets"))
    turn = [F.xxhash64("doc_id"), F.xxhash64(F.lit(1), "doc_id")]
    leaders = shared.join(central, "doc_id").groupBy("key").agg(
        F.count("*").alias("n"), F.max_by("doc_id", F.struct("meets", turn[0])).alias("l0"), F.min_by("doc_id", turn[0]).alias("l1"), F.max_by("doc_id", turn[0]).alias("l2"), F.min_by("doc_id", turn[1]).alias("l3")
    )
    leaders = scratch.keep(leaders)
    met = scratch.keep(shared.drop("n").join(leaders, "key"))
    needed = met.select("doc_id").distinct()
    few = needed.count() <= BROADCAST_ROWS
    texts = scratch.keep(texts.join(F.broadcast(needed) if few else needed, "doc_id", "left_semi"))

    first = scratch.keep(_verified(met.select(F.col("doc_id").alias("a"), F.col("l0").alias("b")).where("a <> b").distinct(), texts, common))
    found = [first.where(F.col("similarity") >= threshold)]
    # within twice the allowed distance of the leader there may be members of the class that are near enough
    fringe_from = 1 - 2 * (1 - threshold)
    left = scratch.keep(
        met.join(first.select(F.col("a").alias("doc_id"), F.col("b").alias("l0"), "similarity"), ["doc_id", "l0"]).where(F.col("similarity") < threshold)
    )
    fringe = left.where(F.col("similarity") >= fringe_from).select(F.col("doc_id").alias("a"), F.explode(F.array("l1", "l2", "l3")).alias("b"))
    second = scratch.keep(_verified(fringe.where("a <> b").distinct().join(first.select("a", "b"), ["a", "b"], "left_anti"), texts, common).where(F.col("similarity") >= threshold).select("a", "b"))
    found.append(second)
    found = [scratch.keep(reduce(DataFrame.union, [f.select("a", "b") for f in found]).distinct())]
    labels = components(found[0], scratch)
    heads = leaders.where("n > 2").select("key", "l0").join(labels.withColumnRenamed("node", "l0"), "l0", "left").select("key", F.coalesce("label", "l0").alias("of_leader"))
    members = met.where("n > 2 and doc_id <> l0").select("key", "doc_id", "l0").join(first.select(F.col("a").alias("doc_id"), F.col("b").alias("l0"), (1 - F.col("similarity")).alias("away")), ["doc_id", "l0"])
    members = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")).join(heads, "key")
    members = members.select("key", "doc_id", "away", "label", (F.col("label") == F.col("of_leader")).alias("main"))
    found.append(tile_links(members, texts, keyed, common, scratch, threshold))
    return scratch.keep(reduce(DataFrame.union, [f.select("a", "b") for f in found]).distinct())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``label``, the smallest node that it is connected to, for every node of an edge (``a``, ``b``).

    Each turn gives every node the smallest label around it and then that label's own label, until nothing changes."""
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = scratch.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("around"))
        lower = scratch.keep(labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "around").alias("label")))
        # nodes jump to the label that their label's node has
        up = lower.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = scratch.keep(lower.join(up, "label", "left").select("node", "old", F.coalesce("top", "label").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.where("old <> label").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document with the class of near copies that it belongs to.

    ``docs``: ``doc_id``, ``text``; other columns are not read. Returns ``doc_id``, ``class_id`` (the smallest id of the
    class, the document's own if it has no near copy) and ``kept`` (whether the document is that one).
    Two texts are linked if their weighted Jaccard similarity over five-word TF-IDF shingles is at least ``threshold``; a pair
    at 0.8 meets in a bucket with probability 0.998. Equal texts are always one class, empty and null texts (which count as
    empty) too; texts without a word are copies only of their equals. Rows with one id count as one document and give one row
    for each row. Rows with a null id have a null class and are kept. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    texts = _prepared(docs)
    copies = exact_copies(texts, scratch)
    classes = components(links(texts, copies, scratch, threshold, bands, rows), scratch)
    moved = copies.select("doc_id", F.col("first").alias("node")).join(classes, "node", "left").select("doc_id", F.coalesce("label", "node").alias("class_id"))
    moved = scratch.keep_last(moved.union(classes.select("node", "label")).groupBy("doc_id").agg(F.min("class_id").alias("class_id")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(moved, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_representatives(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class of near copies, the one with the smallest id; all columns stay.

    Of rows that repeat one id, one stays. Rows with a null id stay. Ids to drop are broadcast up to ``BROADCAST_ROWS``, joined beyond.
    """
    scratch = Scratch(docs.sparkSession)
    gone = scratch.keep(near_duplicates(docs, threshold).where("not kept").select("doc_id").distinct())
    repeated = scratch.keep(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    few = gone.count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).union(once)
