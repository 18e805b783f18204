"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct hashes of a document's shingles, so the sketch of a union is the k smallest of two
sketches, and parts of a document or corpus merge in any order. From sketches follow the resemblance of two sets (the
share of the union's k smallest that both have), the containment of one in another, and the number of distinct shingles
(from how small the k-th hash is).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed, slices

#: Hashes in a sketch; estimates of likeness have a standard error of at most 1 / (2 sqrt(K)).
K = 128
#: Hashes keep their upper 48 bits.
_DROP = np.uint64(16)
_SPACE = float(1 << 48)
#: Stretches of neighbouring ids for each shuffle partition.
STRETCHES = 8


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(hashes >> _DROP)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of what two sketches were made from."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated shared share of the union; 1 for two empty sets, 0 if one is empty. Exact below k distinct shingles together."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / _SPACE)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 if ``a`` is empty."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    """Base64 of the hashes, six bytes each, smallest first."""
    return base64.b64encode(np.ascontiguousarray(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()).decode() if len(a) else ""


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def fingerprint(docs: DataFrame, k: int = K) -> DataFrame:
    """Sketches of every whole text: ``doc_id``, ``n_shingles`` (estimated distinct), ``fingerprint``.

    A null text counts as empty and has an empty fingerprint; null and repeated ids stay; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [sketch(h, k) for h in hashed(batch["text"].fillna("").tolist())]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_shingles": [distinct(a, k) for a in own], "fingerprint": [to_text(a) for a in own]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, n_shingles double, fingerprint string")


def _deal(docs: DataFrame) -> DataFrame:
    """Rows with ``stretch`` and ``guest``, dealt and sorted so that each row is followed by the next smaller id's row.

    Ids are cut into stretches at quantiles. The row with the largest id of each stretch comes once more, as a guest, into the
    stretch above it, and the row with the largest id of all into the lowest stretch. The cuts and these ids are as many as
    ``STRETCHES`` times the shuffle partitions, however large the table is.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("key")
    shares = [i / (STRETCHES * parts) for i in range(1, STRETCHES * parts)]
    cuts = np.unique(np.array(ids.approxQuantile("key", shares, 1 / (4 * STRETCHES * parts)), np.float64)).astype(np.int64)

    @F.pandas_udf("long")
    def stretch_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(np.int64), "right"))

    heads = sorted((r["stretch"], r["head"]) for r in ids.groupBy(stretch_of("key").alias("stretch")).agg(F.max("key").alias("head")).collect())
    hosts: dict[int, list[int]] = {}
    for (_, head), (above, _) in zip(heads, heads[1:] + heads[:1], strict=True):
        hosts.setdefault(head, []).append(above)
    own_ids, own_hosts = np.array(sorted(hosts), np.int64), [hosts[h] for h in sorted(hosts)]

    @F.pandas_udf("array<long>")
    def places(key: pd.Series) -> pd.Series:
        """The row's own stretch, then those where it is a guest."""
        keys = key.to_numpy(np.int64)
        at = np.searchsorted(own_ids, keys)
        out = [[s] for s in np.searchsorted(cuts, keys, "right").tolist()]
        for i in np.flatnonzero((at < len(own_ids)) & (own_ids[np.minimum(at, len(own_ids) - 1)] == keys)) if len(own_ids) else []:
            out[i] += own_hosts[at[i]]
        return pd.Series(out)

    dealt = docs.select("*", F.posexplode(places("key")).alias("place", "stretch")).withColumn("guest", F.col("place") > 0).drop("place")
    return dealt.repartition(parts, "stretch").sortWithinPartitions("stretch", "guest", F.desc("key"), F.xxhash64("text"))


def compare_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprint every whole text and a text edited from it and its neighbour, and compare them.

    The next document is the one with the next smaller ``doc_id``; after the last comes the first. The edited text is the text
    with its last ``floor(n_chars / 3)`` code points replaced by the first as many (or all) of the next document's text.
    Returns ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next`` (resemblance of the fingerprint to the edited text's and the next document's), ``n_shingles``.
    A null text counts as empty. A null id counts as the smallest; rows with one id follow each other in the order of a hash
    of their text. Equal texts have equal fingerprints. An only row is its own next. An empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = plain.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 62))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried: list[tuple] = []
        for batch in batches:
            rows = carried + list(zip(batch["doc_id"], batch["text"], batch["stretch"], batch["guest"], strict=True))
            carried = rows[-1:]
            for a, b in slices([r[1] for r in rows[:-1]]):
                part = rows[a : b + 1]
                texts = [r[1] for r in part]
                pairs = [i for i in range(len(part) - 1) if not part[i][3] and part[i][2] == part[i + 1][2]]
                edited = [texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[i + 1][: len(texts[i]) // 3] for i in pairs]
                own, new = [sketch(h, k) for h in hashed(texts)], [sketch(h, k) for h in hashed(edited)]
                yield pd.DataFrame(
                    {
                        "doc_id": [part[i][0] for i in pairs],
                        "n_chars": [len(texts[i]) for i in pairs],
                        "edited_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited],
                        "fingerprint": [to_text(own[i]) for i in pairs],
                        "edited_fingerprint": [to_text(e) for e in new],
                        "near_edited": [resemblance(own[i], e, k) for i, e in zip(pairs, new, strict=True)],
                        "near_next": [resemblance(own[i], own[i + 1], k) for i in pairs],
                        "n_shingles": [distinct(own[i], k) for i in pairs],
                    }
                )

    out = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"
    # ids travel as text: pandas would turn them into floats beside a null
    dealt = _deal(keyed).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "stretch", "guest")
    return dealt.mapInPandas(run, out).withColumn("doc_id", F.col("doc_id").cast("long"))
