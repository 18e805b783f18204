"""Helpers shared by the text operators: reading tables, hashing words and shingles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
#: Bytes of text that are worked on in one step.
SLICE_BYTES = 1 << 20
#: Bytes of text whose shingles are hashed in one step: small enough for the arrays to stay in a core's cache.
HASH_BYTES = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(column: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null for null."""
    return F.crc32(F.encode(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), "UTF-8")) % modulus


def hash_share(column: str | Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the value and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column) if isinstance(column, str) else column), F.lit(1 << 40)) / float(1 << 40)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores after it while ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def slices(texts: Sequence[str], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs ``[a, b)`` of consecutive texts with about ``most`` characters together; a longer text stands alone."""
    a = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield a, i
            a, size = i, 0
        size += len(text)
    if a < len(texts):
        yield a, len(texts)


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, without a copy, and where each begins (one more at the end); null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs ``[a, b)`` of consecutive texts with at most ``most`` bytes together; a longer text stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1, a + 1)
        yield a, min(b, n)
        a = min(b, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _constants(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


#: A letter, digit, underscore or any byte of a non-ASCII character belongs to a word.
_IN_WORD = np.array([b >= 0x80 or chr(b).isalnum() or b == 0x5F for b in range(256)])
_BYTE_VALUE = _constants(256, 11)
_STEP = 0x5851F42D4C957F2D
_STEP_BACK = pow(_STEP, -1, 1 << 64)
_PLACE = _constants(SHINGLE_WORDS, 23) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have)
    return have[:n]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices ``[start, end)`` of ``data``."""
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * _powers_of(_STEP, len(data)), out=run[1:])
    return mix64((run[end] - run[start]) * _powers_of(_STEP_BACK, len(data))[start] + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)


def word_shingles(word: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``words`` words of each text and where each text's begin; ``word``: hashes of all words, ``at``: each text's first."""
    count = np.diff(at)
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    begin = np.zeros(len(at), np.int64)
    np.cumsum(n, out=begin[1:])
    out = np.empty(begin[-1], np.uint64)
    if len(word) >= words:
        total = np.zeros(len(word) - words + 1, np.uint64)
        for k in range(words):
            total += word[k : len(word) - words + 1 + k] * _PLACE[k]
        keep = np.zeros(len(total) + 1, np.int32)  # positions whose words all belong to one text
        full = np.flatnonzero(count >= words)
        np.add.at(keep, at[full], 1)
        np.add.at(keep, at[full] + count[full] - words + 1, -1)
        place = np.ones(len(out), bool)
        short = np.flatnonzero((count > 0) & (count < words))
        place[begin[short]] = False
        out[place] = mix64(total[np.cumsum(keep[:-1]) > 0])
    for i in np.flatnonzero((count > 0) & (count < words)):
        own = word[at[i] : at[i + 1]]
        out[begin[i]] = mix64(np.array([np.sum(own * _PLACE[: len(own)]) + np.uint64(len(own))], np.uint64))[0]
    return out, begin


def shingle_hashes(texts: Sequence[str], words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of each text, in text order, and the index where each text's begin (one more at the end).

    Words are the maximal runs of letters, digits and non-ASCII characters of the lower-case text. A text of fewer than
    ``words`` words has one shingle of all its words; one without words has none.
    """
    if words > SHINGLE_WORDS:
        raise ValueError(f"at most {SHINGLE_WORDS} words")
    coded = [t.lower().encode("utf-8", "replace") for t in texts]
    first = np.zeros(len(coded) + 1, np.int64)
    np.cumsum([len(c) + 1 for c in coded], out=first[1:])
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8) if coded else np.zeros(0, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IN_WORD[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word = word_hashes(data, start, end)
    at = np.searchsorted(start, first)  # the first word of each text
    return word_shingles(word, at, words)


def hashed(texts: Sequence[str], words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Each text's shingle hashes, as ``shingle_hashes`` but in slices of bounded size."""
    for a, b in slices(texts, HASH_BYTES):
        out, begin = shingle_hashes(texts[a:b], words)
        for i in range(b - a):
            yield out[begin[i] : begin[i + 1]]
