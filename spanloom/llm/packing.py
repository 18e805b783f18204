"""Harmonic packing of token sequences: reciprocal-capacity classes whose bins take a fixed number of pieces.

Class j holds the documents, or what is left of longer ones, of length in ``(capacity / (j + 1), capacity / j]``, and its bins take exactly j
of them, so a bin needs no search and every worker fills its own. A bin that has its j documents lacks less than each of them is long. It
waits for a piece that closes it: a document longer than a bin closes waiting bins before it is cut to whole bins; where more than ``WAIT``
bins wait, so does the next document that is long enough. Whatever closes no bin stays whole. What a worker's rows end on is poured
together at the end, and the last of it is split into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed value: how text splits before the merges of the byte-level vocabulary that is read.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The settings of a tokenizer file that this encoder follows. A file that says otherwise is an error.
SETTINGS = {
    "normalizer": {None},
    "pre_tokenizer.type": {"ByteLevel"},
    "pre_tokenizer.add_prefix_space": {False},
    "pre_tokenizer.use_regex": {True},
    "model.type": {"BPE"},
    "model.dropout": {None},
    "model.continuing_subword_prefix": {None, ""},
    "model.end_of_word_suffix": {None, ""},
    "model.ignore_merges": {None, False},
}
#: Runs of text kept in a worker's memory with their ids; all are forgotten when there are more.
CACHE_RUNS = 200_000
#: Where a blank isn't the only white space between two runs, or a text ends on one, the text is encoded in one go.
_UNEVEN = re.compile(r" (?:\s|\Z)")


def require_settings(whole: dict) -> None:
    """Raise ``ValueError`` where a parsed tokenizer file asks for another split, normal form or merge rule than ``ByteEncoder`` has."""
    for path, fit in SETTINGS.items():
        value = whole
        for name in path.split("."):
            value = value.get(name) if isinstance(value, dict) else None
        if isinstance(value, dict | list) or value not in fit:
            raise ValueError(f"tokenizer file: {path} is {value!r}")
    for token in whole.get("added_tokens", []):
        if any(token.get(flag) for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"tokenizer file: added token {token['content']!r} isn't matched as it stands")


class ByteEncoder:
    """Ids of whole texts, by looking up runs that begin at a blank; merges never reach over those."""

    def __init__(self, file: str) -> None:
        import tiktoken

        from .bpe import byte_letters

        whole = json.loads(file)
        self.special = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        value = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(value[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in self.special}
        self.library = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, allowed_special="all"), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if _UNEVEN.search(text) or any(m in text for m in self.special):
            return self.whole(text)
        if len(self.known) > CACHE_RUNS:
            self.known = {}
        known, (head, *runs) = self.known, text.split(" ")
        for run in {r for r in runs if r not in known}:
            known[run] = np.array(self.library.encode_ordinary(" " + run), "<u4").tobytes()
        return self.whole(head) + b"".join(map(known.__getitem__, runs))


#: Bins with all their documents that wait to be closed, before documents shorter than a bin are cut for them.
WAIT = 32


class Bins:
    """The bins of one worker. A piece ends in its start and length; ``cut_piece`` parts one."""

    def __init__(self, capacity: int, first_id: int, cut_piece: Callable[[tuple, int], tuple[tuple, tuple]], wait: int = WAIT) -> None:
        self.capacity, self.next_id, self.cut_piece, self.wait = capacity, first_id, cut_piece, wait
        self.open: dict[int, list[tuple]] = {}
        self.waiting: list[tuple[int, int, list[tuple]]] = []  # what is lacking, a count, the documents; in that order
        self.turn = 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for piece in pieces:
            yield (*piece, self.next_id, offset)
            offset += piece[-1]
        self.next_id += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        """Rows of the bins that a document has filled."""
        while self.waiting and (piece[-1] > self.capacity or len(self.waiting) > self.wait):
            i = bisect.bisect_left(self.waiting, (piece[-1],)) - 1  # the bin that lacks most, but less than the document
            if i < 0:
                break
            lack, _, pieces = self.waiting.pop(i)
            last, piece = self.cut_piece(piece, lack)
            yield from self._close([*pieces, last])
        while piece[-1] > self.capacity:
            whole, piece = self.cut_piece(piece, self.capacity)
            yield from self._close([whole])
        piece, _ = self.cut_piece(piece, piece[-1])  # its own ids, without those of the document that are already given out
        j = self.capacity // piece[-1]
        bin_ = self.open.setdefault(j, [])
        bin_.append(piece)
        if len(bin_) == j:
            lack = self.capacity - sum(p[-1] for p in self.open.pop(j))
            if lack:
                self.turn += 1
                bisect.insort(self.waiting, (lack, self.turn, bin_))
            else:
                yield from self._close(bin_)

    def _rest(self) -> Iterator[tuple]:
        """Rows of the waiting bins, closed by the documents of bins that are still open; returns what is left."""
        rest = [p for j in sorted(self.open) for p in self.open[j]]
        for lack, _, pieces in self.waiting:
            while lack and rest:
                piece = rest.pop()
                if piece[-1] > lack:
                    piece, after = self.cut_piece(piece, lack)
                    rest.append(after)
                pieces.append(piece)
                lack -= piece[-1]
            if lack:
                rest += pieces
            else:
                yield from self._close(pieces)
        self.open, self.waiting = {}, []
        return rest

    def end(self) -> Iterator[tuple]:
        """Close what waits and pour what is left together: full sequences first, then powers of two from the largest down."""
        rest = yield from self._rest()
        total, bin_, room = sum(p[-1] for p in rest), [], 0
        while rest:
            if not room:
                room = min(self.capacity, 1 << (total.bit_length() - 1)) if total < self.capacity else self.capacity
                total -= room
            piece = rest.pop(0)
            if piece[-1] > room:
                piece, after = self.cut_piece(piece, room)
                rest.insert(0, after)
            bin_.append(piece)
            room -= piece[-1]
            if not room:
                yield from self._close(bin_)
                bin_ = []


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 2048, wait: int = WAIT) -> DataFrame:
    """Encode every whole text, end it with ``end_id`` and pack the pieces into sequences of at most ``capacity`` tokens.

    ``docs``: ``doc_id``, ``text``; other columns are not read. ``path``: a tokenizers JSON file of a byte-level BPE; one with other ``SETTINGS`` is an error.
    Returns one row a piece: ``doc_id``, ``start`` (ids of its document before it), ``length``, ``ids`` (binary, little-endian
    unsigned 32-bit), ``doc_tokens`` (with ``end_id``), ``sequence_id`` and ``offset`` there. A sequence shorter than
    ``capacity`` is padded to it unless its length is a power of two; padding isn't a row. Every row is a document: a null
    text counts as empty and gives ``end_id`` alone; null and repeated ids are packed like others; an empty table gives
    no rows. ``sequence_id`` is the number of the input's partition and a count in it, so each worker packs alone and a
    partition that is read again gives the same rows; partitions must come in a fixed order of rows, as from files.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    with open(path, encoding="utf-8") as source:
        file = source.read()
    require_settings(json.loads(file))
    shared = docs.sparkSession.sparkContext.broadcast(file)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoders.get(path)
        if encoder is None:
            encoder = _encoders.setdefault(path, ByteEncoder(shared.value))
        names = ["doc_id", "ids", "doc_tokens", "start", "length", "sequence_id", "offset"]

        def split(piece: tuple, at: int) -> tuple[tuple, tuple]:
            doc_id, ids, n, start, length = piece
            ids = memoryview(ids)
            return (doc_id, bytes(ids[: 4 * at]), n, start, at), (doc_id, ids[4 * at :], n, start + at, length - at)

        bins = Bins(capacity, TaskContext.get().partitionId() << 40, split, wait)

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            return out

        for batch in batches:
            texts, doc_ids = batch["text"].fillna("").tolist(), batch["doc_id"].tolist()
            for a, b in slices(texts):
                rows: list[tuple] = []
                for i in range(a, b):
                    ids = encoder.encode(texts[i]) + end
                    doc_id = None if pd.isna(doc_ids[i]) else int(doc_ids[i])
                    rows += bins.add((doc_id, ids, len(ids) // 4, 0, len(ids) // 4))
                if rows:
                    yield frame(rows)
        rows = list(bins.end())
        if rows:
            yield frame(rows)

    # ids above 2^53 would not survive pandas' floats beside a null, so they travel as text
    plain = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = plain.mapInPandas(run, "doc_id long, ids binary, doc_tokens long, start long, length long, sequence_id long, offset long")
    return packed.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


_encoders: dict[str, ByteEncoder] = {}
