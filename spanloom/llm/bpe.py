"""BPE encoding and decoding: propose by longest match, verify neighbours, merge exactly only what fails.

A word's tokens are proposed greedily, longest vocabulary entry first. A sequence of tokens is what the merges would give
if and only if every token is reached by merging its own text and no merge would have crossed any boundary between two
neighbours, so all adjacent pairs of a batch's new words are tested at once with array operations. Words with a failing
pair, usually a few in a hundred, go through the merges one by one.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_NEVER = np.int64(1 << 40)
#: Words kept in a worker's memory; all are forgotten when there are more.
CACHE_WORDS = 300_000
#: Words longer than this are merged one at a time, so that the array of a batch stays narrow.
WIDE = 40
#: Words of more bytes aren't proposed in array steps, which would be as many as the word has bytes, but merged at once.
LONG = 512
#: The word pattern of the vocabulary file that is read, for characters up to U+024F.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+"
_PLAIN = re.compile("[\x00-\x1b -ɏ]*")
_ODD_NUMBER = re.compile("[\xb2\xb3\xb9\xbc-\xbe]")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def merge_exactly(symbols: list[str], ranks: dict[tuple[str, str], int], tree: dict[str, tuple[str, str, int]] | None = None) -> list[str]:
    """Apply the merges, the earliest rank and then the leftmost place first."""
    symbols = list(symbols)
    never = int(_NEVER)
    open_ = [ranks.get(pair, never) for pair in zip(symbols, symbols[1:], strict=False)]
    while open_:
        rank = min(open_)
        if rank == never:
            break
        at = open_.index(rank)
        joined = symbols[at] + symbols[at + 1]
        if tree is not None:
            tree[joined] = (symbols[at], symbols[at + 1], rank)
        symbols[at : at + 2] = [joined]
        del open_[at]
        if at:
            open_[at - 1] = ranks.get((symbols[at - 1], joined), never)
        if at < len(open_):
            open_[at] = ranks.get((joined, symbols[at + 1]), never)
    return symbols


@dataclass
class Vocabulary:
    """Tables of a word-level BPE vocabulary; bounded by the vocabulary, so they are broadcast."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    suffix: str
    special: dict[str, int]
    reached: dict[str, int] = field(default_factory=dict)
    pair_keys: np.ndarray | None = None
    pair_ranks: np.ndarray | None = None
    pair_ids: np.ndarray | None = None
    trie_keys: np.ndarray | None = None
    trie_next: np.ndarray | None = None
    trie_token: np.ndarray | None = None
    right: np.ndarray | None = None
    right_until: np.ndarray | None = None
    left: np.ndarray | None = None
    left_until: np.ndarray | None = None

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        vocab = cls(ids, {p: i for i, p in enumerate(pairs)}, suffix, special)
        missing = [x for x in byte_letters() if x not in ids or x + suffix not in ids]
        if missing:
            raise ValueError(f"the vocabulary lacks bytes: {missing[:5]}")
        vocab._spines()
        return vocab

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _spines(self) -> None:
        """For each reachable token, the pieces that once stood at its right and left end, and the rank of the merge that consumed each."""
        tree: dict[str, tuple[str, str, int]] = {}
        for token in self.ids:
            if token not in self.special:
                own: dict[str, tuple[str, str, int]] = {}
                if merge_exactly(self.symbols(token), self.ranks, own) == [token]:
                    self.reached[token] = self.ids[token]
                    if token in own:
                        tree[token] = own[token]
        size = max(self.ids.values()) + 1

        def spine(side: int) -> tuple[np.ndarray, np.ndarray]:
            rows = {}
            for token, i in self.reached.items():
                row, until = [(i, _NEVER)], token
                while until in tree:
                    rank, until = tree[until][2], tree[until][side]
                    row.append((self.ids[until], rank))
                rows[i] = row
            deep = max(map(len, rows.values()))
            piece, gone = np.full((size, deep), -1, np.int32), np.full((size, deep), -1, np.int64)
            for i, row in rows.items():
                piece[i, : len(row)] = [p for p, _ in row]
                gone[i, : len(row)] = [r for _, r in row]
            return piece, gone

        self.right, self.right_until = spine(1)
        self.left, self.left_until = spine(0)
        keys = np.array([self.ids[a] * size + self.ids[b] for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.arange(len(keys), dtype=np.int64)[order]
        self.pair_ids = np.array([self.ids[a + b] for a, b in self.ranks], np.int64)[order]
        self._grow_trie()

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or never) and result of merging ``a`` and ``b``; entries of -1 never merge."""
        key = a.astype(np.int64) * len(self.right) + b
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = (self.pair_keys[place] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_ranks[place], _NEVER), self.pair_ids[place]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbouring tokens, whether no merge would have crossed the boundary between them."""
        good = np.ones(len(a), bool)
        for i in range(self.right.shape[1]):
            for j in range(self.left.shape[1]):
                at = np.flatnonzero(good & (self.right[a, i] >= 0) & (self.left[b, j] >= 0))
                if not len(at):
                    break
                x, y = a[at], b[at]
                rank, _ = self.lookup(self.right[x, i], self.left[y, j])
                # of two equal merges the left one comes first
                good[at[(rank < self.right_until[x, i]) & (rank <= self.left_until[y, j])]] = False
        return good

    def _grow_trie(self) -> None:
        """Reachable tokens as a trie over bytes (256: the end of a word) with its edges as one sorted array."""
        value = {c: b for b, c in enumerate(byte_letters())}
        edges: dict[int, int] = {}
        accepts = [-1]
        for token, i in self.reached.items():
            ends = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            node = 0
            for symbol in [*(value[c] for c in (token[: -len(self.suffix)] if ends else token)), *[256] * ends]:
                key = node * 257 + symbol
                node = edges.get(key, -1)
                if node < 0:
                    node = edges[key] = len(accepts)
                    accepts.append(-1)
            accepts[node] = i
        keys = np.array(list(edges), np.int64)
        order = np.argsort(keys)
        self.trie_keys, self.trie_next, self.trie_token = keys[order], np.array(list(edges.values()), np.int64)[order], np.array(accepts, np.int64)

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the left over all words in step; returns the tokens, word by word, and the index of each one's word."""
        size = np.array([len(w) + 1 for w in words], np.int64)
        end = np.cumsum(size)
        data = np.full(end[-1], 256, np.int64)
        inside = np.ones(end[-1], bool)
        inside[end - 1] = False
        data[inside] = np.frombuffer(b"".join(words), np.uint8)
        word, at = np.arange(len(words)), end - size
        node, token, till = np.zeros_like(at), np.full_like(at, -1), at.copy()
        found, owner = [], []
        while len(word):
            more = at < end[word]
            key = node * 257 + data[np.where(more, at, 0)]
            place = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            hit = more & (self.trie_keys[place] == key)
            node = np.where(hit, self.trie_next[place], 0)
            at = at + hit
            # without the suffix a token may not take the last byte, whose symbol bears the suffix
            took = hit & (self.trie_token[node] >= 0) & (at != end[word] - 1)
            token, till = np.where(took, self.trie_token[node], token), np.where(took, at, till)
            done = ~hit
            if done.any():
                found.append(token[done])
                owner.append(word[done])
                at = np.where(done, till, at)
                token = np.where(done, -1, token)
                left = ~(done & (till >= end[word]))
                word, at, node, token, till = word[left], at[left], node[left], token[left], till[left]
        found, owner = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return found[order], owner[order]

    def exact(self, words: list[str]) -> list[list[int]]:
        """Merge words one merge at a time, all words of about one length together."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for a in range(0, len(order), 4096):
            part = [i for i in order[a : a + 4096] if len(words[i]) <= WIDE]
            if part:
                rows = self._merge_rows([words[i] for i in part])
                for i, row in zip(part, rows, strict=True):
                    out[i] = row
            for i in order[a : a + 4096]:
                if len(words[i]) > WIDE:
                    out[i] = self._merge_long(words[i])
        return out

    def _merge_long(self, word: str) -> list[int]:
        """One long word, with a heap of the merges that are open."""
        piece: list[str | None] = self.symbols(word + self.suffix)
        before, after = list(range(-1, len(piece) - 1)), [*range(1, len(piece)), -1]
        ranks = self.ranks
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(piece, piece[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if piece[i] != pair[0] or j < 0 or piece[j] != pair[1]:
                continue
            piece[i], piece[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (piece[k], piece[after[k]])) in ranks:
                    heapq.heappush(heap, (ranks[p], k, p))
        return [self.ids[p] for p in piece if p is not None]

    def _merge_rows(self, words: list[str]) -> list[list[int]]:
        ids, wide = self.ids, max(map(len, words))
        now = np.full((len(words), wide + 1), -1, np.int64)
        for row, word in zip(now, words, strict=True):
            row[: len(word)] = [ids[c] for c in word[:-1]] + [ids[word[-1] + self.suffix]]
        rank, result = self.lookup(now[:, :-1], now[:, 1:])
        result = result.copy()
        column, live = np.arange(wide + 1), np.arange(len(words))
        while len(live):
            own = rank[live]
            at = own.argmin(1)
            going = own[np.arange(len(live)), at] < _NEVER
            live, at = live[going], at[going]
            if not len(live):
                break
            joined = result[live, at]
            moved = np.minimum(column + (column > at[:, None]), wide)
            row = np.take_along_axis(now[live], moved, 1)
            row[np.arange(len(live)), at] = joined
            now[live] = row
            moved = np.minimum(column[:-1] + (column[:-1] > at[:, None]), wide - 1)
            for table in (rank, result):
                table[live] = np.take_along_axis(table[live], moved, 1)
            rank[live, wide - 1] = _NEVER
            for side in (at - 1, at):
                ok = (side >= 0) & (side < wide)
                rank[live[ok], side[ok]], result[live[ok], side[ok]] = self.lookup(now[live[ok], side[ok]], now[live[ok], side[ok] + 1])
        return [[x for x in row if x >= 0] for row in now.tolist()]


class WordSplitter:
    """Words of a text as the vocabulary file's normaliser and pre-tokenizer give them.

    A word of a text in the plain range stands for itself; a word that the library has split off comes in byte letters
    behind one blank, a special token behind two (no word contains a blank).
    """

    def __init__(self, vocab: Vocabulary, file: str) -> None:
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(vocab.special, key=len, reverse=True)) + ")") if vocab.special else None
        self.marks = tuple(vocab.special)
        self.file, self.library = file, None
        self.find = re.compile(WORD_PATTERN).findall
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.values = {ord(c): b for b, c in enumerate(letters)}

    def words(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            low = unicodedata.normalize("NFC", text).lower()
            if (low.isascii() or _PLAIN.fullmatch(low) and not _ODD_NUMBER.search(low)) and not any(m in low for m in self.marks):
                return self.find(low)
        if self.library is None:  # Unicode classes differ between versions, so other scripts are split by the library itself
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.file)
        out = []
        # no word reaches over white space
        for chunk in re.split(r"[^\S\x1c-\x1f]+", text):
            for part in self.special.split(chunk) if self.special and any(m in chunk for m in self.marks) else [chunk]:
                if part in self.marks:
                    out.append("  " + part)
                elif part.isascii() and not _ODD_SPACE.search(part):
                    out += self.find(part.lower())
                elif part:
                    out += [" " + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def bytes_of(self, word: str) -> bytes:
        return word[1:].translate(self.values).encode("latin-1") if word[0] == " " else word.encode("utf-8")

    def letters_of(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.letters)

    def spell(self, word: str) -> str:
        """The word in byte letters."""
        if word[0] == " ":
            return word[1:]
        return word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.letters)


class Encoder:
    """Encodes the texts of one worker; words seen before are looked up."""

    def __init__(self, vocab: Vocabulary, file: str) -> None:
        self.vocab, self.split = vocab, WordSplitter(vocab, file)
        self.shown = {i: t for t, i in vocab.ids.items()} | {i: t for t, i in vocab.special.items()}
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        self.failed = self.proposed = 0

    def learn(self, new: list[str]) -> None:
        """Encode words: propose all, test all neighbours at once, merge exactly the words that fail, and very long ones."""
        spelled = [self.split.bytes_of(w) for w in new]
        wide = [w for w, s in zip(new, spelled, strict=True) if len(s) > LONG]
        for w, exact in zip(wide, self.vocab.exact([self.split.spell(w) for w in wide]), strict=True):
            self.ids[w], self.text[w] = np.array(exact, "<u4").tobytes(), " ".join([self.shown[t] for t in exact])
        new = [w for w, s in zip(new, spelled, strict=True) if len(s) <= LONG]
        spelled = [s for s in spelled if len(s) <= LONG]
        if not new:
            return
        flat, owner = self.vocab.propose(spelled)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        key, back = np.unique(flat[inner] * len(self.vocab.right) + flat[inner + 1], return_inverse=True)
        good = self.vocab.apart(key // len(self.vocab.right), key % len(self.vocab.right))[back]
        wrong = np.unique(owner[inner[~good]]).tolist()
        self.failed += len(wrong)
        self.proposed += len(new)
        at = np.searchsorted(owner, np.arange(len(new) + 1)).tolist()
        data, tokens, shown = flat.astype("<u4").tobytes(), [self.shown[t] for t in flat.tolist()], self.shown
        for i, w in enumerate(new):
            a, b = at[i], at[i + 1]
            self.ids[w] = data[4 * a : 4 * b]
            self.text[w] = tokens[a] if b == a + 1 else " ".join(tokens[a:b])
        for i, exact in zip(wrong, self.vocab.exact([self.split.spell(new[i]) for i in wrong]), strict=True):
            self.ids[new[i]] = np.array(exact, "<u4").tobytes()
            self.text[new[i]] = " ".join([shown[t] for t in exact])

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        if len(self.ids) > CACHE_WORDS:
            self.ids, self.text = {}, {}
        split = [self.split.words(t) for t in texts]
        known = self.ids
        new = {w for ws in split for w in ws if w not in known}
        for w in [w for w in new if w[:2] == "  "]:
            new.discard(w)
            self.ids[w], self.text[w] = np.array([self.vocab.special[w[2:]]], "<u4").tobytes(), w[2:]
        if new:
            self.learn(list(new))
        ids, shown = self.ids.__getitem__, self.text.__getitem__
        for ws in split:
            yield b"".join(map(ids, ws)), " ".join(map(shown, ws))


_encoders: dict[str, Encoder] = {}


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Token ids and decoded text of every whole text.

    ``docs``: ``doc_id``, ``text``; other columns are not read. ``path``: a tokenizers JSON file with a byte-level word BPE.
    Returns ``doc_id``, ``ids`` (binary: little-endian unsigned 32-bit), ``decoded`` (string: the tokens in their byte
    letters with blanks between, as the library decodes a file without a decoder). A null text counts as empty and gives
    no ids and an empty decoded text; a null ``doc_id`` and repeated rows are kept as they are; an empty table gives none.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as source:
        file = source.read()
    shared = spark.sparkContext.broadcast((Vocabulary.read(path), file))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoders.get(path)
        if encoder is None:
            encoder = _encoders.setdefault(path, Encoder(*shared.value))
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for a, b in slices(texts):
                ids, decoded = zip(*encoder.encode(texts[a:b]), strict=True)
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].array, "ids": ids, "decoded": decoded})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, ids binary, decoded string")
