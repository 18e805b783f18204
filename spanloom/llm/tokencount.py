"""Exact token counts at every prefix by dynamic programming, so that budgets and truncation need no second encoding.

For a word of the byte-level BPE in ``bpe.Vocabulary`` the tokens of each prefix end in exactly one token that stands apart
from the last token of the prefix before it. So ``count[i] = count[j] + 1`` for the one ``j`` where ``word[j:i]`` is a
token that no merge would have joined to the last token of ``word[:j]``. The table holds the count and the last token at
every byte of a word; the counts of a text add up over its words, and where a budget cuts a word, its stored table says
how far the budget reaches. Short words are filled in step by array operations, words of more than ``LONG`` bytes one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LONG, Vocabulary, WordSplitter, byte_letters
from .common import slices

#: Words kept in a worker's memory; all are forgotten when there are more.
CACHE_WORDS = 300_000


class PrefixTable:
    """Counts at every prefix of the words of one worker's texts."""

    def __init__(self, vocab: Vocabulary, file: str) -> None:
        self.vocab, self.split = vocab, WordSplitter(vocab, file)
        self.total: dict[str, int] = {}
        self.inner: dict[str, tuple[bytes, bytes]] = {}
        value = {c: b for b, c in enumerate(byte_letters())}
        suffix = vocab.suffix
        #: Tokens that end a word, by their bytes.
        self._ending = {bytes(value[c] for c in t[: len(t) - len(suffix)]): i for t, i in vocab.reached.items() if t.endswith(suffix) and t != suffix}
        self._longest = max(map(len, self._ending))
        self._seen: dict[int, bool] = {}
        self._ranks: dict[int, int] = {}
        self._edges: dict[int, int] = {}
        self._pairs, self._apart = np.zeros(0, np.int64), np.zeros(0, bool)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether neighbours stand apart, from the pairs seen before or else by the merges."""
        key, back = np.unique(a * len(self.vocab.right) + b, return_inverse=True)
        if not len(key):
            return np.zeros(0, bool)
        place = np.searchsorted(self._pairs, key)
        known = place < len(self._pairs)
        known[known] = self._pairs[place[known]] == key[known]
        out = np.empty(len(key), bool)
        out[known] = self._apart[place[known]]
        new = key[~known]
        out[~known] = self.vocab.apart(new // len(self.vocab.right), new % len(self.vocab.right))
        if len(self._pairs) < 2_000_000 and len(new):
            self._pairs = np.insert(self._pairs, place[~known], new)
            self._apart = np.insert(self._apart, place[~known], out[~known])
        return out[back]

    def table(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all words in step: the first cell of each word, and for each cell (one more than bytes) the count and the last token of
        the prefix without the end of the word; then the count of each whole word."""
        vocab = self.vocab
        size = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(size + 1) - size - 1
        data = np.full(len(words) + size.sum(), 256, np.int64)
        inside = np.ones(len(data), bool)
        inside[first + size] = False
        data[inside] = np.frombuffer(b"".join(words), np.uint8)
        count, last, whole = np.full(len(data), -1, np.int64), np.full(len(data), -1, np.int64), np.full(len(words), -1, np.int64)
        count[first] = 0
        by_size = np.argsort(-size, kind="stable")
        reach = -np.sort(-size)
        for j in range(int(reach[0]) if len(reach) else 0):
            word = by_size[: np.searchsorted(-reach, -j, "left")]  # those longer than j
            word = word[count[first[word] + j] >= 0]
            start, at, node = first[word] + j, first[word] + j, np.zeros(len(word), np.int64)
            owner, begin, until, token = [], [], [], []
            while len(word):
                key = node * 257 + data[at]
                place = np.minimum(np.searchsorted(vocab.trie_keys, key), len(vocab.trie_keys) - 1)
                hit = vocab.trie_keys[place] == key
                word, start, at, node = word[hit], start[hit], at[hit] + 1, vocab.trie_next[place[hit]]
                got = vocab.trie_token[node] >= 0
                if got.any():
                    owner.append(word[got])
                    begin.append(start[got])
                    until.append(at[got])
                    token.append(vocab.trie_token[node[got]])
                going = at <= first[word] + size[word]  # the mark at the end is the last that can be read
                word, start, at, node = word[going], start[going], at[going], node[going]
            if not owner:
                continue
            owner, begin, until, token = map(np.concatenate, (owner, begin, until, token))
            ends = until > first[owner] + size[owner]
            # a token without the suffix may reach the last byte as well: that is a prefix of a longer word
            open_ = np.where(ends, whole[owner], count[np.where(ends, 0, until)]) < 0
            owner, begin, until, token, ends = owner[open_], begin[open_], until[open_], token[open_], ends[open_]
            good = last[begin] < 0
            good[~good] = self.apart(last[begin[~good]], token[~good])
            owner, begin, until, token, ends = owner[good], begin[good], until[good], token[good], ends[good]
            whole[owner[ends]] = count[begin[ends]] + 1
            count[until[~ends]], last[until[~ends]] = count[begin[~ends]] + 1, token[~ends]
        return first, count, last, whole

    def _plain_apart(self, a: int, b: int) -> bool:
        """``apart`` of one pair, kept."""
        key = a * len(self.vocab.right) + b
        known = self._seen.get(key)
        if known is None:
            if not self._ranks:
                self._ranks = dict(zip(self.vocab.pair_keys.tolist(), self.vocab.pair_ranks.tolist(), strict=True))
            size, known = len(self.vocab.right), True
            left = [(y, u) for y, u in zip(self.vocab.left[b].tolist(), self.vocab.left_until[b].tolist(), strict=True) if y >= 0]
            for x, until in zip(self.vocab.right[a].tolist(), self.vocab.right_until[a].tolist(), strict=True):
                if x < 0:
                    break
                if any((r := self._ranks.get(x * size + y)) is not None and r < until and r <= u for y, u in left):
                    known = False
                    break
            if len(self._seen) > 2_000_000:
                self._seen = {}
            self._seen[key] = known
        return known

    def long_table(self, word: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """Count and last token at every prefix of one long word, and the count of the whole, in time that grows with its length."""
        if not self._edges:
            self._edges = dict(zip(self.vocab.trie_keys.tolist(), self.vocab.trie_next.tolist(), strict=True))
            self._token = self.vocab.trie_token.tolist()
        n, edges, tokens, apart = len(word), self._edges, self._token, self._plain_apart
        count, last, whole = [-1] * (n + 1), [-1] * (n + 1), -1
        count[0] = 0
        for j in range(n):
            more = count[j] + 1
            if not more:
                continue
            node, before = 0, last[j]
            for i in range(j, n + 1):
                node = edges.get(node * 257 + (word[i] if i < n else 256), -1)
                if node < 0:
                    break
                token = tokens[node]
                if token < 0:
                    continue
                if i == n:
                    if whole < 0 and (before < 0 or apart(before, token)):
                        whole = more
                elif count[i + 1] < 0 and (before < 0 or apart(before, token)):
                    count[i + 1], last[i + 1] = more, token
        return np.array(count, np.int64), np.array(last, np.int64), whole

    def learn(self, new: list[str]) -> None:
        spelled = [self.split.bytes_of(w) for w in new]
        short = [(w, s) for w, s in zip(new, spelled, strict=True) if len(s) <= LONG]
        first, count, last, whole = self.table([s for _, s in short])
        counts, lasts = count.astype("<i4").tobytes(), last.astype("<i4").tobytes()
        for (w, s), a, n in zip(short, first.tolist(), whole.tolist(), strict=True):
            self.total[w] = n
            self.inner[w] = counts[4 * a : 4 * (a + len(s) + 1)], lasts[4 * a : 4 * (a + len(s) + 1)]
        for w, s in zip(new, spelled, strict=True):
            if len(s) > LONG:
                count, last, self.total[w] = self.long_table(s)
                self.inner[w] = count.astype("<i4").tobytes(), last.astype("<i4").tobytes()

    def longest_within(self, word: str, room: int) -> tuple[int, int]:
        """Bytes (whole characters) and tokens of the longest prefix of a word, taken as a word of its own, with at most ``room`` tokens.

        Read from the stored table: a prefix ends in one token that bears the end of a word, behind a shorter prefix whose count and
        last token the table has."""
        spelled = self.split.bytes_of(word)
        count, last = (np.frombuffer(x, "<i4") for x in self.inner[word])
        fits = np.flatnonzero((count >= 0) & (count < room))
        ending = self._ending
        for i in range(min(len(spelled), int(fits[-1]) + self._longest) if len(fits) else 0, 0, -1):
            if i < len(spelled) and spelled[i] & 0xC0 == 0x80:
                continue
            for j in range(i - 1, max(i - 1 - self._longest, -1), -1):
                token = ending.get(spelled[j:i])
                if token is not None and count[j] >= 0 and (j == 0 or self._plain_apart(int(last[j]), token)):
                    if count[j] < room:
                        return i, int(count[j]) + 1
                    break
        return 0, 0

    def count(self, texts: list[str], budget: int) -> Iterator[tuple[int, int, int, int]]:
        """Tokens; whole words that the budget holds; bytes of the next word that still fit; tokens of that prefix."""
        if len(self.total) > CACHE_WORDS:
            self.total, self.inner = {}, {}
        split = [self.split.words(t) for t in texts]
        new = {w for ws in split for w in ws if w not in self.total}
        for w in [w for w in new if w[:2] == "  "]:
            new.discard(w)
            self.total[w] = 1
        if new:
            self.learn(list(new))
        of = self.total.__getitem__
        for ws in split:
            n = sum(map(of, ws))
            if n <= budget:
                yield n, len(ws), 0, n
                continue
            sums = list(accumulate(map(of, ws)))
            k = int(np.searchsorted(sums, budget, "right"))
            held = sums[k - 1] if k else 0
            part = more = 0
            if ws[k][:2] != "  " and held < budget:
                part, more = self.longest_within(ws[k], budget - held)
            held += more
            yield n, k, part, held


_tables: dict[str, PrefixTable] = {}


def count_tokens(docs: DataFrame, path: str, budget: int = 2048) -> DataFrame:
    """Exact token counts of every whole text, and the longest prefix within a budget.

    ``docs``: ``doc_id``, ``text``; other columns are not read. ``path``: a tokenizers JSON file with a byte-level word BPE.
    Returns ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more tokens than ``budget``), and the longest
    prefix of the normalised text with at most ``budget`` tokens as ``fit_words`` (whole words), ``fit_bytes`` (bytes of
    the word after them, whole characters) and ``fit_tokens``. A null text counts as empty: zeros and false. Null and
    repeated ids are kept as they are; an empty table gives none.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as source:
        file = source.read()
    shared = spark.sparkContext.broadcast((Vocabulary.read(path), file))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _tables.get(path)
        if table is None:
            table = _tables.setdefault(path, PrefixTable(*shared.value))
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for a, b in slices(texts):
                rows = list(table.count(texts[a:b], budget))
                out = pd.DataFrame(rows, columns=["n_tokens", "fit_words", "fit_bytes", "fit_tokens"])
                out.insert(0, "doc_id", batch["doc_id"].iloc[a:b].array)
                out.insert(1, "n_bytes", [len(t.encode("utf-8")) for t in texts[a:b]])
                yield out

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = plain.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, fit_words long, fit_bytes long, fit_tokens long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > budget).alias("over_limit"), "fit_words", "fit_bytes", "fit_tokens")
