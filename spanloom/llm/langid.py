"""Language identification by rank-order profiles.

A profile lists a language's most frequent letter n-grams (one to three letters, blanks mark word edges) in order of
frequency. A document's own list is compared to every profile: each of its n-grams counts the difference of the two ranks,
or the length of the list where the profile lacks it, and the language with the smallest total is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_share

UNDETERMINED = "und"
#: n-grams in a profile and in a document's list.
PROFILE_SIZE = 400
#: Labelled documents a language that profiles are learned from (about as many; all if there are fewer), a bounded sample by a hash of the id.
SAMPLE_DOCS = 1500

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (21 bits a letter) of the whole text in lower case, and how often each occurs."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[code]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # letters, and one blank after each word
    blank = np.array([32], np.int64)
    code = np.concatenate([blank, np.where(letter, code, 32)[keep].astype(np.int64), blank[: int(letter[-1])]])
    two = code[:-1] << 21 | code[1:]
    three = code[:-2] << 42 | code[1:-1] << 21 | code[2:]
    return np.unique(np.concatenate([code[code != 32], two, three[code[1:-1] != 32]]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties in the order of their letters."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:size]


def profiles(labelled: DataFrame, size: int = PROFILE_SIZE, sample_docs: int = SAMPLE_DOCS) -> dict[str, np.ndarray]:
    """Profile of each language from rows with ``doc_id``, ``text``, ``lang``. Languages are counted over all rows; n-grams come from
    the sampled documents' whole texts, each distinct text once. The profiles are ``size`` numbers a language."""
    known = labelled.where("doc_id is not null and text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.element_at(F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(sample_docs / n))]), F.col("lang"))
    sample = known.where(hash_share("doc_id", 8) < share).dropDuplicates(["lang", "text"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                got = [ngrams(t) for t in texts]
                grams, back = np.unique(np.concatenate([g for g, _ in got]), return_inverse=True)
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": np.bincount(back, np.concatenate([c for _, c in got]), len(grams)).astype(np.int64)})

    counted = sample.select("lang", "text").mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    out: dict[str, list] = {}
    for r in top.collect():
        out.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {lang: np.array([g for _, g in sorted(rows)], np.int64) for lang, rows in sorted(out.items())}


def predictor(learned: dict[str, np.ndarray], size: int = PROFILE_SIZE):
    """A pandas UDF from text to ``struct<lang_pred string, score double>``.

    ``score``: one minus the smallest distance as a share of the largest possible (0 where no n-gram is in any profile).
    A null text, or one without a letter, is ``und`` with score 0, and so is every text where nothing was learned. Ties
    go to the language first in the alphabet.
    """
    names = sorted(learned)
    grams = np.unique(np.concatenate([learned[n] for n in names])) if names else np.zeros(0, np.int64)
    ranks = np.full((len(grams) + 1, max(1, len(names))), -1, np.int64)
    for k, name in enumerate(names):
        ranks[np.searchsorted(grams, learned[name]), k] = np.arange(len(learned[name]))

    def one(text: str | None) -> tuple[str, float]:
        top = ranked(*ngrams(text), size) if text and names else ()
        if not len(top):
            return UNDETERMINED, 0.0
        place = np.searchsorted(grams, top)
        place[grams[np.minimum(place, len(grams) - 1)] != top] = len(grams)
        theirs = ranks[place]
        away = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(top))[:, None])).sum(0)
        best = int(away.argmin())
        return names[best], 1.0 - float(away[best]) / (size * len(top))

    @F.pandas_udf("struct<lang_pred string, score double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, learn_from: Column, size: int = PROFILE_SIZE, sample_docs: int = SAMPLE_DOCS, output: str = "language") -> DataFrame:
    """Add a struct column ``output`` (``lang_pred``, ``score``) to ``docs``, learned from its rows where ``learn_from`` holds.

    Predictions use the text alone. Rows, columns and repeated rows stay as they are; a column of that name is replaced.
    Rows with a null id, text or lang teach nothing. An empty table gives an empty table.
    """
    learned = profiles(docs.where(learn_from), size, sample_docs)
    return docs.withColumn(output, predictor(learned, size)(F.col("text").cast("string")))
