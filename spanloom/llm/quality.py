"""Quality classifier: Bradley-Terry scores from preference pairs, cut at a quantile of the scores.

Each document labelled good is preferred to one labelled bad. The chance that one document wins over another is the logistic
function of the difference of their scores, and a score is a weighted sum of features of the whole text, so the weights
follow from a logistic loss on differences of features. The threshold is the quantile of the learned scores at which the
share below it is the share of bad labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.kept import kept
from .common import hash_share

#: Labelled documents of a block, about. Good and bad ones are compared inside blocks, which are dealt by a hash of the id and hold all of them.
BLOCK_DOCS = 6000
#: Good documents that each bad one is compared to.
RIVALS = 12
RIDGE = 1e-2

FEATURES = ("words", "word_length", "upper", "digits", "stops", "shouts", "bars", "symbols", "repeats", "commonest", "variety", "line_repeats")

_UPPER, _DIGIT, _STOP, _SHOUT, _BAR, _SYMBOL, _SPACE, _OTHER = range(8)
_classes: np.ndarray | None = None


def _class_of() -> np.ndarray:
    global _classes
    if _classes is None:
        table = np.full(0x110000, _OTHER, np.uint8)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                table[c] = _UPPER if s.isupper() else _OTHER
            elif s.isdigit():
                table[c] = _DIGIT
            elif s.isspace():
                table[c] = _SPACE
            else:
                table[c] = {".": _STOP, ",": _STOP, ";": _STOP, ":": _STOP, "'": _STOP, "!": _SHOUT, "?": _SHOUT, "|": _BAR}.get(s, _SYMBOL)
        _classes = table
    return _classes


def features(text: str) -> list[float]:
    """One number for each of FEATURES, from the whole text; shares are raised to the power 1/2."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = np.bincount(_class_of()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=8)
    chars = max(1, len(text) - int(n[_SPACE]))
    _, code = np.unique(np.fromiter(map(hash, words), np.int64, len(words)), return_inverse=True)
    count = np.bincount(code)
    lines = [x for x in text.split("\n") if x.strip()]
    share = [n[_UPPER] / chars, n[_DIGIT] / chars, n[_STOP] / len(words), n[_SHOUT] / len(words), n[_BAR] / len(words), n[_SYMBOL] / chars,
             np.count_nonzero(code[1:] == code[:-1]) / len(words), count.max() / (len(words) + 20), len(count) / len(words), 1 - len(set(lines)) / len(lines)]
    return [np.log1p(len(words)) / 10, np.log1p(chars / len(words)), *np.sqrt(np.minimum(share, 4.0)).tolist()]


def _differences(z: np.ndarray, good: np.ndarray, rivals: int) -> np.ndarray:
    """Features of good rows less those of bad ones: every bad row with ``rivals`` good ones, in turn."""
    best, worst = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(best):
        return z[:0]
    return z[best[np.arange(len(worst) * rivals) % len(best)]] - z[np.repeat(worst, rivals)]


def _sums(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hessian and gradient of the logistic loss, summed over differences."""
    p = 1 / (1 + np.exp(d @ w))
    return (d * (p * (1 - p))[:, None]).T @ d, d.T @ p


def _newton(sums, n: int, size: int, ridge: float) -> np.ndarray:
    """Weights by Newton steps, from the sums that ``sums`` gives for weights."""
    w = np.zeros(size)
    for _ in range(25 if n else 0):
        hessian, gradient = sums(w)
        step = np.linalg.solve(hessian / n + ridge * np.eye(size), gradient / n - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, rivals: int = RIVALS, ridge: float = RIDGE) -> dict[str, np.ndarray | float]:
    """Weights from the pairs of one block, and the threshold."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    k = int(np.count_nonzero(~good))
    if k in (0, len(good)):  # nothing to compare: every text is as the labels say
        return {"mean": mean, "scale": scale, "weights": np.zeros(x.shape[1]), "threshold": 4.0 if k else -4.0}
    d = _differences(z, good, rivals)
    w = _newton(lambda w: _sums(d, w), len(d), x.shape[1], ridge)
    scores = np.sort(z @ w)
    return {"mean": mean, "scale": scale, "weights": w, "threshold": float(scores[k - 1] + scores[k]) / 2}


def _per_block(blocks: DataFrame, f) -> np.ndarray:
    """Sum over all blocks of the numbers ``f(x, good)``, in the order of the blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, x, good in zip(batch["block"], batch["x"], batch["good"], strict=True):
                yield pd.DataFrame({"block": [block], "v": [np.asarray(f(np.frombuffer(x).reshape(-1, len(FEATURES)), np.frombuffer(good, bool)), float)]})

    return np.sum([r["v"] for r in sorted(blocks.mapInPandas(run, "block long, v array<double>").collect())], axis=0)


def fit_blocks(blocks: DataFrame, rivals: int = RIVALS, ridge: float = RIDGE) -> dict[str, np.ndarray | float]:
    """What ``fit`` gives, over all ``blocks`` (``block``, ``x`` and ``good`` as bytes): mean, scale and threshold are those of all rows, and a
    bad row meets good ones of its block. One job a step; the driver gets a few hundred numbers a block."""
    m = len(FEATURES)
    first = _per_block(blocks, lambda x, good: [len(x), np.count_nonzero(~good), *x.sum(0)])
    n, k, mean = int(first[0]), int(first[1]), first[2:] / first[0]
    scale = np.sqrt(_per_block(blocks, lambda x, good: ((x - mean) ** 2).sum(0)) / n) + 1e-9
    if k in (0, n):
        return {"mean": mean, "scale": scale, "weights": np.zeros(m), "threshold": 4.0 if k else -4.0}
    pairs = int(_per_block(blocks, lambda x, good: [rivals * np.count_nonzero(~good) if good.any() else 0])[0])

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = _per_block(blocks, lambda x, good: np.concatenate([part.ravel() for part in _sums(_differences((x - mean) / scale, good, rivals), w)]))
        return got[: m * m].reshape(m, m), got[m * m :]

    w = _newton(sums, pairs, m, ridge)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch["x"]:
                yield pd.DataFrame({"s": ((np.frombuffer(x).reshape(-1, m) - mean) / scale) @ w})

    scores = blocks.mapInPandas(run, "s double")
    low, high = scores.approxQuantile("s", [max(0.0, k / n - 0.002), min(1.0, k / n + 0.002)], 0.001)  # the scores about the place, then that place exactly
    below = scores.where(F.col("s") < low).count()
    near = np.array(sorted(map(tuple, scores.where(F.col("s").between(low, high)).groupBy("s").count().collect())))
    upto = below + np.cumsum(near[:, 1])
    at = [float(near[np.searchsorted(upto, place, "left"), 0]) for place in (k, k + 1)]
    return {"mean": mean, "scale": scale, "weights": w, "threshold": sum(at) / 2}


def learn(docs: DataFrame, labels: DataFrame, block_docs: int = BLOCK_DOCS) -> dict[str, np.ndarray | float]:
    """Fit on all labelled documents.

    ``labels``: ``doc_id``, ``quality``; rows with a null in either teach nothing, and a document labelled more than once has
    the mean of its labels, rounded up from a half. Features stay in blocks of about ``block_docs`` documents, fewer blocks where good or bad ones are rare.
    """
    agreed = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    counts = agreed.agg(F.count("*").alias("n"), F.count_if("good").alias("good")).first()
    n_blocks = max(1, min(counts["n"] // block_docs, counts["good"] // 50, (counts["n"] - counts["good"]) // 50))
    rows = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": [features(t) for t in batch["text"]]})

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        own = sorted(zip(rows["doc_id"], map(tuple, rows["x"]), rows["good"], strict=True))
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "x": [np.array([x for _, x, _ in own], float).tobytes()], "good": [np.array([g for _, _, g in own], bool).tobytes()]})

    block = F.least(F.floor(hash_share("doc_id", 10) * n_blocks), F.lit(n_blocks - 1)).cast("long")
    # features of all documents meet the labels, so that no text is shuffled and labels of any number aren't broadcast
    found = rows.mapInPandas(run, "doc_id long, x array<double>").join(agreed.hint("merge"), "doc_id").withColumn("block", block)
    blocks = kept(found.groupBy("block").applyInPandas(packed, "block long, x binary, good binary"))
    if blocks.isEmpty():
        return fit(np.zeros((1, len(FEATURES))), np.array([True]))
    return fit_blocks(blocks)


def scorer(model: dict[str, np.ndarray | float]):
    """A pandas UDF from text to a score in 0..1, above 0.5 where the Bradley-Terry score is above the threshold. Null counts as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t or "") for t in texts]).reshape(len(texts), len(FEATURES))
            s = ((x - model["mean"]) / model["scale"]) @ model["weights"] - model["threshold"]
            yield pd.Series(1 / (1 + np.exp(-np.clip(s, -500, 500))))

    return score


def rate(docs: DataFrame, labels: DataFrame, learn_from: Column, block_docs: int = BLOCK_DOCS, output: str = "quality_score") -> DataFrame:
    """Add the column ``output`` (0 to 1) to ``docs``, learned from the labels whose ``doc_id`` fulfils ``learn_from``.

    Scores use the text alone. All rows and columns stay, repeated ones too; a column of that name is replaced. Empty
    and null texts have a score like any other. Without usable labels every score is above 0.5. An empty table stays empty.
    """
    model = learn(docs, labels.where(learn_from), block_docs)
    return docs.withColumn(output, scorer(model)(F.col("text").cast("string")))
