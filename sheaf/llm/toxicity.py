"""Operator 7, toxicity: a counterfactual-regularised classifier.

Logistic regression over the distinct words of a text, each word standing for itself and
for its first four and five letters, hashed into ``DIMS`` weights. For every labelled text
that mentions identity groups, a counterfactual is made by swapping each identity term
with the next one of its set. Besides the label loss, training penalises the squared
change of the score between a text and its counterfactual, so weight moves away from the
group mentions themselves and neutral mentions are not taken for toxicity.

The fit uses a bounded sample of labelled rows (``labelled.SAMPLE_ROWS`` per class,
weighted back to the class shares); scores use the whole text of every row, and nothing
but the text.

Defined cases: null and empty texts get the score of no words; without labelled texts of
both classes the score is the share of class 1 among the labels (0.5 without any labels); repeated rows score
alike; other columns pass through, columns named like an output are replaced; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import bounded_batches

DIMS = 1 << 18
CACHE = 1 << 17
EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_"

#: Identity terms, in sets whose members are swapped for each other.
IDENTITY_SETS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrants", "natives", "refugees", "citizens"), ("disabled", "blind", "deaf"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def identity_swaps(sets: tuple = IDENTITY_SETS) -> dict[str, str]:
    return {w: s[(i + 1) % len(s)] for s in sets for i, w in enumerate(s)}


def counterfactual(text: str, swaps: dict[str, str]) -> str | None:
    """The text with its identity terms swapped; None if it has none."""
    changed = False

    def swap(m: re.Match) -> str:
        nonlocal changed
        other = swaps.get(m[0].lower())
        if other is None:
            return m[0]
        changed = True
        return other.capitalize() if m[0][0].isupper() else other

    out = re.sub(r"\w+", swap, text)
    return out if changed else None


def slots(token: str) -> tuple[int, ...]:
    """Weights of a token: its word, and its first four and five letters."""
    word = token.strip(EDGE)
    if not word:
        return ()
    names = [b"w" + word.encode("utf-8", "surrogatepass")]
    names += [b"%d" % n + word[:n].encode("utf-8", "surrogatepass") for n in (4, 5) if len(word) >= n]
    return tuple(zlib.crc32(n) % DIMS for n in names)


def features(text: str | None) -> np.ndarray:
    words = {t.strip(EDGE) for t in (text or "").lower().split()}
    return np.array([s for w in sorted(words) for s in slots(w)], np.int32)


def _rows(each: list[np.ndarray], told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots that ``told`` keeps of all texts, and the text of each."""
    kept = [x[told[x]] for x in each]
    return (np.concatenate(kept) if kept else np.zeros(0, np.int64),
            np.repeat(np.arange(len(kept)), [len(x) for x in kept]))


def telling(each: list[np.ndarray], labels: np.ndarray, least: float = 4.0) -> np.ndarray:
    """Slots whose share of texts differs between the classes by ``least`` standard errors
    or more. The others keep weight zero, so that the many neutral words of a long text
    cannot outweigh a few telling ones."""
    counts = np.zeros((2, DIMS))
    for x, label in zip(each, labels):
        counts[int(label), np.unique(x)] += 1
    zero, one = counts
    n1, n0 = max(1.0, float((labels == 1).sum())), max(1.0, float((labels == 0).sum()))
    share = (one + zero) / (n1 + n0)
    error = np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0)) + 1e-12
    return np.abs(one / n1 - zero / n0) >= least * error


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, swaps: dict[str, str] | None = None,
        fairness: float = 1.0, decay: float = 5e-5, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias. The loss is the weighted log loss + ``decay`` x squared weights
    + ``fairness`` x mean squared score change over the counterfactual pairs."""
    swaps = identity_swaps() if swaps is None else swaps
    base = float(np.average(labels, weights=weights)) if len(labels) else 0.5
    w = np.zeros(DIMS)
    if len(labels) == 0 or labels.min() == labels.max():
        clipped = min(max(base, 1e-6), 1 - 1e-6)
        return w, float(np.log(clipped / (1 - clipped)))
    each = [features(t) for t in texts]
    told = telling(each, labels)
    cols, rows = _rows(each, told)
    pairs = [(i, c) for i, t in enumerate(texts) if (c := counterfactual(t, swaps)) is not None]
    other, other_rows = _rows([features(c) for _, c in pairs], told)
    source = np.array([i for i, _ in pairs], np.int64)
    bias = float(np.log(base / (1 - base)))
    share = weights / weights.sum()
    m, v = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    for k in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], len(texts)) + bias
        err = share * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels)
        if len(pairs):
            gap = z[source] - bias - np.bincount(other_rows, w[other], len(pairs))
            pull = 2 * fairness * gap / len(pairs)
            own = err + np.bincount(source, pull, len(texts))
            grad = np.bincount(cols, own[rows], DIMS) - np.bincount(other, pull[other_rows], DIMS)
        else:
            grad = np.bincount(cols, err[rows], DIMS)
        g = np.r_[grad + 2 * decay * w, err.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return w, float(bias)


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias}

    def score(self, text: str | None) -> float:
        cache = self.__dict__.setdefault("_cache", {})
        z = self.bias
        words = set((text or "").lower().split())
        bare: dict[str, float] = {}
        for token in words:
            got = cache.get(token)
            if got is None:
                if len(cache) >= CACHE:
                    cache.clear()
                got = cache[token] = (token.strip(EDGE), float(self.weights[list(slots(token))].sum()))
            if got[1]:
                bare[got[0]] = got[1]  # a word counts once, with or without a comma
        z += sum(bare.values())
        return float(1 / (1 + np.exp(-min(60.0, max(-60.0, z)))))


def train(docs: DataFrame, labels: DataFrame, usable, label_col: str = "toxic", **options) -> Scorer:
    from sheaf.llm.labelled import sample

    rows, weight, share = sample(docs, labels, label_col, usable)
    y = rows["label"].to_numpy(np.float64)
    if len(set(y)) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Scorer(np.zeros(DIMS), float(np.log(share / (1 - share))))
    return Scorer(*fit(rows["text"].tolist(), y, np.array([weight[int(c)] for c in y]), **options))


def score_toxicity(docs: DataFrame, model: Scorer, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold). The
    model is broadcast: it always has ``DIMS`` weights."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value.score
        for batch in texts:
            yield pd.Series([one(t) for t in batch], dtype="float64")

    return (docs.withColumn("score", score(F.col(text_col).cast("string")))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
