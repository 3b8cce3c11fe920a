"""Operator 4, quality: a factorisation machine.

Inputs are hashed words (each distinct word of the text, scaled by one over the root of
their number), structure statistics and length metadata of the whole text, brought to unit
scale. Every input has a weight and a vector of ``RANK`` numbers; a pair of inputs adds
the product of its vectors. All pairs together are half the squared sum of the vectors
less the sum of their squares, so a text is scored in time linear in its words.

The fit uses a bounded sample of labelled rows (``labelled.SAMPLE_ROWS`` per class,
weighted back to the class shares); scores use whole texts, and nothing but the text.

Defined cases: null and empty texts have no words and zero statistics, and are scored like
any other; without labelled texts of both classes the score is the share of class 1 among the
labels (0.5 without any labels); repeated rows score alike; other columns pass through, columns named like an
output are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import bounded_batches

DIMS = 1 << 16
RANK = 8
CACHE = 1 << 17
LEAST_TEXTS = 3
TEXT_CHARS = 1 << 21    # characters scored at a time

#: Statistics by kind of byte; a letter beyond ASCII counts as "other".
KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
         "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".,;:", "mark": b"!?", "symbol": b"#$%&*@^~+=<>_|\\/",
         "bracket": b"()[]{}\"'`-"}
_KIND_OF = np.full(256, len(KINDS), np.uint8)
for _i, _chars in enumerate(KINDS.values()):
    _KIND_OF[list(_chars)] = _i
N_STATS = len(KINDS) + 1 + 8


def statistics(text: str, words: list[str], distinct: int) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * N_STATS
    kinds = np.bincount(_KIND_OF[np.frombuffer(data, np.uint8)], minlength=len(KINDS) + 1)
    w = max(1, len(words))
    repeats = sum(a == b for a, b in zip(words, words[1:])) / w
    lines = int(kinds[4]) + 1
    return [*(np.sqrt(kinds / n)).tolist(), np.log1p(n) / 10, np.log1p(len(words)) / 10, distinct / w, repeats,
            n / w / 20, np.log1p(lines) / 5, np.log1p(len(words) / lines) / 5, np.sqrt(distinct) / 30]


class Machine:
    """The model, and features by word with a memo per worker."""

    def __init__(self, rank: int = RANK, seed: int = 7):
        size = DIMS + N_STATS
        self.bias = 0.0
        self.w = np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, rank)).astype(np.float32)
        self.mean, self.scale = np.zeros(N_STATS), np.ones(N_STATS)

    def __getstate__(self):
        return {k: x for k, x in self.__dict__.items() if not k.startswith("_")}

    def inputs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word slots, their values, the text of each, and the statistics of each text."""
        memo = self.__dict__.setdefault("_memo", {})
        cols, sizes, stats = [], [], []
        for text in texts:
            text = text or ""
            words = text.lower().split()
            distinct = set(words)
            if len(memo) + len(distinct) > CACHE:
                memo.clear()
            for word in distinct.difference(memo):
                memo[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % DIMS
            cols.append(np.array([memo[x] for x in distinct], np.int64))
            sizes.append(len(distinct))
            stats.append(statistics(text, words, len(distinct)))
        sizes = np.array(sizes, np.int64)
        own = np.repeat(np.arange(len(texts)), sizes)
        col = np.concatenate(cols) if cols else np.zeros(0, np.int64)
        order = np.lexsort((col, own))  # a fixed order of sums
        value = 1 / np.sqrt(np.maximum(1, sizes))[own]
        return col[order], value[order], own, np.array(stats, np.float64).reshape(-1, N_STATS)

    def _sums(self, col, value, own, stats):
        n = len(stats)
        x = np.clip((stats - self.mean) / self.scale, -4, 4)
        ws, vs = self.w[DIMS:], self.v[DIMS:]
        linear = np.bincount(own, self.w[col] * value, n) + x @ ws
        total, square = x @ vs, (x * x) @ (vs * vs)
        if len(col):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            vx = self.v[col] * value[:, None]
            total[own[starts]] += np.add.reduceat(vx, starts, axis=0)
            square[own[starts]] += np.add.reduceat(vx * vx, starts, axis=0)
        return x, linear, total, square

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        _, linear, total, square = self._sums(*self.inputs(texts))
        z = self.bias + linear + 0.5 * (total * total - square).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def constant(self, share: float) -> Machine:
        share = min(max(share, 1e-6), 1 - 1e-6)
        self.bias, self.w[:], self.v[:] = float(np.log(share / (1 - share))), 0, 0
        return self

    def fit(self, texts: list[str], labels: np.ndarray, weights: np.ndarray, rounds: int = 12,
            batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> Machine:
        base = float(np.average(labels, weights=weights)) if len(labels) else 0.5
        base = min(max(base, 1e-6), 1 - 1e-6)
        self.bias = float(np.log(base / (1 - base)))
        if len(labels) == 0 or labels.min() == labels.max():
            return self.constant(base)
        col, value, own, stats = self.inputs(texts)
        # words of fewer than LEAST_TEXTS texts say nothing about others and stay out
        known = np.bincount(col, minlength=DIMS) >= LEAST_TEXTS
        self.v[:DIMS][~known] = 0
        use = known[col]
        col, value, own = col[use], value[use], own[use]
        self.mean, self.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-3
        ends = np.searchsorted(own, np.arange(len(texts) + 1))
        seen = [np.zeros_like(self.w), np.zeros_like(self.v)]  # squared gradients
        rng = np.random.default_rng(seed)
        size = DIMS + N_STATS
        for _ in range(max(rounds, -(-300 * batch // len(texts)))):  # few texts: more rounds
            for rows in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
                at = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in rows])
                who = np.repeat(np.arange(len(rows)), ends[rows + 1] - ends[rows])
                c, val = col[at], value[at]
                x, linear, total, square = self._sums(c, val, who, stats[rows])
                z = self.bias + linear + 0.5 * (total * total - square).sum(axis=1)
                err = weights[rows] * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[rows]) / len(rows)
                slots, place = np.unique(c, return_inverse=True)
                gw = np.bincount(place, err[who] * val, len(slots))
                gv = np.zeros((len(slots), self.v.shape[1]))
                part = (err[who] * val)[:, None] * (total[who] - self.v[c] * val[:, None])
                for f in range(gv.shape[1]):
                    gv[:, f] = np.bincount(place, part[:, f], len(slots))
                sw = x.T @ err
                sv = x.T @ (err[:, None] * total) - (x * x).T @ err[:, None] * self.v[DIMS:]
                idx = np.r_[slots, np.arange(DIMS, size)]
                for k, (table, grad) in enumerate(((self.w, np.r_[gw, sw]), (self.v, np.vstack([gv, sv])))):
                    grad = grad + decay * table[idx]
                    seen[k][idx] += grad * grad
                    table[idx] -= rate * grad / (np.sqrt(seen[k][idx]) + 1e-6)
                self.bias -= rate * float(err.sum())
        return self


def train(docs: DataFrame, labels: DataFrame, usable, label_col: str = "quality", **options) -> Machine:
    from sheaf.llm.labelled import sample

    rows, weight, share = sample(docs, labels, label_col, usable)
    y = rows["label"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return Machine().constant(share)
    return Machine().fit(rows["text"].tolist(), y, np.array([weight[int(c)] for c in y]), **options)


def score_quality(docs: DataFrame, model: Machine, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold). The
    model is broadcast: its size is fixed."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            done = batch.str.len().fillna(0).cumsum().to_numpy() // TEXT_CHARS
            cuts = np.flatnonzero(np.r_[True, done[1:] != done[:-1], True])
            parts = [shared.value.score(batch.iloc[a:b].where(batch.iloc[a:b].notna(), None).tolist())
                     for a, b in zip(cuts, cuts[1:])]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return (docs.withColumn("score", score(F.col(text_col).cast("string")))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
