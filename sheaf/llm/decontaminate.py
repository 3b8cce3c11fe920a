"""Operator 2, benchmark decontamination: BM25 retrieval with block-max WAND, then checks
of question and answer overlap.

The test items are indexed: per term the items that hold it with their BM25 impacts, in
blocks of ``BLOCK`` items, and the highest impact in each block and in the whole list.
Every passage of every training text is a query. Retrieval returns all items whose BM25
score reaches the item's threshold; impacts are divided by that threshold when the index
is built, so the bar is 1 for each item. As in block-max WAND, a passage is dropped when
the sum of its terms' list maxima is below the bar, a block is skipped when the sum of the
block maxima is, and only items of the blocks left are scored. The sums are made for all
passages of a batch at once; no candidate is dropped by a cap.

The threshold of an item loses nothing that the checks could accept: with at least
``overlap`` of the five-word shingles of question and of answer present, only so many
words can lack, so the score is at least the item's own score less its heaviest terms of
that number.

A passage is two strides, one stride apart. A stride is the most words an item of the
length class can have, whatever items are in the part, and one for each shingle that may
lack: a copy lies whole in one passage if it is no longer than that with the words put in. Items are indexed
by length class, so a long item does not widen the passages of short ones. The checks: at least ``overlap`` of the distinct
five-word shingles of the item's question are in the passage, and of its answer as well.
The answer is what follows the mark "answer:" or "a:" in an item that opens with "question:"
or "q:"; other items, of one line or more, are plain prose and checked as a whole, as
question. Parts of fewer than five words are one shingle.

Defined cases: null or empty texts match nothing; null, empty or wordless items are not
indexed; repeated items are reported each under its id, and repeated rows of a document
once; words are runs of letters, digits and underscores, lower-cased; extra columns are
ignored; empty tables give no rows. The index is broadcast in parts of about
``PART_WORDS`` words, each with its own pass over the documents, whatever the number of
items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import bounded_batches

WORD = re.compile(r"\w+")
MARKED = re.compile(r"\s*((?:question|q)\s*:.*?)\b((?:answer|a)\s*:.*)", re.I | re.S)
SHINGLE = 5
BLOCK = 8
PART_WORDS = 1 << 16
TEXT_CHARS = 1 << 21    # characters of text scanned at a time
K1, B = 1.2, 0.75


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_answer(text: str) -> tuple[str, str]:
    """An item's question and answer; the answer is empty when the item has no mark for it."""
    marked = MARKED.fullmatch(text)
    return (marked[1], marked[2]) if marked else (text, "")


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def length_class(n_words: int) -> int:
    return max(6, n_words.bit_length()) // 2


def stride_of(length: int, overlap: float) -> int:
    """The longest item of a length class, and a word put in for each shingle that may lack."""
    longest = (1 << 2 * length + 1) - 1
    return longest + int((1 - overlap) * (longest - SHINGLE + 1) + 1e-9)


class Index:
    """Inverted index over items of one length class. ``frequency`` and ``n_items`` and
    ``mean_length`` are those of the whole benchmark."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], n_items: int,
                 mean_length: float, overlap: float):
        parts = []
        for item, text in items:
            q, a = (words_of(x) for x in question_answer(text))
            q, a = (q, a) if q else (a, q)
            parts.append((item, q, a))
        parts.sort(key=lambda p: (len(p[1]) + len(p[2]), p[0]))  # alike lengths share a block
        self.items = [p[0] for p in parts]
        self.checks = [(shingles(q), shingles(a)) for _, q, a in parts]
        self.stride = stride_of(max(length_class(len(q) + len(a)) for _, q, a in parts), overlap)
        self.overlap = overlap
        self.terms: dict[str, int] = {}
        rows, cols, impacts = [], [], []
        for col, (_, q, a) in enumerate(parts):
            words = q + a
            weight = {}
            for w in set(words):
                tf, df = words.count(w), frequency[w]
                idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
                weight[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length))
            lacking = sum(int((1 - overlap) * max(1, len(x) - SHINGLE + 1) + 1e-9) for x in (q, a) if x)
            heavy = sorted(weight.values(), reverse=True)
            bar = max(sum(heavy[lacking:]), 1e-9)
            for w, x in weight.items():
                rows.append(self.terms.setdefault(w, len(self.terms)))
                cols.append(col)
                impacts.append(x / bar)
        n_blocks = -(-len(parts) // BLOCK)
        self.impact = [{} for _ in range(n_blocks)]  # per block: term -> impacts of its items
        self.block_max = np.zeros((len(self.terms), n_blocks), np.float32)
        for t, c, x in zip(rows, cols, impacts):
            b = c // BLOCK
            self.impact[b].setdefault(t, np.zeros(BLOCK, np.float64))[c % BLOCK] = x
            # rounded up, so that the bounds stay bounds
            self.block_max[t, b] = max(self.block_max[t, b], np.nextafter(np.float32(x), np.float32(np.inf)))
        self.list_max = self.block_max.max(axis=1).astype(np.float64)

    def retrieve(self, ids: np.ndarray, passage: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, item column, score) of all pairs that reach the bar. ``ids`` are
        term numbers, -1 for other words; a word in two passages comes twice."""
        known = ids >= 0
        if not known.any():
            return []
        n_terms = len(self.terms)
        pairs = np.unique(passage[known].astype(np.int64) * n_terms + ids[known])
        own, term = pairs // n_terms, pairs % n_terms
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        size = np.diff(np.r_[starts, len(own)])
        slack = 1e-4  # of the bar, for the order of floating-point sums
        hope = np.add.reduceat(self.list_max[term], starts) >= 1 - slack
        keep = np.repeat(hope, size)
        own, term = own[keep], term[keep]
        if not len(own):
            return []
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ends = np.r_[starts[1:], len(own)]
        out = []
        group = 1 << 14
        for k in range(0, len(starts), group):  # bounded memory for the block sums
            lo, hi = starts[k], ends[min(k + group, len(starts)) - 1]
            bound = np.add.reduceat(self.block_max[term[lo:hi]], starts[k:k + group] - lo, axis=0)
            for r, b in zip(*np.nonzero(bound >= 1 - slack)):
                block, score = self.impact[b], np.zeros(BLOCK)
                for t in term[starts[k + r]:ends[k + r]].tolist():
                    if t in block:
                        score += block[t]
                for c in np.flatnonzero(score >= 1 - slack):
                    out.append((int(own[starts[k + r]]), int(b * BLOCK + c), float(score[c])))
        return out

    def verify(self, column: int, words: list[str]) -> tuple[float, float] | None:
        """Question and answer overlap, when both reach ``overlap``."""
        q, a = self.checks[column]
        size = {len(s) for s in (*q, *a)}
        seen = {tuple(words[i:i + n]) for n in size for i in range(len(words) - n + 1)}
        got = tuple(len(x & seen) / len(x) if x else 1.0 for x in (q, a))
        return got if min(got) >= self.overlap else None


def scan(index: Index, texts: list[list[str]]) -> Iterator[tuple[int, int, float, float, float]]:
    """(text number, item id, score, question overlap, answer overlap), the best passage
    of each pair."""
    lookup = index.terms.get
    stride = index.stride
    ids = np.array([lookup(w, -1) for words in texts for w in words], np.int64)
    sizes = np.array([len(w) for w in texts], np.int64)
    firsts = np.cumsum(sizes) - sizes
    passages = np.maximum(1, -(-sizes // stride) - 1)  # the last two strides are one passage
    passage0 = np.cumsum(passages) - passages
    own = np.repeat(np.arange(len(texts)), sizes)
    stretch = (np.arange(len(ids)) - firsts[own]) // stride
    first = passage0[own] + np.minimum(stretch, passages[own] - 1)
    again = (stretch > 0) & (stretch < passages[own])  # words in the second half of the passage before
    best: dict[tuple[int, int], tuple] = {}
    for p, column, score in index.retrieve(np.r_[ids, ids[again]], np.r_[first, first[again] - 1]):
        text = int(np.searchsorted(passage0, p, side="right")) - 1
        at = (p - int(passage0[text])) * stride
        got = index.verify(column, texts[text][at:at + 2 * stride])
        if got:
            key = (text, index.items[column])
            best[key] = max(best.get(key, (-1.0,)), (sum(got), score, *got))
    for (text, item), (_, score, q, a) in sorted(best.items()):
        yield text, item, score, q, a


def build(benchmark: DataFrame, overlap: float, item_col: str, text_col: str) -> list[list[Index]]:
    """Indexes in parts of bounded size; the words of a part are what is collected."""
    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(words_of)

    items = (benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
             .where("text IS NOT NULL").distinct().withColumn("words", words("text")).where("size(words) > 0"))
    total = items.agg(F.count("*"), F.sum(F.size("words"))).first()
    if not total[0]:
        return []
    n_parts = -(-total[1] // PART_WORDS)
    items = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n_parts)))
    terms = items.select("part", F.explode(F.array_distinct("words")).alias("term"))
    frequency = terms.groupBy("term").agg(F.count("*").alias("df"))
    parts = []
    for part in range(n_parts):
        rows = items.where(F.col("part") == part).select("item", "text", "words").collect()
        held = terms.where(F.col("part") == part).select("term").distinct()
        df = {r[0]: r[1] for r in frequency.join(held, "term").collect()}
        by_class: dict[int, list] = {}
        for item, text, w in rows:
            by_class.setdefault(length_class(len(w)), []).append((item, text))
        parts.append([Index(x, df, total[0], total[1] / total[0], overlap) for _, x in sorted(by_class.items())])
    return parts


def contaminated(docs: DataFrame, benchmark: DataFrame, overlap: float = 0.8, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 id_type: str = "long") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): every document that
    holds a test item, once per item, with its best passage. ``score`` is the BM25 score
    in units of the item's threshold; ``doc_id`` is of ``id_type``."""
    schema = f"doc_id {id_type}, item_id long, score double, question_overlap double, answer_overlap double"
    spark = docs.sparkSession
    bounded_batches(spark)
    found = []
    for part in build(benchmark, overlap, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(part)

        def look(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                done = batch["text"].str.len().cumsum().to_numpy() // TEXT_CHARS
                for lo in np.flatnonzero(np.r_[len(done) > 0, done[1:] != done[:-1]]):  # a few texts at a time
                    few = batch.iloc[lo:int(np.searchsorted(done, done[lo], side="right"))]
                    texts, ids = [words_of(t) for t in few["text"]], few["doc_id"].tolist()
                    rows = [(ids[t], *rest) for index in shared.value for t, *rest in scan(index, texts)]
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found.append(docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                     .where("text IS NOT NULL").mapInPandas(look, schema))
    if not found:
        return spark.createDataFrame([], schema)
    rows = reduce(DataFrame.unionByName, found)
    return (rows.groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("question_overlap", "answer_overlap", "score")).alias("b"))
            .select("doc_id", "item_id", "b.score", "b.question_overlap", "b.answer_overlap"))
