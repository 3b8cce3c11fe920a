"""Operator 13, source divergence audit by count-level bitmaps.

Each language keeps the terms of at least ``least`` of its documents. A source's smoothed
share of a term depends on its count alone, so two sources differ by the sum over joint
cells (count here, count there) of the cell's number of terms times the difference of the
two shares. Terms of a language are numbered into blocks of 64; a source has one bitmap
per block and count, and a cell is the popcount of two bitmaps' AND. Only counts above
zero have bitmaps: cells with a zero follow by complement from the number of terms that a
source has at each count and from the size of the vocabulary.

Texts are counted where they are read, by whole ranges of documents, and only sums of
counts are shuffled. Term numbers come from a sort in range slices, bitmaps of a block are
at most 64 bits per source and count, and pairs are summed in each task before they are
added up. All arithmetic is in integers.

Defined cases: null text, lang and source are empty strings; texts without terms still
name their group; whole texts are counted, repeated rows each time; terms compare by their
UTF-8 bytes; a language without kept terms has pairs of value 0 and no term rows; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import bounded_batches, materialize, range_slices

SCALE = 1_000_000_000   # shares are counted in parts of this
PRIOR = 5               # added to every count
HELD = 1 << 17          # distinct (group, term) counts that a task holds before it passes them on
STRETCH = 1 << 20       # bytes of a text that are split at a time
PAIRS = 1 << 18         # pairs of sources that a task sums before it passes them on
#: Bytes that belong to terms, with A-Z lower-cased; all others part them.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text, of very long ones a stretch at a time."""
    text = text.translate(LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + STRETCH)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, docs) of what the task reads, summed as far as it holds;
    a row without term names a group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                        ("count", pa.int64()), ("docs", pa.int64())])
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in counts.items():
            seen = docs[lang, source]
            names = [None, *terms]
            for k in range(0, len(names), 10_000):
                part = names[k:k + 10_000]
                yield pa.record_batch([
                    pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                    pa.array([t if t is None else t.decode() for t in part], pa.string()),
                    pa.array([0 if t is None else terms[t] for t in part], pa.int64()),
                    pa.array([0 if t is None else seen[t] for t in part], pa.int64())], schema=schema)
        counts.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*[c.to_pylist() for c in batch.columns]):
            here = counts[lang, source]
            before, seen = len(here), set()
            for terms in _terms(text):
                here.update(terms)
                seen.update(terms)
            docs[lang, source].update(seen)
            held += len(here) - before
            if held + len(counts) >= HELD:
                yield from told()
                held = 0
    yield from told()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)) in exact integers."""
    num = (count + F.lit(PRIOR)).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    den = total.cast("decimal(19,0)") + (terms * PRIOR).cast("decimal(18,0)")
    return F.lit(1) + F.call_function("div", num, den)


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over joint cells above zero of cell * (f - f(here, 0) - f(0, there) + f(0, 0)),
    per language and pair of sources (a < b). Rows come block by block."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])
    sums: dict[tuple[str, str, str], int] = defaultdict(int)

    def told() -> Iterator[pa.RecordBatch]:
        rows = list(sums.items())
        for k in range(0, len(rows), 10_000):
            part = rows[k:k + 10_000]
            yield pa.record_batch([*[pa.array([key[i] for key, _ in part], pa.string()) for i in range(3)],
                                   pa.array([v for _, v in part], pa.int64())], schema=schema)
        sums.clear()

    def block(lang: str, rows: list[tuple]) -> None:
        # one bitmap of 64 terms per source and count; rows are sorted by source
        bitmaps: dict[tuple[str, int], int] = defaultdict(int)
        zero: dict[str, int] = {}
        for source, bit, p, p0 in rows:
            bitmaps[source, p] |= 1 << bit
            zero[source] = p0
        names = sorted(zero)
        place = {s: k for k, s in enumerate(names)}
        keys = sorted(bitmaps, key=lambda key: place[key[0]])
        bits = np.array([bitmaps[k] for k in keys], np.uint64)
        p = np.array([k[1] for k in keys], np.int64)
        owner = np.array([place[k[0]] for k in keys], np.int64)
        p0 = np.array([zero[s] for s in names], np.int64)
        starts = np.searchsorted(owner, np.arange(len(names) + 1))
        for i, a in enumerate(names[:-1]):
            mine, rest = slice(starts[i], starts[i + 1]), slice(starts[i + 1], None)
            cells = np.bitwise_count(bits[mine, None] & bits[None, rest]).astype(np.int64)
            pa_, pb, zb = p[mine, None], p[None, rest], p0[owner[rest]][None, :]
            f = np.abs(pa_ - pb) - np.abs(pa_ - zb) - np.abs(p0[i] - pb) + np.abs(p0[i] - zb)
            each = np.add.reduceat((cells * f).sum(axis=0), starts[i + 1:-1] - starts[i + 1])
            for b, v in zip(names[i + 1:], each.tolist()):
                sums[lang, a, b] += v

    at, rows = None, []
    for batch in batches:
        for lang, slice_, number, source, bit, p, p0 in zip(*[c.to_pylist() for c in batch.columns]):
            if at != (lang, slice_, number):
                if rows:
                    block(at[0], rows)
                    rows = []
                if len(sums) >= PAIRS:
                    yield from told()
                at = (lang, slice_, number)
            rows.append((source, bit, p, p0))
    if rows:
        block(at[0], rows)
    yield from told()


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part ``pair`` ranks the other sources
    of the language by how far their term shares differ, part ``term`` the ``top`` terms
    that the source uses more than its language does."""
    bounded_batches(docs.sparkSession)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").cast("binary").alias("text"))
    counts = materialize(
        texts.mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")))
    kept = (counts.where("term IS NOT NULL").groupBy("lang", "term")
            .agg(F.sum("count").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"))
    # frequent terms together: blocks of rare terms have few distinct counts
    sliced = range_slices(kept.withColumn("rare", -F.col("all")), ["lang", "rare", "term"])
    place = F.row_number().over(Window.partitionBy("_slice", "lang").orderBy("rare", "term")) - 1
    numbered = materialize(sliced.withColumn("place", place).select(
        "lang", "term", "all", F.col("_slice").alias("slice"), F.expr("place div 64").alias("block"), (F.col("place") % 64).alias("bit")))
    used = materialize(counts.where("term IS NOT NULL").drop("docs").join(numbered, ["lang", "term"]))

    sizes = numbered.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
    totals = used.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = (counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
              .select("lang", "source", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")]))
    p0 = share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))
    groups = materialize(groups.withColumn("p0", F.when(F.col("terms") > 0, p0)))
    shared = materialize(used.join(groups, ["lang", "source"])
                         .withColumn("p", share(F.col("count"), F.col("total"), F.col("terms"))))

    # part term
    q = share(F.col("all"), F.col("lang_total"), F.col("terms"))
    order = [F.col("value").desc(), F.col("item").asc()]
    terms = (shared.select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value")).where("value > 0")
             .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
             .where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))

    # part pair: joint cells from bitmaps, cells with a zero from the number of terms at each count
    blocks = (shared.select("lang", "slice", "block", "source", "bit", "p", "p0")
              .repartition("lang", "slice", "block").sortWithinPartitions("lang", "slice", "block", "source"))
    joint = blocks.mapInArrow(_joint, "lang string, a string, b string, value long")
    joint = joint.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    joint = joint.unionByName(joint.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    levels = shared.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("z"))
    # sum over the counts of a of n * (f(count, 0) - f(0, 0)), for both directions
    ends = (levels.select("lang", F.col("source").alias("a"), "p", "p0", "n").join(other, "lang").where("a <> b")
            .groupBy("lang", "a", "b").agg(F.sum(F.col("n") * (F.abs(F.col("p") - F.col("z")) - F.abs(F.col("p0") - F.col("z")))).alias("value")))
    ends = ends.unionByName(ends.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    empty = (groups.select("lang", F.col("source").alias("a"), "p0", "terms").join(other, "lang").where("a <> b")
             .select("lang", "a", "b", F.coalesce(F.col("terms") * F.abs(F.col("p0") - F.col("z")), F.lit(0)).alias("value")))
    pairs = (empty.unionByName(ends).unionByName(joint).groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item"))
             .agg(F.sum("value").alias("value"))
             .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"))
    return pairs.unionByName(terms)
