"""Operator 9, license scans (native): MinHash bands retrieve templates for overlapping
text windows, then exact shingle containment verifies them.

Texts are cut into windows of two strides of ``STRIDE`` words, one stride apart, so any
template of at most ``STRIDE`` words, and any single shingle, lies whole in one window.
Windows and templates are sets of five-word shingles; the shingles of longer templates are
cut into pieces of ``STRIDE``. A band is one MinHash value; a window and a piece are
candidates if any band agrees.

Windows are far larger than short pieces, so the chance that a band agrees is small and
the number of bands is set from it: a piece of t shingles wholly inside a window of n
agrees in one band with probability t/n or more, and one with a single shingle in it with
1/(n + t - 1); ``bands_for`` gives the number of bands that misses with probability
``MISS`` at most. All bands are not computed for all windows:
band j can only agree if the window holds the very shingle that is the piece's minimum in
band j, so windows without any such shingle (by a bitmap of their hashes, which may keep a few
others) are dropped first, with the same candidates.

Candidates are verified exactly, on shingle strings: at least ``containment`` of the
distinct shingles of the template must be in one passage of the text, that is, where no
more than ``REACH`` words part one of its shingles from the next. Pieces only retrieve: no
share is asked of a piece. Templates of fewer than five words are one shingle of their own
length.

All steps are DataFrame functions; the template side is a list given by the caller. It is
looked for in as many passes over the texts as it has ``PASS_PIECES`` pieces, so what is
broadcast at a time is bounded, whatever the number of templates.

Defined cases: null and empty texts match nothing; words are runs of letters and digits,
lower-cased; null, empty or wordless templates are skipped; two templates of one text are
both reported; repeated rows of a document count once; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import materialize

SHINGLE = 5
STRIDE = 16
MISS = 1e-9
REACH = 256         # words between two shingles of one copy at most
PASS_PIECES = 512   # pieces of templates in one pass over the texts


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hash_at(w: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(w, i + j) for j in range(size)])


def bands_for(window: int, size: int, others: int = 0) -> int:
    """Bands at which one shingle of a piece inside a full window is missed with
    probability ``MISS`` at most; ``others`` are the piece's shingles outside it."""
    most = max(1, window - size + 1) + others
    return 1 if most == 1 else math.ceil(math.log(MISS) / math.log(1 - 1 / most))


def _pieces(templates: DataFrame, stride: int) -> DataFrame:
    """(name, piece, size, whole, shingles): each template's shingles in pieces of
    ``stride``, so that those across cuts are in a piece too; a template of at most
    ``stride`` words is one piece and ``whole``."""
    w = templates.select("name", words("text").alias("w")).where("size(w) > 0").distinct()
    w = w.withColumn("size", F.least(F.lit(SHINGLE), F.size("w"))).withColumn("whole", F.size("w") <= stride)
    p = w.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - F.col("size")) / stride).cast("int"))).alias("piece"))
    w = F.slice("w", F.col("piece") * stride + 1, F.lit(stride) + F.col("size") - 1)
    each = F.transform(F.array(w), lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - F.col("size")),
                       lambda i: F.array_join(F.slice(x, i + 1, F.col("size")), " ")))
    return p.select("name", "piece", "size", "whole", F.array_distinct(F.flatten(each)).alias("shingles"))


def _band_values(hashes: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                       lambda j: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, j))))


def _bitmap(hashes: list[int]) -> np.ndarray:
    """A bit per hash, in signed longs: 1,024 bits or more for each, 8 MB at most."""
    longs = min(1 << 20, max(1 << 13, 1 << (len(hashes) * 16).bit_length()))
    bits = np.zeros(longs, np.uint64)
    h = np.array(hashes, np.int64).view(np.uint64)
    np.bitwise_or.at(bits, (h >> np.uint64(6)) & np.uint64(longs - 1), np.uint64(1) << (h & np.uint64(63)))
    return bits.view(np.int64)


def _marked(h: Column, bits: np.ndarray) -> Column:
    word = F.get(F.lit(bits), F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(len(bits) - 1)).cast("int"))
    return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))) != 0


def _hits(docs: DataFrame, rows: list, id_col: str, text_col: str, stride: int) -> DataFrame:
    """(doc_id, text_hash, name, pos, hit) of the template shingles in windows that a band
    retrieves, for one pass's pieces."""
    spark = docs.sparkSession
    schema = "name string, piece int, size int, whole boolean, shingles array<string>"
    banded, seeds, bands = [], {}, {}
    for size in sorted({r["size"] for r in rows}):
        mine = spark.createDataFrame([tuple(r) for r in rows if r["size"] == size], schema)
        # of a longer template any single shingle in a window is to be found
        others = max((len(r["shingles"]) - 1 for r in rows if r["size"] == size and not r["whole"]), default=0)
        bands[size] = bands_for(2 * stride, size, others)
        mine = mine.withColumn("h", F.transform("shingles", lambda s: hash_at(F.split(s, " "), F.lit(0), size)))  # noqa: B023
        banded.append(mine.withColumn("v", _band_values(F.col("h"), bands[size])))
        # the shingle hashes that are the minimum in some band
        lowest = F.explode(F.filter("h", lambda h: F.exists(F.arrays_zip(
            F.sequence(F.lit(0), F.lit(bands[size] - 1)).alias("j"), F.col("v").alias("x")),  # noqa: B023
            lambda b: F.xxhash64(h, b["j"]) == b["x"])))
        seeds[size] = _bitmap([r[0] for r in banded[-1].select(lowest).distinct().collect()])
    key = reduce(DataFrame.unionByName, banded).select("name", "piece", "size", F.posexplode("v").alias("j", "x"))

    # One pass over the texts. Words and hashes are bound to lambda names, so that each is
    # made once for all that uses it.
    def hits(w: Column, size: int) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: hash_at(w, i, size))
        hashes = F.when(F.size(w) >= size, hashes).otherwise(F.expr("cast(array() as array<bigint>)"))
        last = F.greatest(F.lit(0), F.ceil(F.size(w) / stride).cast("int") - 2)
        part = lambda hs, k: F.slice(hs, k * stride + 1, 2 * stride - size + 1)

        def near(hs):
            """The windows around marked shingles."""
            at = F.filter(F.transform(hs, lambda h, i: F.when(_marked(h, seeds[size]), F.floor(i / stride).cast("int"))), lambda p: p.isNotNull())
            return F.array_distinct(F.flatten(F.transform(F.array_distinct(at), lambda p: F.array(
                F.least(p, last), F.greatest(p - 1, F.lit(0))))))

        bound = F.transform(F.array(hashes), lambda hs: F.transform(
            near(hs), lambda k: F.struct(F.lit(size).alias("size"), k.alias("k"), F.array_distinct(part(hs, k)).alias("h"),
                                         F.slice(w, k * stride + 1, 2 * stride).alias("w"))))
        return F.flatten(bound)

    found_windows = F.transform(F.array(words(F.col(text_col))), lambda w: F.concat(*[hits(w, n) for n in seeds]))
    windows = (docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.explode(F.flatten(found_windows)).alias("t"))
               .select("doc_id", "text_hash", "t.*"))
    signed = windows.select("doc_id", "text_hash", "size", "k", "w", F.posexplode(_band_values(F.col("h"), max(bands.values()))).alias("j", "x"))
    candidates = (signed.join(F.broadcast(key), ["size", "j", "x"])     # PASS_PIECES times the bands
                  .select("doc_id", "text_hash", "k", "w", "size", "name", "piece").distinct())
    seen = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("size")), lambda i: F.struct(
        (F.col("k") * stride + i).alias("pos"), F.array_join(F.slice(F.col("w"), i + 1, F.col("size")), " ").alias("hit")))
    fixed = spark.createDataFrame([tuple(r) for r in rows], schema)
    return (candidates.join(F.broadcast(fixed), ["name", "piece", "size"])
            .select("doc_id", "text_hash", "name", F.inline(F.filter(seen, lambda s: F.array_contains("shingles", s["hit"])))))


def scan(docs: DataFrame, templates: DataFrame, containment: float = 0.8, id_col: str = "doc_id",
         text_col: str = "text", stride: int = STRIDE) -> DataFrame:
    """(doc_id, name, containment, copies): the templates found in each document, the
    largest share of their shingles found in one passage, and the number of passages that
    hold enough. ``templates`` has name, text."""
    spark = docs.sparkSession
    pieces = _pieces(templates.select(F.col("name").cast("string"), F.col("text").cast("string")), stride)
    n_passes = -(-pieces.count() // PASS_PIECES)
    if not n_passes:
        return spark.createDataFrame([], "doc_id long, name string, containment double, copies long")
    pieces = materialize(pieces.withColumn("pass", F.pmod(F.xxhash64("name", "piece"), F.lit(n_passes))))
    found = []
    for k in range(n_passes):
        rows = pieces.where(F.col("pass") == k).drop("pass").collect()     # about PASS_PIECES
        if rows:
            hits = _hits(docs, rows, id_col, text_col, stride)
            found.append(materialize(hits) if n_passes > 1 else hits)
    # passages: a document's shingles of one template in order, cut where they are far apart
    in_order = Window.partitionBy("doc_id", "text_hash", "name").orderBy("pos")
    hits = reduce(DataFrame.unionByName, found).distinct()
    cut = F.coalesce(F.col("pos") - F.lag("pos").over(in_order) > REACH, F.lit(True)).cast("int")
    hits = hits.withColumn("_cut", cut).withColumn("place", F.sum("_cut").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    best = hits.groupBy("doc_id", "text_hash", "name", "place").agg(F.count_distinct("hit").alias("hits"))
    total = pieces.select("name", F.explode("shingles").alias("s")).groupBy("name").agg(F.count_distinct("s").alias("total"))
    return (best.join(total, "name").where(F.col("hits") >= containment * F.col("total"))
            .groupBy("doc_id", "name")
            .agg(F.max(F.col("hits") / F.col("total")).alias("containment"),
                 F.count_distinct("text_hash", "place").alias("copies")))
