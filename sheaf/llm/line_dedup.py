"""Operator 3, line dedup by a distributed suffix array over line ids.

Every non-blank line is one symbol; texts are sequences of symbols. Lines that occur once
cannot be part of a repeat and cut the sequences. Suffixes are ranked by prefix doubling:
after round k, ``rank`` orders the suffixes by their first 2^k lines, and equal ranks mean
equal prefixes; only suffixes whose prefix occurs again go on to the next round. Suffixes
that share their first m lines are the members of one interval of the suffix array with
longest common prefix m or more; it is named by the ranks of the two overlapping blocks of
2^floor(log2 m) lines that make up those m lines.

A run of lines in one document is a repeat if it has at least ``min_words`` words and the
same lines also occur earlier (order: document id, then place). Every line that some
repeat covers is deleted, so of each maximal repeated run the first copy stays. It is
enough to look up the shortest runs of ``min_words`` words that start, or end, at each
line: any longer repeat is a union of those, and a line in it lies in one of them. So each
line asks for two intervals, however many copies there are, doubling stops at the longest
such run, and the overlapping deletions are merged into maximal spans.

Defined cases: a null or blank text has no lines; lines are compared without white space
at their ends, and blank lines are skipped in matching; a blank line goes if the lines
before and after it go in one span; documents that lose nothing keep their text to the
byte; texts of any length are taken whole; rows that repeat id and text count as one document and are edited alike; a null id
sorts first; other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import materialize, ordered_ids

MIN_WORDS = 50
BLANKS = " \t\r\x0b\x0c"
DOC = ["_d", "_h"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return (docs.withColumn("_d", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))
            .withColumn("_h", F.xxhash64(F.col(text_col))))


def symbols(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each non-blank line: document, place among its non-blank lines
    (``_pos``) and among all lines (``_line``), words, and a 128-bit line id."""
    cut = F.transform(F.split(F.col(text_col), "\n", -1),
                      lambda x, i: F.struct(F.trim(x, F.lit(BLANKS)).alias("x"), i.alias("i")))
    lines = (_keyed(docs, id_col, text_col)
             .select(*DOC, F.posexplode(F.filter(cut, lambda s: s["x"] != "")).alias("_pos", "_s")))
    return lines.select(*DOC, "_pos", F.col("_s.i").alias("_line"),
                        F.regexp_count("_s.x", F.lit(r"[^ \t\n\x0B\f\r]+")).alias("_words"),
                        F.xxhash64("_s.x").alias("_l1"), F.xxhash64("_s.x", F.lit(1)).alias("_l2"))


def distinct_symbols(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The symbols of each distinct document. Rows that repeat id and text, however many,
    collapse before their lines meet; only they are shuffled for it."""
    keyed = _keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    again = materialize(keyed.groupBy(*DOC).agg(F.count("*").alias("_n")).where("_n > 1").select(*DOC))
    if again.isEmpty():
        return symbols(docs, id_col, text_col)
    once = symbols(keyed.join(again, DOC, "left_anti"), "_id", "_text")
    return once.unionByName(symbols(keyed.join(again, DOC, "left_semi"), "_id", "_text").dropDuplicates([*DOC, "_pos"]))


def doubled(ranks: DataFrame, step: int) -> DataFrame:
    """One round of prefix doubling: ranks over ``step`` lines -> ranks over twice as
    many, for the suffixes whose doubled prefix occurs more than once."""
    after = ranks.select(*DOC, (F.col("_pos") - step).alias("_pos"), F.col("_rank").alias("_next"))
    pairs = ranks.join(after, [*DOC, "_pos"])
    names = pairs.groupBy("_rank", "_next").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    named = ordered_ids(names, ["_rank", "_next"], "_name")
    return materialize(pairs.join(named, ["_rank", "_next"]).select(*DOC, "_pos", F.col("_name").alias("_rank")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """Maximal spans of later copies: document (``_d``, ``_h``), first and last line
    number (0-based, inclusive), the non-blank lines in it, and the document of the first
    copy of the run that opens the span."""
    lines = materialize(distinct_symbols(docs, id_col, text_col))
    names = lines.groupBy("_l1", "_l2").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    known = lines.join(ordered_ids(names, ["_l1", "_l2"], "_rank"), ["_l1", "_l2"]).drop("_l1", "_l2")

    by_place = Window.partitionBy(*DOC).orderBy("_pos")
    island = Window.partitionBy(*DOC, "_island").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("_prev", F.lag("_pos").over(by_place))
    known = known.withColumn("_island", F.sum(F.when(F.col("_prev") == F.col("_pos") - 1, 0).otherwise(1)).over(
        by_place.rowsBetween(Window.unboundedPreceding, 0)))
    known = known.withColumn("_to", F.sum("_words").over(island)).withColumn("_from", F.col("_to") - F.col("_words"))
    # every line has a word, so a frame of min_words words has at most that many lines
    ahead = Window.partitionBy(*DOC, "_island").orderBy("_from").rangeBetween(0, min_words - 1)
    back = Window.partitionBy(*DOC, "_island").orderBy("_to").rangeBetween(-(min_words - 1), 0)
    known = materialize(known.select(
        *DOC, "_pos", "_line", "_rank",
        F.struct(F.col("_pos").alias("start"), F.max("_pos").over(ahead).alias("end"),
                 F.col("_line").alias("first"), F.max("_line").over(ahead).alias("last"),
                 (F.max("_to").over(ahead) - F.col("_from")).alias("words")).alias("_ahead"),
        F.struct(F.min("_pos").over(back).alias("start"), F.col("_pos").alias("end"),
                 F.min("_line").over(back).alias("first"), F.col("_line").alias("last"),
                 (F.col("_to") - F.min("_from").over(back)).alias("words")).alias("_back")))

    runs = (known.select(*DOC, F.explode(F.array("_ahead", "_back")).alias("r"))
            .where(F.col("r.words") >= min_words)
            .select(*DOC, "r.start", "r.end", "r.first", "r.last").distinct()
            .withColumn("_m", F.col("end") - F.col("start") + 1)
            .withColumn("_level", F.length(F.bin("_m")) - 1)
            .withColumn("_second", F.expr("end + 1 - shiftleft(1, _level)").cast("int")))
    runs = materialize(runs)
    top = runs.agg(F.max("_level")).first()[0]
    ranks = known.select(*DOC, "_pos", "_rank")
    levels = ranks.withColumn("_level", F.lit(0))
    for k in range(top or 0):
        ranks = doubled(ranks, 1 << k)
        levels = levels.unionByName(ranks.withColumn("_level", F.lit(k + 1)))

    at = lambda place, name: levels.select(
        *DOC, "_level", F.col("_pos").alias(place), F.col("_rank").alias(name))
    named = (runs.join(at("start", "_ra"), [*DOC, "_level", "start"])
             .join(at("_second", "_rb"), [*DOC, "_level", "_second"]))
    interval = ["_m", "_ra", "_rb"]
    # written out, so that the join below reads both sides from plain exchanges and a run
    # with very many copies can be split
    named = materialize(named)
    firsts = materialize(named.groupBy(*interval)
                         .agg(F.min(F.struct("_d", "_h", "start")).alias("_f"), F.count("*").alias("_n"))
                         .where("_n > 1").drop("_n"))
    copies = (named.join(firsts, interval)
              .where(F.struct("_d", "_h", "start") != F.col("_f")))

    w = Window.partitionBy(*DOC).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") <= F.col("_reach") + 1, 0).otherwise(1)
    return (copies.withColumn("_reach", reach)
            .withColumn("_span", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*DOC, "_span")
            .agg(F.min("first").alias("first"), F.max("last").alias("last"),
                 (F.max("end") - F.min("start") + 1).alias("lines"),
                 F.min_by("_f._d", F.struct("start", "end")).alias("copy_of"))
            .drop("_span"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated runs deleted from the text, and
    ``lines_removed`` and ``spans_removed``."""
    docs = docs.drop("lines_removed", "spans_removed")
    spans = (repeated_spans(docs, id_col, text_col, min_words).groupBy(*DOC)
             .agg(F.collect_list(F.struct("first", "last")).alias("_spans"),
                  F.sum("lines").cast("long").alias("lines_removed")))
    gone = F.flatten(F.transform("_spans", lambda s: F.sequence(s["first"], s["last"])))
    # the lines are bound to a lambda name, so that a text is split once
    edited = F.get(F.transform(F.array(F.split(F.col(text_col), "\n", -1)), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n")), 0)
    return (_keyed(docs, id_col, text_col).join(spans, DOC, "left")
            .withColumn(text_col, F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(edited))
            .withColumn("spans_removed", F.coalesce(F.size("_spans"), F.lit(0)).cast("long"))
            .withColumn("spans_removed", F.greatest("spans_removed", F.lit(0).cast("long")))
            .withColumn("lines_removed", F.coalesce("lines_removed", F.lit(0).cast("long")))
            .drop(*DOC, "_spans"))
