"""Operator 5, SimHash near-duplicates by bit-sliced comparison.

Texts get a 64-bit fingerprint. Equal fingerprints collapse into one class first, so a
group of exact copies, however large, is one row from there on. Two classes link at
``radius`` or fewer differing bits. Of ``radius + 2`` bit bands at least two agree for
any such pair, so every pair of bands is a key: linked classes share at least one key.

Classes of a key are compared with their fingerprints stored vertically: one 64-bit word
holds one bit position of 64 classes. A class is compared with 64 others at a time by
XOR, and the distances are counted in carry-save bitwise counters (ones, twos, more);
blocks in which every distance has passed the radius are abandoned. A key with more than
``BLOCK`` classes is cut into blocks and compared block against block, each pair of
blocks in its own group, so no group is larger than two blocks. Each group returns a
spanning forest of its links, never all pairs; components are joined up by star steps.

Defined cases: null and empty texts have no words and fingerprint zero, and link like any
other; repeated rows share their class; a text that is not valid UTF-8 is taken as bytes;
an empty table gives no rows; the result has the id and the two new columns only, so other
columns cannot clash. Rows with a null id get the component of their class; a component of
such rows alone has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import bounded_batches, materialize
from sheaf.llm.components import components

BLOCK = 4096        # classes in one side of a comparison
CHUNK = 1 << 16     # shingles whose bits are summed at a time


def fingerprint(data: bytes, words: int, seed: int = 42) -> int:
    """SimHash of whole text bytes: A-Z lower-cased, words between ASCII white space."""
    import xxhash

    parts = data.lower().split()
    if not parts:
        return 0
    text = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(parts) - words + 1)
    begin, end = starts[:n].tolist(), ends[min(words, len(parts)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    sums = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        hashes = np.array([digest(text[s:e], seed) for s, e in zip(begin[k:k + CHUNK], end[k:k + CHUNK])], np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    @F.pandas_udf("long")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            got = (fingerprint(b"" if t is None else bytes(t), words) for t in batch)
            yield pd.Series(np.fromiter(got, np.uint64, len(batch)).view(np.int64))

    bounded_batches(docs.sparkSession)
    return docs.withColumn("_fp", prints(F.col(text_col).cast("string").cast("binary")))


def bands(radius: int) -> list[list[int]]:
    """Bit masks of the keys: all but ``radius`` of ``radius + 2`` bands."""
    edges = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(pair) for pair in combinations(one, 2)]


def sliced_links(fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of rows in the same bucket whose fingerprints differ in at most
    ``radius`` bits. Rows come sorted by bucket."""
    n = len(fps)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[first, n])
    words = -(-size // 64)
    word0 = np.cumsum(words) - words
    own = np.repeat(np.arange(len(first)), size)
    place = np.arange(n) - first[own]
    word_of, slot = word0[own] + place // 64, (place % 64).astype(np.uint64)
    planes = np.zeros((64, int(words.sum())), np.uint64)
    used = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_or.at(used, word_of, np.uint64(1) << slot)
    for b in range(64):
        np.bitwise_or.at(planes[b], word_of, ((fps >> np.uint64(b)) & np.uint64(1)) << slot)
    row_at = np.full(int(words.sum()) * 64, -1, np.int64)
    row_at[word_of * 64 + slot.astype(np.int64)] = np.arange(n)
    left, right = [], []
    reps = words[own]
    step = max(1, (1 << 20) // int(reps.max())) if n else 1
    for k in range(0, n, step):
        rows = np.arange(k, min(n, k + step))
        r = reps[rows]
        row = np.repeat(rows, r)
        word = word0[own[row]] + np.arange(len(row)) - np.repeat(np.cumsum(r) - r, r)
        ones, twos, more = (np.zeros(len(row), np.uint64) for _ in range(3))
        for b in range(64):
            x = planes[b][word] ^ (np.uint64(0) - ((fps[row] >> np.uint64(b)) & np.uint64(1)))
            carry = ones & x
            ones ^= x
            more |= twos & carry
            twos ^= carry
            if radius < 3:
                more |= [ones | twos, twos, twos & ones][radius]
            if b % 8 == 7:  # abandon blocks that are out of reach everywhere
                alive = (~more & used[word]) != 0
                if not alive.all():
                    row, word, ones, twos, more = (v[alive] for v in (row, word, ones, twos, more))
        near = ~more & used[word]
        at = np.flatnonzero(near)
        bits = np.unpackbits(near[at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w, s = np.nonzero(bits)
        i, j = row[at[w]], row_at[word[at[w]] * 64 + s]
        left.append(i[i < j])
        right.append(j[i < j])
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each row the smallest row that its links reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(classes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all pairs
    at ``radius`` or fewer differing bits."""
    if not 0 <= radius <= 2:
        raise ValueError("the counters hold distances up to 2")
    masks = [m - (1 << 64) if m >> 63 else m for m in bands(radius)]
    keyed = classes.select("_fp", F.posexplode(F.array(
        *[F.col("_fp").bitwiseAND(F.lit(m)) for m in masks])).alias("_t", "_k"))
    # written out, as the label table below: the join then reads plain exchanges on both
    # sides and a key with very many rows can be split
    sizes = materialize(keyed.groupBy("_t", "_k").agg(F.count("*").alias("_n")).where("_n > 1"))
    rows = keyed.join(sizes, ["_t", "_k"]).withColumn("_m", F.ceil(F.col("_n") / BLOCK))
    rows = rows.withColumn("_p", F.pmod(F.xxhash64("_fp", "_t"), F.col("_m")))
    other = F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1)
    rows = rows.select("_fp", "_t", "_k", F.explode(F.transform(
        other, lambda q: F.struct(F.least("_p", q).alias("lo"), F.greatest("_p", q).alias("hi")))).alias("_b"))
    rows = rows.select("_fp", F.xxhash64("_t", "_k", "_b.lo", "_b.hi").alias("_g"), "_t", "_k",
                       F.col("_b.lo").alias("_lo"), F.col("_b.hi").alias("_hi"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0

        def done(frame: pd.DataFrame) -> pd.DataFrame:
            fps = frame["_fp"].to_numpy().view(np.uint64)
            cols = [frame[c].to_numpy() for c in ("_t", "_k", "_lo", "_hi")]
            cut = np.zeros(len(frame), np.int64)
            for c in cols:
                cut[1:] |= c[1:] != c[:-1]
            left, right = sliced_links(fps, np.cumsum(cut), radius)
            root = forest(len(fps), left, right)
            at = np.flatnonzero(root != np.arange(len(fps)))
            return pd.DataFrame({"a": fps[at].view(np.int64), "b": fps[root[at]].view(np.int64)})

        for batch in batches:  # sorted by group: cut where the group changes
            held.append(batch)
            count += len(batch)
            if count >= 4 * BLOCK:
                whole = pd.concat(held, ignore_index=True)
                g = whole["_g"].to_numpy()
                end = int(np.searchsorted(g, g[-1]))
                if end:
                    yield done(whole.iloc[:end])
                held, count = [whole.iloc[end:]], len(whole) - end
        if count:
            yield done(pd.concat(held, ignore_index=True))

    return (rows.repartition("_g").sortWithinPartitions("_g", "_t", "_k", "_lo", "_hi")
            .mapInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = 3, radius: int = 2) -> DataFrame:
    """Every row with its ``fingerprint`` (hex) and ``component_id``: the smallest id
    reachable over links of at most ``radius`` bits. Texts are read once, where the
    fingerprints are made; from there on rows are two numbers."""
    prints = materialize(with_fingerprints(docs.select(id_col, text_col), text_col, words).select(id_col, "_fp"))
    classes = prints.groupBy("_fp").agg(F.min(id_col).alias("_first"))
    joined = components(links(classes.select("_fp"), radius)).withColumnRenamed("node", "_fp")
    member = classes.join(joined, "_fp", "left").withColumn("component", F.coalesce("component", "_fp"))
    named = member.groupBy("component").agg(F.min("_first").alias("component_id"))
    label = materialize(member.join(named, "component").select("_fp", "component_id"))
    return (prints.join(label, "_fp")
            .select(id_col, F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id"))
