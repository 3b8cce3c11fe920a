"""Operator 8, byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern and each piece is encoded on its own. The
vocabulary is an Aho-Corasick automaton over bytes mapped to Latin-1. One pass over a
piece gives the longest token that starts at each byte. Tokens are then laid from left to
right, the longest first. A token may follow another only if merging the two byte strings
would really end in this pair; that answer depends on the two tokens alone and is
remembered. Where no fit is left, the last token is taken back and its next shorter prefix
is tried, and positions that led nowhere are marked, so each is visited a bounded number
of times. The result is the merge order's own result without running any merge on the
text.

Two tokens a, b are compatible when no merge crosses their border earlier than the merges
that build them: going back through the halves from which a and b were built, the pair of
halves at the border must not be a token that would have been merged sooner.

Defined cases: null texts are empty; an empty text has no ids; whole texts of any length
are encoded piece by piece; special tokens are plain text; repeated rows and extra columns
pass through; a column named like an output is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import bounded_batches

CACHE = 1 << 18     # pieces, and pairs of tokens, that a worker remembers before it starts anew


class Vocabulary:
    """Ranks with the tables that encoding needs. Plain state is pickled; the automaton
    and the memos are made anew in each worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = {i: b for b, i in ranks.items()}
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token in sorted(ranks, key=ranks.get):
            if len(token) > 1 and (pair := self._last_merge(token)):
                self.halves[ranks[token]] = pair
                self.joined[pair] = ranks[token]
        self.shorter = {i: next((ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in ranks), None)
                        for b, i in ranks.items()}
        self._start()

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _start(self) -> None:
        self._fits: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, bytes] = {}
        self._matches = self._split = None

    def _ready(self) -> None:
        """What only encoding needs."""
        import ahocorasick
        import regex

        automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            automaton.add_word(token.decode("latin-1"), (i, len(token)))
        automaton.make_automaton()
        self._matches = automaton.iter
        self._split = regex.compile(self.pattern).findall

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one."""
        parts = [token[i:i + 1] for i in range(len(token))]
        limit = self.ranks[token]
        while len(parts) > 2:
            rank, i = min(((self.ranks.get(a + b, limit), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
            if rank >= limit:
                return None  # never reached by merges: it only stands for itself
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether merges leave token a directly before token b as they are."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) >= CACHE:
                self._fits.clear()
            known = self._fits[a, b] = self._undisturbed(a, b)
        return known

    def _undisturbed(self, a: int, b: int) -> bool:
        # a and b are undone merge by merge, the latest merge first. A border token of rank
        # r forms before a merge of rank m if r < m; at equal rank the left one is first.
        before = float("inf")
        while True:
            if self.joined.get((a, b), before) < before:
                return False
            undo_a = self.halves.get(a) if (a > b or b not in self.halves) else None
            if undo_a:
                before, a = a, undo_a[1]
            elif b in self.halves:
                # a border token that equals b starts left of b and is merged first
                before, b = b + 1, self.halves[b][0]
            else:
                return True

    def encode_piece(self, data: bytes) -> list[int]:
        if data in self.ranks:
            return [self.ranks[data]]
        if self._matches is None:
            self._ready()
        n = len(data)
        longest = [0] * n
        length = [0] * n
        for end, (i, size) in self._matches(data.decode("latin-1")):
            start = end - size + 1
            if size > length[start]:
                longest[start], length[start] = i, size
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token, shorter, tokens, fits = 0, longest[0], self.shorter, self.tokens, self.fits
        while at < n:
            while token is not None:
                end = at + len(tokens[token])
                if not dead[end] and (not out or fits(out[-1], token)):
                    break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at = end
                token = longest[at] if at < n else None
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(tokens[token])
        return out

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if self._split is None:
            self._ready()
        pieces = self._pieces
        out = []
        for piece in self._split(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = array("I", self.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
                if len(pieces) >= CACHE:
                    pieces.clear()
                if len(piece) <= 64:
                    pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return joined_tokens(self.tokens, ids)


def joined_tokens(tokens: dict[int, bytes], ids: bytes) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``ids`` (little-endian unsigned 32-bit integers, the
    layout of a token file) and ``n_tokens``. The vocabulary is broadcast: its size is
    fixed by its file."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("binary")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode_one = shared.value.encode
        for batch in texts:
            yield pd.Series([encode_one(t or "") for t in batch], dtype=object)

    rest = docs.drop(*[c for c in ("ids", "n_tokens") if c != text_col])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (rest.withColumn("ids", ids(text)).drop(*([text_col] if text_col != "ids" else []))
            .withColumn("n_tokens", F.expr("octet_length(ids) div 4").cast("long")))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that ``ids_col`` stands for; null ids are empty. Workers
    get the tokens alone, not the tables that encoding needs."""
    bounded_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.tokens)

    @F.pandas_udf("binary")
    def data(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = shared.value
        for batch in ids:
            yield pd.Series([joined_tokens(tokens, b"" if x is None else bytes(x)) for x in batch], dtype=object)

    return encoded.withColumn(out, data(F.col(ids_col)))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """``encode`` and then ``decode`` of its ids in one pass over the texts: ``docs`` without
    its text, with ``ids``, ``n_tokens`` and ``decoded``. One worker a task does both, so a
    task holds one vocabulary and ids travel once."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("ids binary, decoded binary")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = shared.value
        for batch in texts:
            ids = [words.encode(t or "") for t in batch]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([words.decode(x) for x in ids], dtype=object)})

    rest = docs.drop(*[c for c in ("ids", "n_tokens", "decoded", "_both") if c != text_col])
    told = rest.withColumn("_both", both(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kept = [c for c in rest.columns if c != text_col]
    return told.select(*[F.col(f"`{c}`") for c in kept], "_both.ids", F.expr("octet_length(_both.ids) div 4").cast("long").alias("n_tokens"), "_both.decoded")
