"""Operator 12, token ids as binary files with a shared zstandard dictionary.

``write_tokens`` encodes whole texts with the tokenizers library, ends each document with
an end id and writes the ids in ascending order of the document's id. The files:

* ``dictionary``: one zstandard dictionary, trained on the serialized ids of a bounded
  sample (``SAMPLE_DOCS`` documents of at most ``SAMPLE_CHARS`` characters, first by a hash
  of the id). Without enough samples it holds their plain bytes, or nothing.
* ``data/part-*.ids``: a header of 48 bytes (``SHEAFID1``, width of an id in bytes as a
  little-endian 32-bit integer, four zero bytes, SHA-256 of the dictionary), then one
  zstandard frame per document: its ids as little-endian unsigned integers of that width.
* ``index``: a Parquet table with a row per document: id, file, byte offset and size of the
  frame, number of ids, and ids of the file before it, in the order of the id.
* ``manifest``: a Parquet table with a row per file: documents, ids, and ids of all files
  before it.

A document is read by seeking to its frame (``read_tokens`` with ``only``). Tasks stream
sorted ranges and append to one file each under a name of its own attempt; the index, which
Spark commits, names the files that count, so files of failed attempts are never read.

Words, parted by ASCII white space and from marks that end them, are encoded once and
remembered: tokenizers of the kind ``BY_WORD`` part words there themselves, so the ids of a
text are those of its words in order. Other tokenizers get whole texts.

Defined cases: null texts are empty and have the end id alone; whole texts of any length;
null ids come first; documents that share an id follow in the order of the first 64
characters and a hash of their texts; identical rows stay apart; special tokens' strings
are plain text; extra columns are ignored; an empty table writes an empty index.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from contextlib import suppress
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.common import bounded_batches

SAMPLE_DOCS = 2048          # documents whose ids train the dictionary
SAMPLE_CHARS = 4096         # characters of a sampled text at most; longer texts are not sampled
DICTIONARY_BYTES = 1 << 15
REMEMBERED = 1 << 18        # words in each of the two generations that a worker remembers
STRETCH = 1 << 22           # bytes of texts that are split at a time
TOGETHER = 64               # new words encoded in one call
READ_BYTES = 8 << 20        # neighbouring frames that are read at once
TASK_BYTES = 128 << 20      # compressed bytes that one reading task should get
END_MARKS = ".,;:!?"
PLAIN = "[0-9A-Za-zÀ-ÖØ-öø-į]"
LATIN = "\u0130"            # below it, every letter has one lower-case form and is composed already
# A normalizer and pre-tokenizer that part words at white space and before marks.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None}
MAGIC = b"SHEAFID1"
HEADER = "<8sII32s"
_BLANK = re.compile(r"[ \t\n\r\f\v]").search
_LOADED: dict[str, WordIds] = {}


class _Words:
    """Words and their ids in one table."""

    def __init__(self, kind: str):
        self.place: dict[str, int] = {"": 0}
        self.start, self.size, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, kind)

    def __len__(self) -> int:
        return len(self.place)

    def find(self, words: list[str]) -> np.ndarray:
        """The place of each word, -1 if it is not there."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def add(self, words: list[str], size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of new words, given the number of ids of each and all their ids in a row."""
        places = np.arange(len(self.size), len(self.size) + len(words))
        if words:
            self.place.update(zip(words, places.tolist()))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        return places

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of the words at ``places`` and their ids in a row."""
        size = self.size[places]
        ends = np.cumsum(size)
        return size, self.ids[np.repeat(self.start[places] - (ends - size), size) + np.arange(int(size.sum()))]


class WordIds:
    """Ids of texts, as bytes of ``width`` each. Where the tokenizer is one that treats
    words on their own (``BY_WORD``), each word is encoded once; else whole texts are."""

    def __init__(self, tokenizer_json: str):
        kind = json.loads(tokenizer_json)
        self.whole = _tokenizer(tokenizer_json)
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.by_word = all(kind.get(k) == v for k, v in BY_WORD.items()) and not kind["model"].get("dropout")
        # lower-cased letters below LATIN need none of the normalizer's other steps
        self.plain = _tokenizer(json.dumps(kind | {"normalizer": None}))
        # the digit 0 is a token of its own and so parts words that do not hold it
        zero = self._each(self.whole, ["0"])[0]
        self.by_word &= len(zero) == 1
        self.zero = zero[0]
        self.young, self.old = _Words(self.kind), _Words(self.kind)

    @classmethod
    def loaded(cls, tokenizer_json: str) -> WordIds:
        """One per worker, kept between tasks."""
        key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
        if key not in _LOADED:
            _LOADED[key] = cls(tokenizer_json)
        return _LOADED[key]

    def _each(self, tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, easy: list[str], hard: list[str]) -> tuple[np.ndarray, np.ndarray]:
        groups = [" 0 ".join([*easy[k:k + TOGETHER], ""])[:-1].lower() for k in range(0, len(easy), TOGETHER)]
        flat = np.concatenate([np.zeros(0, self.kind), *self._each(self.plain, groups)])
        marks = np.flatnonzero(flat == self.zero)
        if len(marks) != len(easy):
            raise ValueError("the tokenizer does not part words at white space")
        places = self.young.add(easy, np.diff(marks, prepend=-1) - 1, flat[flat != self.zero])
        each = self._each(self.whole, hard)
        return places, self.young.add(hard, np.array([len(x) for x in each], np.int64), np.concatenate([np.zeros(0, self.kind), *each]))

    def _known(self, words: list[str], hard: np.ndarray) -> np.ndarray:
        """Places in ``young`` of distinct words; ``hard`` marks those with a 0 or letters
        from LATIN on. ``young`` does not change its places meanwhile."""
        found = self.young.find(words)
        lost = np.flatnonzero(found < 0)
        if len(lost):
            names = [words[k] for k in lost.tolist()]
            kept = self.old.find(names)
            found[lost[kept >= 0]] = self.young.add([n for n, k in zip(names, kept.tolist()) if k >= 0], *self.old.take(kept[kept >= 0]))
            new = lost[kept < 0]
            for part in np.array_split(new, len(new) // REMEMBERED + 1):
                easy, odd = part[~hard[part]], part[hard[part]]
                found[easy], found[odd] = self._learn([words[k] for k in easy.tolist()], [words[k] for k in odd.tolist()])
        return found

    def _by_word(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts of bounded length together."""
        if len(self.young) >= REMEMBERED:
            self.young, self.old = _Words(self.kind), self.young
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten().dictionary_encode()
        distinct, at = flat.dictionary, flat.indices.to_numpy()
        # marks that end a word are tokens of their own behind a plain letter or digit
        core = pc.utf8_rtrim(distinct, END_MARKS)
        cut = pc.match_substring_regex(core, f"{PLAIN}$")
        core = pc.if_else(cut, core, distinct).dictionary_encode()
        tail = pc.if_else(cut, pc.replace_substring_regex(distinct, f"(?s)^.*{PLAIN}", ""), "").dictionary_encode()
        places = []
        for part in (core, tail):
            words = part.dictionary
            hard = pc.match_substring_regex(words, f"[0{LATIN}-\U0010ffff]").to_numpy(zero_copy_only=False)
            places.append(self._known(words.to_numpy(zero_copy_only=False).tolist(), hard)[part.indices.to_numpy()])
        # each word is two pieces of the table
        pieces = np.empty(2 * len(at), np.int64)
        pieces[0::2], pieces[1::2] = places[0][at], places[1][at]
        size, out = self.young.take(pieces)
        borders = np.concatenate([[0], np.cumsum(size)[1::2]])[lists.offsets.to_numpy()]
        return [out[a:b] for a, b in zip(borders[:-1], borders[1:])]

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; none is null."""
        if not self.by_word:
            return [x.tobytes() for t in texts.to_pylist() for x in self._each(self.whole, [t])]
        out: list[bytes] = []
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        while len(out) < len(texts):  # as many texts as a stretch holds, or one long one
            k = len(out)
            n = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + STRETCH, "right")) - k
            out += [x.tobytes() for x in self._by_word(texts.slice(k, n))] if n else [self._long(texts[k].as_py())]
        return out

    def _long(self, text: str) -> bytes:
        """A text cut at white space into stretches."""
        out, at = [], 0
        while at < len(text):
            cut = _BLANK(text, at + STRETCH) if len(text) - at > STRETCH else None
            end = cut.start() if cut else len(text)
            out.append(self._by_word(pa.array([text[at:end]]))[0].tobytes())
            at = end
        return b"".join(out)


def _tokenizer(tokenizer_json: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _store(folder: str):
    """The folder's file system, as tasks reach it, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def train_dictionary(docs: DataFrame, tokenizer_json: str, end_id: int, id_col: str, text_col: str) -> bytes:
    """From the ids of a bounded sample; see the module's text."""
    import zstandard

    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds.loaded(shared.value)
        end = np.array([end_id], ids.kind).tobytes()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([x + end for x in ids.encode_batch(batch.column(1))], pa.binary())], ["at", "ids"])

    sample = (docs.where(F.length(text_col).between(1, SAMPLE_CHARS))
              .select(F.xxhash64(F.col(id_col).cast("string"), text_col).alias("at"), F.col(text_col).cast("string").alias("text"))
              .orderBy("at", "text").limit(SAMPLE_DOCS).mapInArrow(serialized, "at long, ids binary"))
    arrays = [bytes(r["ids"]) for r in sorted(sample.collect(), key=lambda r: (r["at"], bytes(r["ids"])))]
    with suppress(zstandard.ZstdError):
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays, k=512, d=8).as_bytes()
    return b"".join(arrays)[:DICTIONARY_BYTES]  # too few arrays to train on


def write_tokens(docs: DataFrame, folder: str, tokenizer_json: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text") -> str:
    """Write ``docs`` as token files into the new folder ``folder`` of a store that all
    executors reach (a path or a URI that pyarrow knows)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder.rstrip("/")
    store, root = _store(folder)
    store.create_dir(f"{root}/data", recursive=True)
    data = train_dictionary(docs, tokenizer_json, end_id, id_col, text_col)
    with store.open_output_stream(f"{root}/dictionary") as f:
        f.write(data)
    shared = spark.sparkContext.broadcast((tokenizer_json, data))
    kind = docs.schema[id_col].dataType.simpleString()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tokenizer, raw = shared.value
        ids = WordIds.loaded(tokenizer)
        end = np.array([end_id], ids.kind).tobytes()
        pack = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(raw)).compress
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
        out, at, first = None, struct.calcsize(HEADER), 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    store, root = _store(folder)
                    out = store.open_output_stream(f"{root}/data/{name}")
                    out.write(struct.pack(HEADER, MAGIC, ids.width, 0, hashlib.sha256(raw).digest()))
                arrays = [x + end for x in ids.encode_batch(batch.column(1))]
                frames = [pack(x) for x in arrays]
                out.write(b"".join(frames))
                sizes = np.array([len(f) for f in frames], np.int64)
                tokens = np.array([len(x) // ids.width for x in arrays], np.int64)
                n = len(frames)
                yield pa.record_batch(
                    [batch.column(0), pa.array([name] * n), pa.array(at + np.cumsum(sizes) - sizes), pa.array(sizes),
                     pa.array(tokens), pa.array(first + np.cumsum(tokens) - tokens)],
                    ["id", "file", "offset", "size", "n_tokens", "before"])
                at, first = at + int(sizes.sum()), first + int(tokens.sum())
        finally:
            if out is not None:
                out.close()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = ["id", "_head", "_hash", "_salt"]
    (docs.select(F.col(id_col).alias("id"), text.alias("text"))
     .select("id", "text", F.substring("text", 1, 64).alias("_head"), F.xxhash64("text").alias("_hash"),
             F.monotonically_increasing_id().alias("_salt"))  # identical rows are cut into ranges too
     .repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")
     .mapInArrow(written, f"id {kind}, file string, offset long, size long, n_tokens long, before long")
     .write.parquet(f"{folder}/index"))
    files = (spark.read.parquet(f"{folder}/index").groupBy("file")
             .agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.sum("size").alias("bytes")))
    # one row a file; names begin with the number of the range
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    (files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
     .withColumn("dictionary_sha256", F.lit(hashlib.sha256(data).hexdigest()))
     .coalesce(1).write.parquet(f"{folder}/manifest"))
    return folder


def read_tokens(spark: SparkSession, folder: str, only: Column | None = None) -> DataFrame:
    """Documents of a token folder as (id, start, n_tokens, ids), ids as little-endian
    unsigned 32-bit integers, start the ids of all documents before it. ``only`` is a
    condition on the index; nothing but the frames that it leaves is read."""
    bounded_batches(spark)
    folder = folder.rstrip("/")
    store, root = _store(folder)
    with store.open_input_file(f"{root}/dictionary") as f:
        data = f.read()
    shared = spark.sparkContext.broadcast(data)
    index, manifest = (spark.read.parquet(f"{folder}/{name}") for name in ("index", "manifest"))
    index = index if only is None else index.where(only)
    size = manifest.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(2 * spark.sparkContext.defaultParallelism, size // TASK_BYTES + 1)
    kind = index.schema["id"].dataType.simpleString()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        raw = shared.value
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress
        store, root = _store(folder)
        name, f, width = None, None, 2
        for batch in batches:
            ids, files, offsets, sizes, tokens, starts = (batch.column(k) for k in range(6))
            files, offsets, sizes = files.to_pylist(), offsets.to_pylist(), sizes.to_pylist()
            out: list[bytes] = []
            held, k = 0, 0

            def told(upto: int) -> pa.RecordBatch:
                done, n = upto - len(out), len(out)  # noqa: B023
                part = [c.slice(done, n) for c in (ids, starts, tokens)]  # noqa: B023
                return pa.record_batch([*part, pa.array(out, pa.binary())], ["id", "start", "n_tokens", "ids"])  # noqa: B023

            while k < len(files):
                if files[k] != name:
                    if f is not None:
                        f.close()
                    name = files[k]
                    f = store.open_input_file(f"{root}/data/{name}")
                    magic, width, _, used = struct.unpack(HEADER, f.read(struct.calcsize(HEADER)))
                    if magic != MAGIC or used != hashlib.sha256(raw).digest():
                        raise ValueError(f"{name} was not written with this dictionary")
                end = k + 1  # neighbouring frames in one read
                while (end < len(files) and files[end] == name and offsets[end] == offsets[end - 1] + sizes[end - 1]
                       and offsets[end] + sizes[end] - offsets[k] <= READ_BYTES):
                    end += 1
                f.seek(offsets[k])
                block = memoryview(f.read(offsets[end - 1] + sizes[end - 1] - offsets[k]))
                for j in range(k, end):
                    lo = offsets[j] - offsets[k]
                    got = np.frombuffer(unpack(block[lo:lo + sizes[j]]), f"<u{width}").astype("<u4").tobytes()
                    out.append(got)
                    held += len(got)
                    if held >= READ_BYTES:
                        yield told(j + 1)
                        out, held = [], 0
                k = end
            if out:
                yield told(len(files))
        if f is not None:
            f.close()

    rows = (index.join(manifest.select("file", "start"), "file")
            .select("id", "file", "offset", "size", "n_tokens", (F.col("start") + F.col("before")).alias("start"))
            .repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset"))
    return rows.mapInArrow(frames, f"id {kind}, start long, n_tokens long, ids binary")
