"""Operator 12: round trip against the tokenizers library, access by id, defined cases."""
import glob
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheaf.llm import queries as Q
from sheaf.llm import token_files as T
from tests.conftest import SF_SMALL

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
TOKENIZER.encode_special_tokens = True


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def test_query_by_the_library(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    start, exp = 0, {}
    for i, text in docs:
        x = np.array(ids(text), "<u4")
        exp[i] = (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    got = Q.QUERIES["op12_token_files"](spark, SF_SMALL).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == exp and len(got) == len(exp)


ODD = [None, "", " ", "\x1c a\x1db \x85c\xa0d e", "100 0 00 a0b 0", "<|endoftext|> x<|startoftext|>y", "I'm we'LL 'S", "é ́e",
       "ΑΣ ΣΑ İI ß", "日本語テキスト 😀👍🏽", "a" * 5000, "tab\there\x0bnow\x0c\r\nend", " x　y", "0", "naïve-résumé", "word " * 3,
       "don't. can'T, 'S. it''s x'. y\". (z). é.. Ñ! …. ½. ².", "\u012f. \u0130. Ǆ, K! Å;", "a.b.c. 1. 2.5, x_1. _.", ".,;:!? .x ,0. 0."]


def written(spark, tmp, rows, schema="doc_id long, text string"):
    return T.write_tokens(spark.createDataFrame(rows, schema), f"{tmp}/tokens", Q.word_tokenizer(), end_id=1)


def test_odd_texts_ties_and_repeats(spark, tmpdir_path):
    rows = [(i % 9 if i % 4 else None, t, "x") for i, t in enumerate(ODD)] * 3 + [(50 + i, "some words here " * (i % 7), "x") for i in range(200)]
    folder = written(spark, tmpdir_path, rows, "doc_id long, text string, file string")
    got = [(r.id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in T.read_tokens(spark, folder).collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert all(r[2] == len(r[3]) for r in got)
    assert sorted((str(r[0]), r[3]) for r in got) == sorted((str(i), ids(t)) for i, t, _ in rows)


def test_whole_long_texts_are_split_at_white_space_only(monkeypatch):
    monkeypatch.setattr(T, "STRETCH", 1 << 16)
    words = T.WordIds.loaded(Q.word_tokenizer())
    text = " ".join(f"wörd{i % 991}x, {i}" for i in range(300_000))
    assert words.encode_batch(pa.array([text]))[0] == np.array(ids(text)[:-1], "<u2").tobytes()
    one = "ab" * (T.STRETCH // 2 + 10) + " c"
    assert words.encode_batch(pa.array(['a b', one, '']))[1] == np.array(ids(one)[:-1], "<u2").tobytes()


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 50)
    words = T.WordIds(Q.word_tokenizer())
    texts = [" ".join(f"w{(i * k) % 400}" for k in range(60)) for i in range(40)]
    assert words.encode_batch(pa.array(texts)) == [np.array(ids(t)[:-1], "<u2").tobytes() for t in texts]
    assert len(words.young) <= 50 + 401


def test_short_documents_are_read_by_their_frames(spark, tmpdir_path):
    rows = [(i, f"document {i} " * (i % 11)) for i in range(500)]
    folder = written(spark, tmpdir_path, rows)
    some = T.read_tokens(spark, folder, F.col("id").isin(3, 499, 1000))
    assert {r.id: np.frombuffer(r.ids, "<u4").tolist() for r in some.collect()} == {i: ids(rows[i][1]) for i in (3, 499)}
    index = spark.read.parquet(f"{folder}/index").where("id = 499").first()
    with open(f"{folder}/data/{index.file}", "rb") as f:  # by hand, from the description of the format
        import zstandard

        magic, width, _, digest = struct.unpack("<8sII32s", f.read(48))
        f.seek(index.offset)
        frame = f.read(index.size)
    with open(f"{folder}/dictionary", "rb") as f:
        data = zstandard.ZstdCompressionDict(f.read())
    raw = zstandard.ZstdDecompressor(dict_data=data).decompress(frame)
    assert magic == b"SHEAFID1" and width == 2 and np.frombuffer(raw, "<u2").tolist() == ids(rows[499][1])


def test_another_dictionary_is_refused(spark, tmpdir_path):
    folder = written(spark, tmpdir_path, [(i, f"some text {i}") for i in range(100)])
    with open(f"{folder}/dictionary", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="dictionary"):
        T.read_tokens(spark, folder).collect()


def test_empty_table(spark, tmpdir_path):
    folder = written(spark, tmpdir_path, [])
    assert T.read_tokens(spark, folder).count() == 0
    assert not glob.glob(f"{folder}/data/*")


def test_shared_dictionary_shortens_short_documents(spark, tmpdir_path):
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 1 and 600")
    folder = T.write_tokens(docs, f"{tmpdir_path}/tokens", Q.word_tokenizer(), end_id=1)
    size = spark.read.parquet(f"{folder}/index").agg(F.sum("size")).first()[0]
    plain = sum(len(zstandard.compress(np.array(ids(r.text), "<u2").tobytes(), 3)) for r in docs.select("text").collect())
    assert size < 0.9 * plain
