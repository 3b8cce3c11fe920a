"""Registered corpus queries: DuckDB SQL where there is some, brute force elsewhere."""
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from sheaf.llm import queries as Q
from sheaf.session import TABLES
from tests.conftest import SF_SMALL
from tools_check import digest


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES) == list(range(1, 14))
    assert set(Q.ORACLES) <= set(Q.QUERIES)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, con, name):
    got, exp = Q.QUERIES[name](spark, SF_SMALL).toPandas(), con.execute(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert len(got) == len(exp) > 0
    assert digest(got) == digest(exp)


def simhash(text, words=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    s = [" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in ids}


def test_op5_matches_brute_force(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.QUERIES["op5_simhash_near_dedup"](spark, SF_SMALL).collect()}
    prints = {i: simhash(t) for i, t in docs.items()}
    parts = groups(prints, 2)
    assert got == {i: (f"{prints[i]:016x}", parts[i]) for i in docs}


def test_op2_finds_every_whole_copy(spark, con, docs):
    got = {(r.doc_id, r.item_id) for r in Q.QUERIES["op2_decontamination"](spark, SF_SMALL).collect()}
    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    whole = {(d, i) for i, b in items for d, t in docs.items() if t and norm(b) in norm(t)}
    assert whole and whole <= got
    shingles = lambda w: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    for d, i in got - whole:
        b = shingles(norm(dict(items)[i]).split())
        assert len(b & shingles(norm(docs[d]).split())) >= 0.7 * len(b)


def test_op8_is_exact_and_round_trips(spark, docs):
    import public_tokenizers as P
    import tiktoken

    ranks = Q.vocabulary().ranks
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in Q.QUERIES["op8_byte_bpe"](spark, SF_SMALL).collect():
        ids = np.array(enc.encode_ordinary(docs[r.doc_id] or ""), "<u4")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_op9_matches_window_brute_force(spark, docs):
    got = {(r.doc_id, r.name, round(r.containment, 6)) for r in Q.QUERIES["op9_license_scan"](spark, SF_SMALL).collect()}
    norm = lambda t: [w for w in re.findall(r"[^\W_]+", (t or "").lower())]
    exp = set()
    for name, text in Q.LICENSE_NOTICES[:5]:  # notices of one piece
        w = norm(text)
        q = min(5, len(w))
        shingles = lambda x: {tuple(x[k:k + q]) for k in range(len(x) - q + 1)}  # noqa: E731, B023
        want = shingles(w)
        for d, t in docs.items():
            x = norm(t)
            best = max((len(want & shingles(x[k:k + 32])) for k in range(0, max(1, len(x)), 16)), default=0)
            if best >= 0.8 * len(want):
                exp.add((d, name, round(best / len(want), 6)))
    assert exp and {g for g in got if g[1] != "MIT-grant"} == exp


@pytest.mark.parametrize("name,label,threshold", [("op4_quality", "quality", 0.7), ("op7_toxicity", "toxic", 0.5)])
def test_classifiers_on_held_out_rows(spark, con, name, label, threshold):
    got = Q.QUERIES[name](spark, "/root/testdata/sf0.1").toPandas().set_index("doc_id")
    assert got["score"].between(0, 1).all() and ((got["score"] >= threshold) == (got["predicted"] == 1)).all()
    known = duckdb.sql(f"SELECT doc_id, {label} AS y FROM '/root/testdata/sf0.1/labels.parquet' WHERE {label} IS NOT NULL").df()
    test = known.set_index("doc_id").join(got[got["held_out"]], how="inner")
    assert len(test) > 300 and (test["y"] == test["predicted"]).mean() > 0.97


def test_op9_finds_edited_copies_of_long_notices(spark):
    from sheaf.llm import license_scan

    rnd = random.Random(9)
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    shingles = lambda w: {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    notices = [n for n in Q.LICENSE_NOTICES if n[0] == "MIT-grant"]
    notices += [(f"n{n}", " ".join(f"n{n}x{i}" for i in range(n))) for n in (17, 18, 20, 21, 32, 33, 37)]
    texts = []
    for _, text in notices:
        w = words(text)
        edited = [[*w[:i], "zz", *w[i + 1:]] for i in range(len(w))]  # every one-word substitution
        for _ in range(25):
            x = list(w)
            for _ in range(rnd.randint(1, 3)):
                i = rnd.randrange(len(x))
                x[i:i + rnd.randint(0, 1)] = ["yy"] * rnd.randint(0, 40)
            edited.append(x)
        texts += [" ".join([*["p"] * rnd.randint(0, 40), *x, *["q"] * rnd.randint(0, 40)]) for x in edited]
    exp = set()
    for d, t in enumerate(texts):
        for name, text in notices:
            want, got = shingles(words(text)), shingles(words(t))
            if len(want & got) >= 0.8 * len(want):
                exp.add((d, name, round(len(want & got) / len(want), 6)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = license_scan.scan(docs, spark.createDataFrame(notices, "name string, text string")).collect()
    assert {(r.doc_id, r.name, round(r.containment, 6)) for r in got} == exp
    assert {d for d, name, _ in exp if name == "MIT-grant"} >= set(range(62))
    # halves in two texts of one id are no copy
    half = words(notices[0][1])
    docs = spark.createDataFrame([(1, " ".join(half[:35])), (1, " ".join(half[27:]))], "doc_id long, text string")
    assert license_scan.scan(docs, spark.createDataFrame(notices, "name string, text string")).count() == 0
