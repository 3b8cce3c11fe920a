"""Small cases of each corpus operator: nulls, empty and long texts, ties, repeated rows,
empty tables, and extra columns whose names clash."""
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import (bpe, components, decontaminate, license_scan, line_dedup, quality, queries, simhash, topk,
                       toxicity, url_filter, warc)
from sheaf.llm.labelled import held_out, sample

DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# ---- 1 url filters ---------------------------------------------------------

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("", "/ads", "block"), ("example.com", "/en/x", "allow"), ("example.com", "", "block"), ("com", "/", "block")]


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h), len(p), v, h + p) for h, p, v in rules
           if host and (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_url_rules_by_brute_force(spark):
    rnd = random.Random(4)
    hosts = ["com", "example.com", "WWW.Example.com", "a.www.example.com", "xexample.com", "net", "", "com.", "..com", "é.com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/en/xy/z", "/ads", "/adsx?q#f", "?a=/en/", "#/en/", "/EN/", "/en/\U0010ffff"]
    urls = [None, "", "example.com/en/", "x://", "http://", "://com/"]
    urls += [rnd.choice(["http", "HTTPS"]) + "://" + rnd.choice(hosts) + rnd.choice(paths) for _ in range(150)]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(3, "http://com/en/", "x", "y")] * 3
    df = frame(spark, rows, "page_id long, url string, rule string, host string")
    got = url_filter.judge_urls(df, url_filter.rule_frame(spark, RULES))
    assert sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()])) == sorted(
        map(str, [(r[0], *judge(r[1], RULES)) for r in rows]))


def test_url_empty_tables(spark):
    none = frame(spark, [], "page_id long, url string")
    assert url_filter.judge_urls(none, url_filter.rule_frame(spark, RULES)).count() == 0
    one = frame(spark, [(1, "http://a.com/")], "page_id long, url string")
    r = url_filter.judge_urls(one, url_filter.rule_frame(spark, [])).first()
    assert (r.host, r.path, r.rule, r.verdict) == ("a.com", "/", None, "allow")


# ---- 2 decontamination -----------------------------------------------------

QA = "What colour has the sky above the old town in early June?\nIt is deep blue then"


def test_decontamination_needs_question_and_answer(spark):
    noise = " ".join(f"w{i}" for i in range(300))
    q, a = QA.split("\n")
    docs = [(1, f"{noise} {QA.upper().replace('?', ' ?!')} {noise}"), (2, f"{noise} {q} {noise}"), (3, a), (4, None), (5, ""),
            (6, f"{q} {noise} {a}"), (7, QA), (7, QA), (None, QA), (9, (noise + " ") * 60 + QA)]
    bench = [(1, QA), (2, QA), (3, None), (4, ""), (5, "?!"), (6, "lone")]
    df = frame(spark, [(*d, "x") for d in docs], DOCS + ", item_id string")
    got = decontaminate.contaminated(df, frame(spark, bench, "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == sorted(
        (d, i) for d in ("1", "7", "9", "None") for i in (1, 2))
    assert decontaminate.contaminated(df, frame(spark, [], "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(frame(spark, []), frame(spark, bench, "item_id long, text string")).count() == 0


def test_retrieval_loses_no_pair_that_the_checks_accept():
    rnd = random.Random(1)
    vocab = [f"t{i}" for i in range(120)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 40))) + ". " + " ".join(
        rnd.choice(vocab) for _ in range(rnd.randint(1, 12)))) for i in range(60)]
    frequency = {w: sum(w in decontaminate.words_of(t) for _, t in items) for w in vocab}
    mean = np.mean([len(decontaminate.words_of(t)) for _, t in items])
    index = decontaminate.Index(items, frequency, len(items), mean, 0.8)
    texts = []
    for _, t in items:
        w = decontaminate.words_of(t)
        for k in rnd.sample(range(len(w)), min(len(w), rnd.randint(0, 2))):
            w[k] = "zz"
        texts.append([rnd.choice(vocab) for _ in range(rnd.randint(0, 90))] + w + [rnd.choice(vocab) for _ in range(60)])
    got = {(t, i) for t, i, *_ in decontaminate.scan(index, texts)}
    exp = set()
    for t, words in enumerate(texts):
        for start in range(0, max(1, len(words) - index.stride), index.stride):
            for col in range(len(items)):
                if index.verify(col, words[start:start + 2 * index.stride]):
                    exp.add((t, index.items[col]))
    assert exp and got == exp


def test_edited_prose_items_pass_on_the_whole_item(spark):
    w = [f"w{i}" for i in range(40)]
    prose = " ".join(w[:33]) + ". " + " ".join(w[33:])
    assert decontaminate.question_answer(prose) == (prose, "")
    assert decontaminate.question_answer("Q: one two? A: three") == ("Q: one two? ", "A: three")
    docs = [(i, " ".join([*["p"] * 50, *w[:i], "zz", *w[i + 1:], *["q"] * 50])) for i in range(40)]
    got = decontaminate.contaminated(frame(spark, docs), frame(spark, [(1, prose)], "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(40))


@pytest.mark.parametrize("others", [[], [(2, " ".join(f"v{i}" for i in range(120)))]])
def test_copies_with_insertions_lie_in_one_passage(spark, others):
    w = [f"w{i}" for i in range(60)]
    copy = [*w[:20], *["x"] * 5, *w[20:40], *["y"] * 5, *w[40:]]
    docs = [(i, " ".join(["p"] * i + copy + ["q"] * 300)) for i in range(0, 400, 7)]
    items = frame(spark, [(1, " ".join(w)), *others], "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, docs), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(d, 1) for d, _ in docs]
    assert [decontaminate.stride_of(c, 1.0) for c in (3, 4)] == [127, 511]
    assert [decontaminate.length_class(n) for n in (1, 127, 128, 511, 512)] == [3, 3, 4, 4, 5]


# ---- 3 line dedup ----------------------------------------------------------

def deduped(docs, least):
    """The rule, line by line: delete what a run with an earlier occurrence covers."""
    seqs = {}
    for key, text in docs:
        lines = [] if text is None else text.split("\n")
        seqs[key] = [(x.strip(line_dedup.BLANKS), n) for n, x in enumerate(lines) if x.strip(line_dedup.BLANKS)]
    starts = [(key, s) for key in sorted(seqs) for s in range(len(seqs[key]))]
    gone = {key: set() for key in seqs}
    for n, (key, s) in enumerate(starts):
        mine = [x for x, _ in seqs[key][s:]]
        for other, t in starts[:n]:
            theirs = [x for x, _ in seqs[other][t:]]
            m = next((i for i, (a, b) in enumerate(zip(mine, theirs)) if a != b), min(len(mine), len(theirs)))
            if sum(len(x.split()) for x in mine[:m]) >= least:
                gone[key] |= set(range(s, s + m))
    out = {}
    for key, text in docs:
        if text is None or not gone[key]:
            out[key] = text
            continue
        drop = {seqs[key][p][1] for p in gone[key]}
        for p in gone[key]:
            if p + 1 in gone[key]:
                drop |= set(range(seqs[key][p][1], seqs[key][p + 1][1]))
        out[key] = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in drop)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_by_brute_force(spark, seed):
    rnd = random.Random(seed)
    lines = ["a b", "c d e", "f", "", " ", "g h i j\r", "k l", "x y z w v u"]
    docs = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 14)))) for i in range(12)]
    docs += [(50, "\n".join(["a b"] * 40)), (51, None), (52, ""), (53, "\n\n"), (54, docs[0][1]),
             (55, "\n".join(f"u{i}" for i in range(50)))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, docs), min_words=8).collect()}
    assert got == deduped(docs, 8)


def test_line_dedup_edges(spark):
    run = "one two three\nfour five six"
    rows = [(2, run, 1), (2, run, 2), (None, run, 3), (7, "x\n" + run, 4)]
    df = frame(spark, rows, DOCS + ", lines_removed int")
    got = sorted((str(r.doc_id), r.text, r.lines_removed) for r in line_dedup.dedup_lines(df, min_words=6).collect())
    assert got == sorted([("2", "", 2), ("2", "", 2), ("None", run, 0), ("7", "x", 2)])
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


# ---- 4, 7 classifiers ------------------------------------------------------

def test_factorisation_identity():
    m = quality.Machine(rank=3, seed=1)
    rng = np.random.default_rng(0)
    m.w[:] = rng.normal(0, 1, m.w.shape)
    m.mean, m.scale = rng.normal(0, 1, quality.N_STATS), np.ones(quality.N_STATS)
    texts = ["b a a, c!", "", None, "X"]
    for text, got in zip(texts, m.score(texts)):
        col, value, _, stats = m.inputs([text])
        idx = np.r_[col, np.arange(quality.DIMS, len(m.w))]
        x = np.r_[value, np.clip((stats[0] - m.mean) / m.scale, -4, 4)]
        z = m.bias + m.w[idx] @ x + sum(m.v[idx[i]] @ m.v[idx[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(z, -60, 60))), rel=1e-4)


@pytest.mark.parametrize("module,score", [(quality, quality.score_quality), (toxicity, toxicity.score_toxicity)])
def test_classifier_edges(spark, module, score):
    docs = frame(spark, [(i, t, "c") for i, t in [(1, None), (2, ""), (3, "awful junk"), (3, "awful junk"), (None, "x"),
                                                  (4, "word " * 50_000)]], DOCS + ", score string")
    labels = frame(spark, [(3, 1), (3, None), (4, 0), (None, 1), (9, 1)], "doc_id long, y int")
    model = module.train(docs, labels, F.lit(True), label_col="y")
    got = score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    none = module.train(docs, labels.where("false"), F.lit(True), label_col="y")
    assert {round(r.score, 6) for r in score(docs, none).collect()} == {0.5}
    assert score(docs.where("false"), model).count() == 0


def test_sample_bounds_and_shares(spark):
    docs = frame(spark, [(i, f"t{i}") for i in range(100)])
    labels = frame(spark, [(i, int(i % 10 == 0)) for i in range(100)], "doc_id long, y int")
    rows, weight, base = sample(docs, labels, "y", ~held_out(F.col("doc_id"), 5, 0), rows=6)
    used = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    assert rows["label"].value_counts().to_dict() == {0: 6, 1: min(6, sum(i % 10 == 0 for i in used))}
    assert set(rows["text"]) <= {f"t{i}" for i in used}
    share = sum(weight[c] * (rows["label"] == c).sum() for c in (0, 1)) / len(rows)
    assert share == pytest.approx(1.0) and base == sum(i % 10 == 0 for i in used) / len(used)


def test_sample_skips_only_texts_that_do_not_fit(spark):
    docs = frame(spark, [(i, "x" * (500 if i % 7 == 0 else 3)) for i in range(60)])
    labels = frame(spark, [(i, i % 2) for i in range(60)], "doc_id long, y int")
    rows, _, base = sample(docs, labels, "y", F.lit(True), chars=400)
    assert sorted(rows["text"]) == ["xxx"] * 51 and set(rows["label"]) == {0, 1} and base == 0.5


def test_counterfactual_penalty_frees_group_mentions():
    rnd = random.Random(2)
    neutral = [f"n{i}" for i in range(30)]
    texts, labels = [], []
    for i in range(400):  # group mentions come with insults more often than not
        bad = i % 2
        w = [rnd.choice(neutral) for _ in range(8)] + (["scum"] if bad and rnd.random() < 0.8 else [])
        w += ["muslims" if rnd.random() < (0.7 if bad else 0.1) else "people"]
        texts.append(" ".join(w))
        labels.append(bad)
    y, share = np.array(labels, float), np.ones(400)
    swaps = {"muslims": "christians", "christians": "muslims"}
    plain = toxicity.Scorer(*toxicity.fit(texts, y, share, swaps, fairness=0.0))
    fair = toxicity.Scorer(*toxicity.fit(texts, y, share, swaps, fairness=10.0))
    gap = lambda m: abs(m.score("many muslims live here") - m.score("many christians live here"))
    assert gap(plain) > 0.2 and gap(fair) < gap(plain) / 4
    assert fair.score("n1 scum") > 0.5
    assert toxicity.counterfactual("Muslims and n1", swaps) == "Christians and n1"
    assert toxicity.counterfactual("n1", swaps) is None


# ---- 5 simhash -------------------------------------------------------------

@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_sliced_links_by_brute_force(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2 ** 63, 5).astype(np.uint64)
    fps = np.unique(np.concatenate([base[k % 5:k % 5 + 1] ^ np.bitwise_or.reduce(
        np.uint64(1) << rng.integers(0, 64, 1 + k % 4).astype(np.uint64)) for k in range(300)]))
    rng.shuffle(fps)
    bucket = np.sort(rng.integers(0, 4, len(fps)))
    left, right = simhash.sliced_links(fps, bucket, radius)
    got = set(zip(left.tolist(), right.tolist()))
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps))
                   if bucket[i] == bucket[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}


def test_simhash_blocks_and_edges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(3)
    prints = sorted({(0xABCDEF << 40) ^ sum(1 << rng.randrange(24) for _ in range(3)) for _ in range(150)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = components.components(simhash.links(frame(spark, signed, "_fp long"), 2)).collect()
    root = {p: p for p, in signed}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a,) in enumerate(signed):
        for (b,) in signed[:i]:
            if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    joined = {r.node: r.component for r in got}
    assert {p: joined.get(p, p) for p, in signed} == {p: top(p) for p, in signed}
    docs = frame(spark, [(5, None, 1), (4, "", 1), (None, " \t", 1), (9, "A b  c", 1), (9, "a B c", 1), (2, "solo", 1),
                         (8, "w " * 200_000, 1)], DOCS + ", component_id int")
    out = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert [x[2] for x in out if x[1] == "0" * 16] == [4, 4, 4]
    assert len(out) == 7 and len({x[1:] for x in out if x[0] == "9"}) == 1
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = frame(spark, [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (501, 500)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


# ---- 6 warc ----------------------------------------------------------------

def test_revisits(spark):
    schema = "record_id long, kind string, url string, ts long, status int, headers map<string,string>, payload_digest string, outcome string"
    full = lambda i, url, ts, tag, d="d", status=200, **h: (i, "response", url, ts, status, ({"ETag": tag} if tag else {}) | h, d, "x")
    again = lambda i, url, ts, **h: (i, "revisit", url, ts, 304, h or None, None, "x")
    rows = [full(1, "http://www.a.com:80/p/?b=2&utm_x=1&a=1#f", 10, '"1"', **{"Content-Type": "t", "Date": "old", "Age": "1"}),
            full(2, "https://A.com/p?a=1&b=2", 20, '"2"'), full(3, "a.com/p?a=1&b=2", 30, '"3"', status=404),
            full(4, "a.com/p?a=1&b=2", 31, '"4"', d=None), full(5, "a.com/q", 5, None), full(6, "a.com/r", None, '"6"'),
            full(7, "a.com/s", 1, None, **{"Last-Modified": "m"}),
            again(10, "a.com/p?a=1&b=2", 20, etag='W/"1"', date="new", **{"content-type": "u"}),
            again(11, "a.com/p?b=2&a=1", 21, etag='"1"'), again(12, "a.com/p?a=1&b=2", 40, ETAG='W/"2"'),
            again(13, "a.com/q", 6), again(14, "a.com/q", 5), again(15, "a.com/q", 6, etag='"x"'), again(16, None, 6),
            again(17, "a.com/r", 9, etag='"6"'), again(18, "a.com/s", None), again(19, "a.com/s", 2, **{"last-modified": "m"}),
            again(20, "a.com/p?a=1&b=2", 41), again(13, "a.com/q", 6), again(21, "b.com/", 6)]
    got = sorted((r.record_id, r.outcome, r.refers_to) for r in warc.resolve_revisits(frame(spark, rows, schema)).collect())
    assert got == sorted([(10, "resolved", 1), (11, "mismatch", None), (12, "resolved", 2), (13, "resolved", 5), (13, "resolved", 5),
                          (14, "no_response", None), (15, "no_validator", None), (16, "no_url", None), (17, "no_response", None),
                          (18, "no_response", None), (19, "resolved", 7), (20, "no_validator", None), (21, "no_response", None)],
                         key=lambda x: x[0])
    ten = next(r for r in warc.resolve_revisits(frame(spark, rows, schema)).collect() if r.record_id == 10)
    assert ten.headers == {"etag": 'W/"1"', "content-type": "t", "date": "new", "age": "1"}
    assert warc.resolve_revisits(frame(spark, [], schema)).count() == 0


# ---- 8 bpe -----------------------------------------------------------------

def test_bpe_against_merges(spark):
    import public_tokenizers as P
    import tiktoken

    v = queries.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    rnd = random.Random(5)
    texts = ["", "a" * 3000, "ab" * 2000, " \n\t " * 50, "<|endoftext|>", "é漢😀" * 40]
    texts += ["".join(rnd.choice("aAbB zq'stré0.!?\n\x00") for _ in range(rnd.randint(1, 80))) for _ in range(2000)]
    for t in texts:
        ids = v.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert v.decode(ids) == t.encode()
    rows = frame(spark, [(1, None, "x"), (2, "", "x"), (3, "hi there", "x"), (3, "hi there", "x")], DOCS + ", ids string")
    got = bpe.decode(bpe.encode(rows, v), v).collect()
    assert sorted((r.doc_id, r.n_tokens, bytes(r.decoded)) for r in got) == [(1, 0, b""), (2, 0, b""), (3, 2, b"hi there"), (3, 2, b"hi there")]
    assert bpe.encode(rows.where("false"), v).count() == 0


# ---- 9 licenses ------------------------------------------------------------

def test_license_edges(spark):
    long_one = " ".join(f"clause{i} of the terms" for i in range(30))
    templates = frame(spark, [("short", "All rights reserved."), ("long", long_one), ("same", long_one), (None, "x y z"),
                              ("none", None), ("blank", "!!")], "name string, text string")
    pad = " ".join(f"p{i}" for i in range(200))
    broken = long_one.replace("clause10 of", "clause10 off")
    docs = frame(spark, [(1, f"{pad} ALL rights-reserved {pad}", 0), (2, f"{pad} {long_one} {pad}", 0), (3, broken, 0), (4, None, 0),
                         (5, "", 0), (6, "rights", 0), (7, long_one[:200], 0), (1, f"{pad} ALL rights-reserved {pad}", 0)],
                 DOCS + ", name int")
    got = sorted((r.doc_id, r.name) for r in license_scan.scan(docs, templates).collect())
    assert got == [(1, "short"), (2, "long"), (2, "same"), (3, "long"), (3, "same")]
    assert license_scan.scan(docs.where("false"), templates).count() == 0
    assert license_scan.scan(docs, templates.where("false")).count() == 0
    assert (1 - 1 / 28) ** license_scan.bands_for(32, 5) <= license_scan.MISS


# ---- 10 top-k --------------------------------------------------------------

def test_topk_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(0)
    rows = [(i, (rng.integers(-3, 4, 6) / 256).tolist()) for i in range(150)]
    rows += [(200, None), (201, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [0.0] * 6),
             (0, rows[0][1]), (210, []), (220, [1.0, 2.0]), (230, [3e9, -2e9]), (240, [0.0] * 6)]
    df = frame(spark, [(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    low, high = -2 ** 63, 2 ** 63 - 1
    for q in [i for i in good if i % 10 == 0]:
        all_ = sorted((-min(high, max(low, sum(a * b for a, b in zip(good[q], v)))), i) for i, v in good.items()
                      if i != q and len(v) == len(good[q]))
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(all_[:5])], q
    assert topk.top_k(df.where("false"), F.col("vec_id") % 10 == 0, 5).count() == 0


def test_null_ids_are_scored_and_not_held_out(spark):
    docs = frame(spark, [(i, f"good word{i}" if i % 2 else f"bad word{i}") for i in range(60)] + [(None, "bad word1"), (None, None)])
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    usable = ~held_out(F.col("doc_id"), 5, 0)
    assert docs.select(held_out(F.col("doc_id"), 5, 0).alias("h")).where("h IS NULL").count() == 0
    got, _, _ = sample(docs, labels, "toxic", usable)
    assert len(got) == labels.where("doc_id IS NOT NULL").where(usable).count()
    rows = (toxicity.score_toxicity(docs, toxicity.train(docs, labels, usable), threshold=0.5)
            .where("doc_id IS NULL").withColumn("held_out", held_out(F.col("doc_id"), 5, 0)).collect())
    assert len(rows) == 2 and all(r.held_out is False and 0 <= r.score <= 1 for r in rows)


def test_round_trip_is_encode_and_decode(spark):
    words = queries.vocabulary()
    texts = [None, "", "a", " two  words\n", "é日本 😀", "x" * 3000, "same", "same"]
    docs = frame(spark, [(i, t, "q", b"1") for i, t in enumerate(texts)], DOCS + ", decoded string, ids binary")
    one = bpe.round_trip(docs, words).orderBy("doc_id").collect()
    two = bpe.decode(bpe.encode(docs, words), words).orderBy("doc_id").collect()
    assert [(r.doc_id, r.ids, r.n_tokens, r.decoded) for r in one] == [(r.doc_id, r.ids, r.n_tokens, r.decoded) for r in two]
    assert [bytes(r.decoded).decode() for r in one] == [t or "" for t in texts]
    assert bpe.round_trip(docs.limit(0), words).count() == 0
