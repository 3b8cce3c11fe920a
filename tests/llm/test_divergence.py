"""Operator 13: brute force over terms, and its defined cases."""
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sheaf.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        groups[lang or ""].add(source or "")
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= least}
        c = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        all_ = {t: sum(c[s][t] for s in sources) for t in kept}
        p_of = lambda x: {t: 1 + 10**9 * (n + 5) // (sum(x.values()) + 5 * len(kept)) for t, n in x.items()}  # noqa: E731, B023
        p, q = {s: p_of(c[s]) for s in sources}, p_of(all_)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if c[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out |= {(lang, s, part, i, -v, k + 1) for k, (v, _, i) in enumerate(sorted(items)[:most])}
    return out


def documents(seed, n):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("The", "öl", "ÖL", "z", "naïve", "x") for b in ("", "s", "É", "q", "zz")] + ["日本", "a-b", "1x2", "İ"]
    rows = [(i, " ".join(rnd.choice(words[:rnd.randint(1, len(words))]) for _ in range(rnd.randint(0, 30))),
             rnd.choice(["en", "de", None]), rnd.choice(["hot", "hot", "s1", "s2", "", None, "S1"])) for i in range(n)]
    return rows + [(None, None, "fr", "s1"), (None, "", "fr", "s2"), (1, "few", "fr", "s3"), (1, "\x00\x7f{[@`", "en", "bare")] + rows[:40]


def test_all_rows_by_brute_force(spark, monkeypatch):
    rows = documents(2, 900)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", term string").repartition(6)
    for least, top in ((30, 50), (5, 3), (10_000, 50)):
        out = D.audit(df, least, top).collect()
        assert len(out) == len(set(out))
        assert {tuple(r) for r in out} == brute(rows, least, top)


def test_more_terms_than_one_block_and_task_flushes(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in (int(rnd.paretovariate(0.6)) % 600 for _ in range(80))), "en", f"s{i % 5}")
            for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {tuple(r) for r in D.audit(df, 3, 20).collect()} == brute(rows, 3, 20)


def test_empty_and_very_long(spark):
    assert D.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    long = [(i, "Abc déf. " * 300_000 if i == 0 else "abc déf, xyz", "en", f"s{i % 2}") for i in range(40)]
    assert {tuple(r) for r in D.audit(spark.createDataFrame(long, SCHEMA)).collect()} == brute(long, 30, 50)


def test_shares_are_exact_beyond_64_bits(spark):
    big = [(0, 1, 1), (10**15, 3 * 10**15, 10**6), (7 * 10**16 + 3, 9 * 10**17 + 1, 12345)]
    df = spark.createDataFrame(big, "c long, n long, v long")
    got = [r[0] for r in df.orderBy("c").select(D.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in big]
