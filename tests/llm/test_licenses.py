"""Operator 9: many templates in several passes, and copies that must lie in one passage."""
import random
import re

import pytest

from sheaf.llm import license_scan as L
from sheaf.llm.queries import LICENSE_NOTICES

WORDS = re.compile(r"[^\W_]+")


def copies(template, text):
    """Best share of the template's shingles in a stretch of the text where none is more
    than REACH words from the next."""
    t, w = WORDS.findall(template.lower()), WORDS.findall(text.lower())
    n = min(5, len(t))
    want = {" ".join(t[k:k + n]) for k in range(len(t) - n + 1)}
    best, run, last = 0, set(), None
    for k in range(len(w) - n + 1):
        s = " ".join(w[k:k + n])
        if s in want:
            run = run if last is not None and k - last <= L.REACH else set()
            run.add(s)
            last, best = k, max(best, len(run))
    return best / len(want)


@pytest.mark.parametrize("per_pass", [5, 4096])
def test_many_templates_in_passes(spark, monkeypatch, per_pass):
    monkeypatch.setattr(L, "PASS_PIECES", per_pass)
    rnd = random.Random(2)
    vocab = [f"v{k}" for k in range(400)]
    templates = [(f"t{k}", " ".join(rnd.choices(vocab, k=rnd.choice([2, 4, 7, 15, 17, 40, 130])))) for k in range(40)]
    docs = []
    for name, text in templates:
        for _ in range(4):
            w = text.split()
            for _ in range(rnd.randint(0, max(1, len(w) // 12))):
                k = rnd.randrange(len(w) + 1)
                w[k:k + rnd.randint(0, 1)] = rnd.choices(vocab, k=rnd.choice([0, 1, 1, 3, 60]))
            docs.append((len(docs), " ".join([*rnd.choices(vocab, k=rnd.randint(0, 50)), *w, *rnd.choices(vocab, k=rnd.randint(0, 50))])))
    got = L.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(templates, "name string, text string"))
    exp = {(d, n, round(s, 6)) for d, text in docs for n, t in templates if (s := copies(t, text)) >= 0.8}
    assert {(r.doc_id, r.name, round(r.containment, 6)) for r in got.collect()} == exp and len(exp) > 80


def test_halves_far_apart_are_no_copy(spark):
    """Of short and long templates alike; and copies in a very long text are found."""
    noise = " ".join(f"n{k}" for k in range(10_000))
    notices = [(n, t) for n, t in LICENSE_NOTICES if len(WORDS.findall(t)) > 8]
    assert {len(WORDS.findall(t)) > L.STRIDE for _, t in notices} == {True, False}
    docs = []
    for _, t in notices:
        w = t.split()
        half = len(w) // 2
        docs += [f"{' '.join(w[:half + 4])} {noise} {' '.join(w[half:])}", f"{noise} {t} {noise} {noise}", f"{t} {noise} {t}"]
    got = L.scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(notices, "name string, text string"))
    found = {(r.doc_id, r.name): (r.containment, r.copies) for r in got.collect()}
    assert found == {(3 * k + j, n): (1.0, j) for k, (n, _) in enumerate(notices) for j in (1, 2)}
