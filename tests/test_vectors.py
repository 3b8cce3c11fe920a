"""J10 by cells: exact on random and clustered vectors, and few cells read on the latter."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.operators import signatures as SG
from sheaf.operators import vectors as VE


def _frame(spark, m, name):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], f"{name} long, embedding array<double>")


@pytest.mark.parametrize("spread,least_skipped", [(0.05, 0.75), (1.0, 0.0)])
def test_cells_are_exact(spark, spread, least_skipped):
    rnd = np.random.default_rng(3)
    centers = rnd.normal(size=(20, 12))
    m = centers[rnd.integers(0, 20, 900)] + spread * rnd.normal(size=(900, 12))
    m[5:25] = m[4]          # copies: ties by id
    m[30] = 0
    corpus, queries = _frame(spark, m, "id"), _frame(spark, m, "qid").where(F.col("qid") % 9 == 4)
    for self_too in (False, True):
        plain = SG.cosine_topk(corpus, queries, k=7, threshold=0.2, exclude_self=self_too)
        cells = SG.cosine_topk_cells(corpus, queries, k=7, threshold=0.2, exclude_self=self_too)
        rows = lambda d: sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in d.collect())
        assert rows(cells.result) == rows(plain)
        assert 1 - cells.share_read() >= least_skipped
    assert cells.cells.agg(F.sum("n")).first()[0] == 900


def test_cells_edge_cases(spark):
    one = _frame(spark, np.ones((1, 3)), "id")
    none = one.limit(0)
    q = _frame(spark, np.ones((2, 3)), "qid")
    assert SG.cosine_topk_cells(none, q).result.count() == 0
    assert SG.cosine_topk_cells(one, q.limit(0)).result.count() == 0
    assert [(r.qid, r.id, r["rank"]) for r in SG.cosine_topk_cells(one, q, k=3).result.orderBy("qid").collect()] == [(0, 0, 1), (1, 0, 1)]


def test_a_crowded_cell_is_cut(spark, monkeypatch):
    """A third of all vectors in one cell: shards and blocks stay bounded, rows stay exact."""
    monkeypatch.setattr(SG, "SHARD_ROWS", 40)
    monkeypatch.setattr(SG, "BLOCK_ROWS", 10)
    rnd = np.random.default_rng(1)
    m = rnd.normal(size=(600, 8))
    m[:200] = rnd.normal(size=8) + 0.01 * rnd.normal(size=(200, 8))
    corpus, queries = _frame(spark, m, "id"), _frame(spark, m[:120], "qid")
    rows = lambda d: sorted((r.qid, r["rank"], r.id) for r in d.collect())
    assert rows(SG.cosine_topk_cells(corpus, queries, threshold=None).result) == rows(SG.cosine_topk(corpus, queries, threshold=None))


def test_packed_buckets_are_the_rows_of_buckets(spark):
    """words are counted text by text as by rows of words; repeated ids are one text."""
    texts = [(1, "One two, TWO three"), (1, "three four Ähre"), (2, "--"), (3, None), (None, "a b"), (None, "b c"), (4, "x x x")]
    docs = spark.createDataFrame(texts, "id long, text string")
    packed = VE.text_buckets(docs, "id", "text", packed=True)
    got = {(r.id, b, n) for r in packed.collect() for b, n in zip(r.buckets, r.tf, strict=True)}
    assert got == {(r.id, r.bucket, r.tf) for r in VE.text_buckets(docs, "id", "text").collect()} and len(got) == 9
    best = lambda t: sorted((r.file_id, r.id, r["rank"], round(r.score, 9)) for r in VE.cosine_best(t, 0.1).collect())
    more = docs.unionByName(spark.createDataFrame([(5, "one two three"), (6, "x one")], docs.schema))
    assert best(VE.text_buckets(more, "id", "text", packed=True)) == best(VE.text_buckets(more, "id", "text")) != []
