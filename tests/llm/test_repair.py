"""Operator 11: brute force over all edits, small cases, and pieces of long conversations."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sheaf.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    """(role, text, fault) of one conversation's rows in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        out.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen
                    else "truncated" if body[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def cheapest(rows):
    """By plain dynamic programming over the last role: (cost, audit, repaired turns)."""
    best = {"": (0, "", [])}

    def closed():
        for _ in range(3):
            for last, (cost, audit, turns) in list(best.items()):
                role = "assistant" if last == "u" else "user"
                way = (cost + 3, audit + "I", [*turns, role + ":"])
                if role[0] not in best or way[:2] < best[role[0]][:2]:
                    best[role[0]] = way

    closed()
    for role, text, fault in rows:
        after = {}
        for last, (cost, audit, turns) in best.items():
            ways = [(last, (cost + 4, audit + "D", turns))]
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                new = "assistant" if last == "u" else "user"
                ways.append((new[0], (cost + 3 + extra, audit + "R", [*turns, f"{new}:{text}"])))
                if (last, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    ways.append((role[0], (cost + extra, audit + "K", [*turns, f"{role}:{text}"])))
            for state, way in ways:
                if state not in after or way[:2] < after[state][:2]:
                    after[state] = way
        best = after
        closed()
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for conv, all_ in by.items():
        all_.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        marked = faults([r[2:] for r in all_])
        turns = {r[1] for r in all_ if r[0]}
        count = lambda f: sum(m[2] == f for m in marked)  # noqa: E731, B023
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, told = cheapest(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"),
                     count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest())
    return out


def got(done):
    digests = {r.conv_id: r.sha256 for r in done.digests().collect()}
    rows = done.audit.collect()
    assert len(rows) == len({r.conv_id for r in rows}) == len(digests)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests[r.conv_id]) for r in rows}


def conversations(seed, n, most):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        turns = rnd.randint(1, most)
        for t in range(turns):
            if rnd.random() < 0.05:
                continue
            role = rnd.choices([("user", "assistant")[t % 2], "system", "user", "tool", "", None], [20, 1, 2, 1, 1, 1])[0]
            text = rnd.choices([f"Text {t}.", "Same!", "cut short", "", " \t", None, "é…"], [12, 2, 2, 1, 1, 1, 1])[0]
            rows += [(conv if conv else None, rnd.choice([t, t, t, t, None, t * 2]), role, text)] * rnd.choice([1] * 9 + [3])
    return rows


def test_every_conversation_by_brute_force(spark):
    rows = conversations(3, 300, 9)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", cost string").repartition(7)
    assert got(C.repair(df)) == expected(rows)


@pytest.mark.parametrize("size", [3, 40])
def test_long_conversations_are_pieced_together(spark, monkeypatch, size):
    """Pieces of few rows and many ranges give what one search over everything gives."""
    rows = conversations(8, 3, 220) + conversations(9, 1, 500)
    rows = [(None if r[0] is None else r[0] % 2, *r[1:]) for r in rows]
    monkeypatch.setattr(C, "PIECE_ROWS", size)

    def settle(of, kept=C._settle):
        C.PIECE_ROWS = size  # in the workers too
        yield from kept(of)

    monkeypatch.setattr(C, "_settle", settle)
    done = C.repair(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert done.pieces.groupBy("conv_id").count().agg(F.max("count")).first()[0] > 3
    assert got(done) == expected(rows)


def test_search_without_ties_in_the_way():
    rnd = random.Random(5)
    for _ in range(3000):
        marked = [(rnd.choice(["user", "assistant", "system", "x", ""]), str(i) + rnd.choice([".", ""]), rnd.choice(["", "", "", "truncated", "blank"]))
                  for i in range(rnd.randint(0, 8))]
        rows = [(r[:1], f == "truncated", int(f == "blank")) for r, _, f in marked]
        cost, audit, _ = C.Search(rows).cheapest(C.START, (C.START, C.ASSISTANT))
        assert (cost, audit) == cheapest(marked)[:2]


def test_small_cases(spark):
    none = C.repair(spark.createDataFrame([], SCHEMA))
    assert none.audit.count() == none.pieces.count() == none.digests().count() == 0
    long = "w " * 400_000
    rows = [(1, 0, "user", long + "."), (1, 1, "assistant", long), (2, 0, "user", "Hi."), (3, 5, "tool", "x.")]
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(4, 1, "user", "Gone.", 0), (2, 1, "user", "Gone.", 0)], SCHEMA + ", copies int")
    done = C.repair(df, F.col("copies"))
    res = got(done)
    assert res == expected(rows) | {4: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert res[2][5:7] == (3, "KI") and res[3][6] == "D" and res[1][3:7] == (1, 0, 3, "KK")
    told = [(r.role, r.text) for r in done.turns().where("conv_id = 2").orderBy("piece", "place").collect()]
    assert told == [("user", "Hi."), ("assistant", "")]


def test_hot_repeated_rows_are_counted_before_they_meet(spark):
    df = spark.range(0, 40_000).select(F.lit(7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"),
                                       F.lit("user").alias("role"), F.lit("Again.").alias("text"))
    done = C.repair(df)
    r = done.audit.first()
    assert (r.duplicate, r.illegal, r.cost, r.audit) == (39_999, 39_999, 4 * 39_999 + 3, "K" + "D" * 39_999 + "I")
    assert done.digests().first().sha256 == hashlib.sha256(b"user:Again.\nassistant:").hexdigest()
