"""Operator 11, conversation structure repair.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles (system, user,
assistant). Its rows are kept (cost 0), given another role (3) or deleted (4), and turns
without text may be inserted (3); blank rows and rows that repeat an earlier one must go,
and a truncated row that stays adds 3. Iterative-deepening A* finds the cheapest edits:
a depth-first search tries the edits of each row in ASCII order (D, I, K, R) under a cost
bound. What a state (row, last role) was proven to need after all its edits failed is kept
in a transposition table across all bounds, so a state is opened again only with more left
to spend than it failed with. The next bound is the least cost that broke the last one, so
the first accepting path is the cheapest and of these the least in ASCII order. The lower
bound of the rest sums what each row costs at least and what pairs of neighbours that do
not follow each other cost on top (pairs are disjoint).

Rows are sorted by conversation and turn into ranges, and each task reads its range as a
stream. A conversation that lies whole inside a range and has at most ``piece_rows`` rows
is settled there. Longer ones, and those that a range border may cut, leave pieces: for
each state before a piece and each state after it, the cheapest edits in between, found by
the same search. Their chain is resolved over one small row a piece, so that one huge
conversation is searched by many tasks.

Defined cases: a null role or text is one space; a null conv_id is a conversation of its
own; null turns come first, rows of one turn are in the order of role and text; repeated
rows are counted before they meet, the first one may stay and the rest are duplicates;
whatever does not begin with s, u or a (an empty role too) cannot be kept; texts of any
length are judged whole; extra columns are ignored; an empty table gives no rows; a
conversation whose rows all have ``copies`` 0 is named with zeros and no turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import bounded_batches, materialize

SPACE = " \t\n\x0b\f\r"
KEEP_CUT, REROLE, DELETE, INSERT = 3, 3, 4, 3   # costs; keeping a row that is not truncated is free
START, SYSTEM, USER, ASSISTANT = range(4)       # what stands last in the repaired conversation
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
FITS = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
LEGAL = ("su", "ua", "au")                      # roles that may follow each other
FULL = {"u": "user", "a": "assistant"}
NEVER = 1 << 60
PIECE_ROWS = 512        # rows that one search sees at most
PIECE_CHARS = 1 << 24   # characters of their texts together, from which on a piece ends

WAYS = "array<struct<entry:int,exit:int,cost:bigint,audit:string>>"
TURNS = "array<struct<role:string,text:string>>"
ROWS = "array<struct<role:string,text:string,forced:bigint,cut:boolean>>"


class Search:
    """Cheapest edits of a stretch of rows. A row is (initial, truncated, forced): forced
    rows are runs of that many blank or repeated rows, which can only be deleted."""

    def __init__(self, rows: list[tuple[str, bool, int]]):
        self.rows = rows
        n = len(rows)
        own = [DELETE * f if f else (DELETE if cut else REROLE) if x not in AFTER else KEEP_CUT * cut for x, cut, f in rows]
        # live[i]: the first row from i on that is not forced; gap[i]: what the forced rows up to it cost
        live, gap = [n] * (n + 1), [0] * (n + 1)
        floor = [0] * (n + 2)
        for i in range(n - 1, -1, -1):
            x, cut, f = rows[i]
            live[i], gap[i] = (live[i + 1], own[i] + gap[i + 1]) if f else (i, 0)
            floor[i] = own[i] + floor[i + 1]
            j = live[i + 1]
            if not f and j < n and x in AFTER and rows[j][0] in AFTER and x + rows[j][0] not in LEGAL:
                # keeping both as neighbours is not possible: a deletion, another role or a turn between
                extra = DELETE - KEEP_CUT if cut or rows[j][1] else INSERT
                floor[i] = max(floor[i], own[i] + gap[i + 1] + own[j] + extra + floor[j + 1])
        self.own, self.live, self.gap, self.floor = own, live, gap, floor

    def least(self, i: int, state: int, accept: tuple[int, ...]) -> int:
        """A lower bound of the cost from row i on."""
        if state > max(accept):
            return NEVER if max(accept) <= SYSTEM else self.floor[i]
        j = self.live[i]
        if j < len(self.rows):
            x, cut, _ = self.rows[j]
            if x in AFTER and x not in FITS[state]:
                extra = DELETE - KEEP_CUT if cut else INSERT
                return max(self.floor[i], self.gap[i] + self.own[j] + extra + self.floor[j + 1])
        return self.floor[i]

    def edits(self, i: int, state: int) -> list[tuple[str, int, int, int]]:
        """(edit, cost, next row, next state) in ASCII order."""
        then = AFTER[NEXT[state]]
        if i == len(self.rows):
            return [("I", INSERT, i, then)]
        x, cut, forced = self.rows[i]
        if forced:  # a turn inserted after it costs the same, and D comes before I
            return [("D" * forced, DELETE * forced, i + 1, state)]
        out = [("D", DELETE, i + 1, state), ("I", INSERT, i, then)]
        if x and x in FITS[state]:
            out.append(("K", KEEP_CUT * cut, i + 1, AFTER[x]))
        if x != NEXT[state]:
            out.append(("R", REROLE + KEEP_CUT * cut, i + 1, then))
        return out

    def cheapest(self, start: int, accept: tuple[int, ...]) -> tuple[int, str, int] | None:
        """(cost, audit, last state) from ``start`` to one of ``accept``."""
        known: dict[tuple[int, int], int] = {}
        bound = self.least(0, start, accept)
        while bound < NEVER:
            found = self._deepen(start, accept, bound, known)
            if not isinstance(found, int):
                return bound, *found
            bound = found
        return None

    def _deepen(self, start: int, accept: tuple[int, ...], bound: int, known: dict):
        n = len(self.rows)
        # row, state, left to spend, edits still to try, least cost that was seen to be needed, edit that led here, its cost
        stack = [[0, start, bound, iter(self.edits(0, start)), NEVER, "", 0]]
        if n == 0 and start in accept:
            return "", start
        while stack:
            top = stack[-1]
            left = top[2]
            for edit, cost, i, state in top[3]:
                need = known.get((i, state))
                need = cost + (self.least(i, state, accept) if need is None else need)
                if need > left:
                    top[4] = min(top[4], need)
                    continue
                if i == n and state in accept:
                    return "".join(f[5] for f in stack) + edit, state
                stack.append([i, state, left - cost, iter(self.edits(i, state)), NEVER, edit, cost])
                break
            else:
                stack.pop()
                known[top[0], top[1]] = top[4]
                if not stack:
                    return top[4]
                stack[-1][4] = min(stack[-1][4], top[6] + top[4])
        return NEVER

    def ways(self) -> list[dict]:
        """The cheapest edits between every two states around the stretch."""
        out = []
        for a in range(4):
            for b in range(4):
                if b >= USER or b == a or (a, b) == (START, SYSTEM):
                    if found := self.cheapest(a, (b,)):
                        out.append({"entry": a, "exit": b, "cost": found[0], "audit": found[1]})
        return out


def apply_edits(rows: list[dict], entry: int, audit: str) -> list[dict]:
    """The repaired turns of a stretch from its rows and the edits chosen for them."""
    state, at, done, out = entry, 0, 0, []
    for edit in audit:
        if edit == "I":
            out.append({"role": FULL[NEXT[state]], "text": ""})
            state = AFTER[NEXT[state]]
            continue
        row = rows[at]
        if edit == "K":
            out.append({"role": row["role"], "text": row["text"]})
            state = AFTER[row["role"][0]]
        elif edit == "R":
            out.append({"role": FULL[NEXT[state]], "text": row["text"]})
            state = AFTER[NEXT[state]]
        done += 1
        if done >= (row["forced"] or 1):
            at, done = at + 1, 0
    return out


class _Stretch:
    """Rows of one conversation as they come, in order."""

    def __init__(self, conv):
        self.conv = conv
        self.rows: list[dict] = []
        self.size = self.live = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn, role: str, text: str, copies: int, blank: bool, again: bool, cut: bool) -> None:
        if not copies:
            return
        x = role[:1]
        if self.last is not None:
            self.illegal += self.last + x not in LEGAL
        self.illegal += copies - 1  # no role follows itself
        self.first, self.last = x if self.first is None else self.first, x
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        forced = copies if blank or again else copies - 1
        if blank:
            self.blank += copies
        else:
            self.duplicate += forced
        if not blank and not again:
            self.truncated += cut
            self.rows.append({"role": role, "text": text, "forced": 0, "cut": cut})
            self.size += len(text)
            self.live += 1
        if forced:
            if self.rows and self.rows[-1]["forced"]:
                self.rows[-1]["forced"] += forced
            else:
                self.rows.append({"role": None, "text": None, "forced": forced, "cut": False})

    @property
    def full(self) -> bool:
        return self.live >= PIECE_ROWS or self.size >= PIECE_CHARS

    def result(self, piece: int, whole: bool) -> dict:
        search = Search([((r["role"] or "")[:1], r["cut"], r["forced"]) for r in self.rows])
        out = {"conv_id": self.conv, "piece": piece, "whole": whole, "rows": None, "repaired": None}
        out |= {k: getattr(self, k) for k in ("low", "high", "turns", "first", "last", "blank", "duplicate", "truncated", "illegal")}
        if whole:
            cost, audit, state = search.cheapest(START, (START, ASSISTANT))
            out["ways"] = [{"entry": START, "exit": state, "cost": cost, "audit": audit}]
            out["repaired"] = apply_edits(self.rows, START, audit)
        else:
            out["ways"], out["rows"] = search.ways(), self.rows
        return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows and texts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(t["text"] or "") for t in (row.get("rows") or row.get("repaired") or ()))
        if len(held) >= 1000 or size >= 8 << 20:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _settle(rows: Iterator[tuple]) -> Iterator[dict]:
    """Stretches of a range of rows in the order of conversation and turn."""
    piece = TaskContext.get().partitionId() << 40
    current, border = None, True  # the first and the last conversation of a range may go on outside
    for conv, *row in rows:
        if current is not None and current.conv != conv:
            yield current.result(piece, not border)
            piece, current, border = piece + 1, None, False
        elif current is not None and current.full:
            border = True
            yield current.result(piece, False)
            piece, current = piece + 1, None
        if current is None:
            current = _Stretch(conv)
        current.add(*row)
    if current is not None:
        yield current.result(piece, False)


def _chain(rows: Iterator[tuple]) -> Iterator[dict]:
    """For the pieces of each conversation in order: the states before and after it on the
    cheapest way through all of them, and what its border with the one before adds."""
    conv, pieces, back, best, last, high = None, [], [], None, None, None

    def finish() -> Iterator[dict]:
        state = min((best[s][0], best[s][1], s) for s in (START, ASSISTANT) if s in best)[2]
        path = []
        for came in reversed(back):
            path.append((came[state], state))
            state = came[state]
        for (piece, illegal, same), (entry, exit_) in zip(pieces, reversed(path)):
            yield {"piece": piece, "entry": entry, "exit": exit_, "border": illegal, "same_turn": same}

    for c, piece, first, end, low, top, ways in rows:
        if best is None or c != conv:
            if best is not None:
                yield from finish()
            conv, pieces, back, best, last, high = c, [], [], {START: (0, "")}, None, None
        pieces.append((piece, int(last is not None and first is not None and last + first not in LEGAL),
                       int(low is not None and low == high)))
        last, high = last if end is None else end, high if top is None else top
        reached: dict[int, tuple[int, str, int]] = {}
        for w in ways:
            if w["entry"] in best:
                cost, tail = best[w["entry"]]
                way = (cost + w["cost"], tail + w["audit"], w["entry"])
                if w["exit"] not in reached or way < reached[w["exit"]]:
                    reached[w["exit"]] = way
        back.append({s: w[2] for s, w in reached.items()})
        # what all ways share decides no tie any more
        tails = [w[1] for w in reached.values()]
        low_, high_ = min(tails), max(tails)
        shared = next((k for k, (x, y) in enumerate(zip(low_, high_)) if x != y), len(low_))
        best = {s: (w[0], w[1][shared:]) for s, w in reached.items()}
    if best is not None:
        yield from finish()


def _arrow(fields: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(fields))


@dataclass
class Repaired:
    """``audit``: a row per conversation with conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit. ``pieces``: the repaired conversations in pieces of bounded rows
    (conv_id, piece, whole, repaired as an array of role and text); ``whole`` says that the
    conversation has this piece alone."""

    audit: DataFrame
    pieces: DataFrame

    def turns(self) -> DataFrame:
        """A row per repaired turn, in the order of piece and place."""
        return self.pieces.select("conv_id", "piece", F.posexplode("repaired").alias("place", "turn")).select(
            "conv_id", "piece", "place", "turn.role", "turn.text")

    def digests(self) -> DataFrame:
        """SHA-256 of each repaired conversation, its turns as ``role:text`` lines. The hash
        of a conversation of many pieces is one chain: its pieces are streamed in order,
        one at a time in memory."""
        line = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
        told = self.pieces.select("conv_id", "piece", "whole", F.size("repaired").alias("n"), line.alias("told"))

        def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import hashlib

            def hashes() -> Iterator[dict]:
                conv, digest, any_ = None, None, False
                for c, n, text in _rows(batches):
                    if digest is None or c != conv:
                        if digest is not None:
                            yield {"conv_id": conv, "sha256": digest.hexdigest()}
                        conv, digest, any_ = c, hashlib.sha256(), False
                    if n:
                        digest.update((("\n" if any_ else "") + text).encode())
                        any_ = True
                if digest is not None:
                    yield {"conv_id": conv, "sha256": digest.hexdigest()}

            yield from _batches(hashes(), schema)

        kind = f"conv_id {self.pieces.schema['conv_id'].dataType.simpleString()}, sha256 string"
        schema = _arrow(kind, self.pieces.sparkSession)
        long = (told.where(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
                .select("conv_id", "n", "told").mapInArrow(chain, kind))
        return told.where("whole").select("conv_id", F.sha2("told", 256).alias("sha256")).unionByName(long)


def judged_rows(conversations: DataFrame, copies: Column | None = None) -> DataFrame:
    """Distinct rows with the number of their copies and their faults (blank, again: the
    role and text were seen at an earlier turn, cut: truncated)."""
    n = F.lit(1) if copies is None else copies
    some = n > 0
    rows = conversations.select(
        "conv_id", F.when(some, F.col("turn")).alias("turn"),
        F.when(some, F.coalesce(F.col("role"), F.lit(" "))).otherwise("").alias("role"),
        F.when(some, F.coalesce(F.col("text"), F.lit(" "))).otherwise("").alias("text"), n.cast("long").alias("copies"))
    body = F.rtrim("text", F.lit(SPACE))
    rows = (rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
            .withColumn("blank", body == "")
            .withColumn("cut", ~F.substring(body, -1, 1).isin(".", "!", "?"))
            .withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")))
            .withColumn("same", F.sha2(F.concat("role", F.lit("\0"), "text"), 256)))
    # only what occurs at several turns; the side that is joined has one row a key
    seen = (rows.where((F.col("copies") > 0) & ~F.col("blank")).groupBy(F.col("conv_id").alias("_c"), F.col("same").alias("_s"))
            .agg(F.min("at").alias("first"), F.count("*").alias("places")).where("places > 1"))
    return (rows.join(seen, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("same") == F.col("_s")), "left")
            .withColumn("again", F.coalesce(F.col("at") > F.col("first"), F.lit(False)))
            .select("conv_id", "turn", "role", "text", "copies", "blank", "again", "cut"))


def repair(conversations: DataFrame, copies: Column | None = None) -> Repaired:
    """Repair all conversations (conv_id, turn, role, text). ``copies`` says how often a
    row stands there; 0 only names its conversation."""
    spark = conversations.sparkSession
    bounded_batches(spark)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    turn = conversations.schema["turn"].dataType.simpleString()
    rows = judged_rows(conversations, copies)
    # a prefix of the text as the last range key: ranges stay in the order of the whole sort
    order = ["conv_id", "turn", "role", "text"]
    ranged = (rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64))
              .sortWithinPartitions(*order))
    fields = (f"conv_id {kind}, piece long, whole boolean, rows {ROWS}, repaired {TURNS}, low {turn}, high {turn}, turns long, "
              f"first string, last string, blank long, duplicate long, truncated long, illegal long, ways {WAYS}")
    schema = _arrow(fields, spark)
    found = materialize(ranged.mapInArrow(lambda b: _batches(_settle(_rows(b)), schema), fields))

    chosen_fields = "piece long, entry int, exit int, border long, same_turn long"
    chosen_schema = _arrow(chosen_fields, spark)
    parts = found.where(~F.col("whole"))
    chosen = materialize(
        parts.select("conv_id", "piece", "first", "last", "low", "high", "ways")
        .repartition("conv_id").sortWithinPartitions("conv_id", "piece")
        .mapInArrow(lambda b: _batches(_chain(_rows(b)), chosen_schema), chosen_fields))
    way = F.filter("ways", lambda w: (w["entry"] == F.col("entry")) & (w["exit"] == F.col("exit")))[0]
    settled = parts.join(chosen, "piece").withColumn("way", way)
    edit = F.udf(lambda rows, entry, audit: apply_edits([r.asDict() for r in rows], entry, audit), TURNS)
    pieces = found.where("whole").select("conv_id", "piece", "whole", "repaired").unionByName(
        settled.select("conv_id", "piece", "whole", edit("rows", "entry", "way.audit").alias("repaired")))

    counts = ["blank", "duplicate", "truncated"]
    whole = found.where("whole").select(
        "conv_id", "low", "high", "turns", *counts, "illegal", F.col("ways")[0]["cost"].alias("cost"), F.col("ways")[0]["audit"].alias("audit"))
    told = F.sort_array(F.collect_list(F.struct("piece", "way.audit")))
    long = (settled.groupBy("conv_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.col("turns") - F.col("same_turn")).alias("turns"),
        *[F.sum(c).alias(c) for c in counts], F.sum(F.col("illegal") + F.col("border")).alias("illegal"),
        F.sum("way.cost").alias("cost"), F.array_join(F.transform(told, lambda p: p["audit"]), "").alias("audit")))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    audit = whole.unionByName(long).select("conv_id", gaps.alias("gaps"), *counts, "illegal", "cost", "audit")
    return Repaired(audit, pieces)
