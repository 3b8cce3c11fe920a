"""Date parsing over a list of formats without exception-driven misses.

``try_to_timestamp`` with a non-matching format fails internally (costly per
value), so every format is first gated by a cheap shape regex derived from the
format itself; only values that can match are parsed."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = [("yyyy", r"\d{4}"), ("yy", r"\d{2}"), ("MMMM", r"\p{L}{3,}"), ("MMM", r"\p{L}{3}"),
           ("MM", r"\d{1,2}"), ("M", r"\d{1,2}"), ("dd", r"\d{1,2}"), ("d", r"\d{1,2}"),
           ("HH", r"\d{1,2}"), ("H", r"\d{1,2}"), ("mm", r"\d{2}"), ("ss", r"\d{2}"),
           ("SSSSSS", r"\d{1,9}"), ("SSS", r"\d{1,9}")]


def shape_regex(fmt: str) -> str:
    """``dd/MM/yyyy`` -> ``^\\d{1,2}/\\d{1,2}/\\d{4}$`` (quoted literals kept)."""
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "'":
            j = fmt.index("'", i + 1)
            out.append(re.escape(fmt[i + 1:j]))
            i = j + 1
            continue
        for tok, rx in _TOKENS:
            if fmt.startswith(tok, i):
                out.append(rx)
                i += len(tok)
                break
        else:
            out.append(re.escape(fmt[i]))
            i += 1
    return "^" + "".join(out) + "$"


# a number in the forms Python's float() reads (plus signs, exponent); used to gate casts
NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
SPECIAL_FLOATS = ["nan", "+nan", "-nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]


def try_number(s: Column) -> Column:
    """``try_cast(double)`` only for number-shaped text: failing casts never run."""
    t = F.trim(s)
    ok = t.rlike(NUMBER_SHAPE) | F.lower(t).isin(*SPECIAL_FLOATS)
    return F.when(ok, t.try_cast("double"))


def parse_formats(s: Column, formats: list[str]) -> Column:
    """First format (in list order) that parses ``s``; NULL when none does. One
    combined shape test screens out non-dates before any per-format work."""
    shapes = [shape_regex(f) for f in formats]
    any_shape = "|".join(f"(?:{x})" for x in shapes)
    return F.when(s.rlike(any_shape), F.coalesce(*[F.when(s.rlike(x), F.try_to_timestamp(s, F.lit(f)))
                                                  for x, f in zip(shapes, formats)]))
