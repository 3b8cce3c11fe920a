"""Operator 6, WARC not-modified revisits: an as-of join by canonical url.

A revisit record of the server-not-modified kind has headers but no payload. It is
resolved by the latest full response of the same canonical url that is strictly earlier;
that response's validators must agree with the revisit's, and the stored headers are
updated with those that a 304 answer may change.

Responses and revisits are sorted together by (canonical url, time) into range slices of
bounded size. Each slice is swept once, carrying the last full response; what a slice
needs from those before it is one row. A url that holds a third of all records is cut
into many slices like any other stretch of the order. All of it is DataFrame code.

Validators: entity tags are compared weakly (``W/`` is dropped). If the revisit has no
tag, the Last-Modified dates must be equal. A revisit with neither is resolved only by a
response that has neither.

Defined cases: a null url gives ``no_url``; no earlier full response gives
``no_response``; a validator that differs gives ``mismatch``, one that lacks on either
side gives ``no_validator``, and none of these is resolved by an older response; a
response is full with status 200 and a payload digest; of responses at the same time the
one with the larger id wins; a null time never is a source and is never resolved
(``no_response``); header names are compared in lower case, the last of a repeated name
counts; null headers are none; repeated revisits are each returned; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import carry_last, range_slices

#: Headers that describe the stored payload or one connection, which an
#: answer without payload does not change.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-md5", "content-range",
                "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer",
                "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Host without scheme, ``www.`` and default port; path without closing slashes; query
    sorted, without tracking parameters (``utm_``); no fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "(?s)#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    parts = F.split(F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(parts, lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def lower_names(headers: Column) -> Column:
    """The header map with lower-case names; of names that fall together the last counts."""
    entries = F.coalesce(F.map_entries(headers), F.expr("cast(array() as array<struct<key:string,value:string>>)"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    value = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, value))


def merge_headers(stored: Column, update: Column) -> Column:
    allowed = F.map_filter(update, lambda k, v: ~k.isin(*KEPT_HEADERS) & v.isNotNull())
    return F.map_zip_with(stored, allowed, lambda k, a, b: F.coalesce(b, a))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` has record_id, kind (``response`` or ``revisit``), url, ts, status,
    headers (map) and payload_digest. One row per revisit: record_id, url_key, ts,
    outcome (``resolved`` or the reason why not), and for resolved ones refers_to,
    refers_to_ts, payload_digest and the merged headers."""
    full = ((F.col("kind") == "response") & (F.col("status") == 200) & F.col("payload_digest").isNotNull()
            & F.col("ts").isNotNull() & F.col("url").isNotNull())
    rows = (records.where(full | (F.col("kind") == "revisit"))
            .select(canonical_url(F.col("url")).alias("url_key"), "ts",
                    F.when(F.col("kind") == "revisit", 0).otherwise(1).alias("_full"), "record_id",
                    F.monotonically_increasing_id().alias("_row"),  # cuts repeated rows as well
                    lower_names(F.col("headers")).alias("headers"), "payload_digest"))
    order = ["url_key", "ts", "_full", "record_id", "_row"]
    source = F.when(F.col("_full") == 1, F.struct("url_key", "record_id", "ts", "headers", "payload_digest"))
    # at equal times revisits sort first, so what was carried to them is strictly earlier
    joined = carry_last(range_slices(rows, order), order, source, "_s").where(F.col("_full") == 0)

    fits = F.col("ts").isNotNull() & (F.col("_s.url_key") == F.col("url_key"))
    tag = lambda h: F.regexp_replace(F.element_at(h, F.lit("etag")), "^W/", "")
    date = lambda h: F.element_at(h, F.lit("last-modified"))
    mine, stored = F.col("headers"), F.col("_s.headers")

    def compared(a: Column, b: Column) -> Column:
        return F.when(b.isNull(), "no_validator").when(a == b, "resolved").otherwise("mismatch")

    neither = F.when(tag(stored).isNull() & date(stored).isNull(), "resolved").otherwise("no_validator")
    outcome = (F.when(F.col("url_key").isNull(), "no_url")
               .when(~F.coalesce(fits, F.lit(False)), "no_response")
               .when(tag(mine).isNotNull(), compared(tag(mine), tag(stored)))
               .when(date(mine).isNotNull(), compared(date(mine), date(stored)))
               .otherwise(neither))
    told = joined.withColumn("outcome", outcome)
    if_resolved = lambda c: F.when(F.col("outcome") == "resolved", c)
    return told.select("record_id", "url_key", "ts", "outcome",
                       if_resolved(F.col("_s.record_id")).alias("refers_to"),
                       if_resolved(F.col("_s.ts")).alias("refers_to_ts"),
                       if_resolved(F.col("_s.payload_digest")).alias("payload_digest"),
                       if_resolved(merge_headers(stored, mine)).alias("headers"))


def header_text(headers: Column) -> Column:
    """``name: value`` lines in the order of the names."""
    lines = F.transform(F.array_sort(F.map_keys(headers)), lambda k: F.concat(k, F.lit(": "), F.coalesce(F.element_at(headers, k), F.lit(""))))
    return F.array_join(lines, "\n")
