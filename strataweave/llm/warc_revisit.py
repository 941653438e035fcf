"""WARC not-modified revisits: an as-of join to the latest earlier full response.

Records are sorted by canonical URL and date over range partitions and swept
once (``ordered_last``); each revisit meets the last full response before it. A
URL with a third of all captures is cut at dates like any other. If the
revisit's validators agree with the response's, the stored headers are brought
up to date with those that a not-modified answer may send.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, ordered_last

#: Header fields that a 304 answer may send to update a stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
HEADERS = "array<struct<name:string,value:string>>"


#: Characters that mean the same with and without percent-encoding.
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def _decoded(part: Column) -> Column:
    """Percent-encoded unreserved characters as themselves, other codes in upper case."""

    def one(p: Column, i: Column) -> Column:
        code, rest = F.upper(F.substring(p, 1, 2)), F.substr(p, F.lit(3))
        char = F.char(F.conv(code, 16, 10).cast("int"))
        plain = F.when(F.contains(F.lit(UNRESERVED), char), char).otherwise(F.concat(F.lit("%"), code))
        coded = p.rlike("^[0-9A-Fa-f]{2}")
        return F.when(i == 0, p).when(coded, F.concat(plain, rest)).otherwise(F.concat(F.lit("%"), p))

    return F.when(F.contains(part, F.lit("%")), F.array_join(F.transform(F.split(part, "%"), one), "")).otherwise(part)


def canonical_url(url: str) -> Column:
    """One text for URLs that mean the same; null without ``://``.

    Scheme and host A-Z lower-cased (not the user before an ``@``), default ports
    and fragment gone, an empty path as ``/``, unreserved characters decoded.
    """
    bare = F.regexp_replace(F.col(url), "(?s)#.*$", "")
    part = lambda i: F.regexp_extract(bare, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?]*@)?([^/?@]*)([^?]*)(.*)$", i)
    scheme, host = ascii_lower(part(1)), ascii_lower(part(3))
    port = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.when(part(4) == "", F.lit("/")).otherwise(_decoded(part(4)))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), part(2), port, path, _decoded(part(5))))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, names compared without case; null if absent."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def merged_headers(stored_headers: Column, sent: Column) -> Column:
    """Permitted fields as sent, the stored response's others; by name, then value."""
    low = lambda hs: F.transform(F.coalesce(hs, F.array().cast(HEADERS)), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    new = F.filter(low(sent), lambda h: h["name"].isin(*PERMITTED))
    old = F.filter(low(stored_headers), lambda h: ~F.exists(new, lambda n: n["name"].eqNullSafe(h["name"])))
    return F.array_sort(F.concat(old, new))


def resolve(records: DataFrame, kept: tuple[str, ...] = ("payload_digest",), strict: bool = False) -> DataFrame:
    """One row per revisit of ``records(record_id, kind, url, date, status, headers, ...)``.

    ``kind`` is ``response`` or ``revisit``; a full response has status 200, a
    canonical URL and a date. Returns ``record_id``, the canonical ``url``,
    ``outcome``, ``response_id``, the merged ``headers`` and the columns ``kept``
    of the response. ``outcome`` is

    * ``resolved``: the response is the latest strictly earlier one, and the
      entity tags agree (a weak mark ignored), or, where one side has no tag,
      the last-modified dates do;
    * ``unverified``: there is such a response but no validator that both have;
      taken like resolved, with ``strict`` not taken;
    * ``changed``: a validator differs; nothing is taken from the response;
    * ``missing``: no earlier full response, or no URL or date.

    Of responses with one date the largest record_id counts as the latest. Equal
    revisits are each resolved. An empty table gives an empty result; further
    columns are ignored.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("curl").isNotNull() & F.col("date").isNotNull()
    body = F.struct(F.col("curl").alias("url"), F.col("record_id").alias("id"), F.col("headers").cast(HEADERS).alias("headers"), *kept)
    events = records.withColumn("curl", canonical_url("url")).where((F.col("kind") == "revisit") | full)
    events = events.select(
        F.col("curl").alias("url"), "date", F.when(full, 1).otherwise(0).alias("is_full"), "record_id",
        F.when(~F.coalesce(full, F.lit(False)), F.col("headers").cast(HEADERS)).alias("sent"), F.when(full, body).alias("response"),
    )
    # at one date revisits come first: only strictly earlier responses count
    swept = ordered_last(events, ["url", "date", "is_full", "record_id"], "response", "r").where("is_full = 0")
    found = (F.col("r.url") == F.col("url")) & F.col("date").isNotNull()
    tag = lambda hs: F.regexp_replace(header(hs, "etag"), "^W/", "")
    same_tag = tag(F.col("sent")) == tag(F.col("r.headers"))
    same_date = header(F.col("sent"), "last-modified") == header(F.col("r.headers"), "last-modified")
    same = F.coalesce(same_tag, same_date)
    outcome = F.when(~F.coalesce(found, F.lit(False)), "missing").when(same, "resolved").when(~same, "changed").otherwise("unverified")
    taken = F.col("outcome").isin("resolved", *[] if strict else ["unverified"])
    return swept.withColumn("outcome", outcome).select(
        "record_id", "url", "outcome", F.when(taken, F.col("r.id")).alias("response_id"),
        F.when(taken, merged_headers(F.col("r.headers"), F.col("sent"))).alias("headers"), *[F.when(taken, F.col(f"r.{c}")).alias(c) for c in kept],
    )


def with_payload(resolved: DataFrame, records: DataFrame, payload: str = "payload") -> DataFrame:
    """``resolved`` with the response's payload; records are joined by their id."""
    of = records.where("kind = 'response'").select(F.col("record_id").alias("response_id"), payload)
    return resolved.join(of, "response_id", "left")


def captures(pages: DataFrame) -> DataFrame:
    """Records made of raw pages: a full response a minute each, and a not-modified revisit.

    The revisit comes a day later, for every eleventh page a day earlier. It
    sends the page's entity tag, for every seventh another one, for every fifth
    none. Pages that share a URL make a history of it. A null page_id gives
    records without id and date: no response counts, and the revisit is missing.
    A null html counts as empty, and a null url has no canonical one.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    item = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    id_, at = F.col("page_id").cast("string"), F.col("page_id") * 60
    sent = F.when(F.col("page_id") % 7 == 0, F.lit('"changed"')).otherwise(tag)
    modified = item("Last-Modified", (F.col("page_id") * 60).cast("string"))
    full = F.struct(
        F.concat(id_, F.lit("-response")).alias("record_id"), F.lit("response").alias("kind"), at.alias("date"), F.lit(200).alias("status"),
        F.array(item("ETag", tag), modified, item("Cache-Control", F.lit("max-age=60")), item("Content-Type", F.lit("text/html"))).alias("headers"),
    )
    plain = F.array(modified, item("Cache-Control", F.lit("max-age=120")), item("Content-Type", F.lit("text/plain")))
    again = F.struct(
        F.concat(id_, F.lit("-revisit")).alias("record_id"), F.lit("revisit").alias("kind"), (at + F.when(F.col("page_id") % 11 == 0, -86400).otherwise(86400)).alias("date"), F.lit(304).alias("status"),
        F.when(F.col("page_id") % 5 == 0, plain).otherwise(F.concat(plain, F.array(item("ETag", sent)))).alias("headers"),
    )
    return pages.select("url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("payload_digest"), F.explode(F.array(full, again)).alias("r")).select("url", "payload_digest", "r.*")
