"""URL rules and revisit records against plain Python."""

import random
import re

import pytest

from strataweave.llm import common
from strataweave.llm import url_rules as ur
from strataweave.llm import warc_revisit as wr

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("example.org", "/en/12", "allow"), ("a.example.org", "/en/", "block"), ("com", "/fr/", "allow"), ("COM", "/de/", "block"), ("com", "/de/", "allow"), (None, "/", "block"), ("net", "", "block"), ("deep.a.b.c.d.net", "/x", "allow")]
URLS = ["http://example.org/es/1", "https://X.Example.ORG/en/1?q#f", "http://a.example.org/en/123", "http://org", "http://org/", "ftp://b.com/de/", "http://com/fr/x", "no scheme", None, "", "http://", "http:///p", "http://notexample.org/es/", "http://example.org/ES/", "x://y://example.org/es/", "http://a.b.c.deep.a.b.c.d.net/x/y", "http://net", "http://...net/", "http://example.org/en/1", "http://é.example.org/es/ü"]


def plain(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in ((h.lower(), p, v) for h, p, v in rules if h) if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("rules", [RULES, []])
def test_rules(spark, rules):
    rows = [(i, u, "x", 1) for i, u in enumerate(URLS + URLS[:3])] + [(None, URLS[0], "x", 1), (0, URLS[0], "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, key int").repartition(3)
    got = ur.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, *plain(u, rules))) for i, u, *_ in rows)
    assert ur.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_random_nested_rules(spark):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choices("ab", k=rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choices("xy/", k=rng.randint(0, 4)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(60)]
    seen = {}
    rules = [r for r in rules if seen.setdefault(r[:2], r) is r]
    urls = [(i, f"http://{host()}{path()}") for i in range(300)]
    got = ur.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain(u, rules) for i, u in urls}


def test_ordered_last_over_many_ranges(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 5), i, rng.choice([None, None, None, i])) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = common.ordered_last(spark.createDataFrame(rows, "k int, i int, v int"), ["k", "i"], "v", "last").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    last, want = None, {}
    for k, i, v in sorted(rows, key=lambda r: r[:2]):
        last = v if v is not None else last
        want[i] = last
    assert {r.i: r["last"] for r in got} == want


HEAD = lambda **h: [(k.replace("_", "-"), v) for k, v in h.items()]
RECORDS = [
    ("f1", "response", "http://A.org/x#f", 10, 200, HEAD(ETag='"1"', Content_Type="text/html", Cache_Control="old"), "d1"),
    ("f2", "response", "http://a.org:80/x", 20, 200, HEAD(ETag='W/"2"', Last_Modified="Mon"), "d2"),
    ("f3", "response", "http://a.org/x", 20, 200, HEAD(ETag='"3"'), "d3"),
    ("e1", "response", "http://a.org/x", 25, 404, HEAD(ETag='"4"'), "d4"),
    ("f5", "response", "http://b.org", 5, 200, HEAD(Last_Modified="Tue"), "d5"),
    ("f6", "response", "http://c.org/", 5, 200, None, "d6"),
    ("f7", "response", "http://d.org/", None, 200, HEAD(ETag='"7"'), "d7"),
    ("r1", "revisit", "http://a.org/x", 15, 304, HEAD(etag='"1"', cache_control="new", content_type="no"), None),
    ("r2", "revisit", "http://a.org/x", 10, 304, HEAD(etag='"1"'), None),
    ("r3", "revisit", "http://a.org/x", 30, 304, HEAD(etag='"3"'), None),
    ("r3", "revisit", "http://a.org/x", 30, 304, HEAD(etag='"3"'), None),
    ("r4", "revisit", "http://a.org/x", 31, 304, HEAD(etag='"9"'), None),
    ("r5", "revisit", "http://b.org/", 9, 304, HEAD(last_modified="Tue", expires="now"), None),
    ("r6", "revisit", "http://c.org", 9, 304, HEAD(etag='"1"'), None),
    ("r7", "revisit", None, 9, 304, None, None),
    ("r8", "revisit", "http://a.org/x", None, 304, None, None),
    ("r9", "revisit", "http://d.org/", 99, 304, HEAD(etag='"7"'), None),
    (None, "revisit", "https://a.org/x", 99, None, HEAD(etag='"1"'), None),
]
SCHEMA = "record_id string, kind string, url string, date long, status int, headers array<struct<name:string,value:string>>, payload_digest string"


def test_revisits(spark):
    frame = spark.createDataFrame(RECORDS, SCHEMA).selectExpr("*", "'x' as outcome", "1 as _part", "'y' as response").repartition(3)
    got = [(r.record_id, r.outcome, r.response_id, r.payload_digest) for r in wr.resolve(frame).collect()]
    want = [("r1", "resolved", "f1", "d1"), ("r2", "missing", None, None), ("r3", "resolved", "f3", "d3"), ("r3", "resolved", "f3", "d3"), ("r4", "changed", None, None), ("r5", "resolved", "f5", "d5"), ("r6", "unverified", "f6", "d6"), ("r7", "missing", None, None), ("r8", "missing", None, None), ("r9", "missing", None, None), (None, "missing", None, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    heads = {r.record_id: [tuple(h) for h in r.headers] for r in wr.resolve(frame).collect() if r.headers}
    assert heads["r1"] == [("cache-control", "new"), ("content-type", "text/html"), ("etag", '"1"')]
    assert heads["r5"] == [("expires", "now"), ("last-modified", "Tue")]
    assert wr.resolve(frame.limit(0)).count() == 0
    one = wr.with_payload(wr.resolve(frame).drop("payload_digest"), frame, "payload_digest")
    assert one.where("record_id = 'r1'").first().payload_digest == "d1"
    strict = {r.record_id: r for r in wr.resolve(frame, strict=True).collect()}
    assert strict["r6"].outcome == "unverified" and strict["r6"].response_id is None and strict["r6"].headers is None and strict["r1"].response_id == "f1"


@pytest.mark.parametrize(("url", "canonical"), [
    ("HTTP://User:Pa@H.org:80/a#f", "http://User:Pa@h.org/a"), ("http://user:pa@h.org/a", "http://user:pa@h.org/a"), ("https://h.org:443?q=%7ea%2f%C3%a9%zz%4", "https://h.org/?q=~a%2F%C3%A9%zz%4"),
    ("http://h.org/%41%2D%20b", "http://h.org/A-%20b"), ("http://h.org/a@b", "http://h.org/a@b"), ("http://h.org/~u?x=a@b%2", "http://h.org/~u?x=a@b%2"), ("//h.org/", None), ("", None), (None, None),
])
def test_canonical_urls(spark, url, canonical):
    assert spark.createDataFrame([(url,)], "u string").select(wr.canonical_url("u")).first()[0] == canonical


def test_captures_of_pages_with_nulls(spark):
    pages = spark.createDataFrame([(None, "http://a.org/", "x"), (1, None, "x"), (2, "http://a.org/", None), (2, "http://a.org/", None)], "page_id long, url string, html string")
    got = sorted((str(r.record_id), r.outcome, r.response_id) for r in wr.resolve(wr.captures(pages)).collect())
    assert got == [("1-revisit", "missing", None), ("2-revisit", "resolved", "2-response"), ("2-revisit", "resolved", "2-response"), ("None", "missing", None)]
    assert wr.captures(pages.limit(0)).count() == 0
