"""Long tags, sources and documents are read in a time that grows with their length, and in one pass."""

import contextlib
import io
import re
import time

import pytest
from pyspark.sql import functions as F

from strataweave.functions import apex, markup, xmlmeta
from strataweave.functions import text as tx
from strataweave.plans import pipeline

MB = 1_000_000


def timed(spark, raw, make):
    """The row that ``make`` gives of one text, and the seconds that it took beyond a short text."""
    took = []
    for text in (raw[:10], raw):
        df = make(spark.createDataFrame([(text,)], "raw_source string"))
        began = time.perf_counter()
        row = df.first()
        took.append(time.perf_counter() - began)
    return row, took[1] - took[0]


TAGS = {
    "a value of 1 MB": ("<p>x</p><img src='data:" + "A" * MB + "'><b>", 3),
    "many attributes": ("<p " + " ".join(f"a{i % 30000}='v{i}'" for i in range(60_000)) + "><i>", 2),
    "never closed": ("<a " * (MB // 3), 0),
    "an open quote each": ('<a "' * (MB // 4), 0),
    "quotes of both sorts": ("<a '\" \"" * (MB // 7), 0),
    "brackets in a value": ("<a t='" + "<b>" * (MB // 3) + "'>", 1),
}


@pytest.mark.parametrize("name", TAGS)
def test_long_tags(spark, name):
    raw, n = TAGS[name]
    row, seconds = timed(spark, raw, lambda df: df.select(F.size(markup.tags(F.col("raw_source"))).alias("n")))
    assert row.n == n and seconds < 15


def test_tags_are_cut_right(spark):
    text = """<a x="1>2" y='"'><B-c/><d e=f>< g><h <i j="k"></a><!-- <l> -->"""
    found = spark.createDataFrame([(text,)], "t string").select(markup.tags(F.col("t")).alias("t")).first().t
    assert [(t.tag, t.attributes) for t in found] == [("a", {"x": "1>2", "y": '"'}), ("B-c", {}), ("d", {}), ("i", {"j": "k"}), ("l", {})]


def test_the_last_of_repeated_attributes_holds(spark):
    got = spark.createDataFrame([("b='1' a='2' b=\"3\" c='' a='4'",)], "t string").select(tx.attributes(F.col("t")).alias("m")).first().m
    assert got == {"a": "4", "b": "3", "c": ""}


CLASS = "/** @tag x */ public class Foo extends Bar { public void go(String x) { y(); } private Integer n = 3; "
SOURCES = {
    "a tail without braces": (CLASS + "} " + "abc Def " * (5 * MB // 8), 1),
    "comments that never end": (CLASS + "} " + "/* " * (5 * MB // 3), 1),
    "many methods": (CLASS + "".join(f"public void m{i}(String a, Integer b) {{ c{i}(); }} " for i in range(3000)) + "} " + "Abc " * MB, 3001),
}


@pytest.mark.parametrize("name", SOURCES)
def test_long_classes(spark, name):
    raw, methods = SOURCES[name]
    row, seconds = timed(spark, raw, lambda df: apex.parse_classes(df).select("class_name", "extends", F.size("methods").alias("n"), "tags"))
    assert (row.class_name, row.extends, row.n, row.tags) == ("Foo", "Bar", methods, ["x"]) and seconds < 30


@pytest.mark.parametrize("tail", [" abc" * (5 * MB // 4), " abc (d" * (5 * MB // 7), " trigger" * (5 * MB // 8)])
def test_long_triggers(spark, tail):
    row, seconds = timed(spark, "trigger T on A (before insert, after update) { f(x); }" + tail, lambda df: df.select(*[c.alias(k) for k, c in apex.parse_trigger(F.col("raw_source")).items()]))
    assert (row.trigger_name, row.sobject, row.events) == ("T", "A", ["before insert", "after update"]) and seconds < 30


def test_words_after_the_tag_word(spark):
    text = "/** @tag one-two, @tag  b\n@tag\tc_3. @tagd @tag @tag -e @tag é */"
    row = spark.createDataFrame([(text,)], "t string").select(tx.tags_in(tx.doc_comments(F.col("t"))).alias("tags")).first()
    assert row.tags == ["one-two", "b", "c_3", "é"]


def test_references_are_whole_words(spark):
    text = "Abc abcDef A1_b éAbc Abcé X Xy Foo.Bar<Baz> String List9 Abc"
    row = spark.createDataFrame([(text,)], "t string").select(tx.type_references(F.col("t"), F.lit("Baz")).alias("r")).first()
    assert row.r == ["A1_b", "Abc", "Bar", "Foo", "List9"]


def test_comments_are_cut_as_far_as_they_end(spark):
    rows = [("a /* b */ c // d\ne /* f",), ("/*/ a */ b",), ("a */ b /* c */",), (None,), ("x",)]
    got = [r.s for r in spark.createDataFrame(rows, "t string").select(tx.strip_comments(F.col("t")).alias("s")).collect()]
    assert got == ["a   c \ne /* f", "  b", "a */ b  ", None, "x"]


FLOW = "<?xml version='1.0' encoding='ISO-8859-1'?><Flow><x><label>no</label></x><label> Ä &amp; b </label><recordUpdates><object>B</object><name>u</name></recordUpdates><recordLookups><object>A</object></recordLookups><recordUpdates><object>C</object></recordUpdates><loops/><loops> </loops><loops></loops><loops><!-- c --></loops><variables><name>v</name><name>w</name><isInput>true</isInput></variables><variables/></Flow>"


def test_document_order_and_counts(spark):
    row = spark.createDataFrame([(FLOW,)], "x string").select(*[c.alias(k) for k, c in xmlmeta.parse_flow(F.col("x"), F.lit("F")).items()]).first()
    assert row.label == "Ä & b" and row.loops == 2
    assert [(o.operation, o.object) for o in row.record_operations] == [("update", "B"), ("lookup", "A"), ("update", "C")]
    assert [(v.name, v.is_input, v.is_output) for v in row.variables] == [("w", True, False)]


def test_one_reading_a_document(spark):
    """However many columns ask, a plan reads the document once."""
    df = spark.range(3).select(F.lit(FLOW).alias("raw_source"), F.col("id").cast("string").alias("stem"))
    parsed = df.withColumn("bad", xmlmeta.is_malformed(F.col("raw_source"))).withColumns(xmlmeta.parse_flow(F.col("raw_source"), F.col("stem")))
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("read_document(") == 1 + plan.split("ArrowEvalPython", 1)[0].count("read_document(")


def test_a_long_document(spark):
    raw = "<Flow>" + "".join(f"<variables><name>v{i}</name><dataType>String</dataType></variables>" for i in range(30_000)) + "</Flow>"
    row, seconds = timed(spark, raw, lambda df: df.select(F.size(xmlmeta.parse_flow(F.col("raw_source"), F.lit("F"))["variables"]).alias("n")))
    assert row.n == 30_000 and seconds < 20


def test_no_text_is_shuffled_for_a_snapshot(spark, sf):
    """With joins that must shuffle, exchanges carry keys and hashes only."""
    from strataweave import queries as core

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("freshness_semi", "freshness_anti", "cache_upsert", "hash_diff"):
            plan = io.StringIO()
            with contextlib.redirect_stdout(plan):
                core.queries()[name](spark, sf).explain("formatted")
            inputs = re.findall(r"\) Exchange[^\n]*\nInput[^\n]*", plan.getvalue())
            assert inputs and not any("text#" in x for x in inputs), (name, inputs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_kinds_of_columns(spark):
    from strataweave.sources import files as src

    names = ["a.cls", "x/y", "a.flow-meta.xml", "plain", "b\\c", None]
    got = spark.createDataFrame([(n,) for n in names], "t string").select("t", src.kind_column(F.col("t")).alias("k"), src.path_column(F.col("t")).alias("p")).collect()
    assert [(r.k, r.p) for r in got] == [(None if n is None else src.kind_of(n), None if n is None else src.is_path(n)) for n in names]
    assert pipeline.Filters().kinds == []
