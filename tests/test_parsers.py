"""Parsers and text functions on small sources."""

import pytest
from pyspark.sql import functions as F

from strataweave.functions import apex, markup, xmlmeta
from strataweave.functions import text as tx


def one(spark, raw, cols):
    df = spark.createDataFrame([(raw,)], "raw_source string")
    return df.select(*[c.alias(k) for k, c in cols.items()]).first().asDict(True)


def cls(spark, raw):
    return apex.parse_classes(spark.createDataFrame([(raw,)], "raw_source string")).first().asDict(True)


def test_empty_sources_give_defaults(spark):
    for raw in ("", "  \n", "not a class"):
        c = cls(spark, raw)
        assert c["class_name"] == "" and c["methods"] == [] and c["extends"] is None and not c["is_interface"]
    assert one(spark, "", apex.parse_trigger(F.col("raw_source")))["events"] == []
    for parse in (lambda c: xmlmeta.parse_flow(c, F.lit("A_b")), lambda c: xmlmeta.parse_page(c, F.lit("p")), lambda c: xmlmeta.parse_rule(c, F.lit("r"), F.lit("o"))):
        for raw in ("", "<x/>", "<a><b></a>"):
            assert one(spark, raw, parse(F.col("raw_source")))["description"] == ""
    assert one(spark, "", xmlmeta.parse_flow(F.col("raw_source"), F.lit("A_b")))["label"] == "A b"
    assert one(spark, "", xmlmeta.parse_rule(F.col("raw_source"), F.lit("r"), F.lit("o")))["active"] is True


def test_overloads_are_kept_and_equal_neighbours_are_not(spark):
    body = "public void a(String x) {} public void a(Integer x) {} public void a(Integer y) {} public void b() {}"
    assert [(m["name"], [p["param_type"] for p in m["params"]]) for m in cls(spark, f"public class C {{ {body} }}")["methods"]] == [("a", ["String"]), ("a", ["Integer"]), ("b", [])]


def test_interface_methods(spark):
    c = cls(spark, "global interface Shape extends Base, Other {\n  Double area();\n  void move(Integer dx, Integer dy);\n}")
    assert c["is_interface"] and c["extends"] == "Base, Other" and [m["name"] for m in c["methods"]] == ["area", "move"]


def test_modifiers_tags_and_annotations(spark):
    c = cls(spark, "/** @tag one-two\n @tag three */ public abstract inherited sharing class C { @future public static void f() {} // public void no() {}\n private static final Integer N = 1; }")
    assert c["is_abstract"] and not c["is_virtual"] and c["tags"] == ["one-two", "three"]
    assert [(m["name"], m["access_modifier"], m["return_type"]) for m in c["methods"]] == [("f", "@future", "public static void")]
    assert [(p["name"], p["is_static"]) for p in c["properties"]] == [("N", True)]


def test_all_trigger_events(spark):
    text = ", ".join(e.title() for e in tx.TRIGGER_EVENTS) + ", before undelete, before  insert"
    assert one(spark, f"TRIGGER T on A ({text}) {{}}", apex.parse_trigger(F.col("raw_source")))["events"] == list(tx.TRIGGER_EVENTS)


def test_object_fields_and_nested_labels(spark):
    assert one(spark, "<O><a><label>no</label></a><label>yes</label></O>", xmlmeta.parse_object(F.col("raw_source"), F.lit("O")))["label"] == "yes"
    f = one(spark, "<F><fullName>a__c</fullName><type>Lookup</type><referenceTo>X</referenceTo><required>true</required><label>L</label></F>", xmlmeta.parse_field(F.col("raw_source"), F.lit("s")))
    assert (f["api_name"], f["field_type"], f["reference_to"], f["required"], f["label"]) == ("a__c", "Lookup", "X", True, "L")
    assert one(spark, "<F/>", xmlmeta.parse_field(F.col("raw_source"), F.lit("s")))["api_name"] == "s"


def test_component_names_are_claimed_once(spark):
    cols = markup.parse_component(F.col("raw_source"), F.lit("<slot/><slot name='a'></slot><slot name='a'></slot>"))
    c = one(spark, "@api x; @api x; @api get y() {} @api z() {} @api z;", cols)
    assert c["api_props"] == [{"name": "x", "is_method": False}, {"name": "y", "is_method": False}, {"name": "z", "is_method": True}] and c["slots"] == ["a", "default"]
    assert one(spark, "", markup.parse_component(F.col("raw_source"), F.lit(None).cast("string")))["slots"] == []


def test_attributes_last_wins_and_empty_name_does_not_fall_through(spark):
    a = one(spark, "<aura:attribute name='a' name=\"b\" type='T'/><aura:handler name='' event='e'/><aura:handler type='t'/>", markup.parse_aura(F.col("raw_source")))
    assert [x["name"] for x in a["attributes"]] == ["b"] and a["events_handled"] == ["t"] and a["extends"] is None


@pytest.mark.parametrize(("pattern", "name", "fits"), [("*Service", "OrderService", True), ("Order*", "OrderService.cls", True), ("order*", "OrderService", False), ("a?c", "abc", True), ("[!a]*", "abc", False), ("a.c", "abc", False)])
def test_globs(spark, pattern, name, fits):
    assert spark.range(1).select(tx.glob_matches(pattern, F.lit(name))).first()[0] is fits


def test_bad_glob():
    with pytest.raises(ValueError, match="unclosed"):
        tx.glob_regex("a[b")


def test_small_functions(spark):
    row = lambda c: spark.range(1).select(c).first()[0]
    assert row(tx.folder_of(F.lit("/r/a/b/x.cls"), "/r")) == "a/b" and row(tx.folder_of(F.lit("/other/x"), "/r")) == ""
    assert row(tx.path_part(F.lit("x"), 3)) == "Unknown"
    assert row(tx.kebab_to_camel(F.lit("my-big--thing"))) == "myBigThing"
    assert row(tx.sanitize_filename(F.lit("a b/é:x-1_.md"))) == "abéx-1_.md"
    assert row(tx.strip(F.lit(" \n a b\t"))) == "a b"
    assert row(tx.retry_after(F.lit("2.1"))) == 4 and row(tx.retry_after(F.lit("soon"))) is None
    assert row(tx.retry_hint(F.lit("x Retry in 7s"))) == 8
    for attempt, (low, high) in enumerate([(2, 4), (5, 10), (10, 20), (20, 40)]):
        assert tuple(row(tx.backoff_bounds(F.lit(attempt)))) == (low, high)
        assert low <= row(tx.retry_delay(F.lit(None).cast("string"), F.lit(""), F.lit(attempt))) <= high
    assert row(tx.preview(F.lit("éa" * 3), 4)).startswith("éaéa\n") and row(tx.preview(F.lit("ab"), 4)) == "ab"
    assert row(tx.quota_exhausted(F.lit("x limit: 0 y")))
    assert row(tx.has_any_tag(F.array(F.lit("Core")), [])) and row(tx.has_any_tag(F.array(F.lit("Core")), ["cORE"])) and not row(tx.has_any_tag(tx.none(), ["a"]))
