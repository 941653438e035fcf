"""Of a large tree names are joined, dealt out and counted by executors, texts are read once where they are parsed, and the driver keeps no file's status."""

import os

import pytest
from pyspark.sql import functions as F

from strataweave import flow_queries as fq
from strataweave.plans import cache, pipeline
from strataweave.sources import files as src

FILES = {
    "lwc/one/one.js-meta.xml": "<x/>", "lwc/one/one.js": "@api a;", "lwc/one/one.html": "<template><slot></slot></template>", "lwc/two/two.js-meta.xml": "<y/>", "lwc/two/other.html": "<template/>",
    "lwc/bad/bad.js-meta.xml": "<z/>", "classes/A.cls": "public class A {}", "triggers/T.trigger": "trigger T on O (before insert) {}",
}
QUERIES = ("prompt_lwc", "script_fallback", "ordered_scan", "scan_by_tag", "scan_tree", "resolve_targets", "rule_files", "record_files", "page_files", "prompt_flexipages", "prompt_triggers", "trigger_files", "prompt_flows", "apex_files", "prompt_apex", "scan_field_files")


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "lwc/bad/bad.html").write_bytes(b"\xff")
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def _rows(df):
    return sorted(map(str, df.select("name", "hash", "slots", "html", "raw_source").collect()))


def test_components_meet_their_markup_by_name(spark, root, monkeypatch):
    small = _rows(pipeline.metadata(spark, root)["lwc"])
    assert sum("html=None" in r for r in small) == 2  # of another name, and not UTF-8
    monkeypatch.setattr(src, "FEW_ENTRIES", 3)
    tree = src.walk(spark, root)
    table = pipeline.metadata(spark, tree)["lwc"]
    assert _rows(table) == small == _rows(pipeline.parse(spark, "lwc", src.scan(spark, tree, "lwc"), tree))
    assert _plan(table).count("MapInArrow") == 1  # script, markup and description are read where they are parsed, after all joins


def test_parsed_tables_are_in_no_order(spark, root, monkeypatch):
    monkeypatch.setattr(src, "FEW_ENTRIES", 3)
    tree = src.walk(spark, root)
    assert not [k for k, df in pipeline.metadata(spark, tree).items() if "Sort [filename" in _plan(df)]
    assert "Sort [filename" in _plan(src.scan(spark, tree, "apex"))


def test_a_level_is_counted_as_it_is_written(spark, root, monkeypatch):
    monkeypatch.setattr(src, "FEW_ENTRIES", 3)
    spark.sparkContext.setJobGroup("a walk", "a walk")
    try:
        tree = src.walk(spark, root)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("a walk")) <= 3 * 2  # of each level its folders are dealt out and listed
    found = {r.ending: r.n for r in tree.listing.groupBy("ending").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {e: n for e, n in tree.counts.items() if n} == found and found[".html"] == 3


def test_nothing_is_looked_up_in_an_empty_snapshot(spark, tmp_path):
    work = spark.createDataFrame([("apex", "p", "h")], "kind string, path string, hash string")
    todo, ready = cache.split(work, cache.load(spark, f"{tmp_path}/none"), "m")
    assert "Join" not in todo._jdf.queryExecution().optimizedPlan().toString()
    assert todo.count() == 1 and ready.count() == 0


@pytest.mark.parametrize("query", QUERIES)
def test_no_statuses_on_the_driver(spark, sf, query, monkeypatch):
    fq.tree(spark, sf)
    small = sorted(map(str, fq.QUERIES[query](spark, sf).collect()))
    monkeypatch.setattr(src, "FEW_ENTRIES", 3)
    df = fq.QUERIES[query](spark, sf)
    assert "binaryFile" not in _plan(df) and sorted(map(str, df.collect())) == small
