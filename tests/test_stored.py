"""A build reads its tree once and stores what it made; texts that several files share are looked up once."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from strataweave import flow_queries as fq
from strataweave.plans import pipeline, render
from strataweave.sources import files as src
from strataweave.sources import scratch, store

FILES = {
    "classes/A.cls": "public class A {}", "classes/B.cls": "public class B {}", "triggers/T.trigger": "trigger T on O (before insert) { A.x(); }",
    "lwc/one/one.js-meta.xml": "<x/>", "lwc/one/one.js": "@api a;", "lwc/one/one.html": "<template><slot></slot></template>", "objects/O/O.object-meta.xml": "<CustomObject><label>O</label></CustomObject>",
    "objects/P/P.object-meta.xml": "<CustomObject><label>P</label></CustomObject>", "objects/O/fields/B__c.field-meta.xml": "<CustomField><fullName>B__c</fullName></CustomField>", "objects/O/fields/A__c.field-meta.xml": "<CustomField><fullName>A__c</fullName></CustomField>",
}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        os.makedirs((tmp_path / "tree" / name).parent, exist_ok=True)
        (tmp_path / "tree" / name).write_text(text)
    return str(tmp_path / "tree")


def test_pages_need_no_source_any_more(spark, root, tmp_path):
    first = pipeline.build(spark, root, f"{tmp_path}/snapshot")
    second = pipeline.build(spark, root, f"{tmp_path}/snapshot")
    one = pipeline.update(spark, "A", root, f"{tmp_path}/snapshot")
    shutil.rmtree(root)
    pages = sorted(map(tuple, first.pages.collect()))
    assert [p[:2] for p in pages] == [("apex", "A"), ("apex", "B"), ("index", "index"), ("lwc", "one"), ("objects", "O"), ("objects", "P"), ("triggers", "T")]
    assert sorted(map(tuple, second.pages.collect())) == pages
    assert sorted(map(tuple, one.pages.collect())) == [p for p in pages if p[1] in ("A", "index")]


def test_field_files_are_read_once(spark, root):
    table = pipeline.parse(spark, "objects", src.scan(spark, root, "objects"), root)
    assert table._jdf.queryExecution().sparkPlan().toString().count("FileScan binaryFile") == 2  # objects and fields
    rows = {r.name: r for r in table.select("name", "hash", F.col("fields.api_name").alias("fields")).collect()}
    text = "".join(FILES[f"objects/O/{p}"] for p in ("O.object-meta.xml", "fields/A__c.field-meta.xml", "fields/B__c.field-meta.xml"))
    want = spark.createDataFrame([(text,), (FILES["objects/P/P.object-meta.xml"],)], "t string").select(F.sha2("t", 256)).collect()
    assert (rows["O"].hash, rows["P"].hash) == (want[0][0], want[1][0]) and (rows["O"].fields, rows["P"].fields) == (["A__c", "B__c"], [])


def test_shared_texts_are_looked_up_once(spark, monkeypatch):
    looked, link = [], render.containment_link
    monkeypatch.setattr(render, "containment_link", lambda texts, *a: looked.append(texts.count()) or link(texts, *a))
    of = spark.createDataFrame([("apex", "a", ["none", "uses Big", "uses Big"]), ("flows", "f", ["uses Big", None]), ("flows", "g", ["none"]), ("flows", "h", [])], "from_kind string, path string, relationships array<string>")
    names = spark.createDataFrame([("Big", "flows", 2), ("Big", "apex", 0), ("Bi", "flows", 2)], "name string, kind string, priority int")
    got = {(r.from_kind, r.path): r.see_also for r in render.see_also(of, names).collect()}
    assert got == {("apex", "a"): ["[Big](Big.md) — uses Big"] * 2, ("flows", "f"): ["[Big](../classes/Big.md) — uses Big"]} and looked == [3]


def test_files_are_counted_from_one_stored_table(spark, sf, monkeypatch):
    seen, count = [], pipeline.counts_by_kind
    monkeypatch.setattr(pipeline, "counts_by_kind", lambda work, *a: seen.extend(work.inputFiles()) or count(work, *a))
    root = fq.tree(spark, sf)
    fq.kind_counts(spark, sf)
    assert seen and not [f for f in seen if root in f]


def test_a_room_is_empty_when_it_is_left(spark):
    with scratch.room(spark) as keep:
        at = os.path.dirname(keep(spark.range(3)).inputFiles()[0].removeprefix("file://"))
        assert os.listdir(at)
    assert not os.path.exists(at)


def test_whole_files(tmp_path):
    at = f"{tmp_path}/a/b/c"
    store.write(at, b"1")
    store.write(at, b"2")
    assert store.read(at) == b"2" and os.listdir(f"{tmp_path}/a/b") == ["c"]
    assert store.read(f"{tmp_path}/none") is None and store.read(f"{at}/below") is None
