"""Large trees are listed and read by executors and give what small ones give; descriptions made locally are not gathered in a few tasks."""

import os

import pytest
from pyspark.sql import functions as F

from strataweave.functions import text as tx
from strataweave.operators.relational import numbered
from strataweave.plans import enrich, pipeline
from strataweave.sources import files as src

FILES = {
    "classes/A.cls": "public class A {}", "classes/deep/B.cls": "é", "classes/B.cls-meta.xml": "<x/>", "classes/_h.cls": "hidden", "classes/.in/C.cls": "hidden", "node_modules/N.cls": "no",
    "lwc/one/one.js-meta.xml": "<x/>", "lwc/one/one.js": "@api a;", "lwc/one/one.html": "<template><slot></slot></template>", "lwc/two/two.js-meta.xml": "<y/>", "aura/au/au.cmp": "<aura:component/>", "aura/au/au.js": "({})", "elsewhere/c.cmp": "<x/>",
    "objects/O/O.object-meta.xml": "<CustomObject><label>O</label></CustomObject>", "objects/O/fields/F__c.field-meta.xml": "<CustomField><fullName>F__c</fullName></CustomField>", "flows/F[1].flow-meta.xml": "<Flow/>",
}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "classes/bad.cls").write_bytes(b"\xff\xfe")
    (tmp_path / "lwc/two/two.js").write_bytes(b"\xff")
    (tmp_path / "classes/Big.cls").write_bytes(b"x" * (src.MAX_BYTES + 1))
    os.symlink(tmp_path / "classes", tmp_path / "flows" / "link")
    return str(tmp_path)


def _all(spark, root, hidden=False):
    tree = src.walk(spark, root, hidden)
    scans = {k: [tuple(r) for r in df.collect()] for k, df in src.scan_all(spark, tree).items()}
    others = [sorted(map(tuple, f(spark, tree).collect())) for f in (src.scan_markup, src.scan_fields, pipeline.targets)]
    tables = {k: sorted(str(r.asDict(True)) for r in df.collect()) for k, df in pipeline.metadata(spark, tree).items()}
    named = [r.filename for r in src.scan_all(spark, tree, ["apex"], "?.cls")["apex"].collect()]
    order = sorted((r.at, r.filename) for r in numbered(src.scan(spark, tree, "apex").select("filename"), "at").collect())
    return scans, others, tables, named, order


def test_a_large_tree_gives_what_a_small_one_gives(spark, root, monkeypatch, caplog):
    small = _all(spark, root)
    assert src.walk(spark, root).listing is None
    monkeypatch.setattr(src, "FEW_ENTRIES", 3)
    caplog.clear()
    assert _all(spark, root) == small
    assert "Big.cls is left out" in caplog.text
    tree = src.walk(spark, root)
    assert tree.listing is not None and not tree.whole and not tree.files  # no names on the driver
    assert [r[1] for r in small[0]["apex"]] == ["A.cls", "B.cls", "bad.cls"] and small[3] == ["A.cls", "B.cls"]
    assert "_h.cls" in [r.filename for r in src.scan(spark, root, "apex", include_hidden=True).collect()]


def test_texts_are_handed_on_in_pieces(spark, root, monkeypatch):
    monkeypatch.setattr(src, "FEW_ENTRIES", 3)
    whole = src.scan(spark, root, "apex").collect()
    monkeypatch.setattr(src, "BYTES_A_BATCH", 1)
    assert src.scan(spark, root, "apex").collect() == whole


def test_builtin_types_are_words_of_prose(spark):
    df = spark.createDataFrame([("My String, Label and Foo",)], "t string")
    assert df.select(tx.type_references(F.col("t"), builtin=())).first()[0] == ["Foo", "Label", "String"]
    assert df.select(tx.type_references(F.col("t"))).first()[0] == ["Foo"]


def test_local_descriptions_are_made_where_rows_are(spark):
    work = spark.range(40).repartition(20).select(F.lit("flows").alias("kind"), F.col("id").cast("string").alias("path"), F.lit("n").alias("name"), F.lit("p").alias("prompt"))
    out = enrich.enrich(work, enrich.OfflineGenerator())
    assert out.rdd.getNumPartitions() == 20 and out.where("error is null").count() == 40
    assert enrich.enrich(work, enrich.OfflineGenerator(), 3, per_minute=1000).rdd.getNumPartitions() == 3
