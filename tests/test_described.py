"""What needs the snapshot alone makes no pages, pages parse nothing again, only answers that cost something are kept in a journal, and parsers read a text once."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from strataweave import flow_queries as fq
from strataweave.functions import markup
from strataweave.plans import enrich, pipeline
from strataweave.sources import files as src

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the generator below runs on executors


@pytest.fixture
def session(spark, sf, monkeypatch):
    """A session in which nothing but the tree is made."""
    fq.tree(spark, sf)
    monkeypatch.setattr(fq, "_MADE", {k: v for k, v in fq._MADE.items() if k[2] == "tree"})
    return monkeypatch


def test_the_snapshot_needs_no_pages(spark, sf, session):
    rendered, make = [], pipeline._pages
    session.setattr(pipeline, "_pages", lambda *a: rendered.append(a) or make(*a))
    entries = fq.snapshot_entries(spark, sf)
    assert entries.count() == entries.distinct().count() > 8 and not rendered
    fq.pages_flows(spark, sf)
    assert len(rendered) == 1


def test_pages_are_made_of_what_was_described(spark, sf, session):
    n = {r.kind: r["count"] for r in fq.snapshot_entries(spark, sf).groupBy("kind").count().collect()}
    session.setattr(pipeline, "parse", lambda *a, **k: pytest.fail("parsed again"))
    assert fq.pages_flows(spark, sf).count() == n["flows"] and fq.pages_objects(spark, sf).count() == n["objects"]


class Paid(enrich.OfflineGenerator):
    free = False


@pytest.mark.parametrize(("generator", "per_minute", "kept"), [(enrich.OfflineGenerator(), 0, False), (fq.Fixed(), 0, False), (enrich.OfflineGenerator(), 600, True), (Paid(), 0, True)])
def test_answers_that_cost_nothing_are_in_no_journal(spark, tmp_path, monkeypatch, generator, per_minute, kept):
    at, seen, make = tmp_path / "tree/flows", [], pipeline._journal
    at.mkdir(parents=True)
    for name in "AB":
        (at / f"{name}.flow-meta.xml").write_text("<Flow/>")
    monkeypatch.setattr(pipeline, "_journal", lambda *a: seen.append(a) or make(*a))
    found = pipeline.describe(spark, str(tmp_path / "tree"), f"{tmp_path}/snapshot", generator, per_minute=per_minute)
    assert bool(seen) == kept and found.summary == {"files": 2, "up_to_date": 0, "made": 2, "failed": 0}
    assert found.snapshot.where(F.col("documentation").isNotNull()).count() == 2 and not (tmp_path / "snapshot/journal").exists()
    again = pipeline.describe(spark, str(tmp_path / "tree"), f"{tmp_path}/snapshot", generator, per_minute=per_minute)
    assert again.summary == {"files": 2, "up_to_date": 2, "made": 0, "failed": 0}


FIELD = "<CustomField><fullName>{0}</fullName><label>{0} of it</label></CustomField>"
TREE = {
    "objects/O/O.object-meta.xml": "<CustomObject><label>Own</label></CustomObject>", "objects/O/fields/B__c.field-meta.xml": FIELD.format("B__c"), "objects/O/fields/A__c.field-meta.xml": FIELD.format("A__c"), "objects/O/fields/Bad__c.field-meta.xml": "<CustomField>",
    "objects/P/P.object-meta.xml": "<CustomObject>", "objects/P/fields/Bad__c.field-meta.xml": "<a><b></a>", "objects/Q/Q.object-meta.xml": "<CustomObject/>", "lwc/one/one.js-meta.xml": "<x/>", "lwc/one/one.js": "@api a;", "lwc/one/one.html": "<template><slot name='s'></slot><c-part/></template>",
    "aura/au/au.cmp": "<aura:component extends='c:base'><aura:attribute name='n'/></aura:component>", "aura/au/au.js": "({})",
}


@pytest.fixture(params=[2000, 0], ids=["small", "large"])
def parsed(spark, tmp_path, monkeypatch, request):
    """What parses a kind of a small tree, and of one that executors walk."""
    monkeypatch.setattr(src, "FEW_ENTRIES", request.param)
    for name, text in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    tree = src.walk(spark, str(tmp_path))
    assert (tree.listing is None) == bool(request.param)
    return lambda kind: pipeline.parse(spark, kind, src.with_markup(spark, tree, kind), tree)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_read_once(spark, parsed):
    found = parsed("objects")
    assert plan(found).count("ArrowEvalPython") == 2  # objects and fields
    text = "".join(TREE[f"objects/O/{p}"] for p in ("O.object-meta.xml", "fields/A__c.field-meta.xml", "fields/B__c.field-meta.xml"))
    want = [("O", "Own", ["A__c", "B__c"], None, text), ("P", "", [], "malformed XML", TREE["objects/P/P.object-meta.xml"]), ("Q", "", [], None, "<CustomObject/>")]
    hashes = spark.createDataFrame(want, "name string, label string, fields array<string>, error string, t string").withColumn("hash", F.sha2("t", 256)).drop("t")
    assert sorted(found.select("name", "label", "fields.api_name", "error", "hash").collect()) == sorted(hashes.collect())
    assert found.columns[-5:] == ["fields", "object_name", "label", "description", "name"]


def test_texts_of_fields_pass_by_the_driver(parsed):
    found = parsed("objects")
    if "FileScan parquet" in plan(found):  # a large tree: what its table of names takes says nothing of the texts
        assert "Broadcast" not in plan(found)


def test_tags_are_found_once(parsed):
    one, au = parsed("lwc"), parsed("aura")
    assert plan(one).count(markup.TAG) == plan(au).count(markup.TAG) == 2  # names and the rest
    row = one.select("api_props", "slots", "referenced_components").first()
    assert ([p.name for p in row.api_props], row.slots, row.referenced_components) == (["a"], ["s", "default"], ["part"])
    assert au.select("extends", "attributes.name").first() == ("c:base", ["n"]) and not {"_tags", "_members"} & {*one.columns, *au.columns}
