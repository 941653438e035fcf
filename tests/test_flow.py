"""The whole flow over a small tree: full build, incremental build, update, failures, watch."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from strataweave import cli
from strataweave.operators import relational as rel
from strataweave.plans import cache, enrich, prompts, render, versions
from strataweave.plans import pipeline as pl
from strataweave.sources import files as src
from strataweave.streaming import watch

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the generators below run on executors

FILES = {
    "classes/Order.cls": "/** @tag core */ public class Order implements Runner { public void go(String a) { Stock.take(); } }",
    "classes/sub/Stock.cls": "public class Stock extends base.Thing { private Integer n; }",
    "classes/Runner.cls": "public interface Runner {\n void go(String a);\n}",
    "classes/Order.cls-meta.xml": "<x/>",
    "node_modules/No.cls": "public class No {}",
    "triggers/Watch.trigger": "trigger Watch on Account (before insert) { Order.go(); }",
    "flows/My_Flow.flow-meta.xml": "<Flow><label>Welcome</label><processType>Auto</processType><loops><name>x</name></loops></Flow>",
    "flows/Broken.flow-meta.xml": "<Flow><label></Flow>",
    "objects/Acc/Acc.object-meta.xml": "<CustomObject><label>Acc</label></CustomObject>",
    "objects/Acc/fields/F__c.field-meta.xml": "<CustomField><fullName>F__c</fullName><type>Lookup</type><referenceTo>X</referenceTo></CustomField>",
    "objects/Acc/validationRules/R.validationRule-meta.xml": "<ValidationRule><active>false</active></ValidationRule>",
    "lwc/myButton/myButton.js-meta.xml": "<x/>", "lwc/myButton/myButton.js": "@api label;", "lwc/myButton/myButton.html": "<slot/>",
    "aura/comp/comp.cmp": "<aura:component><aura:attribute name='t'/></aura:component>", "aura/comp/comp.js": "({})",
    "flexipages/P.flexipage-meta.xml": "<FlexiPage><masterLabel>PL</masterLabel></FlexiPage>",
    "customMetadata/T__mdt.D.md-meta.xml": "<CustomMetadata><label>D</label><values><field>F</field><value>1</value></values></CustomMetadata>",
}


def tree(root, files=FILES):
    for path, text in files.items():
        os.makedirs(os.path.dirname(root / path), exist_ok=True)
        (root / path).write_text(text)
    return str(root)


class Linking(enrich.OfflineGenerator):
    def generate(self, system, prompt, label):
        out = json.loads(super().generate(system, prompt, label))
        out["relationships"] = ["works with Stock and Order", "nothing known"]
        if "handler_classes" in out:
            out["handler_classes"] = ["Order", "Gone"]
        return json.dumps(out)


class Failing(enrich.OfflineGenerator):
    def generate(self, system, prompt, label):
        if label == "Order":
            return '{"summary": "x"}'
        return super().generate(system, prompt, label)


def test_build_incremental_and_update(spark, tmp_path):
    root, store = tree(tmp_path / "in"), str(tmp_path / "cache")
    flt = pl.Filters(kinds=["apex", "triggers", "objects"])
    first = pl.build(spark, root, store, Linking(), filters=flt)
    assert first.summary == {"files": 5, "up_to_date": 0, "made": 5, "failed": 0}
    pages = {(r.kind, r.name): r.body for r in first.pages.collect()}
    assert "- [Order](Order.md)" in pages["apex", "Runner"]
    assert "- [Order](Order.md) — works with Stock and Order" in pages["apex", "Stock"]
    assert not any("nothing known" in body for body in pages.values())
    assert "- [Order](../classes/Order.md)" in pages["triggers", "Watch"] and "- `Gone`" in pages["triggers", "Watch"]
    assert "| `F__c` | Lookup → `X` |" in pages["objects", "Acc"]
    assert "2 class(es), 1 trigger(s)" in pages["index", "index"] and "### classes/sub" in pages["index", "index"]
    render.write_pages(first.pages, str(tmp_path / "out"))
    assert (tmp_path / "out/classes/Order.md").read_text() == pages["apex", "Order"] and (tmp_path / "out/index.md").exists()

    (tmp_path / "in/objects/Acc/fields/F__c.field-meta.xml").write_text("<CustomField><fullName>F__c</fullName></CustomField>")
    assert pl.build(spark, root, store, Linking(), filters=flt).summary == {"files": 5, "up_to_date": 4, "made": 1, "failed": 0}

    with pytest.raises(pl.Failed, match="Order: missing field"):
        pl.build(spark, root, store, Failing(), model="other", filters=pl.Filters(kinds=["apex"]))
    kept = cache.load(spark, store)
    assert {r.name: r.model for r in kept.where("kind = 'apex'").collect()} == {"Order": "offline", "Stock": "other", "Runner": "other"}
    assert cache.vacuum(kept, kept.where("name = 'Order'")).count() == 1


def test_metadata_of_all_kinds(spark, tmp_path):
    tables = pl.metadata(spark, tree(tmp_path))
    assert {k: df.count() for k, df in tables.items()} == {"flows": 2, "validation-rules": 1, "objects": 1, "flexipages": 1, "custom-metadata": 1, "lwc": 1, "triggers": 1, "apex": 3, "aura": 1}
    assert {r.stem: r.error for r in tables["flows"].collect()} == {"My_Flow": None, "Broken": "malformed XML"}
    assert tables["aura"].first().attributes[0]["name"] == "t"  # the markup, not the script beside it
    assert tables["lwc"].first().slots == ["default"]
    assert {(r.source, r.target) for r in pl.impact(tables).collect()} == {("Order", "Runner"), ("Order", "Stock"), ("Watch", "Order")}
    assert pl.unreferenced(tables).count() == 0
    tagged = pl.metadata(spark, str(tmp_path), pl.Filters(tags=["CORE"]))
    assert set(tagged) == {"apex", "triggers"} and [r.name for r in tagged["apex"].collect()] == ["Order"]
    named = pl.metadata(spark, str(tmp_path), pl.Filters(kinds=["apex"], name="*er"))
    assert sorted(r.name for r in named["apex"].collect()) == ["Order", "Runner"]
    with pytest.raises(pl.NoFiles):
        pl.metadata(spark, str(tmp_path), pl.Filters(name="zzz"))
    with pytest.raises(ValueError, match="unknown kinds"):
        src.scan_all(spark, str(tmp_path), ["nope"])


def test_sources(spark, tmp_path):
    tree(tmp_path, {"a/x.cls": "é", "a/_y.cls": "y", "b/.git/z.cls": "z"})
    (tmp_path / "a/bad.cls").write_bytes(b"\xff\xfe")
    (tmp_path / "a/big.cls").write_bytes(b"x" * (src.MAX_BYTES + 1))
    (tmp_path / "a/full.cls").write_bytes(b"x" * src.MAX_BYTES)
    assert [(r.filename, r.error) for r in src.scan(spark, str(tmp_path), "apex").collect()] == [("bad.cls", "not UTF-8"), ("full.cls", None), ("x.cls", None)]
    assert "_y.cls" in [r.filename for r in src.scan(spark, str(tmp_path), "apex", include_hidden=True).collect()]
    assert src.kind_of("a/b.js-meta.xml") == "lwc" and src.kind_of("x.txt") is None
    assert src.is_path("a/b") and src.is_path("Foo.cls") and not src.is_path("Foo")
    with pytest.raises(FileNotFoundError):
        src.read_target(spark, str(tmp_path / "none.cls"))


def test_targets(spark, tmp_path):
    root = tree(tmp_path, {k: v for k, v in FILES.items() if k.startswith(("classes", "lwc"))})
    assert pl.resolve(spark, "mybutton", root)[1] == "lwc"
    with pytest.raises(LookupError, match="did you mean Runner"):
        pl.resolve(spark, "Runer", root)
    with pytest.raises(FileNotFoundError, match="full build"):
        pl.update(spark, "Order", root, str(tmp_path / "none"))


def test_snapshot_of_another_version_is_left_aside(spark, tmp_path):
    path = str(tmp_path / "c")
    assert cache.load(spark, path).isEmpty()
    os.makedirs(path)
    (tmp_path / "c/part.parquet").write_text("{}")
    assert cache.load(spark, path).isEmpty()
    rows = spark.createDataFrame([("apex", "p", "h", "m", "{}", "{}", "n", 1)], cache.SCHEMA)
    cache.save(rows, path)
    assert cache.load(spark, path).count() == 1
    todo, ready = cache.split(spark.createDataFrame([("apex", "p", "h"), ("apex", "p", "h2")], "kind string, path string, hash string"), cache.load(spark, path), "m")
    assert [r.hash for r in todo.collect()] == ["h2"] and [r.hash for r in ready.collect()] == ["h"]
    assert cache.split(todo, cache.load(spark, path), "other")[1].isEmpty()


def test_http_retries():
    answers = [(429, {"retry-after": "1.5"}, ""), (0, {}, "refused"), (503, {}, "retry in 3s"), (200, {}, json.dumps({"choices": [{"message": {"content": "ok"}}]}))]
    slept, sent = [], []
    g = enrich.HttpGenerator("openai", "m", "k", lambda *a: sent.append(a) or answers[len(sent) - 1], slept.append)
    assert g.generate("s", "p", "l") == "ok" and slept[0] == 3 and 2 <= slept[1] - 3 <= 7 and slept[2] == 4
    assert sent[0][1] == {"Authorization": "Bearer k"} and sent[0][2]["response_format"] == {"type": "json_object"}
    with pytest.raises(RuntimeError, match="status 404"):
        enrich.HttpGenerator("groq", "m", "k", lambda *a: (404, {}, "no"), slept.append).generate("s", "p", "l")
    tries = []
    with pytest.raises(RuntimeError, match="status 500"):
        enrich.HttpGenerator("ollama", "m", "", lambda *a: tries.append(1) or (500, {}, ""), lambda s: None).generate("s", "p", "l")
    assert len(tries) == 5
    with pytest.raises(RuntimeError, match="limit: 0"):
        enrich.HttpGenerator("gemini", "m", "k", lambda *a: (429, {}, "limit: 0"), lambda s: None).generate("s", "p", "l")


def test_problems_and_keys(monkeypatch):
    good = enrich.OfflineGenerator().generate("lwc: x", "p", "n")
    assert enrich.problem("lwc", good) is None and "no JSON" in enrich.problem("lwc", "{")
    assert enrich.problem("lwc", json.dumps(json.loads(good) | {"summary": 1})) == "wrong type of summary"
    monkeypatch.delenv("GROQ_API_KEY", raising=False)
    assert enrich.api_key("ollama") == ""
    with pytest.raises(KeyError):
        enrich.api_key("groq")


def test_watch(spark, tmp_path):
    """New, edited and deleted files; a tick without a change writes nothing."""
    import hashlib

    root, table = tmp_path / "in", str(tmp_path / "t")
    os.makedirs(root / "sub")
    (root / "a.cls").write_text("one")
    (root / "sub/c.cls").write_text("three")
    run = lambda: watch.watch(spark, str(root), ".cls", table, str(tmp_path / "cp")).awaitTermination(60)
    kept = lambda: {r.path.rsplit("/", 1)[-1]: r.hash for r in watch.fingerprints(spark, table).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert kept() == {}
    run()
    assert kept() == {"a.cls": digest("one"), "c.cls": digest("three")}
    (root / "b.cls").write_text("two")
    (root / "a.cls").write_text("one, edited")
    os.utime(root / "a.cls", (2_000_000_000, 2_000_000_000))
    os.remove(root / "sub/c.cls")
    assert watch.refresh(spark, str(root), ".cls", table) == {"new": 1, "edited": 1, "deleted": 1}
    assert kept() == {"a.cls": digest("one, edited"), "b.cls": digest("two")}
    at = versions.current(spark, table)
    assert watch.refresh(spark, str(root), ".cls", table) == {"new": 0, "edited": 0, "deleted": 0}
    assert versions.current(spark, table) == at


def test_there_is_always_a_version(spark, tmp_path, monkeypatch):
    """A reader that has begun keeps its version; a write that breaks off leaves the old one."""
    path = str(tmp_path / "v")
    assert versions.current(spark, path) is None
    versions.replace(spark.range(3), path)
    reader = spark.read.parquet(versions.current(spark, path))
    versions.replace(spark.range(5), path)
    assert reader.count() == 3 and spark.read.parquet(versions.current(spark, path)).count() == 5
    monkeypatch.setattr(versions, "_point", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        versions.replace(spark.range(7), path)
    assert spark.read.parquet(versions.current(spark, path)).count() == 5
    monkeypatch.undo()
    versions.replace(versions_of(spark, path).selectExpr("id + 1 AS id"), path)
    assert sorted(r.id for r in versions_of(spark, path).collect()) == [1, 2, 3, 4, 5]
    assert len([f for f in os.listdir(path) if f.startswith("v-")]) == 2


def versions_of(spark, path):
    return spark.read.parquet(versions.current(spark, path))


def test_prompts_name_every_field():
    for kind, fields in enrich.FIELDS.items():
        text = prompts.system(kind, fields)
        assert text.startswith(f"{kind}:") and all(f'"{name}"' in text for name in fields)
    text = prompts.system("apex", enrich.FIELDS["apex"])
    assert '"params" (a list of objects with "name" (a text), "description" (a text))' in text and '"throws" (a list of texts)' in text


def test_generators_are_told_the_fields(spark):
    class Told(enrich.OfflineGenerator):
        def generate(self, system, prompt, label):
            assert '"summary"' in system and '"relationships"' in system
            return super().generate(system, prompt, label)

    work = spark.createDataFrame([(k, f"p{i}", k, "x") for i, k in enumerate(enrich.FIELDS)], "kind string, path string, name string, prompt string")
    out = enrich.enrich(work, Told(), concurrency=2, per_minute=1000).collect()
    assert len(out) == 8 and not any(r.error for r in out)


def test_limiter_keeps_every_window():
    now, starts = [0.0], []
    limiter = enrich.Limiter(3, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for i in range(20):
        limiter.acquire()
        starts.append(now[0])
        now[0] += 7 if i % 5 == 0 else 0.5
    assert all(b - a >= 60 for a, b in zip(starts, starts[3:], strict=False)) and starts[:3] == [0, 7, 7.5]
    assert starts[3] == pytest.approx(60.001)
    assert enrich.shares(10, 3) == [4, 3, 3] and enrich.shares(2, 5) == [1, 1] and enrich.shares(0, 3) == [0, 0, 0]


def test_command_line(spark, tmp_path, capsys):
    root, out, snap = tree(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "snap")
    common = ["--source-dir", root, "--output", out, "--snapshot", snap]
    assert cli.main(["generate", *common, "--type", "apex,triggers", "--type", "lwc"], spark) == 0
    said = capsys.readouterr().out
    assert "apex: 3 files, 0 up to date, 3 described, 0 failed" in said and "5 files, 0 up to date, 5 made, 0 failed" in said
    assert sorted(os.listdir(out)) == ["classes", "index.md", "lwc", "triggers"]
    assert cli.main(["generate", *common, "--type", "apex", "--name-filter", "Or*"], spark) == 0 and "1 up to date, 0 made" in capsys.readouterr().out
    assert cli.main(["update", "Stock", *common], spark) == 0
    assert cli.main(["update", "Nobody", *common], spark) == 1 and "nothing is called Nobody" in capsys.readouterr().err
    assert cli.main(["generate", *common, "--name-filter", "zzz"], spark) == 1
    assert cli.main(["status"], spark) == 0 and "gemini-2.5-flash" in capsys.readouterr().out
    assert cli.main(["auth", "--provider", "groq"]) == 0 and "GROQ_API_KEY" in capsys.readouterr().out
    for wrong in (["--concurrency", "0"], ["--name-filter", "a["], ["--type", "nope"], ["--rpm", "-1"], ["--provider", "nobody"]):
        with pytest.raises(SystemExit) as e:
            cli.main(["generate", *wrong], spark)
        assert e.value.code == 2


def test_two_things_of_one_page(spark, tmp_path):
    root = tree(tmp_path / "in", {"classes/a/One.cls": "public class One {}", "classes/b/One.cls": "public class One { Integer x; }", "classes/Two.cls": "public class Two {}"})
    result = pl.build(spark, root, str(tmp_path / "s"))
    assert result.clashes == ["classes/One.md"] and result.kinds == {"apex": {"files": 3, "up_to_date": 0, "made": 3, "failed": 0}}
    os.remove(tmp_path / "in/classes/Two.cls")
    assert pl.build(spark, root, str(tmp_path / "s"), prune=True).snapshot.count() == 2


def plain_admission(requests, limit, seconds):
    """Starts by key: each request as early as the rule lets it."""
    out = {}
    for key in {k for k, _ in requests}:
        starts = []
        for t in sorted(t for k, t in requests if k == key):
            at = max([t, *starts[-1:]])
            if len(starts) >= limit and at - starts[-limit] < seconds * 1_000_000:
                at = starts[-limit] + seconds * 1_000_000 + 1000
            starts.append(at)
        out[key] = starts
    return out


def test_admission_with_null_keys(spark):
    rows = [(k, i * 3_000_000) for i in range(30) for k in (None, 1, 2)] + [(None, None)]
    got = {}
    for r in rel.admitted(spark.createDataFrame(rows, "k long, at long"), ["k"], "at", 2, 60).collect():
        got.setdefault(r.k, []).append(r.started_at)
    assert got[None].count(None) == 1
    got[None].remove(None)
    assert {k: sorted(v) for k, v in got.items()} == plain_admission([r for r in rows if r[1] is not None], 2, 60)


def test_differences_with_nulls(spark):
    now = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "x"), (None, "n")], "id int, hash string")
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (5, None), (None, "m")], "id int, hash string")
    assert {r.id: r.change for r in rel.hash_diff(now, old, ["id"], "hash").collect()} == {1: "same", 2: "same", 3: "modified", 4: "new", 5: "deleted", None: "modified"}


def test_fuzzy_match_finds_all_pairs(spark):
    import random

    rng = random.Random(8)
    names = sorted({"".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(150)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {(r.a, r.b, r.distance) for r in rel.fuzzy_match(df, df, "n", "n").collect()}
    assert got == {(a, b, d) for a in names for b in names if (d := distance(a, b)) <= 2}


def test_containment_without_broadcast(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "uses OrderService daily"), (2, "nothing"), (3, "Order and Stock")], "id int, t string")
    names = spark.createDataFrame([("Order",), ("OrderService",), ("Stock",), ("",), ("in",)], "name string")
    want = {1: "OrderService", 2: "in", 3: "Order"}
    for bound in (100_000, 1):
        monkeypatch.setattr(rel, "BROADCAST_ROWS", bound)
        assert {r.id: r.linked for r in rel.containment_link(texts, names, ["id", "t"], "t", "name").collect()} == want


def test_admission_keeps_the_rate(spark):
    rows = spark.createDataFrame([("k", i * 1_000_000) for i in range(10)], "k string, at long")
    starts = sorted(r.started_at for r in rel.admitted(rows, ["k"], "at", 3, 60).collect())
    assert all(b - a >= 60_000_000 for a, b in zip(starts, starts[3:], strict=False)) and starts[:3] == [0, 1_000_000, 2_000_000]


def test_without_the_corpus_operators(tmp_path):
    """Without the optional folders and the pipeline module the entry module and the other tests work; the parsers' stand for them here."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(here, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; assert 'group_index' in e.queries() and not any(k.startswith('op') for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=60)
    subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", "tests/test_parsers.py"], cwd=tmp_path / "r", check=True, timeout=300)


def test_a_walk_leaves_out_links_and_pruned_folders(spark, tmp_path, caplog):
    root = tree(tmp_path / "in")
    os.makedirs(tmp_path / "else" / "deep")
    (tmp_path / "else" / "Linked.cls").write_text("public class Linked {}")
    os.symlink(tmp_path / "else", tmp_path / "in" / "classes" / "link")
    os.symlink(tmp_path / "else" / "Linked.cls", tmp_path / "in" / "triggers" / "Alias.cls")
    os.symlink(tmp_path / "nowhere", tmp_path / "in" / "classes" / "gone.cls")
    (tmp_path / "in" / "classes" / "A[1].cls").write_text("public class A1 {}")
    (tmp_path / "in" / "classes" / "Big.cls").write_text("x" * (src.MAX_BYTES + 1))
    os.makedirs(tmp_path / "in" / "node_modules" / "deep")
    (tmp_path / "in" / "node_modules" / "deep" / "No.cls").write_text("public class No {}")
    for root_form in (root, "file://" + root):
        names = sorted(r.filename for r in src.scan(spark, root_form, "apex").collect())
        assert names == ["A[1].cls", "Alias.cls", "Order.cls", "Runner.cls", "Stock.cls"]
    assert "Big.cls is left out" in caplog.text
    found = src.walk(spark, root)
    assert not any("node_modules" in p or "classes/link" in p for p in [*found.whole, *(f for f, _ in found.files)])
    assert f"{root}/triggers" in found.whole and f"{root}/classes" not in found.whole
    apart = src._look_apart(spark, [f"{root}/classes", f"{root}/triggers"])
    assert apart == {f: src._look_local(f) for f in apart} and apart[f"{root}/classes"].mixed
    assert [r.kind for r in src.read_targets(spark, [f"{root}/triggers/Watch.trigger"]).collect()] == ["triggers"]


def test_pages_are_written_by_executors(spark, tmp_path):
    rows = [("apex", "A", "one"), ("apex", "B b", "two"), ("index", "index", "all"), ("apex", "A", "later")]
    pages = spark.createDataFrame(rows, "kind string, name string, body string").repartition(4)
    out = tmp_path / "out"
    os.makedirs(out / "classes")
    (out / "classes" / "Old.md").write_text("old")
    for _ in range(2):
        render.write_pages(pages, str(out))
        got = {str(p.relative_to(out)): p.read_text() for p in out.rglob("*") if p.is_file()}
        assert got == {"classes/A.md": "one", "classes/Bb.md": "two", "index.md": "all", "classes/Old.md": "old"}
    broken = pages.withColumn("body", F.when(F.col("name") == "B b", F.raise_error(F.lit("no"))).otherwise("new"))
    with pytest.raises(Exception, match="no"):
        render.write_pages(broken, str(out))
    assert (out / "classes" / "A.md").read_text() == "one" and not [p for p in os.listdir(out) if p.startswith(".staging")]


@pytest.mark.parametrize(
    ("change", "says"),
    [
        ({"methods": ["x", 3]}, r"wrong type of methods\[0\]"),
        ({"methods": [{"name": "a", "description": "b", "params": [{"name": "c"}], "returns": "d", "throws": []}]}, r"missing field methods\[0\].params\[0\].description"),
        ({"methods": [{"name": "a", "description": "b", "params": [], "returns": "d", "throws": [1]}]}, r"wrong type of methods\[0\].throws\[0\]"),
        ({"properties": [{"name": "a", "description": None}]}, r"wrong type of properties\[0\].description"),
        ({"summary": 3}, "wrong type of summary"),
        ({"usage_examples": [None]}, r"wrong type of usage_examples\[0\]"),
    ],
)
def test_nested_answers_are_strict(change, says):
    good = {"class_name": "a", "summary": "b", "description": "c", "methods": [{"name": "a", "description": "b", "params": [{"name": "c", "description": "d", "more": 1}], "returns": "d", "throws": ["e"]}], "properties": [], "usage_examples": [], "relationships": []}
    assert enrich.problem("apex", json.dumps(good)) is None
    assert __import__("re").fullmatch(says, enrich.problem("apex", json.dumps(good | change)))


def test_an_infinite_wait_is_none():
    assert enrich.wait("inf", "", 0, lambda a, b: a) == 2 and enrich.wait("inf", "retry in 3s", 0) == 4


LOST = r"""
import os, sys
from pyspark.sql import SparkSession
from strataweave.plans import enrich

class Dying(enrich.OfflineGenerator):
    def generate(self, system, prompt, label):
        with open(sys_path + "/calls", "a") as f:
            f.write(label + "\n")
        n = len(open(sys_path + "/calls").read().split())
        if n == 7 or n == 12:
            os._exit(1)
        return super().generate(system, prompt, label)

sys_path = sys.argv[1]
spark = SparkSession.builder.master("local[1,4]").config("spark.ui.enabled", "false").getOrCreate()
work = spark.createDataFrame([("flows", f"p{i}", f"n{i}", "x") for i in range(20)], "kind string, path string, name string, prompt string")
made = enrich.enrich(work, Dying(), 1, journal=enrich.Journal("file:" + sys_path + "/journal", "m", "run")).collect()
assert len(made) == 20 and all(r.documentation and not r.error for r in made)
again = enrich.enrich(work, Dying(), 1, journal=enrich.Journal("file:" + sys_path + "/journal", "m", "later")).collect()
assert sorted(again) == sorted(made)
"""


def test_a_lost_worker_repeats_no_answered_call(tmp_path):
    """The process that calls dies twice: only the two calls that it died in are made again, and a later run calls nothing."""
    import subprocess

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", LOST, str(tmp_path)], check=True, env=os.environ | {"PYTHONPATH": here}, timeout=300, capture_output=True)
    calls = (tmp_path / "calls").read_text().split()
    assert len(calls) == 22 and sorted(set(calls)) == sorted(f"n{i}" for i in range(20))


def test_the_snapshot_is_a_log(spark, tmp_path):
    at = str(tmp_path / "snap")
    rows = lambda data: spark.createDataFrame([(*r, "doc " + r[2], "{}", r[1]) for r in data], "kind string, path string, hash string, documentation string, metadata string, name string")
    cache.add(rows([("apex", f"p{i}", "h0") for i in range(5)]), at, "m")
    sizes = []
    for n in range(1, cache.ADDITIONS + 3):
        cache.add(rows([("apex", "p1", f"h{n}"), ("flows", f"q{n}", "h"), ("apex", "p1", f"g{n}")]), at, "m")
        sizes.append(len(versions.members(spark, at)))
        found = {(r.kind, r.path): r.hash for r in cache.load(spark, at).collect()}
        assert found == {("apex", f"p{i}"): "h0" for i in range(5)} | {("apex", "p1"): f"h{n}"} | {("flows", f"q{k}"): "h" for k in range(1, n + 1)}
        assert cache.load(spark, at).count() == len(found)
    assert sizes == [*range(2, cache.ADDITIONS + 2), 1, 2]


def test_a_key_is_needed_only_for_work(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.delenv("GROQ_API_KEY", raising=False)
    root = tree(tmp_path / "in", {"flows/F.flow-meta.xml": "<Flow/>"})
    common = ["--source-dir", root, "-o", str(tmp_path / "out"), "--snapshot", str(tmp_path / "snap"), "--model", "m"]
    assert cli.main(["generate", *common, "--provider", "groq"], spark) == 1 and "GROQ_API_KEY" in capsys.readouterr().err
    assert cli.main(["generate", *common], spark) == 0
    assert cli.main(["generate", *common, "--provider", "groq", "-v"], spark) == 0
    assert cli.parser().parse_args(["generate", "--tag", "a, b", "--tag", "c"]).tag == ["a", "b", "c"]
