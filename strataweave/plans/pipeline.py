"""The whole flow: scan, parse, filter, split against the snapshot, enrich, render.

Scans and parsers are lazy; a run stores what it parsed, described and rendered once
each in the shared folder, so no step repeats another's work. ``describe`` ends with
the snapshot, and ``rendered`` makes pages of what it parsed. Each answer is in a
journal beside the snapshot before the next call, and goes into the snapshot before
anything else reads it. So a file is described once, though executors are lost or the
run ends early, and a run with failures still keeps its successes. The answers of a
``free`` generator that is not held to a rate have no journal: they are made again.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import apex, markup, xmlmeta
from ..functions.text import composite_hash, content_hash, folder_of, has_any_tag, path_part, split_first_dot
from ..operators.relational import fold_children, fuzzy_match, members
from ..sources import files as src
from ..sources import scratch, store
from . import cache, render
from .enrich import FIELDS, Generator, Journal, OfflineGenerator, enrich
from .prompts import prompt

log = logging.getLogger(__name__)
_FIELDS = ["api_name", "label", "field_type", "description", "help_text", "reference_to", "required"]


@dataclass
class Filters:
    """Kinds, a shell pattern for names and tags; all must hold, an empty one always does."""

    kinds: list[str] = field(default_factory=list)
    name: str | None = None
    tags: list[str] = field(default_factory=list)


class NoFiles(ValueError):
    """No file of any kind is left after the filters by kind and name."""


class Failed(RuntimeError):
    """Some descriptions could not be made; the others are in the snapshot."""


def parse(spark: SparkSession, kind: str, files: DataFrame, root: str | src.Tree, include_hidden: bool = False) -> DataFrame:
    """Files of a kind with their metadata, ``name`` (the stem where the text names nothing), ``folder`` and ``hash``."""
    raw = F.col("raw_source")
    base = files.withColumn("folder", folder_of(F.col("path"), root.root if isinstance(root, src.Tree) else root)).withColumn("hash", content_hash(raw))
    if kind == "apex":
        out = apex.parse_classes(base)
        return out.withColumn("name", F.when(F.col("class_name") != "", F.col("class_name")).otherwise(F.col("stem")))
    if kind == "triggers":
        out = base.withColumns(apex.parse_trigger(raw))
        return out.withColumn("name", F.when(F.col("trigger_name") != "", F.col("trigger_name")).otherwise(F.col("stem")))
    component = src.component()
    if kind == "lwc":
        out = base.withColumn("component_name", component)
        if "html" not in files.columns:
            out = out.join(src.scan_markup(spark, root, include_hidden).hint("merge"), ["folder_path", "component_name"], "left")
        out = out.withColumn("hash", composite_hash(raw, F.filter(F.array("html"), lambda x: x.isNotNull())))
        return markup.with_component(out).withColumn("name", F.col("component_name"))
    if kind == "aura":
        return markup.with_aura(base.withColumn("component_name", component)).withColumn("name", F.col("component_name"))
    base = base.withColumn("error", F.coalesce("error", F.when(xmlmeta.is_malformed(raw), F.lit("malformed XML"))))
    if kind == "flows":
        return base.withColumns(xmlmeta.parse_flow(raw, F.col("stem"))).withColumn("name", F.col("stem"))
    if kind == "validation-rules":
        return base.withColumns(xmlmeta.parse_rule(raw, F.col("stem"), path_part(F.col("path"), 3))).withColumn("name", F.col("stem"))
    if kind == "flexipages":
        return base.withColumns(xmlmeta.parse_page(raw, F.col("stem"))).withColumn("name", F.col("stem"))
    if kind == "custom-metadata":
        ids = split_first_dot(F.col("stem"))
        return base.withColumns(xmlmeta.parse_record(raw, ids["type"], ids["record"])).withColumn("name", F.col("type_name"))
    if kind == "objects":
        # whether a field is sound goes along with it, since a filter by it would read each document twice
        fields = src.scan_fields(spark, root, include_hidden).withColumns(xmlmeta.parse_field(F.col("raw_source"), F.col("stem")) | {"_ok": ~xmlmeta.is_malformed(F.col("raw_source"))})
        fields = fields.select(F.col("object_dir").alias("folder_path"), F.col("path").alias("_path"), *_FIELDS, F.col("raw_source").alias("_text"), "_ok")
        own = xmlmeta.parse_object(raw, F.col("stem"))
        base = base.withColumns(own)
        if isinstance(root, src.Tree) and root.listing is not None:
            base = base.hint("merge")  # what a list of names takes says nothing of the texts, and the driver gets none
        out = fold_children(base, fields, ["folder_path"], ["_path"], [*_FIELDS, "_text", "_ok"], "fields")  # a folder's paths are ordered as its file names
        out = out.withColumn("fields", F.filter("fields", lambda x: x["_ok"]))
        out = out.withColumn("hash", composite_hash(raw, F.transform("fields", lambda x: x["_text"])))
        out = out.withColumn("fields", F.transform("fields", lambda x: F.struct(*[x[f].alias(f) for f in _FIELDS])))
        return out.select(*[c for c in out.columns if c not in own], *own, F.col("stem").alias("name"))
    raise ValueError(kind)


def metadata(spark: SparkSession, root: str | src.Tree, filters: Filters | None = None, include_hidden: bool = False) -> dict[str, DataFrame]:
    """Parsed tables by kind, after all filters. Tags leave out the kinds that cannot have any."""
    return {k: make() for k, make in _metadata(spark, root, filters, include_hidden).items()}


def _metadata(spark: SparkSession, root: str | src.Tree, filters: Filters | None = None, include_hidden: bool = False) -> dict[str, Callable[[], DataFrame]]:
    """What makes each table of ``metadata``."""
    filters = filters or Filters()
    kinds = src.chosen(filters.kinds)
    tree = root if isinstance(root, src.Tree) else src.walk(spark, root, include_hidden)
    if all(src.is_empty(spark, tree, k, name=filters.name) for k in kinds):
        raise NoFiles(f"no files below {tree.root} after the filters")

    def table(k: str) -> DataFrame:
        out = parse(spark, k, src.with_markup(spark, tree, k, name=filters.name), tree)
        return out.where(has_any_tag(F.col("tags"), filters.tags)) if filters.tags else out

    return {k: partial(table, k) for k in kinds if not filters.tags or src.BY_NAME[k].taggable}


def entities(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, kind, priority)`` of everything that can be linked to; custom-metadata types cannot."""
    parts = [df.select("name", F.lit(k).alias("kind"), F.lit(render.PRIORITY[k]).alias("priority")) for k, df in tables.items() if k in render.PRIORITY]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


Keep = Callable[[DataFrame], DataFrame]
#: Tables that are planned and stored at once: all kinds.
AT_ONCE = len(src.KINDS)


def _kept(tables: dict[str, Callable[[], DataFrame]], keep: Keep) -> dict[str, DataFrame]:
    """Each table made and stored, all at once: planning takes the driver as long as the work of small tables, and one table's last tasks leave room for another's."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return dict(zip(tables, pool.map(lambda make: keep(make()), tables.values()), strict=True))


def _described(tables: dict[str, DataFrame], snapshot: DataFrame, keep: Keep) -> tuple[dict[str, DataFrame], Callable[[str], DataFrame]]:
    """Metadata joined with descriptions, first without, then, by kind, with what other files add; files without one are left out, and so are the texts of the others."""

    def describe(k: str) -> DataFrame:
        docs = snapshot.where(F.col("kind") == k).select("path", "documentation")
        fields = ", ".join(f"{f} {t}" for f, t in FIELDS[k].items())
        rows = tables[k].drop("raw_source", "script", "html").join(docs, "path").withColumn("doc", F.from_json("documentation", fields)).where("doc is not null")
        return rows.drop("documentation")

    found = _kept({"": lambda: entities(tables)} | {k: partial(describe, k) for k in tables if k in FIELDS}, keep)
    names, rels = found.pop(""), None
    for k, df in found.items():
        part = df.select(F.lit(k).alias("from_kind"), "path", "doc.relationships")
        rels = part if rels is None else rels.union(part)
    links = keep(render.see_also(rels, names, keep)) if found else None

    def complete(k: str) -> DataFrame:
        rows = found[k].join(links.where(F.col("from_kind") == k).select("path", "see_also"), "path", "left")
        rows = rows.withColumn("see_also", F.coalesce("see_also", F.array().cast("array<string>")))
        if k == "apex":
            by = members(tables[k].where(~F.col("is_interface")), "implements", "item", "name", "implemented_by")
            rows = rows.join(by, rows["name"] == by["item"], "left").drop("item").withColumn("implemented_by", F.coalesce("implemented_by", F.array().cast("array<string>")))
        if k == "triggers":
            classes = names.where("kind = 'apex'").select(F.col("name").alias("_class"))
            each = rows.select("path", F.explode("doc.handler_classes").alias("_class")).join(classes, "_class").groupBy("path").agg(F.collect_set("_class").alias("known_handlers"))
            rows = rows.join(each, "path", "left").withColumn("known_handlers", F.coalesce("known_handlers", F.array().cast("array<string>")))
        return rows

    return found, complete


def _entries(described: dict[str, DataFrame], tables: dict[str, DataFrame]) -> DataFrame:
    summary = F.coalesce("doc.summary", F.lit(""))
    code = render.code
    cells = {
        "apex": [summary], "triggers": [code(F.col("sobject")), summary], "flows": [code(F.col("process_type")), summary],
        "validation-rules": [code(F.col("object_name")), F.when(F.col("active"), "active").otherwise("inactive"), summary],
        "objects": [F.col("label"), F.size("fields").cast("string"), summary], "lwc": [F.size("api_props").cast("string"), summary],
        "flexipages": [code(F.col("page_type")), summary], "aura": [F.size("attributes").cast("string"), summary],
    }
    parts = []
    for k, df in described.items():
        kind = F.when(F.col("is_interface"), "interface").otherwise("apex") if k == "apex" else F.lit(k)
        label = F.col("label") if k == "flows" else F.col("name")
        folder = F.col("object_name") if k == "validation-rules" else F.col("folder")
        parts.append(df.select(kind.alias("kind"), "name", label.alias("label"), folder.alias("folder"), F.array(*cells[k]).alias("cells")))
    if "custom-metadata" in tables:
        types = tables["custom-metadata"].groupBy("name").agg(F.count(F.lit(1)).cast("string").alias("n"))
        parts.append(types.select(F.lit("custom-metadata").alias("kind"), "name", F.col("name").alias("label"), F.lit("").alias("folder"), F.array("n").alias("cells")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _pages(tables: dict[str, DataFrame], snapshot: DataFrame, keep: Keep) -> dict[str, Callable[[], DataFrame]]:
    """What makes the pages of each kind and the index."""
    found, complete = _described(tables, snapshot, keep)
    page = lambda k: complete(k).select(F.lit(k).alias("kind"), "name", render.PAGES[k]().alias("body"))
    parts = {k: partial(page, k) for k in found}
    if "custom-metadata" in tables:
        parts["custom-metadata"] = lambda: render.record_pages(tables["custom-metadata"])
    parts["index"] = lambda: render.index(_entries(found, tables)).select(F.lit("index").alias("kind"), F.lit("index").alias("name"), "body")
    return parts


def pages(tables: dict[str, DataFrame], snapshot: DataFrame, keep: Keep) -> DataFrame:
    """``(kind, name, body)`` of every page and the index; what ``keep`` stores is read with them."""
    out, *others = [make() for make in _pages(tables, snapshot, keep).values()]
    for p in others:
        out = out.union(p)
    return out


def file_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """``(kind, path, hash)`` of the rows of ``work_rows``: what it takes to tell which are up to date."""
    parts = [df.where("error is null").select(F.lit(k).alias("kind"), "path", "hash") for k, df in tables.items() if k in FIELDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def work_rows(tables: dict[str, DataFrame], kinds: list[str] | None = None) -> DataFrame:
    """``(kind, path, hash, name, prompt, metadata)`` of what can be described; files with an error are left out."""
    parts = []
    for k, df in tables.items():
        if k in FIELDS and (not kinds or k in kinds):
            skip = {"raw_source", "script", "html", "path", "filename", "length", "error", "stem", "folder_path"}
            meta = F.to_json(F.struct(*[c for c in df.columns if c not in skip]))
            parts.append(df.where("error is null").select(F.lit(k).alias("kind"), "path", "hash", "name", prompt(k).alias("prompt"), meta.alias("metadata")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@dataclass
class Result:
    """The pages, stored until the driver ends, the counts of a run, the same by kind, and the files of which several things would be written."""

    pages: DataFrame
    snapshot: DataFrame
    summary: dict[str, int]
    kinds: dict[str, dict[str, int]] = field(default_factory=dict)
    clashes: list[str] = field(default_factory=list)


COUNTS = ("files", "up_to_date", "made", "failed")


def counts_by_kind(work: DataFrame, ready: DataFrame, made: DataFrame) -> dict[str, dict[str, int]]:
    """How many files of each kind there are, are up to date, were described and failed."""
    parts = [work.select("kind", F.lit("files").alias("what")), ready.select("kind", F.lit("up_to_date").alias("what")), made.select("kind", F.when(F.col("error").isNull(), "made").otherwise("failed").alias("what"))]
    rows = parts[0].union(parts[1]).union(parts[2]).groupBy("kind").agg(*[F.count_if(F.col("what") == c).alias(c) for c in COUNTS])
    return {r.kind: {c: r[c] for c in COUNTS} for r in rows.orderBy("kind").collect()}


@dataclass
class Described:
    """The parsed tables of a run, the snapshot after it, the counts and the same by kind."""

    tables: dict[str, DataFrame]
    snapshot: DataFrame
    summary: dict[str, int]
    kinds: dict[str, dict[str, int]]


def describe(spark: SparkSession, root: str, cache_path: str, generator: Generator | None = None, model: str = "offline", filters: Filters | None = None, force: bool = False, strict: bool = False, concurrency: int = 3, per_minute: int = 0, include_hidden: bool = False, prune: bool = False, keep: Keep = scratch.stored) -> Described:
    """Describe what is new or changed below ``root`` and save it in the snapshot, as ``build`` does; no page is made. ``keep`` stores the parsed tables."""
    with scratch.room(spark) as passing:
        root = src.canonical(spark, root)
        tables = _kept(_metadata(spark, root, filters, include_hidden), keep)
        if strict:
            for k, df in tables.items():
                if bad := df.where("error is not null").select("path", "error").head():
                    raise Failed(f"{k}: {bad.path}: {bad.error}")
        before = cache.empty(spark) if force else cache.load(spark, cache_path)
        work = work_rows(tables)
        todo, ready = cache.split(work, before, model)
        generator = generator or OfflineGenerator()
        journal = None if getattr(generator, "free", False) and not per_minute else _journal(cache_path, model)
        if force and journal:
            store.delete(f"{journal.folder}/answers")  # of a run that ended early: everything is described anew
        if hasattr(generator, "prepare") and not todo.isEmpty():
            generator.prepare()
        made = passing(enrich(todo, generator, concurrency, per_minute, journal))
        done, failed = made.where("error is null"), made.where("error is not null")
        # counted before the snapshot that they read is replaced
        kinds = counts_by_kind(work, ready, made)
        for kind, n in kinds.items():
            log.info("%s: %s found, %s up to date, %s made, %s failed", kind, n["files"], n["up_to_date"], n["made"], n["failed"])
        summary = {c: sum(n[c] for n in kinds.values()) for c in COUNTS}
        if prune and filters is None:
            cache.save(cache.vacuum(cache.update(before, done, model), work), cache_path)
        elif force:
            cache.save(cache.update(before, done, model), cache_path)
        elif summary["made"] or not cache.members(spark, cache_path):
            cache.add(done, cache_path, model)
        errors = [r.error for r in failed.select("error").orderBy("error").limit(20).collect()]
        if journal:
            store.delete(journal.folder)  # what it has is in the snapshot
        if errors:
            raise Failed(f"{summary['failed']} failed: " + "; ".join(errors))
        return Described(tables, cache.load(spark, cache_path), summary, kinds)


def rendered(spark: SparkSession, found: Described, keep: Keep) -> Result:
    """All pages of what was described."""
    out = scratch.together(spark, "kind string, name string, body string", _pages(found.tables, found.snapshot, keep).values(), AT_ONCE)
    clashes = [f"{render.FOLDERS.get(r.kind, '.')}/{r.file}.md" for r in render.same_page(out).orderBy("kind", "file").limit(20).collect()]
    for c in clashes:
        log.warning("several things would be written to %s; the last one holds", c)
    return Result(out, found.snapshot, found.summary, found.kinds, clashes)


def build(spark: SparkSession, root: str, cache_path: str, generator: Generator | None = None, model: str = "offline", filters: Filters | None = None, force: bool = False, strict: bool = False, concurrency: int = 3, per_minute: int = 0, include_hidden: bool = False, prune: bool = False) -> Result:
    """Describe what is new or changed below ``root`` and render all pages.

    ``force`` starts from an empty snapshot; ``strict`` makes a broken file an
    error; ``prune`` drops snapshot entries of files that are gone (only without
    filters). If a description fails, the others are saved, then ``Failed`` is
    raised and nothing is rendered.
    """
    with scratch.room(spark) as keep:
        return rendered(spark, describe(spark, root, cache_path, generator, model, filters, force, strict, concurrency, per_minute, include_hidden, prune, keep), keep)


def _journal(cache_path: str, model: str) -> Journal:
    return Journal(f"{cache_path}/journal", model, f"run-{uuid.uuid4().hex}")


def targets(spark: SparkSession, root: str | src.Tree) -> DataFrame:
    """``(kind, path, name)`` of everything that a name can mean."""
    known = None
    root = root if isinstance(root, src.Tree) else src.walk(spark, root)
    for k in src.BY_NAME:
        name = F.element_at(F.split("path", "/"), -2) if k in ("lwc", "aura") else F.col("stem")
        part = src.listed(spark, root, k).select(F.lit(k).alias("kind"), "path", name.alias("name"))
        known = part if known is None else known.union(part)
    return known


def resolve_all(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """``wanted(target)`` with the ``kind`` and ``path`` of the one thing of that name, without case, and ``status``: found, ambiguous or missing. One join, however many targets."""
    of = known.groupBy(F.lower("name").alias("_low")).agg(F.min("kind").alias("kind"), F.min("path").alias("path"), F.count(F.lit(1)).alias("_n"))
    out = wanted.withColumn("_low", F.lower("target")).join(of, "_low", "left")
    one = lambda c: F.when(F.col("_n") == 1, F.col(c)).alias(c)
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 1, "found").otherwise("ambiguous")
    return out.select(*wanted.columns, one("kind"), one("path"), status.alias("status"))


def resolve(spark: SparkSession, target: str, root: str) -> tuple[str, str]:
    """``(path, kind)`` of a target, a path or a name without case; else an error that lists what it could mean."""
    if src.is_path(target):
        row = src.read_target(spark, target).first()
        return row.path, row.kind
    known = targets(spark, root)
    hits = known.where(F.lower("name") == target.lower()).orderBy("path").limit(20).collect()
    if len(hits) == 1:
        return hits[0].path, hits[0].kind
    if hits:
        raise LookupError(f"{target} is ambiguous: " + ", ".join(h.path for h in hits))
    near = fuzzy_match(spark.createDataFrame([(target,)], "t string"), known, "t", "name").orderBy("distance", "b").limit(10).collect()
    raise LookupError(f"nothing is called {target}" + ("; did you mean " + ", ".join(n.b for n in near) + "?" if near else ""))


def update(spark: SparkSession, target: str, root: str, cache_path: str, generator: Generator | None = None, model: str = "offline") -> Result:
    """Describe one file anew, fresh or not, and give its page and the index.

    Metadata comes from the files, so the index keeps folders, states and counts.
    """
    if not src.exists(spark, cache_path):
        raise FileNotFoundError(f"no snapshot at {cache_path}: run a full build first")
    root = src.canonical(spark, root)
    path, kind = resolve(spark, target, root)
    if kind in cache.NEVER_FRESH:
        raise ValueError("custom metadata has no description to update")
    with scratch.room(spark) as keep:
        tables = _kept(_metadata(spark, root), keep)
        generator, journal = generator or OfflineGenerator(), _journal(cache_path, model)
        if hasattr(generator, "prepare"):
            generator.prepare()
        store.delete(journal.folder)  # fresh or not, it is described anew
        made = keep(enrich(work_rows(tables, [kind]).where(F.col("path") == path), generator, 1, journal=journal))
        if bad := made.where("error is not null").head():
            raise Failed(bad.error)
        cache.add(made, cache_path, model)
        name = made.select("name").first().name
        store.delete(journal.folder)
        snapshot = cache.load(spark, cache_path)
        all_pages = pages(tables, snapshot, keep)
        one = all_pages.where(((F.col("kind") == kind) & (F.col("name") == name)) | (F.col("kind") == "index"))
        return Result(scratch.stored(one), snapshot, {"files": 1, "up_to_date": 0, "made": 1, "failed": 0})


def impact(tables: dict[str, DataFrame]) -> DataFrame:
    """Extension: ``(source, target)`` references between known names, of classes and triggers."""
    refs = None
    for k in ("apex", "triggers"):
        if k in tables:
            part = tables[k].select(F.col("name").alias("source"), F.explode("references").alias("target"))
            refs = part if refs is None else refs.union(part)
    return refs.join(entities(tables).select(F.col("name").alias("target")).distinct(), "target").where("source <> target").select("source", "target").distinct()


def unreferenced(tables: dict[str, DataFrame]) -> DataFrame:
    """Extension: classes that nothing refers to."""
    return tables["apex"].select("name").join(impact(tables).select(F.col("target").alias("name")), "name", "left_anti")


