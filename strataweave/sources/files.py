"""Scanning a tree of files into ``source_files`` tables, one row a file.

A tree is first walked, folder by folder and level by level: pruned folders and
links to folders are not entered, and files above the size limit are named. Names
that begin with ``_`` or ``.`` are hidden, files and folders; ``include_hidden``
takes them too.

A small tree, or one that is not on a local or mounted file system, is walked by
the driver. What is left falls into whole subtrees, in which nothing is pruned,
and single files beside pruned folders; Spark's binary-file reader lists and reads
these on the executors. Of a local tree with more than ``FEW_ENTRIES`` entries the
executors, which must see it, write a table of its files, level by level, and read
the files that this table names: the driver sees neither names nor statuses, and
files are put in order and beside each other by their names, before they are read.
"""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_matches, path_part
from . import scratch, store

log = logging.getLogger(__name__)

#: Folders that are never entered, and the largest file in bytes.
PRUNED = (".git", ".sfdx", "node_modules", "target")
MAX_BYTES = 10 * 1024 * 1024


@dataclass(frozen=True)
class Kind:
    """How files of a kind are found: suffix, an excluded part of the name, a folder that must be above, the page folder."""

    name: str
    suffix: str
    folder: str
    excluded: str = ""
    ancestor: str = ""
    taggable: bool = False
    companion: bool = False


#: The nine kinds, in the order in which a suffix is looked up.
KINDS = (
    Kind("flows", ".flow-meta.xml", "flows"),
    Kind("validation-rules", ".validationRule-meta.xml", "validation-rules"),
    Kind("objects", ".object-meta.xml", "objects"),
    Kind("flexipages", ".flexipage-meta.xml", "flexipages"),
    Kind("custom-metadata", ".md-meta.xml", "custom-metadata", ancestor="customMetadata"),
    Kind("lwc", ".js-meta.xml", "lwc", ancestor="lwc", companion=True),
    Kind("triggers", ".trigger", "triggers", excluded="-meta.xml", taggable=True),
    Kind("apex", ".cls", "classes", excluded="-meta.xml", taggable=True),
    Kind("aura", ".cmp", "aura", ancestor="aura", companion=True),
)
BY_NAME = {k.name: k for k in KINDS}
SCHEMA = "path string, filename string, length long, raw_source string, error string"


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, local or not, and the path in its terms."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def canonical(spark: SparkSession, path: str) -> str:
    """One spelling of a path: absolute, links of local ones resolved, the ``file:`` prefix left out."""
    fs, at = file_system(spark, path)
    full = fs.makeQualified(at).toString()
    return os.path.realpath(re.sub("^file:/+", "/", full)) if full.startswith("file:") else full


def kind_of(path: str) -> str | None:
    """The kind of the first suffix that fits; None for other files."""
    return next((k.name for k in KINDS if path.endswith(k.suffix)), None)


def is_path(target: str) -> bool:
    """Whether a target names a path: it has a slash or backslash, or a known suffix."""
    return "/" in target or "\\" in target or kind_of(target) is not None


def kind_column(path: Column) -> Column:
    """``kind_of`` of a column; null for other files and null paths."""
    return F.coalesce(*[F.when(F.endswith(path, F.lit(k.suffix)), k.name) for k in KINDS])


def path_column(target: Column) -> Column:
    """``is_path`` of a column."""
    return F.contains(target, F.lit("/")) | F.contains(target, F.lit("\\")) | kind_column(target).isNotNull()


@dataclass(frozen=True)
class Look:
    """One folder: folders to enter, whether it holds something that must not be entered, and its files of known endings with their sizes."""

    folders: list[str]
    mixed: bool
    files: list[tuple[str, int]]


#: Endings of files that are ever read.
ENDINGS = (*(k.suffix for k in KINDS), ".js", ".html", ".field-meta.xml")
#: Entries of a local tree up to which the driver walks it.
FEW_ENTRIES = 2000
#: Folders and files for which a task is planned, bytes and files after which it hands on what it has read, and names after which it hands on what it has listed.
FOLDERS_A_TASK, FILES_A_TASK, BYTES_A_BATCH, FILES_A_BATCH, NAMES_A_BATCH = 10_000, 5000, 8 << 20, 1000, 10_000


def is_hidden(path: str) -> bool:
    return path.rsplit("/", 1)[1].startswith(("_", "."))


def _few(root: str) -> bool:
    """Whether a local tree has at most ``FEW_ENTRIES`` entries; counts no further."""
    seen, todo = 0, [root]
    while todo:
        try:
            with os.scandir(todo.pop()) as entries:
                for e in entries:
                    seen += 1
                    if seen > FEW_ENTRIES:
                        return False
                    if e.is_dir(follow_symlinks=False) and e.name not in PRUNED:
                        todo.append(e.path)
        except OSError:  # named by the walk
            continue
    return True


def _entry(e: os.DirEntry) -> tuple[str, int, str] | None:
    if e.is_dir(follow_symlinks=False):
        return e.path, 0, "mixed" if e.name in PRUNED else "folder"
    if e.is_dir():
        return e.path, 0, "mixed"  # a link to a folder
    ending = next((x for x in ENDINGS if e.name.endswith(x)), None)
    return (e.path, e.stat().st_size, ending) if ending else None


def _entries(folder: str) -> Iterator[tuple[str, int, str]]:
    """What a local folder holds, one after the other: paths, sizes and endings of files of known endings; ``folder`` stands for the ending of folders to enter, ``mixed`` for that of what must not be entered."""
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                try:
                    found = _entry(e)
                except OSError:  # a link to nothing, or to itself
                    found = e.path, 0, "mixed"
                if found:
                    yield found
    except OSError as e:
        log.warning("%s cannot be listed: %s", folder, e)
        yield folder, 0, "mixed"


def _look_local(folder: str) -> Look:
    found = list(_entries(folder))
    return Look([p for p, _, x in found if x == "folder"], any(x == "mixed" for *_, x in found), [(p, n) for p, n, x in found if x in ENDINGS])


def _look_at(spark: SparkSession, folder: str) -> Look:
    """The same on any of Hadoop's file systems; these show no links."""
    fs, at = file_system(spark, folder)
    folders, mixed, files = [], False, []
    for status in fs.listStatus(at):
        path, name = status.getPath().toString(), status.getPath().getName()
        if not status.isDirectory():
            if name.endswith(ENDINGS):
                files.append((path, status.getLen()))
        elif name in PRUNED:
            mixed = True
        else:
            folders.append(path)
    return Look(folders, mixed, files)


def _look_apart(spark: SparkSession, folders: list[str]) -> dict[str, Look]:
    """Folders of a local or mounted file system, looked at by the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_look_local(f) for f in pdf["folder"]]
            yield pd.DataFrame({"folder": pdf["folder"], "folders": [x.folders for x in found], "mixed": [x.mixed for x in found], "files": [[{"path": p, "size": n} for p, n in x.files] for x in found]})

    rows = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(4 * spark.sparkContext.defaultParallelism)
    schema = "folder string, folders array<string>, mixed boolean, files array<struct<path:string,size:long>>"
    return {r.folder: Look(list(r.folders), r.mixed, [(f.path, f.size) for f in r.files]) for r in rows.mapInPandas(run, schema).toLocalIterator()}


@dataclass(frozen=True)
class Tree:
    """What a walk leaves of ``root``: subtrees to read as a whole, and files to read one by one; or, of a large tree, the table ``(path, length, ending)`` of all files and how many have each ending."""

    root: str
    whole: list[str] = field(default_factory=list)
    files: list[tuple[str, int]] = field(default_factory=list)
    include_hidden: bool = False
    listing: DataFrame | None = None
    counts: dict[str, int] = field(default_factory=dict)


_LISTED = "path string, length long, ending string"


def _names(batches: Iterator[pa.RecordBatch], include_hidden: bool) -> Iterator[pa.RecordBatch]:
    """What the folders of ``batches`` hold as ``_LISTED``, handed on as they are listed: a task keeps ``NAMES_A_BATCH`` names, however many a folder has."""
    found = []

    def part() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "length", "ending"])

    for batch in batches:
        for folder in batch.column(0).to_pylist():
            for row in _entries(folder):
                if row[2] != "mixed" and (include_hidden or not is_hidden(row[0])):
                    found.append(row)
                    if len(found) >= NAMES_A_BATCH:
                        yield part()
                        found.clear()
    if found:
        yield part()


def _list_level(folders: DataFrame, many: int, include_hidden: bool, to: str) -> tuple[dict[str, int], int]:
    """Write what a level's folders hold to the table ``to``; folders to enter have the ending ``folder``. How many rows have each ending, and the largest length, are counted as they are written."""
    tasks = max(1, min(many, folders.sparkSession.sparkContext.defaultParallelism), -(-many // FOLDERS_A_TASK))
    seen, endings = Observation(), (*ENDINGS, "folder")
    each = [F.count_if(F.col("ending") == e).alias(f"n{i}") for i, e in enumerate(endings)]
    folders.repartition(tasks).mapInArrow(partial(_names, include_hidden=include_hidden), _LISTED).observe(seen, *each, F.max("length").alias("most")).write.parquet(to)
    return {e: seen.get[f"n{i}"] for i, e in enumerate(endings)}, seen.get["most"] or 0


def _walk_apart(spark: SparkSession, root: str, include_hidden: bool) -> Tree:
    """A walk by the executors; the driver sees counts, and the names of files above the size limit."""
    levels, many, counts = [], 1, {}
    folders = spark.createDataFrame([(root,)], "path string")
    while many:
        levels.append(scratch.passing(spark))
        here, most = _list_level(folders, many, include_hidden, levels[-1])
        found = spark.read.schema(_LISTED).parquet(levels[-1])
        for ending, n in here.items():
            counts[ending] = counts.get(ending, 0) + n
        if most > MAX_BYTES:
            for r in found.where(F.col("length") > MAX_BYTES).toLocalIterator():
                _too_large(r.path, r.length)
        folders, many = found.where("ending = 'folder'").select("path"), here["folder"]
    listing = spark.read.schema(_LISTED).parquet(*levels).where(F.col("length") <= MAX_BYTES)
    return Tree(root, include_hidden=include_hidden, listing=listing, counts=counts)


def _too_large(path: str, size: int) -> None:
    log.warning("%s is left out: %.1f MB are more than %d MB", path, size / (1 << 20), MAX_BYTES >> 20)


def walk(spark: SparkSession, root: str, include_hidden: bool = False) -> Tree:
    """Walk a tree once, for all kinds. Of a small tree, or one that is not local, the driver keeps a few bytes a folder and the files beside pruned ones, as the reader keeps a row a file."""
    root = canonical(spark, root)
    local = root.startswith("/")
    if not exists(spark, root):
        raise FileNotFoundError(f"no such folder: {root}")
    if local and not _few(root):
        return _walk_apart(spark, root, include_hidden)
    parent, mixed, files, level = {}, set(), {}, [root]
    while level:
        found = {f: _look_local(f) if local else _look_at(spark, f) for f in level}
        level = []
        for folder, look in found.items():
            for path, size in look.files:
                if size > MAX_BYTES:
                    _too_large(path, size)
            files[folder] = [(p, n) for p, n in look.files if n <= MAX_BYTES]
            if look.mixed:
                mixed.add(folder)
            for sub in look.folders:
                if include_hidden or not is_hidden(sub):
                    parent[sub] = folder
                    level.append(sub)
    if include_hidden:
        return Tree(root, [], [f for some in files.values() for f in some], True)
    for folder in list(mixed):  # whoever holds a mixed folder is mixed
        while (folder := parent.get(folder)) and folder not in mixed:
            mixed.add(folder)
    whole = [f for f in files if f not in mixed and (f == root or parent[f] in mixed)]
    shown = [(p, n) for f in mixed for p, n in files.get(f, []) if not is_hidden(p)]
    return Tree(root, whole, shown)


def _tree(spark: SparkSession, root: str | Tree, include_hidden: bool) -> Tree:
    return root if isinstance(root, Tree) else walk(spark, root, include_hidden)


def _as_text(raw: DataFrame) -> DataFrame:
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return raw.select(
        "path", F.substring_index("path", "/", -1).alias("filename"), "length",
        F.when(valid, F.col("content").cast("string")).otherwise("").alias("raw_source"), F.when(~valid, F.lit("not UTF-8")).alias("error"),
    )


def _binary(spark: SparkSession, paths: list[str], suffix: str = "") -> DataFrame:
    plain = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]  # a bracket in a name is no pattern
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*" + suffix).load(plain)
    return raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "content")


def _texts(listed: DataFrame, paths: dict[str, str]) -> DataFrame:
    """``listed`` with the texts of the files that some of its columns name, read where the row is, in order: ``paths`` gives each such column and the name of the text's column; beside it ``<name>_ok`` says whether it is UTF-8. A null path has a null text."""
    kept = listed.columns
    new = [c for name in paths.values() for c in (name, f"{name}_ok")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts, begun, size = [batch.column(kept.index(p)).to_pylist() for p in paths], [[] for _ in paths], 0, 0

            def part(end: int, begun: int, texts: list, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                read = [a for t in texts for a in (pa.array([x for x, _ in t], pa.string()), pa.array([ok for _, ok in t], pa.bool_()))]
                return pa.RecordBatch.from_arrays([*batch.slice(begun, end - begun).columns, *read], names=[*kept, *new])

            for i, row in enumerate(zip(*columns, strict=True)):
                for text, path in zip(texts, row, strict=True):
                    raw = None
                    if path is not None:
                        with open(path, "rb") as f:
                            raw = f.read()
                        size += len(raw)
                    try:
                        text.append((None if raw is None else raw.decode(), None if raw is None else True))
                    except UnicodeDecodeError:
                        text.append(("", False))
                if size >= BYTES_A_BATCH or i + 1 - begun >= FILES_A_BATCH:
                    yield part(i + 1, begun, texts)
                    texts, begun, size = [[] for _ in paths], i + 1, 0
            if begun < batch.num_rows:
                yield part(batch.num_rows, begun, texts)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema)
    return listed.mapInArrow(run, schema + "".join(f", {t} string, {t}_ok boolean" for t in paths.values()))


def _listed(tree: Tree, suffix: str) -> DataFrame:
    """``(path, filename, length)`` of the files of a large tree with a suffix that is in ``ENDINGS``."""
    return tree.listing.where(F.col("ending") == suffix).select("path", F.substring_index("path", "/", -1).alias("filename"), "length")


def _tasks(tree: Tree, suffix: str) -> int:
    """Tasks that read the files with the suffix."""
    many = tree.counts.get(suffix, 0)
    return max(1, min(many, tree.listing.sparkSession.sparkContext.defaultParallelism), -(-many // FILES_A_TASK))


def read_files(spark: SparkSession, root: str | Tree, suffix: str, include_hidden: bool = False) -> DataFrame:
    """All files of a tree with the suffix, as text; those that are no UTF-8 have an error instead."""
    tree = _tree(spark, root, include_hidden)
    if tree.listing is not None:
        read = _texts(_listed(tree, suffix).repartition(_tasks(tree, suffix)), {"path": "raw_source"})
        return read.select("path", "filename", "length", "raw_source", F.when(~F.col("raw_source_ok"), "not UTF-8").alias("error"))
    single = [(p, n) for p, n in tree.files if p.endswith(suffix)]
    if tree.include_hidden:

        def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for path, length in zip(pdf["path"], pdf["length"], strict=True):
                    yield pd.DataFrame({"path": [path], "length": [length], "content": [store.read(path)]})

        listed = spark.createDataFrame(single, "path string, length long")
        return _as_text(listed.repartition(max(1, min(len(single), spark.sparkContext.defaultParallelism))).mapInPandas(load, "path string, length long, content binary"))
    paths = [*tree.whole, *(p for p, _ in single)]
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    return _as_text(_binary(spark, paths, suffix).where(F.col("length") <= MAX_BYTES))


def _folder(path: str = "path") -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _of_kind(files: DataFrame, k: Kind, name: str | None) -> DataFrame:
    """``files(path, filename, ...)`` of a kind and, unless there is none, a name's pattern, with ``stem`` and ``folder_path``."""
    if k.excluded:
        files = files.where(~F.contains("filename", F.lit(k.excluded)))
    if k.ancestor:
        files = files.where(F.array_contains(F.split("path", "/"), k.ancestor))
    stem = F.substr(F.col("filename"), F.lit(1), F.length("filename") - len(k.suffix))
    files = files.withColumn("stem", stem).withColumn("folder_path", _folder())
    return files.where(glob_matches(name, F.col("stem"), F.col("filename"))) if name else files


def listed(spark: SparkSession, root: str | Tree, kind: str) -> DataFrame:
    """``(path, filename, stem)`` of one kind, in no order; no file is read."""
    k, root = BY_NAME[kind], _tree(spark, root, False)
    files = read_files(spark, root, k.suffix) if root.listing is None else _listed(root, k.suffix)
    return _of_kind(files, k, None).select("path", "filename", "stem")


def _scan_listed(tree: Tree, k: Kind, name: str | None, ordered: bool = True, markup: bool = False) -> DataFrame:
    """``scan`` of a large tree: names meet their scripts' names, and those of their markup, and are put in order or dealt out, then the files are read."""
    files, beside = _of_kind(_listed(tree, k.suffix), k, name), lambda suffix, key, to: _listed(tree, suffix).select(_folder().alias("folder_path"), F.substr(F.col("filename"), F.lit(1), F.length("filename") - len(suffix)).alias(key), F.col("path").alias(to)).hint("merge")
    if k.companion:
        files = files.join(beside(".js", "stem", "_script"), ["folder_path", "stem"], "left")
    else:
        files = files.withColumn("_script", F.lit(None).cast("string"))
    if markup:
        files = files.withColumn("_component", component()).join(beside(".html", "_component", "_markup"), ["folder_path", "_component"], "left")
    many = _tasks(tree, k.suffix)
    placed = files.repartitionByRange(many, "filename", "path").sortWithinPartitions("filename", "path") if ordered else files.repartition(many, "path")
    read = _texts(placed, {"path": "raw_source"} | ({"_script": "script"} if k.companion else {}) | ({"_markup": "html"} if markup else {}))
    script = F.when(F.col("script_ok"), F.col("script")) if k.companion else F.lit(None).cast("string")
    source = F.coalesce(script, F.col("raw_source")) if k.name == "lwc" else F.col("raw_source")
    html = [F.when(F.col("html_ok"), F.col("html")).alias("html")] if markup else []
    return read.select("path", "filename", "stem", "folder_path", "length", source.alias("raw_source"), F.when(~F.col("raw_source_ok"), "not UTF-8").alias("error"), script.alias("script"), *html)


def component(path: str = "path") -> Column:
    """The folder that a file lies in, by its last name: what a component is called."""
    return path_part(F.col(path), 2, "")


def scan(spark: SparkSession, root: str | Tree, kind: str, include_hidden: bool = False, name: str | None = None, ordered: bool = True) -> DataFrame:
    """``(path, filename, stem, folder_path, length, raw_source, error, script)`` of one kind, by filename and path unless it may come in no order; ``name`` is a shell pattern for the stem or the whole file name.

    Lightning components take the text of the script beside them, if there is
    one; Aura components keep their markup and have the script apart. Files
    above the size limit are left out.
    """
    k, root = BY_NAME[kind], _tree(spark, root, include_hidden)
    if root.listing is not None:
        return _scan_listed(root, k, name, ordered)
    files = _of_kind(read_files(spark, root, k.suffix), k, name)
    if k.companion:
        js = read_files(spark, root, ".js").where("error is null")
        js = js.select(_folder().alias("folder_path"), F.regexp_replace("filename", r"\.js$", "").alias("stem"), F.col("raw_source").alias("script"))
        files = files.join(js, ["folder_path", "stem"], "left")
        if kind == "lwc":
            files = files.withColumn("raw_source", F.coalesce("script", "raw_source"))
    else:
        files = files.withColumn("script", F.lit(None).cast("string"))
    files = files.select("path", "filename", "stem", "folder_path", "length", "raw_source", "error", "script")
    return files.orderBy("filename", "path") if ordered else files


def with_markup(spark: SparkSession, root: str | Tree, kind: str, include_hidden: bool = False, name: str | None = None) -> DataFrame:
    """``scan`` in no order; Lightning components have the text of the markup of their name beside them as ``html``. Of a large tree only names are joined."""
    tree = _tree(spark, root, include_hidden)
    if kind != "lwc":
        return scan(spark, tree, kind, include_hidden, name, ordered=False)
    if tree.listing is not None:
        return _scan_listed(tree, BY_NAME[kind], name, ordered=False, markup=True)
    html = scan_markup(spark, tree, include_hidden)
    files = scan(spark, tree, kind, include_hidden, name, ordered=False).withColumn("component_name", component())
    return files.join(html.hint("merge"), ["folder_path", "component_name"], "left").select("path", "filename", "stem", "folder_path", "length", "raw_source", "error", "script", "html")


def is_empty(spark: SparkSession, root: str | Tree, kind: str, include_hidden: bool = False, name: str | None = None) -> bool:
    """Whether there is no file of a kind; of a large tree none is read."""
    k, tree = BY_NAME[kind], _tree(spark, root, include_hidden)
    return _of_kind(read_files(spark, tree, k.suffix, include_hidden) if tree.listing is None else _listed(tree, k.suffix), k, name).isEmpty()


def scan_markup(spark: SparkSession, root: str | Tree, include_hidden: bool = False) -> DataFrame:
    """``(folder_path, component_name, html)`` of markup files, to join to components."""
    html = read_files(spark, root, ".html", include_hidden).where("error is null")
    return html.select(_folder().alias("folder_path"), F.regexp_replace("filename", r"\.html$", "").alias("component_name"), F.col("raw_source").alias("html"))


def scan_fields(spark: SparkSession, root: str | Tree, include_hidden: bool = False) -> DataFrame:
    """Field files in a ``fields`` folder: ``(object_dir, path, filename, stem, raw_source)``; unreadable ones are left out."""
    files = read_files(spark, root, ".field-meta.xml", include_hidden).where("error is null").withColumn("_in", _folder())
    files = files.where(F.endswith("_in", F.lit("/fields")))
    return files.select(F.regexp_replace("_in", "/fields$", "").alias("object_dir"), "path", "filename", F.regexp_replace("filename", r"\.field-meta\.xml$", "").alias("stem"), "raw_source")


def scan_all(spark: SparkSession, root: str | Tree, kinds: list[str] | None = None, name: str | None = None, include_hidden: bool = False) -> dict[str, DataFrame]:
    """The chosen kinds (all, if none is named); ``name`` is a shell pattern for the stem or the whole file name."""
    root = _tree(spark, root, include_hidden)
    return {k: scan(spark, root, k, name=name) for k in chosen(kinds)}


def chosen(kinds: list[str] | None) -> list[str]:
    """The kinds in their order; all, if none is named."""
    unknown = set(kinds or []) - set(BY_NAME)
    if unknown:
        raise ValueError(f"unknown kinds: {', '.join(sorted(unknown))}")
    return [k.name for k in KINDS if not kinds or k.name in kinds]


def read_target(spark: SparkSession, path: str) -> DataFrame:
    """One file by its path, without size or folder checks; a missing one is an error of its own."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no such file: {path}")
    if kind_of(path) is None:
        raise ValueError(f"not a known kind of file: {path}")
    return read_targets(spark, [canonical(spark, path)])


def read_targets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, filename, kind, raw_source)`` of files by their canonical paths, in one scan; files of no known kind have a null kind."""
    raw = _binary(spark, paths).select("path", F.substring_index("path", "/", -1).alias("filename"), F.col("content").cast("string").alias("raw_source"))
    return raw.select("path", "filename", kind_column(F.col("path")).alias("kind"), "raw_source")
