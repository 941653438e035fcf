"""Markdown pages and the index, as string expressions over joined tables.

Input rows have the metadata columns of their kind, the description ``doc``
(by ``from_json``) and ``see_also``, an array of finished lines. Sections whose
list or text is empty are left out, with their line in the table of contents.
Cells are not escaped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import badges, direction, field_type, sanitize_filename
from ..operators.relational import containment_link, small
from ..sources.page_sink import TextFiles
from ..sources.scratch import stored

#: Page folders by kind, and which kind owns a name that several have.
FOLDERS = {"apex": "classes", "triggers": "triggers", "flows": "flows", "validation-rules": "validation-rules", "objects": "objects", "lwc": "lwc", "flexipages": "flexipages", "aura": "aura", "custom-metadata": "custom-metadata"}
PRIORITY = {k: i for i, k in enumerate(("apex", "triggers", "flows", "validation-rules", "objects", "lwc", "flexipages", "aura"))}


def _or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def text_section(title: str, body: Column) -> tuple[str, Column, Column]:
    return title, _or_empty(body) != "", F.concat(F.lit(f"## {title}\n\n"), _or_empty(body), F.lit("\n\n"))


def list_section(title: str, items: Column) -> tuple[str, Column, Column]:
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")
    return title, F.coalesce(F.size(items) > 0, F.lit(False)), F.concat(F.lit(f"## {title}\n\n"), lines, F.lit("\n"))


def table_section(title: str, heads: list[str], items: Column, cells: object) -> tuple[str, Column, Column]:
    head = "| " + " | ".join(heads) + " |\n|" + "|".join("-" * (len(h) + 2) for h in heads) + "|\n"
    rows = F.array_join(F.transform(items, lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", *cells(x)), F.lit(" |\n"))), "")
    return title, F.coalesce(F.size(items) > 0, F.lit(False)), F.concat(F.lit(f"## {title}\n\n{head}"), rows, F.lit("\n"))


def code(x: Column) -> Column:
    return F.concat(F.lit("`"), _or_empty(x), F.lit("`"))


def page(title: Column, badge: Column, summary: Column, sections: list[tuple[str, Column, Column]], tags: Column | None = None, toc: bool = True, toc_extra: dict[str, Column] | None = None) -> Column:
    """Title, badges, tags, summary, contents, and the sections that have something."""
    parts = [F.concat(F.lit("# "), title, F.lit("\n\n")), F.when(badge != "", F.concat(badge, F.lit("\n\n"))).otherwise("")]
    if tags is not None:
        parts.append(F.when(F.size(tags) > 0, F.concat(F.lit("**Tags:** "), F.array_join(F.transform(tags, code), ", "), F.lit("\n\n"))).otherwise(""))
    parts.append(F.concat(_or_empty(summary), F.lit("\n\n")))
    if toc:
        lines = []
        for name, there, _ in sections:
            line = F.concat(F.lit(f"- [{name}](#{name.lower().replace(' ', '-')})\n"), (toc_extra or {}).get(name, F.lit("")))
            lines.append(F.when(there, line).otherwise("") if name != "See Also" else F.lit(""))
        parts.append(F.concat(F.lit("## Table of Contents\n\n"), *lines, F.lit("\n")))
    parts += [F.when(there, body).otherwise("") for _, there, body in sections]
    return F.concat(*parts)


def _see() -> tuple[str, Column, Column]:
    return list_section("See Also", F.col("see_also"))


def class_page() -> Column:
    c, doc = F.col, F.col("doc")
    known = lambda name, items: F.get(F.filter(items, lambda m: m["name"] == name), F.lit(0))
    kind = lambda p: F.coalesce(F.when(known(p["name"], c("properties"))["is_static"], F.concat(F.lit("static "), known(p["name"], c("properties"))["property_type"])).otherwise(known(p["name"], c("properties"))["property_type"]), F.lit("—"))

    def method(m: Column) -> Column:
        of = known(m["name"], c("methods"))
        args = F.array_join(F.transform(of["params"], lambda p: F.concat_ws(" ", p["param_type"], p["name"])), ", ")
        sign = F.coalesce(F.concat(F.when(of["is_static"], F.lit("static ")).otherwise(""), of["return_type"], F.lit(" "), of["name"], F.lit("("), args, F.lit(")")), m["name"])
        params = F.when(F.size(m["params"]) > 0, F.concat(F.lit("**Parameters**\n\n| Name | Description |\n|------|-------------|\n"), F.array_join(F.transform(m["params"], lambda p: F.concat(F.lit("| "), code(p["name"]), F.lit(" | "), _or_empty(p["description"]), F.lit(" |\n"))), ""), F.lit("\n"))).otherwise("")
        returns = F.when(~_or_empty(m["returns"]).isin("", "void"), F.concat(F.lit("**Returns:** "), m["returns"], F.lit("\n\n"))).otherwise("")
        throws = F.when(F.size(m["throws"]) > 0, F.concat(F.lit("**Throws**\n\n"), F.array_join(F.transform(m["throws"], lambda t: F.concat(F.lit("- "), t, F.lit("\n"))), ""), F.lit("\n"))).otherwise("")
        return F.concat(F.lit("### `"), sign, F.lit("`\n\n"), _or_empty(m["description"]), F.lit("\n\n"), params, returns, throws)

    has = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))
    methods = ("Methods", has(doc["methods"]), F.concat(F.lit("## Methods\n\n"), F.array_join(F.transform(doc["methods"], method), "")))
    names = F.array_join(F.transform(doc["methods"], lambda m: F.concat(F.lit("  - ["), code(m["name"]), F.lit("](#"), F.lower(m["name"]), F.lit(")\n"))), "")
    examples = ("Usage Examples", has(doc["usage_examples"]), F.concat(F.lit("## Usage Examples\n\n"), F.array_join(F.transform(doc["usage_examples"], lambda e: F.concat(e, F.lit("\n\n"))), "")))
    by = ("Implemented By", c("is_interface") & has(c("implemented_by")), list_section("Implemented By", F.transform("implemented_by", lambda n: F.concat(F.lit("["), n, F.lit("]("), n, F.lit(".md)"))))[2])
    badge = badges(
        (c("access_modifier") != "", c("access_modifier")), (c("is_interface"), "interface"), (c("is_abstract"), "abstract"), (c("is_virtual"), "virtual"),
        (c("extends").isNotNull(), F.concat(F.lit("extends "), c("extends"))), (F.size("implements") > 0, F.concat(F.lit("implements "), F.array_join("implements", ", "))),
    )
    sections = [text_section("Description", doc["description"]), by, table_section("Properties", ["Name", "Type", "Description"], doc["properties"], lambda p: [code(p["name"]), code(kind(p)), _or_empty(p["description"])]), methods, examples, _see()]
    return page(c("name"), badge, doc["summary"], sections, c("tags"), toc_extra={"Methods": _or_empty(names)})


def trigger_page() -> Column:
    c, doc = F.col, F.col("doc")
    linked = F.transform(doc["handler_classes"], lambda h: F.when(F.array_contains(c("known_handlers"), h), F.concat(F.lit("["), h, F.lit("](../classes/"), h, F.lit(".md)"))).otherwise(code(h)))
    badge = F.concat(F.lit("`trigger` · `on "), c("sobject"), F.lit("` · "), F.array_join(F.transform("events", code), " · "))
    sections = [text_section("Description", doc["description"]), table_section("Event Handlers", ["Event", "Description"], doc["events"], lambda e: [code(e["event"]), _or_empty(e["description"])]), list_section("Handler Classes", linked), list_section("Usage Notes", doc["usage_notes"]), _see()]
    return page(c("name"), badge, doc["summary"], sections, c("tags"))


def flow_page() -> Column:
    c, doc = F.col, F.col("doc")
    counts = F.filter(F.array(*[F.when(c(n) > 0, F.concat(F.lit(f"{n.title()}: "), c(n).cast("string"))) for n in ("decisions", "loops", "screens")]), lambda x: x.isNotNull())
    sections = [
        text_section("Description", doc["description"]), text_section("Business Process", doc["business_process"]), text_section("Entry Criteria", doc["entry_criteria"]),
        table_section("Variables", ["Name", "Type", "Direction"], c("variables"), lambda v: [code(v["name"]), code(v["data_type"]), direction(v["is_input"], v["is_output"])]),
        table_section("Record Operations", ["Operation", "Object"], c("record_operations"), lambda o: [o["operation"], code(o["object"])]),
        table_section("Action Calls", ["Action", "Type"], c("action_calls"), lambda a: [code(a["name"]), a["action_type"]]),
        list_section("Element Counts", counts), list_section("Key Decisions", doc["key_decisions"]), list_section("Admin Notes", doc["admin_notes"]), _see(),
    ]
    return page(c("label"), F.concat(F.lit("`flow` · "), code(c("process_type"))), doc["summary"], sections)


def rule_page() -> Column:
    c, doc = F.col, F.col("doc")
    formula = ("Error Condition Formula", c("error_condition_formula") != "", F.concat(F.lit("## Error Condition Formula\n\n```\n"), c("error_condition_formula"), F.lit("\n```\n\n")))
    shown = F.when(c("error_display_field") != "", F.concat(F.lit("**Displayed on field:** "), code(c("error_display_field")), F.lit("\n\n"))).otherwise("")
    message = ("Error Message", c("error_message") != "", F.concat(F.lit("## Error Message\n\n> "), c("error_message"), F.lit("\n\n"), shown))
    badge = F.concat(F.lit("`validation-rule` · `on "), c("object_name"), F.lit("` · "), F.when(c("active"), "`active`").otherwise("`inactive`"))
    sections = [text_section("When It Fires", doc["when_fires"]), text_section("What It Protects", doc["what_protects"]), formula, text_section("Formula Explanation", doc["formula_explanation"]), message, list_section("Edge Cases", doc["edge_cases"]), _see()]
    return page(c("name"), badge, doc["summary"], sections)


def object_page() -> Column:
    c, doc = F.col, F.col("doc")
    cells = lambda f: [code(f["api_name"]), field_type(f["field_type"], code(f["reference_to"])), f["label"], F.when(f["required"], "Yes").otherwise("No")]
    sections = [text_section("Purpose", doc["purpose"]), text_section("Description", doc["description"]), table_section("Fields", ["API Name", "Type", "Label", "Required"], c("fields"), cells), list_section("Key Fields", doc["key_fields"]), list_section("Admin Notes", doc["admin_notes"]), _see()]
    return page(F.when(c("label") != "", c("label")).otherwise(c("name")), F.concat(F.lit("`object` · "), code(c("name"))), doc["summary"], sections, toc=False)


def component_page() -> Column:
    c, doc = F.col, F.col("doc")
    is_method = lambda p: F.exists("api_props", lambda m: (m["name"] == p["name"]) & m["is_method"])
    slots = table_section("Slots", ["Slot", "Description"], c("slots"), lambda s: [F.when(s == "default", "_(default)_").otherwise(code(s)), F.lit("")])
    sections = [text_section("Description", doc["description"]), table_section("Public API", ["Name", "Kind", "Description"], doc["api_props"], lambda p: [code(p["name"]), F.when(is_method(p), "method").otherwise("property"), _or_empty(p["description"])]), slots, list_section("Usage Notes", doc["usage_notes"]), _see()]
    return page(c("name"), F.lit("`lwc` · `Lightning Web Component`"), doc["summary"], sections)


def flexipage_page() -> Column:
    c, doc = F.col, F.col("doc")
    badge = F.concat(F.lit("`lightning-page` · "), code(c("page_type")), F.lit(" · "), code(F.when(c("sobject") != "", c("sobject")).otherwise("—")))
    sections = [text_section("Description", doc["description"]), text_section("Usage Context", doc["usage_context"]), table_section("Components", ["Component"], c("component_names"), lambda n: [code(n)]), list_section("Key Components", doc["key_components"]), list_section("Referenced Flows", F.transform("flow_names", code)), _see()]
    return page(F.when(c("label") != "", c("label")).otherwise(c("name")), badge, doc["summary"], sections, toc=False)


def aura_page() -> Column:
    c, doc = F.col, F.col("doc")
    of = lambda p: F.get(F.filter("attributes", lambda a: a["name"] == p["name"]), F.lit(0))
    dash = lambda x: F.when(_or_empty(x) != "", x).otherwise("—")
    cells = lambda p: [code(p["name"]), code(dash(of(p)["attr_type"])), F.when(_or_empty(of(p)["default"]) != "", code(of(p)["default"])).otherwise("—"), _or_empty(p["description"])]
    badge = badges((F.lit(True), "aura"), (F.lit(True), "Aura Component"), (c("extends").isNotNull(), F.concat(F.lit("extends "), c("extends"))))
    sections = [text_section("Description", doc["description"]), table_section("Attributes", ["Name", "Type", "Default", "Description"], doc["attributes"], cells), list_section("Events", F.transform("events_handled", code)), list_section("Usage Notes", doc["usage_notes"]), _see()]
    return page(c("name"), badge, doc["summary"], sections)


PAGES = {"apex": class_page, "triggers": trigger_page, "flows": flow_page, "validation-rules": rule_page, "objects": object_page, "lwc": component_page, "flexipages": flexipage_page, "aura": aura_page}


def see_also(described: DataFrame, names: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """``(from_kind, path, see_also)`` of ``described(from_kind, path, relationships)``: those that contain a known name, with a link to it, in order; others are left out. Each different text is looked up once."""
    rels = described.select("from_kind", "path", F.posexplode("relationships").alias("pos", "rel"))
    owners = names.groupBy("name").agg(F.min_by("kind", "priority").alias("kind"))
    found = containment_link(rels.select("rel").distinct(), owners, ["rel"], "rel", "name").join(owners, F.col("linked") == owners["name"])
    linked = rels.join(small(keep(found.select("rel", "linked", "kind"))), "rel")
    target = F.lit(None).cast("string")
    for k, folder in FOLDERS.items():
        way = F.when(F.col("from_kind") == k, "").otherwise(f"../{folder}/")
        target = F.when(F.col("kind") == k, F.concat(way, sanitize_filename(F.col("linked")), F.lit(".md"))).otherwise(target)
    line = F.concat(F.lit("["), F.col("linked"), F.lit("]("), target, F.lit(") — "), F.col("rel"))
    return linked.groupBy("from_kind", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]).alias("see_also"))


def record_pages(records: DataFrame) -> DataFrame:
    """``(kind, name, body)`` of custom-metadata types: one table a type, a column a field, the first value a record."""
    rows = records.select("type_name", "record_name", "label", F.posexplode_outer("values").alias("pos", "v")).select("type_name", "record_name", "label", "pos", F.col("v.field").alias("field"), F.col("v.value").alias("value"))
    fields = rows.where("field is not null").groupBy("type_name").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    first = rows.where("field is not null").groupBy("type_name", "record_name", "label", "field").agg(F.min_by("value", "pos").alias("value"))
    maps = first.groupBy("type_name", "record_name", "label").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("map"))
    keyed = records.select("type_name", "record_name", "label").join(maps, ["type_name", "record_name", "label"], "left").join(fields, "type_name", "left")
    none = F.array().cast("array<string>")
    cells = F.transform(F.coalesce("fields", none), lambda f: F.concat(F.lit("| "), F.coalesce(F.element_at("map", f), F.lit("—")), F.lit(" ")))
    line = F.concat(F.lit("| "), code(F.col("record_name")), F.lit(" | "), F.col("label"), F.lit(" "), F.array_join(cells, ""), F.lit("|\n"))
    out = keyed.groupBy("type_name", F.coalesce("fields", none).alias("fields")).agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("record_name", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    head = F.concat(F.lit("| Record | Label"), F.array_join(F.transform("fields", lambda f: F.concat(F.lit(" | "), f)), ""), F.lit(" |\n|--------|------"), F.array_join(F.transform("fields", lambda f: F.lit("|------")), ""), F.lit("|\n"))
    body = F.concat(F.lit("# "), F.col("type_name"), F.lit("\n\n`custom-metadata-type`\n\n"), F.col("n").cast("string"), F.lit(" record(s)\n\n## Records\n\n"), head, F.array_join("lines", ""))
    return out.select(F.lit("custom-metadata").alias("kind"), F.col("type_name").alias("name"), body.alias("body"))


#: Index sections in order: title, kind, columns, and whether rows are grouped by folder.
INDEX = (
    ("Classes", "apex", ("Class", "Summary"), True),
    ("Interfaces", "interface", ("Interface", "Summary"), False),
    ("Triggers", "triggers", ("Trigger", "SObject", "Summary"), True),
    ("Flows", "flows", ("Flow", "Process Type", "Summary"), True),
    ("Validation Rules", "validation-rules", ("Rule", "Object", "Status", "Summary"), True),
    ("Objects", "objects", ("Object", "Label", "Fields", "Summary"), False),
    ("Lightning Web Components", "lwc", ("Component", "@api Props", "Summary"), True),
    ("Lightning Pages", "flexipages", ("Page", "Type", "Summary"), False),
    ("Custom Metadata Types", "custom-metadata", ("Type", "Records"), False),
    ("Aura Components", "aura", ("Component", "Attributes", "Summary"), False),
)
COUNTED = (("apex", "class(es)"), ("triggers", "trigger(s)"), ("flows", "flow(s)"), ("validation-rules", "validation rule(s)"), ("objects", "object(s)"), ("lwc", "LWC component(s)"), ("flexipages", "Lightning page(s)"), ("custom-metadata", "Custom Metadata type(s)"), ("aura", "Aura component(s)"))


def index(entries: DataFrame) -> DataFrame:
    """One row ``body`` from ``entries(kind, name, label, folder, cells)``.

    ``cells`` are the columns after the link; the label is what rows are sorted
    by and linked with; ``kind`` is ``interface`` for interfaces. Folders get a
    heading if a section has more than one.
    """
    order = F.create_map(*[F.lit(x) for i, s in enumerate(INDEX) for x in (s[1], i)])
    folder = F.create_map(*[F.lit(x) for _, k, _, _ in INDEX for x in (k, FOLDERS["apex" if k == "interface" else k])])
    grouped = F.col("kind").isin(*[s[1] for s in INDEX if s[3]])
    rows = entries.withColumn("group", F.when(grouped, F.coalesce("folder", F.lit(""))).otherwise("")).withColumn("at", F.element_at(order, F.col("kind")))
    link = F.concat(F.lit("| ["), F.col("label"), F.lit("]("), F.element_at(folder, F.col("kind")), F.lit("/"), sanitize_filename(F.col("name")), F.lit(".md) | "), F.array_join("cells", " | "), F.lit(" |\n"))
    per = rows.groupBy("at", "kind", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "name", link.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    head = F.create_map(*[F.lit(x) for s in INDEX for x in (s[1], "| " + " | ".join(s[2]) + " |\n|" + "|".join("-" * (len(h) + 2) for h in s[2]) + "|\n")])
    several = F.size(F.collect_set("group").over(W.partitionBy("kind"))) > 1
    title = F.concat(F.lit("### "), F.when(F.col("group") == "", "(root)").otherwise(F.col("group")), F.lit("\n\n"))
    block = per.withColumn("block", F.concat(F.when(several, title).otherwise(""), F.element_at(head, F.col("kind")), F.col("lines"), F.lit("\n")))
    heading = F.create_map(*[F.lit(x) for s in INDEX for x in (s[1], f"## {s[0]}\n\n")])
    sections = block.groupBy("at", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", "block"))), lambda x: x["block"]), "").alias("body"))
    sections = sections.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat(F.element_at(heading, F.col("kind")), "body").alias("body")))), lambda x: x["body"]), "").alias("body"))
    counts = entries.agg(*[F.count_if(F.col("kind") == k).alias(k) for k, _ in COUNTED])
    words = [F.concat(F.col(f"`{k}`").cast("string"), F.lit(f" {w}")) for k, w in COUNTED]
    line = F.concat(F.lit("# Apex Documentation Index\n\nGenerated documentation for "), F.concat_ws(", ", *words[:-1]), F.lit(", and "), words[-1], F.lit(".\n\n"))
    return counts.select(line.alias("line")).crossJoin(sections).select(F.concat("line", F.coalesce("body", F.lit(""))).alias("body"))  # one row each


def write_pages(pages: DataFrame, out: str) -> None:
    """``(kind, name, body)`` as one file a page below ``out``; folders appear with their first page, old pages stay.

    Executors write into staging folders below ``out``, which they must reach, and
    a commit moves the files into place: a run that fails leaves the old pages.
    Of several pages of one file the last by name and body holds.
    """
    folders = F.create_map(*[F.lit(x) for k, f in FOLDERS.items() for x in (k, f"{f}/")])
    file = F.concat(F.coalesce(F.element_at(folders, F.col("kind")), F.lit("")), sanitize_filename(F.col("name")), F.lit(".md"))
    rows = pages.select(file.alias("file"), "name", F.coalesce("body", F.lit("")).alias("body"))
    rows.sparkSession.dataSource.register(TextFiles)
    rows = rows.repartition("file").sortWithinPartitions("file", "name", "body").select("file", "body")
    rows.write.format(TextFiles.name()).option("path", out).mode("append").save()


def same_page(pages: DataFrame) -> DataFrame:
    """Pages that more than one entity would write: the last written wins, so these are worth a warning."""
    return pages.groupBy("kind", sanitize_filename(F.col("name")).alias("file")).agg(F.count(F.lit(1)).alias("entities")).where("entities > 1")


