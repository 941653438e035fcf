"""What a generator is asked about a file: metadata in words, and as much of the text as is useful."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import field_type, preview, signature

#: Code points of a flow's XML and of a component's script that go along.
FLOW_PREVIEW, SCRIPT_PREVIEW = 3000, 6000


def _line(title: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{title}: "), value, F.lit("\n"))).otherwise("")


def _list(title: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{title}:\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("* "), x, F.lit("\n"))), ""))).otherwise("")


def _source(title: str, text: Column) -> Column:
    return F.concat(F.lit(f"{title}:\n"), text, F.lit("\n"))


def prompt(kind: str) -> Column:
    """The prompt column over the metadata columns of a kind and ``raw_source``."""
    c, raw = F.col, F.col("raw_source")
    if kind == "apex":
        parts = [_line("Class", c("class_name")), _line("Extends", c("extends")), _list("Implements", c("implements")), _list("Methods", F.transform("methods", signature)), _list("Properties", F.transform("properties", lambda p: F.concat_ws(" ", p["property_type"], p["name"]))), _list("Comments", c("existing_comments")), _source("Source", raw)]
    elif kind == "triggers":
        parts = [_line("Trigger", c("trigger_name")), _line("Object", c("sobject")), _line("Events", F.array_join("events", ", ")), _list("Comments", c("existing_comments")), _source("Source", raw)]
    elif kind == "flows":
        names = lambda keep: F.transform(F.filter("variables", keep), lambda v: F.concat_ws(" ", v["data_type"], v["name"]))
        parts = [
            _line("Flow", c("label")), _line("Type", c("process_type")), _line("About", c("description")), _list("Inputs", names(lambda v: v["is_input"])), _list("Outputs", names(lambda v: v["is_output"])),
            _list("Record operations", F.transform("record_operations", lambda o: F.concat_ws(" ", o["operation"], o["object"]))), _list("Actions", F.transform("action_calls", lambda a: F.concat_ws(" ", a["name"], a["action_type"]))),
            _line("Decisions", c("decisions").cast("string")), _line("Loops", c("loops").cast("string")), _line("Screens", c("screens").cast("string")), _source("XML", preview(raw, FLOW_PREVIEW)),
        ]
    elif kind == "validation-rules":
        parts = [_line("Rule", c("rule_name")), _line("Object", c("object_name")), _line("Active", c("active").cast("string")), _line("About", c("description")), _source("Formula", c("error_condition_formula")), _line("Field", c("error_display_field")), _line("Message", c("error_message"))]
    elif kind == "objects":
        fields = F.transform("fields", lambda f: F.concat_ws(" | ", f["api_name"], field_type(f["field_type"], f["reference_to"]), f["label"], f["description"], f["help_text"]))
        parts = [_line("Object", c("object_name")), _line("Label", c("label")), _line("About", c("description")), _list("Fields", fields)]
    elif kind == "lwc":
        parts = [_line("Component", c("component_name")), _list("Public", F.transform("api_props", lambda p: F.concat_ws(" ", F.when(p["is_method"], "method").otherwise("property"), p["name"]))), _list("Slots", c("slots")), _list("Children", c("referenced_components")), _source("Script", preview(raw, SCRIPT_PREVIEW))]
    elif kind == "flexipages":
        parts = [_line("Page", c("label")), _line("Type", c("page_type")), _line("Object", c("sobject")), _line("About", c("description")), _list("Components", c("component_names")), _list("Flows", c("flow_names"))]
    elif kind == "aura":
        parts = [_line("Component", c("component_name")), _line("Extends", c("extends")), _list("Attributes", F.transform("attributes", lambda a: F.concat_ws(" ", a["attr_type"], a["name"], a["default"], a["description"]))), _list("Events", c("events_handled")), _source("Markup", preview(raw, SCRIPT_PREVIEW))]
    else:
        raise ValueError(f"{kind} has no prompt")
    return F.concat(*parts)


#: What the fields of a description are for.
ABOUT = {
    "class_name": "the name of the class or interface", "trigger_name": "the name of the trigger", "rule_name": "the name of the rule", "object_name": "the name of the object", "component_name": "the name of the component", "api_name": "the technical name", "label": "the name that users see",
    "sobject": "the object whose records it reacts to", "summary": "one sentence on what it is for", "description": "what it does and how, in a few paragraphs", "business_process": "the work of the organisation that it supports", "entry_criteria": "what makes it start",
    "when_fires": "in which situation a record is refused", "what_protects": "which data it keeps right, and why", "formula_explanation": "the formula in plain words, part by part", "purpose": "which thing of the business a record stands for", "usage_context": "who sees it, where and when",
    "methods": "every public or global method", "properties": "every public property", "events": "every event that it handles, and what happens then", "handler_classes": "names of the classes that it hands work to", "api_props": "every public property and method of the component", "attributes": "every attribute of the component",
    "usage_examples": "short pieces of code that use it", "usage_notes": "what whoever uses it has to know", "key_decisions": "where it branches, and on what", "admin_notes": "what an administrator has to know", "key_fields": "the most important fields, and what they are for", "key_components": "the most important components, and what they show", "edge_cases": "unusual values and what happens with them",
    "relationships": "other classes, objects, flows or components that it works with, each named as it is called, with the way they work together",
}


def _shape(kind: str) -> str:
    """A Spark type in words that fit a JSON value."""
    if not kind.startswith("array<"):
        return "a text"
    inner = kind[len("array<") : -1]
    if not inner.startswith("struct<"):
        return "a list of texts"
    parts, depth, at = [], 0, ""
    for c in inner[len("struct<") : -1] + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(at)
            at = ""
        else:
            at += c
    return "a list of objects with " + ", ".join(f'"{n}" ({_shape(t)})' for n, t in (p.split(":", 1) for p in parts))


def system(kind: str, fields: dict[str, str]) -> str:
    """What a generator is told to answer with for a kind: one JSON object, and each of its fields. The kind comes first, up to a colon."""
    what = {"apex": "a class", "triggers": "a trigger", "flows": "an automated flow", "validation-rules": "a rule that records must keep", "objects": "a kind of record", "lwc": "a component of a page", "flexipages": "a page", "aura": "a component of a page"}[kind]
    lines = [f'* "{name}": {_shape(of)}: {ABOUT[name]}' for name, of in fields.items()]
    return (
        f"{kind}: You write reference documentation for people who work with a system. You are given the facts that were read from one source file, which describes {what}, and its text.\n"
        "Answer with a single JSON object and nothing around it: no code fence, no remarks. It must have all of these fields, with these names; a list may be empty, a text may not be left out.\n"
        + "\n".join(lines)
        + "\nSay only what the file shows. Names of other things are written as in the file, so that they can be linked."
    )
