"""Metadata documents to nested columns, each document read once.

A streaming parser goes through a document in an Arrow batch and notes, in the
order of the document, what any kind asks for: texts of elements with their depth,
how often some elements occur, and blocks with the texts of their parts. All else
is Spark's own functions over these short lists. A broken document gives empty
values and a true ``is_malformed`` instead of an error; a blank one counts as an
empty one. Self-closing elements have no text and are not counted.
"""

from __future__ import annotations

from xml.parsers import expat

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_true, label_or_name, strip

RECORD_OPERATIONS = {"recordLookups": "lookup", "recordCreates": "create", "recordUpdates": "update", "recordDeletes": "delete"}
#: Elements whose texts are asked for, those that are counted, and those whose parts belong together.
TEXTS = frozenset(("label", "masterLabel", "processType", "description", "active", "errorConditionFormula", "errorDisplayField", "errorMessage", "fullName", "type", "inlineHelpText", "referenceTo", "required", "sobjectType", "componentName", "actionName"))
COUNTED = ("decisions", "loops", "screens")
BLOCKS = frozenset(("variables", *RECORD_OPERATIONS, "actionCalls", "values"))
_PART = "array<struct<name:string,text:string>>"
SCHEMA = f"ok boolean, texts array<struct<name:string,depth:int,text:string>>, {', '.join(f'{c} int' for c in COUNTED)}, blocks array<struct<element:string,parts:{_PART}>>"


def read_document(xml: str | None) -> tuple:
    """``(ok, texts, counts..., blocks)`` of one document, as ``SCHEMA`` names them."""
    texts, counts, blocks = [], dict.fromkeys(COUNTED, 0), []
    if xml is None or not xml.strip():
        return (True, texts, *counts.values(), blocks)
    parser, stack = expat.ParserCreate("UTF-8"), []  # an element: name, whether anything is in it, and its parts if it is a block
    parser.buffer_text = True

    def fill(*_: object) -> None:
        if stack:
            stack[-1][1] = True

    def start(name: str, _: dict) -> None:
        fill()
        parts = [] if name in BLOCKS else None
        if parts is not None:
            blocks.append((name, parts))
        stack.append([name, False, parts])

    def end(_: str) -> None:
        name, filled, _parts = stack.pop()
        if filled and name in counts:
            counts[name] += 1

    def text(data: str) -> None:
        fill()
        if stack and (data := data.strip()):
            name = stack[-1][0]
            if name in TEXTS:
                texts.append((name, len(stack), data))
            if len(stack) > 1 and stack[-2][2] is not None:
                stack[-2][2].append((name, data))

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.CommentHandler = parser.ProcessingInstructionHandler = fill
    try:
        parser.Parse(xml.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError:
        return (False, [], *(0 for _ in COUNTED), [])
    return (True, texts, *counts.values(), blocks)


_READERS: dict[int, object] = {}


def document(xml: Column) -> Column:
    """What ``read_document`` finds. One function a context: all columns of a projection that ask for the same document share one reading."""
    key = id(SparkContext._active_spark_context)
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = F.udf(read_document, SCHEMA, useArrow=True)
    return _READERS[key](xml)


def well_formed(xml: Column) -> Column:
    """Whether a document parses; blank ones do not, but are no error."""
    return F.coalesce(strip(xml) != "", F.lit(False)) & document(xml)["ok"]


def is_malformed(xml: Column) -> Column:
    return ~document(xml)["ok"]


class Document:
    """Values of one column of documents; of several texts the first or the last can be asked for."""

    def __init__(self, xml: Column):
        self.found = document(xml)

    def all(self, name: str, depth: int | None = None) -> Column:
        """Texts of the elements of a name, anywhere or at a depth (1 is the root)."""
        fits = lambda t: (t["name"] == name) & (F.lit(True) if depth is None else t["depth"] == depth)
        return F.transform(F.filter(self.found["texts"], fits), lambda t: t["text"])

    def first(self, name: str, depth: int | None = None) -> Column:
        return F.coalesce(F.get(self.all(name, depth), F.lit(0)), F.lit(""))

    def last(self, name: str, depth: int | None = None) -> Column:
        return F.coalesce(F.get(F.reverse(self.all(name, depth)), F.lit(0)), F.lit(""))

    def count(self, element: str) -> Column:
        return self.found[element].cast("long")

    def blocks(self, *elements: str) -> Column:
        """``(element, parts)`` of all such elements in document order."""
        return F.filter(self.found["blocks"], lambda b: b["element"].isin(*elements))


def _text(parts: Column, name: str) -> Column:
    """The last text of a part of this name, empty without one."""
    return F.coalesce(F.get(F.reverse(F.filter(parts, lambda p: p["name"] == name)), F.lit(0))["text"], F.lit(""))


def parse_flow(xml: Column, api_name: Column) -> dict[str, Column]:
    d = Document(xml)
    variables = F.transform(d.blocks("variables"), lambda b: F.struct(_text(b["parts"], "name").alias("name"), _text(b["parts"], "dataType").alias("data_type"), is_true(_text(b["parts"], "isInput")).alias("is_input"), is_true(_text(b["parts"], "isOutput")).alias("is_output")))
    names = F.create_map(*[F.lit(x) for pair in RECORD_OPERATIONS.items() for x in pair])
    operations = F.transform(d.blocks(*RECORD_OPERATIONS), lambda b: F.struct(F.element_at(names, b["element"]).alias("operation"), _text(b["parts"], "object").alias("object")))
    actions = F.transform(d.blocks("actionCalls"), lambda b: F.struct(_text(b["parts"], "actionName").alias("name"), _text(b["parts"], "actionType").alias("action_type")))
    return {
        "api_name": api_name,
        "label": label_or_name(d.first("label", 2), api_name),
        "process_type": d.first("processType"),
        "description": d.first("description", 2),
        "variables": F.filter(variables, lambda v: v["name"] != ""),
        "decisions": d.count("decisions"),
        "loops": d.count("loops"),
        "screens": d.count("screens"),
        "record_operations": F.filter(operations, lambda o: o["object"] != ""),
        "action_calls": F.filter(actions, lambda a: a["name"] != ""),
    }


def parse_rule(xml: Column, rule_name: Column, object_name: Column) -> dict[str, Column]:
    d = Document(xml)
    active = d.last("active")
    return {
        "rule_name": rule_name,
        "object_name": object_name,
        "active": F.when(active == "", True).otherwise(active == "true"),
        "description": d.last("description"),
        "error_condition_formula": d.last("errorConditionFormula"),
        "error_display_field": d.last("errorDisplayField"),
        "error_message": d.last("errorMessage"),
    }


def parse_object(xml: Column, object_name: Column) -> dict[str, Column]:
    d = Document(xml)
    return {"object_name": object_name, "label": d.first("label", 2), "description": d.first("description", 2)}


def parse_field(xml: Column, stem: Column) -> dict[str, Column]:
    d = Document(xml)
    name = d.last("fullName")
    return {
        "api_name": F.when(name == "", stem).otherwise(name),
        "label": d.last("label"),
        "field_type": d.last("type"),
        "description": d.last("description"),
        "help_text": d.last("inlineHelpText"),
        "reference_to": d.last("referenceTo"),
        "required": is_true(d.last("required")),
    }


def parse_page(xml: Column, api_name: Column) -> dict[str, Column]:
    d = Document(xml)
    return {
        "api_name": api_name,
        "label": d.first("masterLabel"),
        "page_type": d.last("type", 2),
        "sobject": d.last("sobjectType"),
        "description": d.first("description", 2),
        "component_names": F.array_distinct(F.transform(d.all("componentName"), lambda n: F.regexp_replace(n, "^c__", ""))),
        "flow_names": F.array_distinct(d.all("actionName")),
    }


def parse_record(xml: Column, type_name: Column, record_name: Column) -> dict[str, Column]:
    """A custom-metadata record; values stay in order, with repeats, as text."""
    d = Document(xml)
    values = F.transform(d.blocks("values"), lambda b: F.struct(_text(b["parts"], "field").alias("field"), _text(b["parts"], "value").alias("value")))
    return {"type_name": type_name, "record_name": record_name, "label": d.first("label"), "values": F.filter(values, lambda v: (v["field"] != "") & (v["value"] != ""))}
