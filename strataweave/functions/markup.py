"""Component scripts and markup to nested columns: a script's decorators one by one, markup tag by tag.

Runs of characters and quoted values are taken whole and never tried again
shorter, so a tag costs its length, however long it or a value of it is, and a
tag that is not closed costs the way to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import attributes, first_present, kebab_to_camel, none, strip

#: An opening tag: its name, then quoted values and other text up to a bracket; an opening bracket that is in no quotes begins another tag.
TAG = r"""<([A-Za-z][A-Za-z0-9:_.-]*+)([^<>"']*+(?:(?:"[^"]*+"|'[^']*+')[^<>"']*+)*+)>"""
#: Fixed value: the decorator of a component's public members.
DECORATOR = "@api"
_IDENTIFIER = r"^[A-Za-z_$][A-Za-z0-9_$]*"


def tags(text: Column) -> Column:
    """``(tag, attributes)`` of all opening tags in order; null has none."""
    whole = F.coalesce(text, F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(whole, F.lit(TAG), F.lit(1)).alias("tag"), F.regexp_extract_all(whole, F.lit(TAG), F.lit(2)).alias("rest"))
    return F.transform(pairs, lambda p: F.struct(p["tag"].alias("tag"), attributes(p["rest"]).alias("attributes")))


def decorated(source: Column) -> Column:
    """``(name, is_method)`` of every decorated member in order; a getter is a property."""
    parts = F.split(F.coalesce(source, F.lit("")), DECORATOR)
    after = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p.rlike(r"(?U)^\s"))

    def member(part: Column) -> Column:
        text = strip(part)
        first = F.regexp_extract(text, _IDENTIFIER, 0)
        rest = strip(F.substr(text, F.length(first) + 1))
        second = F.regexp_extract(rest, _IDENTIFIER, 0)
        getter = (first == "get") & (second != "")
        end = F.when(getter, strip(F.substr(rest, F.length(second) + 1))).otherwise(rest)
        sign = F.substring(end, 1, 1)
        return F.struct(F.when(sign.isin("=", ";", "(", "{"), F.when(getter, second).otherwise(first)).otherwise("").alias("name"), (~getter & (sign == "(")).alias("is_method"))

    return F.filter(F.transform(after, member), lambda m: m["name"] != "")


def parse_component(source: Column, html: Column) -> dict[str, Column]:
    """Public properties and methods of a script, slots and children of its markup; null markup has none.

    A name that is a method anywhere is one. A named slot alone also gives
    ``default``. Children are tags in lower case whose name begins with ``c-``.
    """
    return _component(decorated(source), tags(html))


def _component(members: Column, found: Column) -> dict[str, Column]:
    names = lambda is_method: F.array_distinct(F.transform(F.filter(members, lambda m: m["is_method"] == is_method), lambda m: m["name"]))
    methods = names(True)
    props = F.array_except(names(False), methods)
    row = lambda is_method: lambda n: F.struct(n.alias("name"), F.lit(is_method).alias("is_method"))
    slots = F.filter(found, lambda t: t["tag"] == "slot")
    named = F.filter(F.transform(slots, lambda t: F.coalesce(F.element_at(t["attributes"], "name"), F.lit(""))), lambda n: n != "")
    default = F.when(F.size(slots) > 0, F.array(F.lit("default"))).otherwise(none())
    children = F.filter(F.transform(found, lambda t: t["tag"]), lambda n: n.rlike("^c-[a-z][a-z0-9-]*$"))
    return {
        "api_props": F.array_sort(F.concat(F.transform(methods, row(True)), F.transform(props, row(False)))),
        "slots": F.array_union(F.array_distinct(named), default),
        "referenced_components": F.array_distinct(F.transform(children, lambda n: kebab_to_camel(F.substr(n, F.lit(3))))),
    }


def parse_aura(source: Column) -> dict[str, Column]:
    """Attributes, events and parent of a component file."""
    return _aura(tags(source))


def _aura(found: Column) -> dict[str, Column]:
    of = lambda *names: F.transform(F.filter(found, lambda t: t["tag"].isin(*names)), lambda t: t["attributes"])
    parent = F.coalesce(first_present(F.get(of("aura:component"), F.lit(0)), "extends"), F.lit(""))
    rows = F.transform(of("aura:attribute"), lambda a: F.struct(first_present(a, "name").alias("name"), first_present(a, "type").alias("attr_type"), first_present(a, "default").alias("default"), first_present(a, "description").alias("description")))
    events = F.transform(of("aura:registerEvent", "aura:handler"), lambda a: first_present(a, "name", "event", "type"))
    return {
        "attributes": F.filter(rows, lambda r: r["name"] != ""),
        "events_handled": F.array_distinct(F.filter(events, lambda e: e != "")),
        "extends": F.when(parent != "", parent),
    }


def with_component(files: DataFrame, source: str = "raw_source", html: str = "html") -> DataFrame:
    """``files`` with the columns of ``parse_component``; members and tags are found once a row, in a projection of their own."""
    found = files.withColumns({"_members": decorated(F.col(source)), "_tags": tags(F.col(html))})
    return found.withColumns(_component(F.col("_members"), F.col("_tags"))).drop("_members", "_tags")


def with_aura(files: DataFrame, source: str = "raw_source") -> DataFrame:
    """``files`` with the columns of ``parse_aura``; tags are found once a row."""
    return files.withColumn("_tags", tags(F.col(source))).withColumns(_aura(F.col("_tags"))).drop("_tags")
