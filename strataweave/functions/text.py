"""Scalar functions over columns: hashes, names, paths, patterns and small formats.

All are built from Spark's own functions, so they stay in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type names that are never counted as references.
BUILTIN_TYPES = (
    "String", "Integer", "Long", "Double", "Decimal", "Boolean", "Date", "DateTime", "Time", "Blob", "Id", "Object",
    "List", "Map", "Set", "SObject", "Schema", "Database", "System", "Math", "JSON", "Type", "Exception", "DmlException",
    "QueryException", "Test", "ApexPages", "PageReference", "SelectOption", "Messaging", "Approval", "UserInfo", "Label",
    "Site", "Network", "ConnectApi",
)
#: The events a trigger can name, and HTTP answers worth another try.
TRIGGER_EVENTS = ("before insert", "before update", "before delete", "after insert", "after update", "after delete", "after undelete")
RETRY_STATUS = (429, 500, 502, 503, 504)
#: Retries after the first attempt, and the first wait in seconds.
MAX_RETRIES, BASE_SECONDS = 4, 5


def none() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, body: object) -> Column:
    """``body(x)`` with ``x`` computed once: inside, it is a variable and no expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, lower-case hex."""
    return F.sha2(text, 256)


def composite_hash(text: Column, parts: Column) -> Column:
    """Hash of a text followed by ``parts``, an array that is already in order, without separators."""
    return F.sha2(F.concat(text, F.array_join(F.coalesce(parts, none()), "")), 256)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"^(?U)\s+", ""), r"(?U)\s+$", "")


def glob_regex(pattern: str) -> str:
    """A shell pattern (``* ? [..] [!..]``) as an anchored regular expression; an unclosed bracket is an error."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))
            if end < 0:
                raise ValueError(f"unclosed bracket in {pattern!r}")
            body = pattern[i:end].replace("\\", r"\\")
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def glob_matches(pattern: str, *names: Column) -> Column:
    """Whether the pattern fits any of the names as a whole, with case."""
    regex = glob_regex(pattern)
    hit = F.lit(False)
    for name in names:
        hit = hit | name.rlike(regex)
    return hit


def has_any_tag(tags: Column, wanted: list[str]) -> Column:
    """Whether a tag is among ``wanted``, without case; an empty list lets all pass, and no tags pass nothing else."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(F.transform(tags, F.lower), F.array(*[F.lit(w.lower()) for w in wanted])), F.lit(False))


def folder_of(path: Column, root: str) -> Column:
    """The folder of ``path`` below ``root`` with forward slashes; empty if it is not below it."""
    clean, base = F.regexp_replace(path, r"\\", "/"), root.replace("\\", "/").rstrip("/") + "/"
    inner = F.regexp_replace(clean, "[^/]*$", "")
    return F.when(F.startswith(clean, F.lit(base)), F.regexp_replace(F.substr(inner, F.lit(len(base) + 1)), "/$", "")).otherwise("")


def path_part(path: Column, back: int, default: str = "Unknown") -> Column:
    """The ``back``-th last component of a path (1 is the name), or ``default``."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) >= back, F.element_at(parts, -back)).otherwise(default)


def sanitize_filename(name: Column) -> Column:
    """Letters and digits of any script, underscore, dot and hyphen."""
    return F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N}_.\-]", "")


def kebab_to_camel(name: Column) -> Column:
    parts = F.split(name, "-")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def _commented(text: Column) -> tuple[Column, Column]:
    """The text up to the last end of a comment, and the rest, in which none is closed: no search goes through it again and again."""
    rest = F.substring_index(text, "*/", -1)
    return F.substr(text, F.lit(1), F.length(text) - F.length(rest)), rest


def strip_comments(text: Column) -> Column:
    """Block comments become one space, then line comments go; also inside strings and addresses."""
    closed, rest = _commented(text)
    return F.regexp_replace(F.concat(F.regexp_replace(closed, r"(?s)/\*.*?\*/", " "), rest), r"//[^\n]*", "")


def doc_comments(text: Column) -> Column:
    return F.regexp_extract_all(_commented(text)[0], F.lit(r"(?s)/\*\*.*?\*/"), F.lit(0))


def tags_in(comments: Column) -> Column:
    """Labels after the word ``@tag`` and white space in all comments, in order, repeats kept: word characters and hyphens, no hyphen first."""
    after = lambda c: F.slice(F.split(c, "@tag"), F.lit(2), F.size(F.split(c, "@tag")))
    label = lambda p: F.get(F.split(strip(p), r"(?U)[^\w-]"), F.lit(0))
    spaced = F.filter(F.flatten(F.transform(comments, after)), lambda p: p.rlike(r"(?U)^\s"))
    return F.filter(F.transform(spaced, label), lambda t: (t != "") & ~F.startswith(t, F.lit("-")))


def type_references(text: Column, *others: Column, builtin: tuple[str, ...] = BUILTIN_TYPES) -> Column:
    """Words of three or more letters, digits and underscores, all ASCII, with a capital first: sorted and distinct, but for ``builtin`` types and ``others``."""
    words = F.array_distinct(F.split(text, r"(?U)\W+"))
    known = F.array(*[F.lit(b) for b in builtin]).cast("array<string>")
    capital = (F.lit("A"), F.lit("Z"))
    kept = F.filter(words, lambda w: F.substring(w, 1, 1).between(*capital) & (F.length(w) > 2) & ~w.rlike("[^A-Za-z0-9_]"))
    kept = F.array_except(kept, F.concat(known, F.array(*[F.coalesce(o, F.lit("")) for o in others])) if others else known)
    return F.array_sort(kept)


def split_list(text: Column) -> Column:
    """Parts between commas, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def parameters(text: Column) -> Column:
    """``type name`` pairs between commas; a single word is no pair. Angle brackets do not protect commas."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip)
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(?Us)^\S+\s(.*)$", 1).alias("name"), F.regexp_extract(p, r"(?Us)^(\S+)\s", 1).alias("param_type")))
    trimmed = F.transform(pairs, lambda p: F.struct(strip(p["name"]).alias("name"), p["param_type"].alias("param_type")))
    return F.filter(trimmed, lambda p: p["param_type"] != "")


def trigger_events(text: Column) -> Column:
    """Known events in order, lower-cased; a word pair must have exactly one space."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.lower(strip(t))), lambda t: t.isin(*TRIGGER_EVENTS))


def attributes(text: Column) -> Column:
    """A map of the attributes of a tag; the last of a repeated key holds, and a value may have quotes of the other sort."""
    pattern = F.lit(r"""(?U)(\w+)=(?:"([^"]*)"|'([^']*)')""")
    part = lambda i, name: F.regexp_extract_all(text, pattern, F.lit(i)).alias(name)
    pairs = F.arrays_zip(part(1, "k"), part(2, "v"), part(3, "w"))
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), F.concat(p["v"], p["w"]).alias("v"))))
    last = let(placed, lambda all_: F.filter(all_, lambda p, i: ~F.get(all_, i + 1)["k"].eqNullSafe(p["k"])))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def first_present(pairs: Column, *keys: str) -> Column:
    """The value of the first key that is there, trimmed; an empty value counts as there."""
    return strip(F.coalesce(*[F.element_at(pairs, k) for k in keys], F.lit("")))


def label_or_name(label: Column, name: Column) -> Column:
    return F.when(F.coalesce(label, F.lit("")) == "", F.translate(name, "_", " ")).otherwise(label)


def split_first_dot(name: Column) -> Column:
    """``type`` before and ``record`` after the first dot; without a dot the record is empty."""
    return F.struct(F.regexp_extract(name, r"(?s)^([^.]*)", 1).alias("type"), F.regexp_extract(name, r"(?s)^[^.]*\.(.*)$", 1).alias("record"))


def relative_link(name: Column, kind: Column, from_kind: str, folders: dict[str, str]) -> Column:
    """A Markdown link from a page of ``from_kind``; without a kind the bare name."""
    link = F.lit(None).cast("string")
    for k, folder in folders.items():
        target = F.concat(F.lit("" if k == from_kind else f"../{folder}/"), sanitize_filename(name), F.lit(".md"))
        link = F.when(kind == k, F.concat(F.lit("["), name, F.lit("]("), target, F.lit(")"))).otherwise(link)
    return F.coalesce(link, name)


def direction(is_input: Column, is_output: Column) -> Column:
    return F.when(is_input & is_output, "Input / Output").when(is_input, "Input").when(is_output, "Output").otherwise("Internal")


def field_type(kind: Column, target: Column) -> Column:
    """``Type → target`` for the two relationship types that have a target."""
    return F.when(kind.isin("Lookup", "MasterDetail") & (F.coalesce(target, F.lit("")) != ""), F.concat(kind, F.lit(" → "), target)).otherwise(kind)


def signature(method: Column) -> Column:
    """``access static type name(type name, ...)`` of a method struct, parts that are empty left out."""
    params = F.array_join(F.transform(method["params"], lambda p: F.concat_ws(" ", p["param_type"], p["name"])), ", ")
    head = F.filter(F.array(method["access_modifier"], F.when(method["is_static"], F.lit("static")).otherwise(""), method["return_type"]), lambda x: x != "")
    return F.concat(F.array_join(head, " "), F.lit(" "), method["name"], F.lit("("), params, F.lit(")"))


def badges(*pairs: tuple[Column, str | Column]) -> Column:
    """Labels whose condition holds, joined by a middle dot."""
    labels = F.array(*[F.when(c, F.concat(F.lit("`"), t if isinstance(t, Column) else F.lit(t), F.lit("`"))) for c, t in pairs])
    return F.array_join(F.filter(labels, lambda x: x.isNotNull()), " · ")


def preview(text: Column, limit: int, marker: str = "\n... (truncated)") -> Column:
    """The first ``limit`` code points, and a marker if there were more."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def is_true(text: Column) -> Column:
    return F.coalesce(text == "true", F.lit(False))


def should_retry(status: Column) -> Column:
    return status.isin(*RETRY_STATUS)


def retry_after(text: Column) -> Column:
    """Seconds of a Retry-After header, rounded up, and one; null if it is not a number."""
    return (F.ceil(F.trim(text).try_cast("double")) + 1).cast("long")


def retry_hint(body: Column) -> Column:
    """Seconds of ``retry in Ns`` in an answer, rounded up, and one; null without."""
    number = F.regexp_extract(body, r"(?i)retry in ([0-9]+(?:\.[0-9]+)?)s", 1)
    return (F.ceil(F.when(number != "", number).cast("double")) + 1).cast("long")


def backoff_bounds(attempt: Column) -> Column:
    """Least and most seconds of the wait before retry ``attempt`` (from 0): half to all of a doubling cap."""
    half = F.floor(F.lit(BASE_SECONDS) * F.pow(F.lit(2.0), attempt) / 2).cast("long")
    return F.struct(half.alias("low"), (half * 2).alias("high"))


def retry_delay(header: Column, body: Column, attempt: Column) -> Column:
    """The header's wait, else the body's hint, else a random one within the bounds."""
    bounds = backoff_bounds(attempt)
    chance = bounds["low"] + F.floor(F.rand() * (bounds["high"] - bounds["low"] + 1))
    return F.coalesce(retry_after(header), retry_hint(body), chance.cast("long"))


def quota_exhausted(body: Column) -> Column:
    return F.contains(body, F.lit("limit: 0"))
