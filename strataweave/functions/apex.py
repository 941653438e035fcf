"""Class and trigger sources to nested columns, statement by statement.

Comment-free text is cut into *heads*: what stands before each brace, semicolon
or equals sign. A head's words then say what it is: a declaration, a method, a
property or nothing. Sources without a declaration give empty values, never an
error. Divergences from a plain match, on purpose: parents may be dotted, generic
or a list; a property whose type has the word class or interface is left out; an
empty class name falls back to the file's stem (in the pipeline); white space
within types and parents becomes one blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import doc_comments, let, none, parameters, split_list, strip, strip_comments, tags_in, trigger_events, type_references

#: Words of the language that heads are read by, and words that are never the name of a method or property.
ACCESS = ("public", "private", "protected", "global")
CLASS_WORDS = ("abstract", "virtual", "with", "without", "inherited", "sharing")
METHOD_WORDS = ("static", "override", "virtual", "abstract")
PROPERTY_WORDS = ("static", "final")
KEYWORDS = ("if", "else", "for", "while", "catch", "class", "return", "new")
_NAME, _TYPE_TEXT = r"(?U)^[A-Za-z_]\w*$", r"(?U)^[\w<>\[\],. ]+$"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _lower(words: Column) -> Column:
    return F.transform(words, F.lower)


def _from(words: Column, start: Column) -> Column:
    """The words from number ``start`` (1 is the first) on."""
    return F.slice(words, start, F.greatest(F.size(words) - start + 1, F.lit(0)))


def _first(words: Column, test: object) -> Column:
    """Number of the first word that passes, 0 if none does."""
    return F.array_position(F.transform(words, lambda w: F.coalesce(test(w), F.lit(False))), True).cast("int")


def _leading(words: Column, known: tuple[str, ...]) -> Column:
    """How many words at the start are ``known``, without case."""
    other = _first(words, lambda w: ~F.lower(w).isin(*known))
    return F.when(other > 0, other - 1).otherwise(F.size(words))


def heads(bare: Column) -> Column:
    """``(text, end)`` of every head; the end is the sign that it stands before. Each match begins where the last one ended, so the text is read once."""
    pattern = r"\G([^{};=]*+)([{};=])"
    return F.arrays_zip(F.regexp_extract_all(bare, F.lit(pattern), F.lit(1)).alias("text"), F.regexp_extract_all(bare, F.lit(pattern), F.lit(2)).alias("end"))


def _declared(text: Column) -> Column:
    """What a head declares; ``access`` is null if it declares no class or interface."""
    return let(_words(text), lambda words: let(_first(_lower(words), lambda w: w.isin("class", "interface")), lambda at: _declaration(words, at)))


def _declaration(words: Column, at: Column) -> Column:
    before = F.slice(_lower(words), F.lit(1), F.greatest(at - 1, F.lit(0)))
    access = F.get(F.filter(F.reverse(before), lambda w: ~w.isin(*CLASS_WORDS)), F.lit(0))
    tail = _from(words, at + 2)
    extends, implements = _first(_lower(tail), lambda w: w == "extends"), _first(_lower(tail), lambda w: w == "implements")
    parent = F.slice(tail, extends + 1, F.greatest(F.when(implements > extends, implements - extends - 1).otherwise(F.size(tail) - extends), F.lit(0)))
    return F.struct(
        F.when((at > 0) & access.isin(*ACCESS), access).alias("access"),
        F.array_contains(before, "abstract").alias("abstract"), F.array_contains(before, "virtual").alias("virtual"), (F.lower(F.get(words, at - 1)) == "interface").alias("interface"),
        F.regexp_extract(F.coalesce(F.get(words, at), F.lit("")), r"(?U)^\w+", 0).alias("name"),
        F.when(extends > 0, F.array_join(parent, " ")).otherwise("").alias("parent"),
        F.when(implements > 0, F.array_join(_from(tail, implements + 1), " ")).otherwise("").alias("implements"),
    )


def _member(words: Column, params: Column, opens: object, modifiers: tuple[str, ...]) -> Column:
    """Parts of a member from its words: from the first that ``opens`` it, a run of modifiers, the type, the name."""

    def parts(words: Column, before: Column, at: Column, rest: Column, n: Column) -> Column:
        return F.struct(
            F.coalesce(F.element_at(words, -1), F.lit("")).alias("name"), F.lower(F.get(before, at - 1)).alias("access"), F.array_join(_from(rest, n + 1), " ").alias("type"),
            params.alias("params"), F.array_contains(F.slice(_lower(rest), F.lit(1), n), "static").alias("static"), at.alias("at"),
        )

    def run(words: Column) -> Column:
        before = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
        return let(before, lambda b: let(_first(b, opens), lambda at: let(_from(b, at + 1), lambda rest: let(_leading(rest, modifiers), lambda n: parts(words, b, at, rest, n)))))

    return let(words, run)


def _sound(m: Column) -> Column:
    return m["name"].rlike(_NAME) & m["type"].rlike(_TYPE_TEXT)


def _calls(of: Column) -> Column:
    """Heads that end with a parenthesis: the words before the last opening one, the text within, and the end."""
    closed = F.filter(F.transform(of, lambda h: F.struct(strip(h["text"]).alias("text"), h["end"].alias("end"))), lambda h: h["end"].isin("{", ";") & F.endswith(h["text"], F.lit(")")))
    inner = lambda h: F.substring_index(h["text"], "(", -1)
    return F.transform(closed, lambda h: F.struct(_words(F.substr(h["text"], F.lit(1), F.greatest(F.length(h["text"]) - F.length(inner(h)) - 1, F.lit(0)))).alias("words"), F.rtrim(inner(h), F.lit(")")).alias("params"), h["end"].alias("end")))


def adjacent_distinct(items: Column, same: object) -> Column:
    """Items that differ from the one before; ``same(a, b)`` compares."""
    return F.filter(items, lambda x, i: (i == 0) | ~same(F.get(items, i - 1), x))


CLASS_COLUMNS = ("class_name", "access_modifier", "is_abstract", "is_virtual", "is_interface", "extends", "implements", "methods", "properties", "existing_comments", "references", "tags")


def parse_classes(files: DataFrame, source: str = "raw_source") -> DataFrame:
    """``files`` with the columns of a class or interface.

    The first declaration counts; members of inner classes are among the others.
    Each stage is a projection of its own: what several later columns use is a
    column there, and computed once a row.
    """
    kept = [c for c in files.columns if c not in CLASS_COLUMNS]
    a = files.select(*kept, heads(strip_comments(F.col(source))).alias("_heads"), doc_comments(F.col(source)).alias("existing_comments"))
    found = F.filter(F.transform(F.filter("_heads", lambda h: h["end"] == "{"), lambda h: _declared(h["text"])), lambda d: d["access"].isNotNull())
    b = a.withColumn("_class", F.get(found, F.lit(0))).withColumn("_calls", _calls(F.col("_heads")))
    given = lambda field, default: F.coalesce(F.col(f"_class.{field}"), F.lit(default))
    b = b.select("*", given("name", "").alias("class_name"), given("interface", False).alias("is_interface"))
    opened = F.transform("_calls", lambda h: _member(h["words"], h["params"], lambda w: F.lower(w).isin(*ACCESS) | F.startswith(w, F.lit("@")), METHOD_WORDS))
    plain = F.filter(opened, lambda m: (m["at"] > 0) & _sound(m) & ~m["name"].isin(*KEYWORDS) & (m["name"] != F.col("class_name")))
    # an interface's own methods: no access word, and the whole head is type and name
    loose = F.transform(F.filter("_calls", lambda h: F.col("is_interface") & (h["end"] == ";")), lambda h: _member(h["words"], h["params"], lambda w: F.lit(False), ()))
    loose = F.filter(loose, lambda m: _sound(m) & (m["name"] != F.col("class_name")))
    fields = F.filter("_heads", lambda h: h["end"].isin("=", ";", "{") & ~F.contains(h["text"], F.lit("(")))
    fields = F.transform(fields, lambda h: _member(_words(h["text"]), F.lit(""), lambda w: F.lower(w).isin(*ACCESS), PROPERTY_WORDS))
    c = b.select("*", plain.alias("_plain"), loose.alias("_loose"), F.filter(fields, lambda m: (m["at"] > 0) & _sound(m)).alias("_fields"))

    def method(m: Column, access: Column) -> Column:
        return F.struct(m["name"].alias("name"), access.alias("access_modifier"), m["type"].alias("return_type"), parameters(m["params"]).alias("params"), m["static"].alias("is_static"))

    new = F.filter("_loose", lambda m: (m["at"] == 0) & ~F.exists("_plain", lambda p: p["name"] == m["name"]))
    d = c.withColumn("_all", F.concat(F.transform("_plain", lambda m: method(m, m["access"])), F.transform(new, lambda m: method(m, F.lit("")))))
    types = lambda m: F.transform(m["params"], lambda p: p["param_type"])
    e = d.withColumn("methods", adjacent_distinct(F.col("_all"), lambda x, y: (x["name"] == y["name"]) & (x["return_type"] == y["return_type"]) & (types(x) == types(y))))
    named = F.filter("_fields", lambda p: ~p["name"].isin(*KEYWORDS) & ~p["type"].rlike(r"(?i)\b(class|interface)\b") & ~F.exists("methods", lambda m: m["name"] == p["name"]))
    f = e.withColumn("_kept", F.transform(named, lambda p: F.struct(p["name"].alias("name"), p["access"].alias("access_modifier"), p["type"].alias("property_type"), p["static"].alias("is_static"))))
    parent, implements = given("parent", ""), given("implements", "")
    done = {
        "class_name": F.col("class_name"), "access_modifier": given("access", ""), "is_abstract": given("abstract", False), "is_virtual": given("virtual", False),
        "is_interface": F.col("is_interface"), "extends": F.when(parent != "", parent), "implements": F.when(implements != "", split_list(implements)).otherwise(none()),
        "methods": F.col("methods"), "properties": adjacent_distinct(F.col("_kept"), lambda x, y: (x["name"] == y["name"]) & (x["property_type"] == y["property_type"])),
        "existing_comments": F.col("existing_comments"), "references": type_references(F.col(source), F.col("class_name")), "tags": tags_in(F.col("existing_comments")),
    }
    return f.select(*kept, *[done[c].alias(c) for c in CLASS_COLUMNS])


def parse_trigger(source: Column) -> dict[str, Column]:
    """Columns of a trigger: the first ``trigger <name> on <object> (...)``, comments included."""
    pattern = r"\G([^()]*+)([()])"
    cut = F.arrays_zip(F.regexp_extract_all(source, F.lit(pattern), F.lit(1)).alias("text"), F.regexp_extract_all(source, F.lit(pattern), F.lit(2)).alias("end"))
    word = lambda words, back: F.get(words, F.size(words) - back)
    is_name = lambda w: w.rlike(r"(?U)^\w+$")
    fits = lambda words: (F.lower(word(words, 4)) == "trigger") & (F.lower(word(words, 2)) == "on") & is_name(word(words, 3)) & is_name(word(words, 1))

    def lead(parts: Column, i: Column) -> Column:
        """The words before an opening parenthesis that is closed, and what is within."""
        within = F.get(parts, i + 1)
        closed = (F.get(parts, i)["end"] == "(") & (within["end"] == ")") & F.contains(F.lower(F.get(parts, i)["text"]), F.lit("trigger"))
        return F.struct(F.when(closed, _words(F.get(parts, i)["text"])).alias("words"), within["text"].alias("inner"))

    calls = let(cut, lambda parts: F.filter(F.transform(parts, lambda p, i: lead(parts, i)), lambda c: F.coalesce(fits(c["words"]), F.lit(False))))
    one = let(F.get(calls, F.lit(0)), lambda c: F.struct(word(c["words"], 3).alias("name"), word(c["words"], 1).alias("sobject"), c["inner"].alias("inner")))
    name, sobject = F.coalesce(one["name"], F.lit("")), F.coalesce(one["sobject"], F.lit(""))
    comments = doc_comments(source)
    return {
        "trigger_name": name,
        "sobject": sobject,
        "events": trigger_events(F.coalesce(one["inner"], F.lit(""))),
        "existing_comments": comments,
        "references": type_references(source, F.lit("Trigger"), name, sobject),
        "tags": tags_in(comments),
    }
