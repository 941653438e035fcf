"""Queries of the whole flow: a tree of files made of the supplier table is scanned, parsed, described and rendered.

Every supplier gives a file of each kind, written by the executors, every region an
interface, and there are files that no scan may take. The expected rows are spelled
out in SQL from the same tables. The tree and what is built of it are made once for
a session and a data folder, in the shared folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators.relational import numbered
from .plans import cache, enrich, pipeline, prompts, versions
from .sources import files as src
from .sources import scratch, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_MADE: dict[tuple, str] = {}
_FOUND: dict[str, pipeline.Described] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _once(s: SparkSession, d: str, what: str, make: Callable[[str], object]) -> str:
    key = (s.sparkContext.applicationId, d, what)
    if key not in _MADE:
        at = scratch.folder(s)
        make(at)
        _MADE[key] = at
    return _MADE[key]


# --- the tree ------------------------------------------------------------------


def sources(i: int, name: str, region: int, region_name: str) -> dict[str, str]:
    """Paths and texts of one supplier."""
    out = {
        f"classes/{region_name}/Class_{i}.cls": f"/** Class of {name}. @tag {region_name.lower()} */\npublic {'abstract ' if i % 3 == 0 else ''}with sharing class Class_{i}{f' extends Base_{region}' if i % 2 == 0 else ''} implements Runner_{region}, Batch {{\n"
        f"  private static Integer LIMIT_{i} = {i};\n  public String label;\n  // public void hidden() {{}}\n  public void run(String why, Integer times) {{ Helper.go(why); }}\n  global static Class_{i} first(Id key) {{ return null; }}\n}}",
        f"classes/{region_name}/Class_{i}.cls-meta.xml": "<x/>",
        f"triggers/Watch_{i}.trigger": f"/** Keeps {name}. @tag watch-{region} */\ntrigger Watch_{i} on Obj_{i} (before insert, AFTER UPDATE{', before undelete' if i % 2 else ''}) {{ Class_{i}.first(null); }}",
        f"flows/Flow_{i}.flow-meta.xml": f"<Flow xmlns='http://x'>{f'<label>Greet {name} &amp; go</label>' if i % 2 == 0 else ''}<processType>Auto{region}</processType><description>For {name}</description><variables><name>v{i}</name><dataType>String</dataType><isInput>true</isInput><isOutput>{'true' if i % 3 == 0 else 'false'}</isOutput></variables>"
        f"<variables><name>own</name><dataType>Number</dataType></variables><recordUpdates><object>Obj_{i}</object></recordUpdates><recordLookups><object>Account</object></recordLookups><actionCalls><actionName>send{i}</actionName><actionType>email</actionType></actionCalls><decisions><name>d</name></decisions><decisions><name>e</name></decisions><screens><name>s</name></screens></Flow>",
        f"objects/Obj_{i}/Obj_{i}.object-meta.xml": f"<CustomObject><description>Holds {name}</description><label>{name}</label><nameField><label>No</label></nameField></CustomObject>",
        f"objects/Obj_{i}/fields/B__c.field-meta.xml": "<CustomField><fullName>B__c</fullName><label>B</label><type>Text</type><required>true</required></CustomField>",
        f"objects/Obj_{i}/fields/A__c.field-meta.xml": f"<CustomField><fullName>A__c</fullName><label>A of {i}</label><type>Lookup</type><referenceTo>Obj_{region}</referenceTo><inlineHelpText>help</inlineHelpText></CustomField>",
        f"objects/Obj_{i}/validationRules/Rule_{i}.validationRule-meta.xml": f"<ValidationRule>{'<active>false</active>' if i % 2 else ''}<description>Guards {name}</description><errorConditionFormula>a &lt; {i}</errorConditionFormula><errorDisplayField>A__c</errorDisplayField><errorMessage> Below {i} </errorMessage></ValidationRule>",
        f"lwc/comp{i}/comp{i}.js-meta.xml": f"<x>{i}</x>",
        f"flexipages/Page_{i}.flexipage-meta.xml": f"<FlexiPage><masterLabel>Start {i}</masterLabel><type>AppPage</type>{f'<sobjectType>Obj_{i}</sobjectType>' if i % 2 else ''}<r><componentName>c__comp{i}</componentName><componentName>c__comp{i}</componentName><componentName>force:two</componentName><actionName>Flow_{i}</actionName></r></FlexiPage>",
        f"customMetadata/Type{i % 3}__mdt.Rec_{i:06d}.md-meta.xml": f"<CustomMetadata xmlns:xsi='http://y'><label>Rec of {name}</label><values><field>A__c</field><value xsi:type='xsd:double'>{i}</value></values>{f'<values><field>B{region}__c</field><value>b{i}</value></values>' if i % 2 else ''}<values><field>C__c</field></values></CustomMetadata>",
        f"aura/au{i}/au{i}.cmp": f'<aura:component{f" extends=\'c:base{region}\'" if i % 2 else ""}><aura:attribute name="title" type="String" default="{name}"/><aura:attribute name="n" type="Integer"/><aura:registerEvent name="saved" type="c:e"/><aura:handler event="c:again{i}"/><aura:handler event="c:again{i}"/></aura:component>',
        f"aura/au{i}/au{i}.js": "({})",
    }
    if i % 2:
        out[f"lwc/comp{i}/comp{i}.js"] = f"import x from 'y';\n@api label = {i};\n@api get size() {{ return 1; }}\n@api focus() {{}}\n@api label;\n"
    if i % 3:
        out[f"lwc/comp{i}/comp{i}.html"] = f"<template><slot name='icon'></slot><slot></slot><c-tool-tip></c-tool-tip><c-tool-tip/><c-part{i}/></template>"
    return out


DECOYS = {
    "node_modules/Skip.cls": "public class Skip {}", "classes/.sfdx/Skip.cls": "public class Skip {}", "target/Skip.trigger": "x", "classes/Big.cls": "x" * (src.MAX_BYTES + 1), "elsewhere/T.R.md-meta.xml": "<x/>", "elsewhere/c.js-meta.xml": "<x/>", "elsewhere/c.cmp": "<x/>", "README.md": "none",
}


def _suppliers(s: SparkSession, d: str) -> DataFrame:
    """The suppliers as ``_N`` names them."""
    supplier, nation, region = (s.read.parquet(f"{d}/{t}.parquet") for t in ("supplier", "nation", "region"))
    of = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return of.select(F.col("s_suppkey").cast("long").alias("i"), F.concat_ws("_", "n_name", F.col("s_suppkey").cast("string")).alias("name"), F.col("n_regionkey").alias("k"), F.col("r_name").alias("region"))


def tree(s: SparkSession, d: str) -> str:
    """The folder with the files, written once."""

    def make(at: str) -> None:
        def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                n = 0
                for row in pdf.itertuples(index=False):
                    for name, text in sources(int(row.i), row.name, int(row.k), row.region).items():
                        store.write(f"{at}/{name}", text.encode())
                        n += 1
                yield pd.DataFrame({"n": [n]})

        rows = _suppliers(s, d)
        rows.repartition(s.sparkContext.defaultParallelism, "i").mapInPandas(put, "n long").agg(F.sum("n")).collect()
        interfaces = {f"classes/Runner_{r.k}.cls": f"public interface Runner_{r.k} {{\n  void run(String why, Integer times);\n}}" for r in rows.select("k").distinct().collect()}  # a row a region
        for name, text in (DECOYS | interfaces).items():
            store.write(f"{at}/{name}", text.encode())

    return src.canonical(s, _once(s, d, "tree", make))


_N = "n AS (SELECT CAST(s_suppkey AS BIGINT) AS i, n_name || '_' || s_suppkey AS name, n_regionkey AS k, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_LIST = f"""WITH {_N}, f AS (
SELECT 'apex' AS kind, 'classes/' || region || '/Class_' || i || '.cls' AS path, '.cls' AS suffix, false AS has_script FROM n
UNION ALL SELECT DISTINCT 'apex', 'classes/Runner_' || k || '.cls', '.cls', false FROM n
UNION ALL SELECT 'triggers', 'triggers/Watch_' || i || '.trigger', '.trigger', false FROM n
UNION ALL SELECT 'flows', 'flows/Flow_' || i || '.flow-meta.xml', '.flow-meta.xml', false FROM n
UNION ALL SELECT 'objects', 'objects/Obj_' || i || '/Obj_' || i || '.object-meta.xml', '.object-meta.xml', false FROM n
UNION ALL SELECT 'validation-rules', 'objects/Obj_' || i || '/validationRules/Rule_' || i || '.validationRule-meta.xml', '.validationRule-meta.xml', false FROM n
UNION ALL SELECT 'flexipages', 'flexipages/Page_' || i || '.flexipage-meta.xml', '.flexipage-meta.xml', false FROM n
UNION ALL SELECT 'custom-metadata', 'customMetadata/Type' || (i % 3) || '__mdt.Rec_' || lpad(i::VARCHAR, 6, '0') || '.md-meta.xml', '.md-meta.xml', false FROM n
UNION ALL SELECT 'lwc', 'lwc/comp' || i || '/comp' || i || '.js-meta.xml', '.js-meta.xml', i % 2 = 1 FROM n
UNION ALL SELECT 'aura', 'aura/au' || i || '/au' || i || '.cmp', '.cmp', true FROM n),
x AS (SELECT kind, path, string_split(path, '/')[-1] AS filename, suffix, has_script FROM f)
"""


def _below(root: str) -> Column:
    return F.substr(F.col("path"), F.lit(len(root) + 2))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(_LIST + "SELECT kind, path, filename, left(filename, length(filename) - length(suffix)) AS stem, has_script FROM x")
def scan_tree(s, d):
    root = tree(s, d)
    return _union([df.select(F.lit(k).alias("kind"), _below(root).alias("path"), "filename", "stem", F.col("script").isNotNull().alias("has_script")) for k, df in src.scan_all(s, root).items()])


@query(_LIST + "SELECT kind, filename, row_number() OVER (PARTITION BY kind ORDER BY filename, path) AS at FROM x")
def ordered_scan(s, d):
    """The place of each file in its scan; the scan itself gives the order."""
    return _union([numbered(df.select("filename"), "at").withColumn("kind", F.lit(k)) for k, df in src.scan_all(s, tree(s, d)).items()]).select("kind", "filename", "at")


@query(f"WITH {_N} SELECT 'Obj_' || i AS object, f AS filename, 'objects/Obj_' || i || '/fields/' || f AS path FROM n, (VALUES ('A__c.field-meta.xml'), ('B__c.field-meta.xml')) t(f)")
def scan_field_files(s, d):
    root = tree(s, d)
    return src.scan_fields(s, root).select(F.substring_index("object_dir", "/", -1).alias("object"), "filename", _below(root).alias("path"))


@query(f"""WITH {_N} SELECT 'comp' || i AS component_name, '<template><slot name=''icon''></slot><slot></slot><c-tool-tip></c-tool-tip><c-tool-tip/><c-part' || i || '/></template>' AS html FROM n WHERE i % 3 <> 0""")
def scan_markup_files(s, d):
    return src.scan_markup(s, tree(s, d)).select("component_name", "html")


_SCRIPT = "CASE i % 2 WHEN 1 THEN 'import x from ''y'';' || chr(10) || '@api label = ' || i || ';' || chr(10) || '@api get size() { return 1; }' || chr(10) || '@api focus() {}' || chr(10) || '@api label;' || chr(10) ELSE '<x>' || i || '</x>' END"


@query(f"WITH {_N} SELECT 'comp' || i AS stem, {_SCRIPT} AS source FROM n")
def script_fallback(s, d):
    return src.scan(s, tree(s, d), "lwc").select("stem", F.col("raw_source").alias("source"))


@query(f"WITH {_N} SELECT 'Watch_' || i || '.trigger' AS filename, 'triggers' AS kind, true AS has_text FROM n UNION ALL SELECT 'Page_' || i || '.flexipage-meta.xml', 'flexipages', true FROM n")
def read_targets(s, d):
    """Files by their paths, all in one scan."""
    root = tree(s, d)
    names = [r.i for r in _suppliers(s, d).select("i").collect()]  # the targets that a user names
    found = src.read_targets(s, [f"{root}/{p}" for i in names for p in (f"triggers/Watch_{i}.trigger", f"flexipages/Page_{i}.flexipage-meta.xml")])
    return found.select("filename", "kind", (F.length("raw_source") > 20).alias("has_text"))


@query(f"WITH {_N} SELECT DISTINCT 'RUNNER_' || k AS target, 'apex' AS kind, 'found' AS status FROM n UNION ALL SELECT 'COMP' || i, 'lwc', 'found' FROM n UNION ALL SELECT 'Nobody_' || i, NULL, 'missing' FROM n UNION ALL SELECT DISTINCT 'b__C', NULL, 'missing' FROM n")
def resolve_targets(s, d):
    rows = _suppliers(s, d)
    word = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string")).alias("target")
    wanted = _union([rows.select(word("RUNNER_", "k")).distinct(), rows.select(word("COMP", "i")), rows.select(word("Nobody_", "i")), rows.select(F.lit("b__C").alias("target")).distinct()])
    return pipeline.resolve_all(wanted, pipeline.targets(s, tree(s, d))).select("target", "kind", "status")


@query(_LIST + "SELECT kind, filename FROM x WHERE kind IN ('apex', 'triggers') AND (filename GLOB '*_1?' OR left(filename, length(filename) - length(suffix)) GLOB '*_1?')")
def scan_by_kind_and_name(s, d):
    return _union([df.select(F.lit(k).alias("kind"), "filename") for k, df in src.scan_all(s, tree(s, d), ["apex", "triggers"], "*_1?").items()])


@query(f"WITH {_N} SELECT 'apex' AS kind, 'Class_' || i AS name FROM n WHERE lower(region) = 'asia' UNION ALL SELECT 'triggers', 'Watch_' || i FROM n WHERE k = 1")
def scan_by_tag(s, d):
    return _union([df.select(F.lit(k).alias("kind"), "name") for k, df in pipeline.metadata(s, tree(s, d), pipeline.Filters(tags=["ASIA", "watch-1"])).items()])


@query(f"WITH {_N} SELECT i, CASE WHEN i % 2 = 0 THEN 'none' ELSE 'some' END AS answer FROM n")
def scan_of_nothing(s, d):
    """A filter that fits no file is an error of its own; asked for once, as an answer for every second supplier."""
    answers = {}
    for n, name in enumerate(("zzz*", "Watch_*")):
        try:
            pipeline.metadata(s, tree(s, d), pipeline.Filters(name=name))
            answers[n] = "some"
        except pipeline.NoFiles:
            answers[n] = "none"
    return _suppliers(s, d).select("i", F.when(F.col("i") % 2 == 0, answers[0]).otherwise(answers[1]).alias("answer"))


# --- parsers over all files ----------------------------------------------------


def _table(s: SparkSession, d: str, kind: str) -> DataFrame:
    root = src.walk(s, tree(s, d))
    return pipeline.parse(s, kind, src.with_markup(s, root, kind), root)


def _flat(items, f):
    return F.array_join(F.transform(items, f), ";")


@query(f"""WITH {_N} SELECT 'Class_' || i AS class_name, 'classes/' || region AS folder, 'public' AS access, i % 3 = 0 AS is_abstract, false AS is_interface, CASE i % 2 WHEN 0 THEN 'Base_' || k END AS extends, 'Runner_' || k || ';Batch' AS implements,
'public void run(String why, Integer times);global static Class_' || i || ' first(Id key)' AS methods, 'static Integer LIMIT_' || i || ';String label' AS properties,
array_to_string(list_sort(list_filter(['Batch', CASE i % 2 WHEN 0 THEN 'Base_' || k END, 'Class', 'Helper', 'LIMIT_' || i, name, 'Runner_' || k], lambda r: r IS NOT NULL)), ';') AS refs, string_split(lower(region), ' ')[1] AS tags,
'/** Class of ' || name || '. @tag ' || lower(region) || ' */' AS comments FROM n
UNION ALL SELECT DISTINCT 'Runner_' || k, 'classes', 'public', false, true, NULL, '', 'void run(String why, Integer times)', '', '', '', '' FROM n""")
def apex_files(s, d):
    prop = lambda p: F.concat_ws(" ", F.when(p["is_static"], F.lit("static")), p["property_type"], p["name"])
    sign = lambda m: F.ltrim(tx.signature(m))
    return _table(s, d, "apex").select("class_name", "folder", F.col("access_modifier").alias("access"), "is_abstract", "is_interface", "extends", F.array_join("implements", ";").alias("implements"), _flat("methods", sign).alias("methods"), _flat("properties", prop).alias("properties"), F.array_join("references", ";").alias("refs"), F.array_join("tags", ";").alias("tags"), F.array_join("existing_comments", ";").alias("comments"))


@query(f"""WITH {_N} SELECT 'Watch_' || i AS trigger_name, 'Obj_' || i AS sobject, 'before insert;after update' AS events, array_to_string(list_sort(['AFTER', 'Class_' || i, 'Keeps', name, 'UPDATE']), ';') AS refs, 'watch-' || k AS tags FROM n""")
def trigger_files(s, d):
    return _table(s, d, "triggers").select("trigger_name", "sobject", F.array_join("events", ";").alias("events"), F.array_join("references", ";").alias("refs"), F.array_join("tags", ";").alias("tags"))


@query(f"""WITH {_N} SELECT 'Flow_' || i AS api_name, CASE i % 2 WHEN 0 THEN 'Greet ' || name || ' & go' ELSE 'Flow ' || i END AS label, 'Auto' || k AS process_type, 'For ' || name AS description,
'v' || i || ':String:true:' || (i % 3 = 0) || ';own:Number:false:false' AS variables, 2 AS decisions, 0 AS loops, 1 AS screens, 'update Obj_' || i || ';lookup Account' AS operations, 'send' || i || ' email' AS actions FROM n""")
def flow_files(s, d):
    t = _table(s, d, "flows")
    variables = _flat("variables", lambda v: F.concat_ws(":", v["name"], v["data_type"], v["is_input"].cast("string"), v["is_output"].cast("string")))
    return t.select("api_name", "label", "process_type", "description", variables.alias("variables"), F.col("decisions").cast("int").alias("decisions"), F.col("loops").cast("int").alias("loops"), F.col("screens").cast("int").alias("screens"), _flat("record_operations", lambda o: F.concat_ws(" ", o["operation"], o["object"])).alias("operations"), _flat("action_calls", lambda a: F.concat_ws(" ", a["name"], a["action_type"])).alias("actions"))


@query(f"WITH {_N} SELECT 'Rule_' || i AS rule_name, 'Obj_' || i AS object_name, i % 2 = 0 AS active, 'Guards ' || name AS description, 'a < ' || i AS formula, 'A__c' AS field, 'Below ' || i AS message FROM n")
def rule_files(s, d):
    return _table(s, d, "validation-rules").select("rule_name", "object_name", "active", "description", F.col("error_condition_formula").alias("formula"), F.col("error_display_field").alias("field"), F.col("error_message").alias("message"))


_OBJECT = "'<CustomObject><description>Holds ' || name || '</description><label>' || name || '</label><nameField><label>No</label></nameField></CustomObject>'"
_FIELDS = "'<CustomField><fullName>A__c</fullName><label>A of ' || i || '</label><type>Lookup</type><referenceTo>Obj_' || k || '</referenceTo><inlineHelpText>help</inlineHelpText></CustomField>' || '<CustomField><fullName>B__c</fullName><label>B</label><type>Text</type><required>true</required></CustomField>'"


@query(f"WITH {_N} SELECT 'Obj_' || i AS object_name, name AS label, 'Holds ' || name AS description, 'A__c|A of ' || i || '|Lookup|Obj_' || k || '|help|false;B__c|B|Text|||true' AS fields, sha256({_OBJECT} || {_FIELDS}) AS hash FROM n")
def object_files(s, d):
    return _table(s, d, "objects").select("object_name", "label", "description", _flat("fields", lambda f: F.concat_ws("|", f["api_name"], f["label"], f["field_type"], f["reference_to"], f["help_text"], f["required"].cast("string"))).alias("fields"), "hash")


@query(f"""WITH {_N} SELECT 'comp' || i AS component_name, CASE i % 2 WHEN 1 THEN 'focus:true;label:false;size:false' ELSE '' END AS props, CASE WHEN i % 3 <> 0 THEN 'icon;default' ELSE '' END AS slots, CASE WHEN i % 3 <> 0 THEN 'toolTip;part' || i ELSE '' END AS children FROM n""")
def component_files(s, d):
    return _table(s, d, "lwc").select("component_name", _flat("api_props", lambda p: F.concat_ws(":", p["name"], p["is_method"].cast("string"))).alias("props"), F.array_join("slots", ";").alias("slots"), F.array_join("referenced_components", ";").alias("children"))


@query(f"WITH {_N} SELECT 'Page_' || i AS api_name, 'Start ' || i AS label, 'AppPage' AS page_type, CASE i % 2 WHEN 1 THEN 'Obj_' || i ELSE '' END AS sobject, 'comp' || i || ';force:two' AS components, 'Flow_' || i AS flows FROM n")
def page_files(s, d):
    return _table(s, d, "flexipages").select("api_name", "label", "page_type", "sobject", F.array_join("component_names", ";").alias("components"), F.array_join("flow_names", ";").alias("flows"))


@query(f"WITH {_N} SELECT 'Type' || (i % 3) || '__mdt' AS type_name, 'Rec_' || lpad(i::VARCHAR, 6, '0') AS record_name, 'Rec of ' || name AS label, 'A__c=' || i || CASE i % 2 WHEN 1 THEN ';B' || k || '__c=b' || i ELSE '' END AS cells FROM n")
def record_files(s, d):
    return _table(s, d, "custom-metadata").select("type_name", "record_name", "label", _flat("values", lambda v: F.concat_ws("=", v["field"], v["value"])).alias("cells"))


@query(f"WITH {_N} SELECT 'au' || i AS component_name, 'title:String:' || name || ';n:Integer:' AS attributes, 'saved;c:again' || i AS events, CASE i % 2 WHEN 1 THEN 'c:base' || k END AS extends FROM n")
def aura_files(s, d):
    return _table(s, d, "aura").select("component_name", _flat("attributes", lambda a: F.concat_ws(":", a["name"], a["attr_type"], a["default"])).alias("attributes"), F.array_join("events_handled", ";").alias("events"), "extends")


@query(f"""WITH {_N}, r AS (SELECT 'Class_' || i AS source, 'Runner_' || k AS target FROM n UNION ALL SELECT 'Watch_' || i, 'Class_' || i FROM n) SELECT source, target FROM r""")
def impact(s, d):
    return pipeline.impact({k: _table(s, d, k) for k in ("apex", "triggers")})


@query(f"WITH {_N} SELECT 'Class_' || i AS name FROM n")
def dead_code(s, d):
    return pipeline.unreferenced({"apex": _table(s, d, "apex")})


# --- prompts -------------------------------------------------------------------

_NL = "chr(10)"


def _lines(*parts: str) -> str:
    """SQL of a text of lines; a part is SQL of one line's text, or of several with their ends."""
    return " || ".join(f"{p} || {_NL}" for p in parts)


PROMPT_SQL = {
    "triggers": _lines("'Trigger: Watch_' || i", "'Object: Obj_' || i", "'Events: before insert, after update'", "'Comments:'", "'* /** Keeps ' || name || '. @tag watch-' || k || ' */'", "'Source:'", "'/** Keeps ' || name || '. @tag watch-' || k || ' */'", "'trigger Watch_' || i || ' on Obj_' || i || ' (before insert, AFTER UPDATE' || CASE i % 2 WHEN 1 THEN ', before undelete' ELSE '' END || ') { Class_' || i || '.first(null); }'"),
    "validation-rules": _lines("'Rule: Rule_' || i", "'Object: Obj_' || i", "'Active: ' || (i % 2 = 0)", "'About: Guards ' || name", "'Formula:'", "'a < ' || i", "'Field: A__c'", "'Message: Below ' || i"),
    "objects": _lines("'Object: Obj_' || i", "'Label: ' || name", "'About: Holds ' || name", "'Fields:'", "'* A__c | Lookup → Obj_' || k || ' | A of ' || i || ' |  | help'", "'* B__c | Text | B |  | '"),
    "flexipages": _lines("'Page: Start ' || i", "'Type: AppPage'") + f" || CASE i % 2 WHEN 1 THEN 'Object: Obj_' || i || {_NL} ELSE '' END || " + _lines("'Components:'", "'* comp' || i", "'* force:two'", "'Flows:'", "'* Flow_' || i"),
    "lwc": _lines("'Component: comp' || i") + f" || CASE i % 2 WHEN 1 THEN {_lines(repr('Public:'), repr('* method focus'), repr('* property label'), repr('* property size'))} ELSE '' END || CASE WHEN i % 3 <> 0 THEN {_lines(repr('Slots:'), repr('* icon'), repr('* default'), repr('Children:'), repr('* toolTip'), repr('* part') + ' || i')} ELSE '' END || 'Script:' || {_NL} || CASE i % 2 WHEN 1 THEN "
    + _lines("'import x from ''y'';'", "'@api label = ' || i || ';'", "'@api get size() { return 1; }'", "'@api focus() {}'", "'@api label;'") + f" ELSE '<x>' || i || '</x>' END || {_NL}",
}


def _prompt_query(kind: str, name_sql: str) -> None:
    def f(s: SparkSession, d: str) -> DataFrame:
        return _table(s, d, kind).select("name", prompts.prompt(kind).alias("prompt"))

    f.__name__ = f"prompt_{kind.replace('-', '_')}"
    query(f"WITH {_N} SELECT {name_sql} || i AS name, {PROMPT_SQL[kind]} AS prompt FROM n")(f)


for _kind, _name in (("triggers", "'Watch_'"), ("validation-rules", "'Rule_'"), ("objects", "'Obj_'"), ("flexipages", "'Page_'"), ("lwc", "'comp'")):
    _prompt_query(_kind, _name)


_FLOW = "'<Flow xmlns=''http://x''>' || CASE i % 2 WHEN 0 THEN '<label>Greet ' || name || ' &amp; go</label>' ELSE '' END || '<processType>Auto' || k || '</processType><description>For ' || name || '</description><variables><name>v' || i || '</name><dataType>String</dataType><isInput>true</isInput><isOutput>' || CASE i % 3 WHEN 0 THEN 'true' ELSE 'false' END || '</isOutput></variables>' || '<variables><name>own</name><dataType>Number</dataType></variables><recordUpdates><object>Obj_' || i || '</object></recordUpdates><recordLookups><object>Account</object></recordLookups><actionCalls><actionName>send' || i || '</actionName><actionType>email</actionType></actionCalls><decisions><name>d</name></decisions><decisions><name>e</name></decisions><screens><name>s</name></screens></Flow>'"


@query(f"""WITH {_N}, t AS (SELECT i, {_FLOW} || {_NL} AS head FROM n)
SELECT 'Flow_' || n.i AS name, {_lines("'Flow: ' || CASE n.i % 2 WHEN 0 THEN 'Greet ' || name || ' & go' ELSE 'Flow ' || n.i END", "'Type: Auto' || k", "'About: For ' || name", "'Inputs:'", "'* String v' || n.i")} || CASE n.i % 3 WHEN 0 THEN {_lines("'Outputs:'", "'* String v' || n.i")} ELSE '' END
|| {_lines("'Record operations:'", "'* update Obj_' || n.i", "'* lookup Account'", "'Actions:'", "'* send' || n.i || ' email'", "'Decisions: 2'", "'Loops: 0'", "'Screens: 1'", "'XML:'")} || head AS prompt FROM n JOIN t USING (i)""")
def prompt_flows(s, d):
    return _table(s, d, "flows").select("name", prompts.prompt("flows").alias("prompt"))


_CLASS = f"""'/** Class of ' || name || '. @tag ' || lower(region) || ' */' || {_NL} || 'public ' || CASE i % 3 WHEN 0 THEN 'abstract ' ELSE '' END || 'with sharing class Class_' || i || CASE i % 2 WHEN 0 THEN ' extends Base_' || k ELSE '' END || ' implements Runner_' || k || ', Batch {{' || {_NL} || '  private static Integer LIMIT_' || i || ' = ' || i || ';' || {_NL} || '  public String label;' || {_NL} || '  // public void hidden() {{}}' || {_NL} || '  public void run(String why, Integer times) {{ Helper.go(why); }}' || {_NL} || '  global static Class_' || i || ' first(Id key) {{ return null; }}' || {_NL} || '}}'"""


@query(f"""WITH {_N} SELECT 'Class_' || i AS name, {_lines("'Class: Class_' || i")} || CASE i % 2 WHEN 0 THEN 'Extends: Base_' || k || {_NL} ELSE '' END || {_lines("'Implements:'", "'* Runner_' || k", "'* Batch'", "'Methods:'", "'* public void run(String why, Integer times)'", "'* global static Class_' || i || ' first(Id key)'", "'Properties:'", "'* Integer LIMIT_' || i", "'* String label'", "'Comments:'", "'* /** Class of ' || name || '. @tag ' || lower(region) || ' */'", "'Source:'")} || {_CLASS} || {_NL} AS prompt FROM n""")
def prompt_apex(s, d):
    return _table(s, d, "apex").where("not is_interface").select("name", prompts.prompt("apex").alias("prompt"))


_MARKUP = "'<aura:component' || CASE i % 2 WHEN 1 THEN ' extends=''c:base' || k || chr(39) ELSE '' END || '><aura:attribute name=\"title\" type=\"String\" default=\"' || name || '\"/><aura:attribute name=\"n\" type=\"Integer\"/><aura:registerEvent name=\"saved\" type=\"c:e\"/><aura:handler event=\"c:again' || i || '\"/><aura:handler event=\"c:again' || i || '\"/></aura:component>'"


@query(f"""WITH {_N} SELECT 'au' || i AS name, {_lines("'Component: au' || i")} || CASE i % 2 WHEN 1 THEN 'Extends: c:base' || k || {_NL} ELSE '' END || {_lines("'Attributes:'", "'* String title ' || name || ' '", "'* Integer n  '", "'Events:'", "'* saved'", "'* c:again' || i", "'Markup:'")} || {_MARKUP} || {_NL} AS prompt FROM n""")
def prompt_aura(s, d):
    return _table(s, d, "aura").select("name", prompts.prompt("aura").alias("prompt"))


# --- descriptions, snapshot, pages ---------------------------------------------


class Fixed:
    """A generator whose answers depend on the file's name only."""

    local = free = True

    def generate(self, system: str, prompt: str, label: str) -> str:
        kind = system.split(":", 1)[0]
        out: dict[str, object] = {f: [f"{f} one of {label}", f"{f} two"] if t.startswith("array") else f"{f} of {label}" for f, t in enrich.FIELDS[kind].items()}
        named = {
            "methods": [{"name": "run", "description": "runs", "params": [{"name": "why", "description": "reason"}], "returns": "void", "throws": ["Oops"]}, {"name": "first", "description": "finds", "params": [], "returns": "the first", "throws": []}, {"name": "gone", "description": "left", "params": [], "returns": "", "throws": []}],
            "properties": [{"name": "label", "description": "shown"}, {"name": f"LIMIT_{label[6:]}", "description": "bound"}, {"name": "gone", "description": "left"}],
            "events": [{"event": "before insert", "description": "checks"}], "handler_classes": ["Class_0", "Gone"], "api_props": [{"name": "focus", "description": "sets it"}, {"name": "label", "description": "shows it"}],
            "attributes": [{"name": "title", "description": "on top"}, {"name": "n", "description": "number"}, {"name": "gone", "description": "left"}], "relationships": ["nothing known", "works with Obj_1 and Class_1"],
        }
        return json.dumps(out | {k: v for k, v in named.items() if k in out})


def described(s: SparkSession, d: str) -> str:
    """The folder with the snapshot of the whole tree, described once; ``_FOUND`` has what pages are made of."""

    def make(at: str) -> None:
        _FOUND[at] = pipeline.describe(s, tree(s, d), f"{at}/snapshot", Fixed(), "fixed")

    return _once(s, d, "described", make)


def built(s: SparkSession, d: str) -> str:
    """The folder with the pages of the whole tree, made once of what was described."""

    def make(at: str) -> None:
        with scratch.room(s) as keep:
            pipeline.rendered(s, _FOUND[described(s, d)], keep).pages.write.parquet(f"{at}/pages")

    return _once(s, d, "built", make)


def _pages(s: SparkSession, d: str, kind: str) -> DataFrame:
    return s.read.parquet(f"{built(s, d)}/pages").where(F.col("kind") == kind).select("name", "body")


def _see(folder: str) -> str:
    """SQL of the links section; the folder is the way from the page to the objects."""
    return f"'## See Also' || {_NL} || {_NL} || '- [Class_1]({folder}Class_1.md) — works with Obj_1 and Class_1' || {_NL} || {_NL}"


def _toc(*titles: str) -> str:
    return f"'## Table of Contents' || {_NL} || {_NL} || " + " || ".join(f"'- [{t}](#{t.lower().replace(' ', '-')})' || {_NL}" for t in titles) + f" || {_NL}"


def _text(title: str, field: str, name: str) -> str:
    return f"'## {title}' || {_NL} || {_NL} || '{field} of ' || {name} || {_NL} || {_NL}"


def _items(title: str, field: str, name: str) -> str:
    return f"'## {title}' || {_NL} || {_NL} || '- {field} one of ' || {name} || {_NL} || '- {field} two' || {_NL} || {_NL}"


def _rows(title: str, *lines: str) -> str:
    """SQL of a table section; the first line is its head."""
    return f"'## {title}' || {_NL} || {_NL} || {_lines(*lines)} || {_NL}"


def _page_sql(name: str, title: str, badge: str, *parts: str) -> str:
    head = f"'# ' || {title} || {_NL} || {_NL} || {badge} || {_NL} || {_NL} || 'summary of ' || {name} || {_NL} || {_NL}"
    return f"WITH {_N} SELECT {name} AS name, " + " || ".join([head, *parts]) + " AS body FROM n"


_W, _C, _O, _F, _R, _L, _P, _A = "'Watch_' || i", "'Class_' || i", "'Obj_' || i", "'Flow_' || i", "'Rule_' || i", "'comp' || i", "'Page_' || i", "'au' || i"


@query(_page_sql(_W, _W, f"'`trigger` · `on Obj_' || i || '` · `before insert` · `after update`' || {_NL} || {_NL} || '**Tags:** `watch-' || k || '`'", _toc("Description", "Event Handlers", "Handler Classes", "Usage Notes"), _text("Description", "description", _W), _rows("Event Handlers", "'| Event | Description |'", "'|-------|-------------|'", "'| `before insert` | checks |'"),
                 f"'## Handler Classes' || {_NL} || {_NL} || '- [Class_0](../classes/Class_0.md)' || {_NL} || '- `Gone`' || {_NL} || {_NL}", _items("Usage Notes", "usage_notes", _W), _see("../classes/")))
def pages_triggers(s, d):
    return _pages(s, d, "triggers")


@query(_page_sql(_R, _R, "'`validation-rule` · `on Obj_' || i || '` · ' || CASE i % 2 WHEN 0 THEN '`active`' ELSE '`inactive`' END", _toc("When It Fires", "What It Protects", "Error Condition Formula", "Formula Explanation", "Error Message", "Edge Cases"), _text("When It Fires", "when_fires", _R), _text("What It Protects", "what_protects", _R),
                 f"'## Error Condition Formula' || {_NL} || {_NL} || '```' || {_NL} || 'a < ' || i || {_NL} || '```' || {_NL} || {_NL}", _text("Formula Explanation", "formula_explanation", _R), f"'## Error Message' || {_NL} || {_NL} || '> Below ' || i || {_NL} || {_NL} || '**Displayed on field:** `A__c`' || {_NL} || {_NL}", _items("Edge Cases", "edge_cases", _R), _see("../classes/")))
def pages_validation_rules(s, d):
    return _pages(s, d, "validation-rules")


@query(_page_sql(_O, "name", "'`object` · `Obj_' || i || '`'", _text("Purpose", "purpose", _O), _text("Description", "description", _O), _rows("Fields", "'| API Name | Type | Label | Required |'", "'|----------|------|-------|----------|'", "'| `A__c` | Lookup → `Obj_' || k || '` | A of ' || i || ' | No |'", "'| `B__c` | Text | B | Yes |'"), _items("Key Fields", "key_fields", _O), _items("Admin Notes", "admin_notes", _O), _see("../classes/")))
def pages_objects(s, d):
    return _pages(s, d, "objects")


@query(_page_sql(_F, "CASE i % 2 WHEN 0 THEN 'Greet ' || name || ' & go' ELSE 'Flow ' || i END", "'`flow` · `Auto' || k || '`'", _toc("Description", "Business Process", "Entry Criteria", "Variables", "Record Operations", "Action Calls", "Element Counts", "Key Decisions", "Admin Notes"), _text("Description", "description", _F), _text("Business Process", "business_process", _F), _text("Entry Criteria", "entry_criteria", _F),
                 _rows("Variables", "'| Name | Type | Direction |'", "'|------|------|-----------|'", "'| `v' || i || '` | `String` | ' || CASE i % 3 WHEN 0 THEN 'Input / Output' ELSE 'Input' END || ' |'", "'| `own` | `Number` | Internal |'"), _rows("Record Operations", "'| Operation | Object |'", "'|-----------|--------|'", "'| update | `Obj_' || i || '` |'", "'| lookup | `Account` |'"), _rows("Action Calls", "'| Action | Type |'", "'|--------|------|'", "'| `send' || i || '` | email |'"),
                 f"'## Element Counts' || {_NL} || {_NL} || '- Decisions: 2' || {_NL} || '- Screens: 1' || {_NL} || {_NL}", _items("Key Decisions", "key_decisions", _F), _items("Admin Notes", "admin_notes", _F), _see("../classes/")))
def pages_flows(s, d):
    return _pages(s, d, "flows")


@query(_page_sql(_L, _L, "'`lwc` · `Lightning Web Component`'", f"'## Table of Contents' || {_NL} || {_NL} || '- [Description](#description)' || {_NL} || '- [Public API](#public-api)' || {_NL} || CASE WHEN i % 3 <> 0 THEN '- [Slots](#slots)' || {_NL} ELSE '' END || '- [Usage Notes](#usage-notes)' || {_NL} || {_NL}", _text("Description", "description", _L),
                 _rows("Public API", "'| Name | Kind | Description |'", "'|------|------|-------------|'", "'| `focus` | ' || CASE i % 2 WHEN 1 THEN 'method' ELSE 'property' END || ' | sets it |'", "'| `label` | property | shows it |'"), "CASE WHEN i % 3 <> 0 THEN " + _rows("Slots", "'| Slot | Description |'", "'|------|-------------|'", "'| `icon` |  |'", "'| _(default)_ |  |'") + " ELSE '' END", _items("Usage Notes", "usage_notes", _L), _see("../classes/")))
def pages_lwc(s, d):
    return _pages(s, d, "lwc")


@query(_page_sql(_P, "'Start ' || i", "'`lightning-page` · `AppPage` · `' || CASE i % 2 WHEN 1 THEN 'Obj_' || i ELSE '—' END || '`'", _text("Description", "description", _P), _text("Usage Context", "usage_context", _P), _rows("Components", "'| Component |'", "'|-----------|'", "'| `comp' || i || '` |'", "'| `force:two` |'"), _items("Key Components", "key_components", _P), f"'## Referenced Flows' || {_NL} || {_NL} || '- `Flow_' || i || '`' || {_NL} || {_NL}", _see("../classes/")))
def pages_flexipages(s, d):
    return _pages(s, d, "flexipages")


@query(_page_sql(_A, _A, "'`aura` · `Aura Component`' || CASE i % 2 WHEN 1 THEN ' · `extends c:base' || k || '`' ELSE '' END", _toc("Description", "Attributes", "Events", "Usage Notes"), _text("Description", "description", _A), _rows("Attributes", "'| Name | Type | Default | Description |'", "'|------|------|---------|-------------|'", "'| `title` | `String` | `' || name || '` | on top |'", "'| `n` | `Integer` | — | number |'", "'| `gone` | `—` | — | left |'"),
                 f"'## Events' || {_NL} || {_NL} || '- `saved`' || {_NL} || '- `c:again' || i || '`' || {_NL} || {_NL}", _items("Usage Notes", "usage_notes", _A), _see("../classes/")))
def pages_aura(s, d):
    return _pages(s, d, "aura")


_METHODS = f"'## Methods' || {_NL} || {_NL} || '### `void run(String why, Integer times)`' || {_NL} || {_NL} || 'runs' || {_NL} || {_NL} || '**Parameters**' || {_NL} || {_NL} || '| Name | Description |' || {_NL} || '|------|-------------|' || {_NL} || '| `why` | reason |' || {_NL} || {_NL} || '**Throws**' || {_NL} || {_NL} || '- Oops' || {_NL} || {_NL} || '### `static Class_' || i || ' first(Id key)`' || {_NL} || {_NL} || 'finds' || {_NL} || {_NL} || '**Returns:** the first' || {_NL} || {_NL} || '### `gone`' || {_NL} || {_NL} || 'left' || {_NL} || {_NL}"


@query(_page_sql(_C, _C, f"'`public`' || CASE i % 3 WHEN 0 THEN ' · `abstract`' ELSE '' END || CASE i % 2 WHEN 0 THEN ' · `extends Base_' || k || '`' ELSE '' END || ' · `implements Runner_' || k || ', Batch`' || {_NL} || {_NL} || '**Tags:** `' || string_split(lower(region), ' ')[1] || '`'",
                 f"'## Table of Contents' || {_NL} || {_NL} || " + " || ".join(f"'- {t}' || {_NL}" for t in ("[Description](#description)", "[Properties](#properties)", "[Methods](#methods)")) + " || " + " || ".join(f"'  - [`{m}`](#{m})' || {_NL}" for m in ("run", "first", "gone")) + f" || '- [Usage Examples](#usage-examples)' || {_NL} || {_NL}",
                 _text("Description", "description", _C), _rows("Properties", "'| Name | Type | Description |'", "'|------|------|-------------|'", "'| `label` | `String` | shown |'", "'| `LIMIT_' || i || '` | `static Integer` | bound |'", "'| `gone` | `—` | left |'"), _METHODS, f"'## Usage Examples' || {_NL} || {_NL} || 'usage_examples one of ' || {_C} || {_NL} || {_NL} || 'usage_examples two' || {_NL} || {_NL}", _see("")))
def pages_classes(s, d):
    return _pages(s, d, "apex").where("name like 'Class%'")


_I = "'Runner_' || k"
_INTERFACE = " || ".join([
    f"'# ' || {_I} || {_NL} || {_NL} || '`public` · `interface`' || {_NL} || {_NL} || 'summary of ' || {_I} || {_NL} || {_NL} || '## Table of Contents' || {_NL} || {_NL}",
    _lines("'- [Description](#description)'", "'- [Implemented By](#implemented-by)'", "'- [Properties](#properties)'", "'- [Methods](#methods)'", *(f"'  - [`{m}`](#{m})'" for m in ("run", "first", "gone")), "'- [Usage Examples](#usage-examples)'", "''"),
    _text("Description", "description", _I), f"'## Implemented By' || {_NL} || {_NL} || classes || {_NL}",
    _rows("Properties", "'| Name | Type | Description |'", "'|------|------|-------------|'", "'| `label` | `—` | shown |'", "'| `LIMIT__' || k || '` | `—` | bound |'", "'| `gone` | `—` | left |'"),
    _METHODS.replace("static Class_' || i || ' first(Id key)", "first"),
    f"'## Usage Examples' || {_NL} || {_NL} || 'usage_examples one of ' || {_I} || {_NL} || {_NL} || 'usage_examples two' || {_NL} || {_NL}", _see(""),
])


@query(f"WITH {_N}, c AS (SELECT k, string_agg('- [Class_' || i || '](Class_' || i || '.md)' || {_NL}, '' ORDER BY 'Class_' || i) AS classes FROM n GROUP BY k) SELECT {_I} AS name, {_INTERFACE} AS body FROM c")
def pages_interfaces(s, d):
    return _pages(s, d, "apex").where("name like 'Runner%'")


@query(f"""WITH {_N}, r AS (SELECT 'Type' || (i % 3) || '__mdt' AS t, 'Rec_' || lpad(i::VARCHAR, 6, '0') AS rec, 'Rec of ' || name AS label, i, k FROM n),
c AS (SELECT t, list_sort(['A__c'] || list(DISTINCT 'B' || k || '__c') FILTER (i % 2 = 1)) AS cols, count(*) AS n FROM r GROUP BY t),
b AS (SELECT r.t AS t, rec, '| `' || rec || '` | ' || label || ' ' || array_to_string(list_transform(cols, lambda x: '| ' || CASE WHEN x = 'A__c' THEN i::VARCHAR WHEN i % 2 = 1 AND x = 'B' || k || '__c' THEN 'b' || i ELSE '—' END || ' '), '') || '|' || {_NL} AS line FROM r JOIN c ON r.t = c.t)
SELECT c.t AS name, '# ' || c.t || {_NL} || {_NL} || '`custom-metadata-type`' || {_NL} || {_NL} || n || ' record(s)' || {_NL} || {_NL} || '## Records' || {_NL} || {_NL} || '| Record | Label' || array_to_string(list_transform(cols, lambda x: ' | ' || x), '') || ' |' || {_NL} || '|--------|------' || repeat('|------', len(cols)) || '|' || {_NL}
|| (SELECT string_agg(line, '' ORDER BY rec) FROM b WHERE b.t = c.t) AS body FROM c""")
def render_records(s, d):
    return _pages(s, d, "custom-metadata")


def _index_rows(link: str, folder: str, cells: str, order: str, where: str = "true") -> str:
    return f"(SELECT string_agg('| [' || {link} || ']({folder}/' || {order} || '.md) | ' || {cells} || ' |' || {_NL}, '' ORDER BY {link}, {order}) FROM n WHERE {where})"


_BY_REGION = f"(SELECT string_agg('### classes/' || region || {_NL} || {_NL} || '| Class | Summary |' || {_NL} || '|-------|---------|' || {_NL} || rows || {_NL}, '' ORDER BY region) FROM (SELECT region, string_agg('| [Class_' || i || '](classes/Class_' || i || '.md) | summary of Class_' || i || ' |' || {_NL}, '' ORDER BY 'Class_' || i) AS rows FROM n GROUP BY region))"
_BY_OBJECT = f"(SELECT string_agg('### Obj_' || i || {_NL} || {_NL} || '| Rule | Object | Status | Summary |' || {_NL} || '|------|--------|--------|---------|' || {_NL} || '| [Rule_' || i || '](validation-rules/Rule_' || i || '.md) | `Obj_' || i || '` | ' || CASE i % 2 WHEN 0 THEN 'active' ELSE 'inactive' END || ' | summary of Rule_' || i || ' |' || {_NL} || {_NL}, '' ORDER BY 'Obj_' || i) FROM n)"
_BY_COMPONENT = f"(SELECT string_agg('### lwc/comp' || i || {_NL} || {_NL} || '| Component | @api Props | Summary |' || {_NL} || '|-----------|------------|---------|' || {_NL} || '| [comp' || i || '](lwc/comp' || i || '.md) | ' || CASE i % 2 WHEN 1 THEN 3 ELSE 0 END || ' | summary of comp' || i || ' |' || {_NL} || {_NL}, '' ORDER BY 'lwc/comp' || i) FROM n)"


def _section(title: str, head: str, rows: str) -> str:
    heads = head.split(" | ")
    rule = "|" + "|".join("-" * (len(h) + 2) for h in heads) + "|"
    return f"'## {title}' || {_NL} || {_NL} || '| {head} |' || {_NL} || '{rule}' || {_NL} || {rows} || {_NL}"


@query(f"""WITH {_N} SELECT '# Apex Documentation Index' || {_NL} || {_NL} || 'Generated documentation for ' || (SELECT count(*) FROM n) || ' class(es), ' || (SELECT string_agg(c || ' ' || x, ', ' ORDER BY o) FROM (SELECT count(*) AS c FROM n), (VALUES (1, 'trigger(s)'), (2, 'flow(s)'), (3, 'validation rule(s)'), (4, 'object(s)'), (5, 'LWC component(s)'), (6, 'Lightning page(s)')) t(o, x)) || ', ' || (SELECT count(DISTINCT i % 3) FROM n) || ' Custom Metadata type(s), and ' || (SELECT count(*) FROM n) || ' Aura component(s).' || {_NL} || {_NL}
|| '## Classes' || {_NL} || {_NL} || {_BY_REGION}
|| {_section("Interfaces", "Interface | Summary", f"(SELECT string_agg('| [Runner_' || k || '](classes/Runner_' || k || '.md) | summary of Runner_' || k || ' |' || {_NL}, '' ORDER BY k) FROM (SELECT DISTINCT k FROM n))")}
|| {_section("Triggers", "Trigger | SObject | Summary", _index_rows(_W, "triggers", "'`Obj_' || i || '` | summary of Watch_' || i", _W))}
|| {_section("Flows", "Flow | Process Type | Summary", _index_rows("CASE i % 2 WHEN 0 THEN 'Greet ' || name || ' & go' ELSE 'Flow ' || i END", "flows", "'`Auto' || k || '` | summary of Flow_' || i", _F))}
|| '## Validation Rules' || {_NL} || {_NL} || {_BY_OBJECT}
|| {_section("Objects", "Object | Label | Fields | Summary", _index_rows(_O, "objects", "name || ' | 2 | summary of Obj_' || i", _O))}
|| '## Lightning Web Components' || {_NL} || {_NL} || {_BY_COMPONENT}
|| {_section("Lightning Pages", "Page | Type | Summary", _index_rows(_P, "flexipages", "'`AppPage` | summary of Page_' || i", _P))}
|| {_section("Custom Metadata Types", "Type | Records", f"(SELECT string_agg('| [' || t || '](custom-metadata/' || t || '.md) | ' || c || ' |' || {_NL}, '' ORDER BY t) FROM (SELECT 'Type' || (i % 3) || '__mdt' AS t, count(*) AS c FROM n GROUP BY 1))")}
|| {_section("Aura Components", "Component | Attributes | Summary", _index_rows(_A, "aura", "'2 | summary of au' || i", _A))} AS body""")
def pages_index(s, d):
    return _pages(s, d, "index").select("body")


@query(_LIST + "SELECT kind, path, 'fixed' AS model FROM x WHERE kind <> 'custom-metadata'")
def snapshot_entries(s, d):
    at = described(s, d)
    return cache.load(s, f"{at}/snapshot").select("kind", _below(tree(s, d)).alias("path"), "model")


@query(_LIST + ", o(model) AS (VALUES ('fixed'), ('other')) SELECT model, kind, count(*) AS files, CASE model WHEN 'fixed' THEN count(*) ELSE 0 END AS up_to_date, CASE model WHEN 'fixed' THEN 0 ELSE count(*) END AS made, CAST(0 AS BIGINT) AS failed FROM x, o WHERE kind <> 'custom-metadata' GROUP BY model, kind")
def kind_counts(s, d):
    root, at = tree(s, d), described(s, d)
    work = scratch.stored(pipeline.file_rows(pipeline.metadata(s, root)))  # counted several times
    known, rows = cache.load(s, f"{at}/snapshot"), []
    for model in ("fixed", "other"):
        todo, ready = cache.split(work, known, model)
        for kind, n in pipeline.counts_by_kind(work, ready, todo.withColumn("error", F.lit(None).cast("string"))).items():
            rows.append((model, kind, n["files"], n["up_to_date"], n["made"], n["failed"]))
    return s.createDataFrame(rows, "model string, kind string, files long, up_to_date long, made long, failed long")


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def snapshot_versions(s, d):
    at = scratch.folder(s)
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", tx.content_hash(F.col("text")).alias("hash"))
    versions.replace(docs.withColumn("hash", F.lit("old")), at)
    versions.replace(docs, at)
    return s.read.schema(docs.schema).parquet(versions.current(s, at))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS hash FROM documents), k AS (SELECT doc_id, hash, quality FROM h JOIN labels USING (doc_id))
SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN quality IS NULL THEN hash WHEN quality = 0 THEN 'new ' || hash ELSE hash END AS hash, CASE WHEN quality IS NULL THEN 1 ELSE 1 + CAST(quality = 0 AS INTEGER) END AS versions FROM h LEFT JOIN k USING (doc_id, hash)""")
def snapshot_log(s, d):
    """Documents in a snapshot to which runs add only what changed; who reads gets each file's last version."""
    at = scratch.folder(s)
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.lit("flows").alias("kind"), F.col("doc_id").cast("string").alias("path"), tx.content_hash(F.col("text")).alias("hash"))
    rows = lambda df: df.select("*", F.lit("{}").alias("documentation"), F.lit("{}").alias("metadata"), F.col("path").alias("name"))
    bad = s.read.parquet(f"{d}/labels.parquet").where("quality = 0").select(F.col("doc_id").cast("string").alias("path"))
    changed = docs.join(bad, "path").withColumn("hash", F.concat(F.lit("new "), F.col("hash"))).select(*docs.columns)
    cache.add(rows(docs), at, "m")
    cache.add(rows(changed.withColumn("hash", F.lit("between"))), at, "m")
    cache.add(rows(changed), at, "m")
    parts = [s.read.parquet(p).select("path") for p in versions.members(s, at)]
    n = _union([parts[0], parts[2]]).groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("versions"))
    return cache.load(s, at).select("path", "hash").join(n, "path")
