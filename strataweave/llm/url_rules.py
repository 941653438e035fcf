"""URL rules as a sort-merge range join (DataFrame functions only).

A rule is a host and a path prefix and fits the host's subdomains too. With the
host's labels reversed, ``org.example/`` and the path make a key, and a rule
fits a key exactly if it is a prefix of it: rules are intervals of keys, and two
intervals are nested or apart. A URL has a key for each suffix of its host that
is no longer than the longest rule host.

Keys and rules are sorted together and swept once. The state of the sweep is the
stack of rules that are open at the last rule passed; each rule carries it from
the start (it is the rule and the rules whose keys are prefixes of its own). A
key takes of that stack the rules that are still open, which are all that fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, ordered_last, stored


def split_url(url: str) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``. Without ``://`` both are empty."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    part = lambda i: F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", i)
    return ascii_lower(part(1)), part(2)


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("/"), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Distinct rules with ``key`` and ``stack``, the open rules at it from the outermost in; of equal rules the later verdict by name (block) holds."""
    one = rules.where("host is not null and path is not null and verdict is not null")
    one = one.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    one = one.select(_key(F.reverse(F.split("host", r"\.")), F.col("path")).alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.concat("host", "path").alias("rule"), "verdict")
    one = stored(one, "rules")
    prefixes = one.select(F.col("key").alias("inner"), F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("key"))
    entry = F.struct(F.length("key").alias("size"), "key", "rule", "verdict")
    stacks = prefixes.join(one, "key").groupBy("inner").agg(F.sort_array(F.collect_list(entry)).alias("stack"))
    return stored(stacks.withColumnRenamed("inner", "key").join(one.select("key", "labels"), "key"), "stacks")


def match(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``(host, path, rule, verdict)`` for every distinct host and path of ``pages`` that a rule fits: the longest, on a tie the one with the longer host, then block."""
    stacks = rule_stacks(rules)
    deepest = stacks.agg(F.coalesce(F.max("labels"), F.lit(0))).first()[0]
    host, path = split_url(url)
    found = pages.select(host.alias("host"), path.alias("path")).where("host <> ''").distinct()
    labels = F.reverse(F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, deepest)))), lambda n: _key(F.slice(labels, 1, n), F.col("path")))
    points = found.select("host", "path", F.explode(suffixes).alias("key"), F.lit(1).alias("kind"))
    opens = stacks.select("key", F.lit(0).alias("kind"), "stack")
    swept = ordered_last(points.unionByName(opens, allowMissingColumns=True), ["key", "kind", "host", "path"], "stack", "open")
    fits = F.filter("open", lambda r: F.startswith(F.col("key"), r["key"]))
    fitting = F.transform(fits, lambda r: F.struct(F.length(r.rule).alias("size"), F.instr(r["key"], "/").alias("host_size"), r.verdict.alias("verdict"), r.rule.alias("rule")))
    best = swept.where("kind = 1").select("host", "path", F.array_max(fitting).alias("r"))
    return best.where("r is not null").groupBy("host", "path").agg(F.max("r").alias("r")).select("host", "path", "r.rule", "r.verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``; where no rule fits, rule is null and the verdict ``default``.

    A null url, or one without ``://``, has an empty host and path and no rule.
    Rules with a null are left out; without rules all get the default. Repeated
    rows stay, a null id too; further columns are ignored.
    """
    best = stored(match(pages, rules, url), "matched")
    host, path = split_url(url)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    judged = rows.where("host <> ''").join(best.hint("merge"), ["host", "path"], "left").select("page_id", "host", "path", "rule", "verdict")
    # urls without a host are one key: they pass by the join
    bare = rows.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return judged.union(bare).withColumn("verdict", F.coalesce("verdict", F.lit(default)))
