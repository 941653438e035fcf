"""Joins, de-duplication, grouping and set operators over any DataFrames.

Nothing relies on row order: where order matters a position or sort column is
named. Sides are broadcast only where a bound on their rows is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Rows up to which a lookup side is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``bound`` rows (looked at no further than one more), else as it is."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def fresh(rows: DataFrame, snapshot: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key and fingerprint columns ``on`` are in the snapshot; a null in them is in no snapshot, so such a row is stale."""
    return rows.join(snapshot.select(*on), on, "left_semi")


def stale(rows: DataFrame, snapshot: DataFrame, on: list[str]) -> DataFrame:
    """Rows that are new or changed: not in the snapshot by ``on``."""
    return rows.join(snapshot.select(*on), on, "left_anti")


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
    """Whether the columns ``on`` are equal, nulls like each other; the right ones have an underscore before their names."""
    return reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[f"_{c}"]) for c in on])


def latest(rows: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """One row a key, null keys too: the greatest by ``order`` (all other columns unless given). A combining maximum, so a frequent key shrinks before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    by = F.struct(*(order or rest)) if order or rest else F.lit(0)
    row = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), by).alias("_row"))
    return row.select("_row.*")


def upsert(table: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """``table`` with the rows of ``new`` in place of those with equal keys.

    A null key is equal to a null key. Of several new rows of a key the last by
    ``order`` (all other columns unless given) is taken.
    """
    one = latest(new, key, order)
    keys = one.select(*[F.col(c).alias(f"_{c}") for c in key])
    return table.join(keys, _same(table, keys, key), "left_anti").unionByName(one)


def fallback(rows: DataFrame, other: DataFrame, on: list[str], column: str) -> DataFrame:
    """``column`` from ``other`` where it has the key, else the row's own; ``other`` is unique by ``on``."""
    theirs = other.select(*on, F.col(column).alias("_theirs"))
    return rows.join(theirs, on, "left").withColumn(column, F.coalesce("_theirs", column)).drop("_theirs")


def fold_children(parents: DataFrame, children: DataFrame, on: list[str], order: list[str], fields: list[str], name: str) -> DataFrame:
    """``parents`` with their children as an array in ``order``; none gives an empty array. Children without a key belong to parents without one."""
    lists = children.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("_it")))).alias("_list"))
    lists = lists.select(*[F.col(c).alias(f"_{c}") for c in on], F.transform("_list", lambda x: x["_it"]).alias(name))
    kind = lists.schema[name].dataType.simpleString()
    out = parents.join(lists, _same(parents, lists, on), "left").drop(*[f"_{c}" for c in on])
    return out.withColumn(name, F.coalesce(name, F.array().cast(kind)))


def first_match(rows: DataFrame, lookup: DataFrame, on: list[str], order: list[str | Column], columns: dict[str, object]) -> DataFrame:
    """The first row of ``lookup`` in ``order`` (nulls first) for each key, left-joined; ``columns`` gives the names and the defaults of rows without a match.

    A null of the matched row stays null. A combining minimum, so a frequent key
    of ``lookup`` shrinks before the shuffle.
    """
    first = lookup.groupBy(*on).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_first"))
    out = rows.join(first, on, "left")
    return out.withColumns({c: F.when(F.col("_first").isNotNull(), F.col("_first")[c]).otherwise(F.lit(d)) for c, d in columns.items()}).drop("_first")


def name_owner(entities: DataFrame, name: str = "name", kind: str = "kind", priority: str = "priority") -> DataFrame:
    """Each name with the kind of smallest priority that has it."""
    return entities.groupBy(name).agg(F.min_by(kind, priority).alias(kind))


#: Characters of the runs by which names meet texts when there are too many names for an automaton.
RUN = 8


def containment_link(texts: DataFrame, names: DataFrame, key: list[str], text: str, name: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``texts`` with ``linked``: the known name that the text contains, the longest, then the first by alphabet; null without one.

    Up to ``bound`` names make one automaton that every task builds once; each
    text goes through it once, and nothing is shuffled. More names meet texts by
    runs of characters (``_by_runs``). Null texts and names link nothing; null and
    repeated keys are rows like others: ``key`` only names columns that stay.
    """
    known = names.select(F.col(name).cast("string").alias("_name")).where(F.length("_name") > 0).distinct()
    few = known.limit(bound + 1).collect()  # no more than the bound and one
    if len(few) > bound:
        return _by_runs(texts, known, text)
    ranked = sorted((r["_name"] for r in few), key=lambda n: (-len(n), n))
    if not ranked:
        return texts.withColumn("linked", F.lit(None).cast("string"))

    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for rank, one in enumerate(ranked):
            found.add_word(one, rank)
        found.make_automaton()
        for batch in batches:
            best = [min((rank for _, rank in found.iter(t)), default=None) if t else None for t in batch]
            yield pd.Series([None if rank is None else ranked[rank] for rank in best], dtype=object)

    return texts.withColumn("linked", F.pandas_udf(look, "string")(F.col(text).cast("string")))


def _by_runs(texts: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """The same for any number of names: a name is cut into runs, the last one overlapping, and is in a text where all of its runs stand at their distances.

    Only a text's 128-bit number, runs and places are joined and grouped; texts
    get their name back by the number, from a side that has one name a text.
    """
    size, last = F.length("_name"), F.greatest(F.length("_name") - RUN, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(RUN)), F.array(last)))
    pieces = known.select("_name", F.size(starts).alias("_pieces"), F.explode(starts).alias("_off")).withColumn("_run", F.substr("_name", F.col("_off") + 1, F.least(size, F.lit(RUN))))
    lengths = [r[0] for r in known.select(F.least(F.length("_name"), F.lit(RUN))).distinct().collect()]  # RUN rows at most
    number = lambda: F.struct(F.xxhash64(F.col(text)).alias("a"), F.xxhash64(F.lit("second"), F.col(text)).alias("b"))

    def runs(n: int) -> Column:
        places = F.when(F.length(text) >= n, F.sequence(F.lit(0), F.length(text) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.substr(F.col(text), i + 1, F.lit(n)).alias("run")))

    each = texts.where(F.col(text).isNotNull()).select(number().alias("_number"), F.explode(F.concat(*[runs(n) for n in lengths])).alias("_r"))
    met = each.select("_number", F.col("_r.at").alias("_at"), F.col("_r.run").alias("_run")).join(pieces, "_run")
    whole = met.groupBy("_number", "_name", "_pieces", (F.col("_at") - F.col("_off")).alias("_from")).agg(F.count_distinct("_off").alias("_there")).where("_there = _pieces")
    best = whole.groupBy("_number").agg(F.min(F.struct((-F.length("_name")).alias("_len"), "_name")).alias("_best"))
    numbered = texts.withColumn("_number", number())
    return numbered.join(best.select("_number", F.col("_best._name").alias("linked")), "_number", "left").drop("_number")


def fuzzy_match(left: DataFrame, right: DataFrame, a: str, b: str, distance: int = 2) -> DataFrame:
    """Pairs of distinct names at most ``distance`` edits apart, without case, the nearest first by ``distance``.

    Candidates come from an equi-join: each name is cut into ``distance + 1``
    parts, and a name within the distance has one of these parts unchanged,
    shifted by at most ``distance`` places. Names shorter than that are compared
    by length alone. No cross join.
    """
    parts = distance + 1
    low = lambda df, c, n: df.select(F.col(c).alias(n)).where(F.col(c).isNotNull()).distinct().withColumn("_low", F.lower(n))
    x, y = low(left, a, "a"), low(right, b, "b")

    def cut(df: DataFrame, shifts: bool) -> DataFrame:
        size = F.length("_low")
        ids = F.sequence(F.lit(0), F.lit(parts - 1))
        if not shifts:
            start = lambda i, n: F.floor(n * i / parts).cast("int")
            keys = F.transform(ids, lambda i: F.struct(size.alias("size"), i.alias("i"), F.substr(F.col("_low"), start(i, size) + 1, start(i + 1, size) - start(i, size)).alias("part")))
            return df.withColumn("_k", F.explode(keys))
        sizes = F.sequence(F.greatest(size - distance, F.lit(0)), size + distance)
        start = lambda i, n: F.floor(n * i / parts).cast("int")
        moved = F.sequence(F.lit(-distance), F.lit(distance))
        keys = F.flatten(F.flatten(F.transform(sizes, lambda n: F.transform(ids, lambda i: F.transform(moved, lambda s: F.struct(n.alias("size"), i.alias("i"), F.when(start(i, n) + s >= 0, F.substr(F.col("_low"), start(i, n) + s + 1, start(i + 1, n) - start(i, n))).alias("part")))))))
        return df.withColumn("_k", F.explode(F.array_distinct(keys)))

    p, q = cut(x, False).withColumnRenamed("_low", "_x"), cut(y, True).withColumnRenamed("_low", "_y")
    d = F.levenshtein("_x", "_y", distance)
    return p.join(q, p["_k"] == q["_k"]).withColumn("distance", d).where("distance >= 0").select("a", "b", "distance").distinct()


def resolve_names(wanted: DataFrame, known: DataFrame, name: str, by: str) -> DataFrame:
    """How many rows of ``known`` have each wanted name, without case: ``status`` is found, ambiguous or missing."""
    counts = known.select(F.lower(by).alias("_low")).groupBy("_low").agg(F.count(F.lit(1)).alias("matches"))
    out = wanted.withColumn("_low", F.lower(name)).join(counts, "_low", "left").drop("_low").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))
    return out.withColumn("status", F.when(F.col("matches") == 0, "missing").when(F.col("matches") == 1, "found").otherwise("ambiguous"))


def flag_known(rows: DataFrame, known: DataFrame, on: list[str], flag: str = "is_known") -> DataFrame:
    """``rows`` with whether the key is in ``known``."""
    return rows.join(known.select(*on).distinct().withColumn(flag, F.lit(True)), on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def group_index(rows: DataFrame, group: str, per: list[str] | None = None) -> DataFrame:
    """Rows by group, and ``with_heading``: whether the partition ``per`` has more than one group."""
    per = per or []
    counts = rows.groupBy(*per, group).agg(F.count(F.lit(1)).alias("rows_in_group"))
    groups = counts.groupBy(*per).agg(F.count(F.lit(1)).alias("_groups")) if per else counts.agg(F.count(F.lit(1)).alias("_groups"))
    out = counts.join(groups, per) if per else counts.crossJoin(F.broadcast(groups))  # one row
    return out.withColumn("with_heading", F.col("_groups") > 1).drop("_groups")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, in an order, with their numbers from 1: each partition counts its own, and begins where those before it end. The rows are stored once, since ranges drawn twice may differ."""
    placed = stored(rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    out = placed.join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_part", "_before")


def adjacent_dedup(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Rows of each key that differ in ``columns`` from the row before in ``order``."""
    w = W.partitionBy(*key).orderBy(*order)
    same = reduce(lambda x, y: x & y, [F.lag(c).over(w).eqNullSafe(F.col(c)) for c in columns])
    return rows.withColumn("_same", same & (F.row_number().over(w) > 1)).where(~F.col("_same")).drop("_same")


def ordered_distinct(rows: DataFrame, key: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """Distinct values of each key in order of first appearance."""
    lists = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(column).alias("_v")))).alias("_l"))
    return lists.select(*key, F.array_distinct(F.transform("_l", lambda x: x["_v"])).alias(name))


def joined_text(rows: DataFrame, key: list[str], order: list[str], column: str, name: str, separator: str = ", ") -> DataFrame:
    lists = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(column).alias("_v")))).alias("_l"))
    return lists.select(*key, F.array_join(F.transform("_l", lambda x: x["_v"]), separator).alias(name))


def pivot_first(rows: DataFrame, key: list[str], field: str, value: str, position: str, fields: list[str] | None = None, missing: str = "—") -> DataFrame:
    """One column a field, sorted by name unless given, with the first value by ``position``."""
    names = fields if fields is not None else sorted(r[0] for r in rows.select(field).distinct().collect())
    out = rows.groupBy(*key).pivot(field, names).agg(F.min_by(value, position))
    return out.fillna(missing, subset=names)


def rolling_count(rows: DataFrame, key: list[str], at_micros: str, seconds: int, name: str) -> DataFrame:
    """Rows of the key within the half-open window of ``seconds`` that ends with each row."""
    w = W.partitionBy(*key).orderBy(at_micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return rows.withColumn(name, F.count(F.lit(1)).over(w))


def admitted(rows: DataFrame, key: list[str], at_micros: str, limit: int, seconds: int, ties: list[str] | None = None) -> DataFrame:
    """Greedy admission: when each request of a key may start if at most ``limit`` start in any window.

    A request waits until the oldest of the last ``limit`` starts is ``seconds``
    old, and a millisecond more; starts never go back in time. ``started_at`` is
    in microseconds; of requests of one time those first by ``ties`` start first.
    Requests without a time have no start; ``limit`` 0 is no limit.

    A key's requests depend on each other, but no further back than to the last
    one that came when the key was certainly idle. These cut a key into segments,
    which are streamed one by one: what is held is the last ``limit`` starts of
    one segment, and a frequent key is in many tasks. Only a stretch in which a
    key is never idle stays in one.
    """
    if not limit:
        return rows.withColumn("started_at", F.col(at_micros).cast("long"))
    from collections import deque

    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, deque(maxlen=limit)
        for pdf in batches:
            out = []
            for k, segment, t in zip(pdf["_key"], pdf["_segment"], pdf[at_micros], strict=True):
                if (k, segment) != current:
                    current = (k, segment)
                    last.clear()
                if pd.isna(t):
                    out.append(None)
                    continue
                t = int(t)
                now = max(t, last[-1]) if last else t
                if len(last) == limit and now - last[0] < seconds * 1_000_000:
                    now = last[0] + seconds * 1_000_000 + 1000
                last.append(now)
                out.append(now)
            yield pdf.assign(started_at=pd.array(out, dtype="Int64"))[[*names, "started_at"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", started_at long"
    # one text that tells keys apart, nulls too: null numbers would reach the function as values that differ from themselves
    keyed = rows.withColumn("_key", F.to_json(F.array(*[F.col(k).cast("string") for k in key])))
    dealt = _segments(keyed, at_micros, limit, seconds, ties or []).repartition("_key", "_segment")
    return dealt.sortWithinPartitions("_key", "_segment", at_micros, *(ties or [])).mapInPandas(run, schema)


def _segments(keyed: DataFrame, at_micros: str, limit: int, seconds: int, ties: list[str]) -> DataFrame:
    """``keyed`` with ``_segment``: the number, within the key, of the last request at or before that surely found the key idle.

    If every request waited for a window and a millisecond behind the ``limit``-th
    before it, the ``i``-th would start at the greatest ``t_j + step * (i - j)`` of
    all ``j <= i``, with ``step`` the window and the millisecond over ``limit``; no
    start is later. That is ``step * i`` and a running maximum of ``t_j - step * j``.
    A request a window after that bound for the one before it starts at once, and no
    earlier start matters to it or later ones. Requests are cut into spans of time
    with about equal numbers of them; in each span a key numbers its own and takes
    what it had in the spans before.
    """
    window, parts = seconds * 1_000_000 + 1000, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step, order = window / limit, [F.asc_nulls_first(at_micros), *ties]
    cuts = keyed.agg(F.percentile_approx(at_micros, [i / parts for i in range(1, parts)] or [0.5], 100_000)).first()[0] or []
    span = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(at_micros))) if cuts else F.lit(0)
    spans = keyed.withColumn("_part", F.when(F.col(at_micros).isNull(), -1).otherwise(span))
    here = W.partitionBy("_part", "_key").orderBy(*order)
    so_far, t = here.rowsBetween(W.unboundedPreceding, 0), F.col(at_micros).cast("double")
    local = spans.withColumn("_i", F.row_number().over(here)).withColumn("_up", F.max(t - step * F.col("_i")).over(so_far))

    def carried(sums: DataFrame, value: Column, name: str) -> DataFrame:
        """For each range of a key what those before it had: one row a range and key."""
        before = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        return sums.select("_key", "_part", value(before).alias(name))

    sums = local.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n"), F.max("_up").alias("_top"))
    begin = carried(sums, lambda w: F.coalesce(F.sum("_n").over(w), F.lit(0)), "_begin")
    tops = carried(sums.join(begin, ["_key", "_part"]), lambda w: F.max(F.col("_top") - step * F.col("_begin")).over(w), "_above")
    placed = local.join(begin, ["_key", "_part"]).join(tops, ["_key", "_part"])
    number = F.col("_begin") + F.col("_i")
    up = F.greatest("_above", F.col("_up") - step * F.col("_begin"))
    bound = F.coalesce(F.lag(up).over(here), F.col("_above")) + step * (number - 1)
    marked = placed.withColumn("_idle", F.when(bound.isNull() | (t >= bound + window + 1000), number))  # a millisecond for rounding
    ends = carried(marked.groupBy("_key", "_part").agg(F.max("_idle").alias("_last")), lambda w: F.max("_last").over(w), "_open")
    segment = F.coalesce(F.max("_idle").over(so_far), F.col("_open"), F.lit(0))
    return marked.join(ends, ["_key", "_part"]).withColumn("_segment", segment).select(*keyed.columns, "_segment")


def distinct_names(tables: list[tuple[DataFrame, str]], name: str = "name") -> DataFrame:
    """All different names of several tables."""
    return reduce(DataFrame.union, [df.select(F.col(c).alias(name)) for df, c in tables]).distinct()


def tagged_union(parts: dict[str, DataFrame], kind: str = "kind") -> DataFrame:
    """Rows of all parts with their kind; columns that a part lacks are null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [df.withColumn(kind, F.lit(k)) for k, df in parts.items()])


def members(rows: DataFrame, lists: str, item: str, name: str, out: str) -> DataFrame:
    """For every item of an array column the sorted names of the rows that have it."""
    each = rows.select(F.explode(lists).alias(item), F.col(name).alias("_n"))
    return each.groupBy(item).agg(F.array_sort(F.collect_set("_n")).alias(out))


def append_missing(base: Column, extra: Column) -> Column:
    """``base`` and those of ``extra`` that it does not have, in order."""
    return F.concat(base, F.filter(extra, lambda x: ~F.array_contains(base, x)))


def hash_diff(now: DataFrame, before: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Keys with ``change``: new, deleted, modified or same; a null digest is a value like any other, null keys match each other."""
    side = lambda df, n: df.select(*[F.col(k).alias(f"{n}{k}") for k in key], F.col(digest).alias(f"{n}_"), F.lit(True).alias(f"{n}there"))
    a, b = side(now, "a"), side(before, "b")
    on = reduce(lambda x, y: x & y, [F.col(f"a{k}").eqNullSafe(F.col(f"b{k}")) for k in key])
    change = F.when(F.col("bthere").isNull(), "new").when(F.col("athere").isNull(), "deleted").when(F.col("a_").eqNullSafe(F.col("b_")), "same").otherwise("modified")
    return a.join(b, on, "full").select(*[F.coalesce(f"a{k}", f"b{k}").alias(k) for k in key], change.alias("change"))
