"""Relational operators on nulls, repeats, ties and hot keys."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from strataweave.operators import relational as rel


@pytest.mark.parametrize("bound", [1000, 3])
def test_names_in_texts(spark, bound):
    """By an automaton and by runs: the longest name, then the first; nulls and repeats are rows like others."""
    rng = random.Random(1)
    names = ["a", "ab", "abcabcabc", "bcabcabca", "cabcabcabcab", "日本", "x" * 20, "xxxxxxxxy", "", None, "ab"]
    texts = [(rng.choice([None, 1, 2]), "".join(rng.choices("abcx", k=rng.randint(0, 40)))) for _ in range(60)]
    texts += [(1, None), (None, None), (1, "in 日本 a"), (1, "in 日本 a"), (2, "x" * 25), (3, "zz")]
    frame = spark.createDataFrame(texts, "k long, t string").repartition(3)
    known = spark.createDataFrame([(n,) for n in names], "name string")
    got = rel.containment_link(frame, known, ["k"], "t", "name", bound)
    best = lambda t: min(((-len(n), n) for n in names if n and t and n in t), default=(0, None))[1]
    assert sorted(map(str, [tuple(r) for r in got.collect()])) == sorted(str((k, t, best(t))) for k, t in texts)
    assert {r.linked for r in rel.containment_link(frame, known.limit(0), ["k"], "t", "name").collect()} == {None}


def test_no_shuffle_for_few_names(spark):
    frame = spark.createDataFrame([(1, "abc")], "k long, t string")
    plan = rel.containment_link(frame, spark.createDataFrame([("b",)], "n string"), ["k"], "t", "n")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_the_later_of_new_rows_replaces(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(1, "c"), (1, "d"), (None, "m"), (3, "e"), (3, "e")], "k long, v string")
    assert sorted(map(str, rel.upsert(table, new, ["k"]).collect())) == sorted(map(str, spark.createDataFrame([(1, "d"), (2, "b"), (3, "e"), (None, "m")], table.schema).collect()))
    stamped = new.withColumn("at", F.when(F.col("v") == "c", 9).otherwise(1))
    assert {(r.k, r.v) for r in rel.upsert(table.withColumn("at", F.lit(0)), stamped, ["k"], ["at"]).collect()} == {(1, "c"), (2, "b"), (3, "e"), (None, "m")}


def test_null_keys_and_null_matches(spark):
    parents = spark.createDataFrame([(1,), (None,), (2,)], "k long")
    children = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z")], "k long, c string")
    assert {(r.k, tuple(i.c for i in r.all)) for r in rel.fold_children(parents, children, ["k"], ["c"], ["c"], "all").collect()} == {(1, ("x",)), (None, ("y", "z")), (2, ())}
    lookup = spark.createDataFrame([(1, 5, None), (1, 6, 7)], "k long, at long, v long")
    assert {(r.k, r.v) for r in rel.first_match(parents.where("k is not null"), lookup, ["k"], ["at"], {"v": -1}).collect()} == {(1, None), (2, -1)}


def plain_admission(times, limit, window):
    out, last = [], deque(maxlen=limit)
    for t in times:
        now = max(t, last[-1]) if last else t
        if len(last) == limit and now - last[0] < window:
            now = last[0] + window + 1000
        last.append(now)
        out.append(now)
    return out


@pytest.mark.parametrize(("limit", "gap"), [(5, 14), (5, 11), (1, 70), (3, 5), (7, 400)])
def test_admission_in_many_tasks(spark, limit, gap):
    """One hot key, busy and idle by turns, with ties, times within the millisecond of slack, and small keys beside it."""
    rng, rows, t = random.Random(limit), [], 10**15
    for i in range(1500):
        t += rng.choice([0, 1, int(rng.expovariate(1 / gap) * 10**6), 60_000_000 // limit, 60_000_500 // limit])
        if i % 300 == 0:
            t += 600_000_000
        rows.append((i, None if i % 11 == 0 else "hot", t))
    rows += [(5000, "few", None), (5001, "few", 10**15), (5002, "one", 10**15)]
    frame = spark.createDataFrame(rows, "id long, k string, at long").repartition(5)
    got = {r.id: r.started_at for r in rel.admitted(frame, ["k"], "at", limit, 60, ["id"]).collect()}
    want = {}
    for key in {k for _, k, _ in rows}:
        mine = sorted((t, i) for i, k, t in rows if k == key and t is not None)
        want |= dict(zip((i for _, i in mine), plain_admission([t for t, _ in mine], limit, 60_000_000), strict=True))
    assert got == {i: want.get(i) for i, _, _ in rows}


def test_a_hot_key_is_cut(spark):
    rows = [(i, "hot", 10**15 + i * 90_000_000) for i in range(400)]
    keyed = spark.createDataFrame(rows, "id long, _key string, at long")
    found = rel._segments(keyed, "at", 5, 60, ["id"]).select("_segment").distinct().count()
    assert found > 300
    assert {r.started_at - r.at for r in rel.admitted(spark.createDataFrame(rows, "id long, k string, at long"), ["k"], "at", 0, 60).collect()} == {0}


def test_numbers_without_one_task(spark):
    rows = spark.range(1000).select((F.lit(999) - F.col("id")).alias("v")).repartition(7).orderBy("v")
    assert [(r.v, r.n) for r in rel.numbered(rows, "n").orderBy("n").collect()] == [(i, i + 1) for i in range(1000)]
