"""Conversation repair, centroid clustering and HyperMinHash groups against plain Python."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataweave.llm import conversation_repair as cr
from strataweave.llm import exponion_kmeans as ek
from strataweave.llm import hyper_minhash as hm
from strataweave.llm import simhash_copies as sc

STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FULL = {"u": "user", "a": "assistant"}


def plain_repair(rows):
    """Counts, cost, audit and digest of ``(turn, role, text)`` in order, by a search over all edits."""
    seen, faults = set(), []
    for _, r, x in rows:
        end = x.rstrip(" \t\n\x0b\f\r")[-1:]
        faults.append("blank" if not end else "duplicate" if (r, x) in seen else "" if end in ".!?" else "truncated")
        seen.add((r, x))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, q, out = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in (0, 3):
            break
        for c in "ua":
            if c in STEP[q]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, STEP[q][c], (*out, (FULL[c], ""))))
        if i < len(rows):
            _, r, x = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q, out))
            if faults[i] in ("", "truncated"):
                more = cost + 5 * (faults[i] == "truncated")
                if r[:1] in STEP[q]:
                    heapq.heappush(heap, (more, audit + "K", i + 1, STEP[q][r[:1]], (*out, (r, x))))
                for c in "ua":
                    if c in STEP[q]:
                        heapq.heappush(heap, (more + 1, audit + "R", i + 1, STEP[q][c], (*out, (FULL[c], x))))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def in_order(rows):
    told = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(told, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


@pytest.fixture(scope="module")
def talks():
    """Conversations with every fault, nulls, ties and unknown roles; one is long."""
    rng, out = random.Random(5), []
    for c in range(150):
        for _ in range(rng.randint(1, 14)):
            out.append((c or None, rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(["", "  ", "a.", "b", "c!", "d? ", "e.\n", None, *(f"t{rng.randint(0, 20)}." for _ in range(6))])))
    for i in range(500):
        out.append((7000, rng.choice([None, i, i, i]), rng.choice(["user", "assistant", "system"]), rng.choice(["x.", "y", f"t{rng.randint(0, 2000)}."])))
    return out


@pytest.mark.parametrize("held", [{}, {"long_turns": 100}, {"long_bytes": 400}])
def test_repair(spark, talks, held):
    """Whole conversations and those put together from segments."""
    want = defaultdict(list)
    for c, *row in talks:
        want[c].append(row)
    frame = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "'x' as `a.b`", "map('k', 1) as audit").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in cr.repair(frame, **held).collect()}
    assert got == {c: plain_repair(in_order(rows)) for c, rows in want.items()}


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "hi."), (1, 1, "user", "x"), (1, 2, "user", "ok."), (2, 0, "user", "?"), (2, 1, "assistant", "!"), (3, 0, "user", "gone.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "conv_id <> 3 as live")
    each = sorted(tuple(r) for r in cr.repair(frame, each=True).collect())
    assert each == [(1, 0, "R", "user", "hi."), (1, 1, "D", "user", "x"), (1, 2, "R", "assistant", "ok."), (2, 0, "K", "user", "?"), (2, 1, "K", "assistant", "!")]
    whole = {r.conv_id: r for r in cr.repair(frame).collect()}
    assert whole[3].audit == "" and whole[3].repaired_sha256 == hashlib.sha256(b"").hexdigest() and (whole[1].cost, whole[1].audit) == (4, "RDR")
    assert cr.repair(frame.limit(0)).collect() == []


def test_damage(spark):
    rows = [(c, t, "user", "One. Two? Three!") for c in range(20) for t in range(6)]
    got = defaultdict(list)
    for r in cr.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[r.conv_id, r.turn].append((r.role, r.text, r.live))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = (role, {1: "", 2: "One Two Three"}.get(kind, text), kind != 0)
        assert got[c, t] == [want] * (2 if kind == 3 else 1)
    null = cr.damage(spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")).first()
    assert null.turn is None and null.text == " " and zlib.crc32(b" : ") % 20 > 4


def test_layers_hold_every_difference():
    """What the states need never differs by more than the layers hold: the word gives the plain costs."""
    rng = random.Random(2)
    for _ in range(300):
        turns = [(rng.choice("suat"), rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 25))]
        at = cr.layers(turns, [0, None, None, 0])
        cost = {0: 0, 3: 0}
        for i in range(len(turns), -1, -1):
            if i < len(turns):
                initial, fault = turns[i]
                new = {q: c + 2 for q, c in cost.items()}
                if fault not in ("blank", "duplicate"):
                    for q in range(4):
                        for c, to in STEP[q].items():
                            if to in cost:
                                more = cost[to] + 5 * (fault == "truncated")
                                if c == initial:
                                    new[q] = min(new.get(q, 99), more)
                                if c in "ua":
                                    new[q] = min(new.get(q, 99), more + 1)
                cost = new
            for _ in range(3):
                for q in range(4):
                    for c, to in STEP[q].items():
                        if c in "ua" and to in cost:
                            cost[q] = min(cost.get(q, 99), cost[to] + 5)
            assert {q: cr.left(at[i], q) for q in range(4)} == cost


def plain_clusters(ids, v, k=40, rounds=5):
    c = v[sorted(range(len(ids)), key=lambda i: hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest())[:k]].copy()
    near = lambda: ((v[:, None] - c[None]) ** 2).sum(2)
    for _ in range(rounds):
        a = near().argmin(1)
        for j in range(len(c)):
            if (a == j).any():
                c[j] = v[a == j].sum(0) // (a == j).sum()
    d = near()
    return d.argmin(1), d.min(1), c


@pytest.mark.parametrize(("spread", "scale"), [(3, 1), (0.2, 1), (3, 30_000)])
def test_clusters(spark, spread, scale):
    """Few different vectors make ties and empty centroids; large components leave floating-point products behind."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, spread, (400, 64))) * scale
    x[200:260] = x[0]
    rows = [(i, r.tolist(), 1, "x") for i, r in enumerate(x)]
    bad = [(1000, None, 1, "x"), (1001, [1.0] * 63, 1, "x"), (1002, [1.0] * 65, 1, "x"), (1003, [None] * 64, 1, "x"), (1004, [float("nan")] * 64, 1, "x"), (1005, [float("-inf")] * 64, 1, "x"), (1006, [], 1, "x")]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, cluster int, `a.b` string").repartition(3)
    got = sorted(ek.cluster(frame).collect())
    v = np.clip(np.floor(256 * x), -ek.LARGEST, ek.LARGEST).astype(np.int64)
    a, d, c = plain_clusters(list(range(400)), v)
    held = lambda some: min(sum(map(int, some)), (1 << 63) - 1)
    sha = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    assert [tuple(r) for r in got] == [(i, int(a[i]), int(d[i]), held(d[a == a[i]]), held(d), sha[a[i]]) for i in range(400)]


def test_cluster_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert ek.cluster(spark.createDataFrame([], kind)).collect() == []
    few = spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64), (None, [1.0] * 64)], kind)
    got = sorted((r.vec_id or 0, r.distance) for r in ek.cluster(few).collect())
    assert got == [(0, 0), (1, 0), (1, 0)]
    assert [r.distance for r in ek.cluster(spark.createDataFrame([(1, [3e38] * 64)], kind)).collect()] == [0]


def plain_near(texts, k=3, percent=85):
    """``(n, component)`` by place, over all pairs that share a shingle."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    where, up, both = defaultdict(list), list(range(len(sets))), Counter()
    for i, s in enumerate(sets):
        for g in s:
            both.update((j, i) for j in where[g])
            where[g].append(i)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, j), c in both.items():
        if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def test_near_groups(spark, docs, data, empty):
    n, of = plain_near([t for _, t in data])
    least = {}
    for (i, _), c in zip(data, of, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = [(i, k, least.get(c) if k else i) for (i, _), k, c in zip(data, n, of, strict=True)]
    got = hm.near_duplicates(docs).collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(str((*w, w[0] == w[2])) for w in want)
    assert hm.near_duplicates(empty).collect() == []


def test_near_copies_on_the_edge(spark):
    """Copies with ever more words changed, from far above to far below the threshold."""
    rng, texts = random.Random(3), []
    for _ in range(40):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 8, 15, 40, 150]))]
        texts += [" ".join(w if rng.random() > p else f"c{rng.randrange(10**6)}" for w in own) for p in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.1)]
    _, want = plain_near(texts)
    got = {r.doc_id: r.component_id for r in hm.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert 40 < len(set(want)) < 280


@pytest.mark.parametrize(("n", "share"), [(20, 0.85), (300, 0.5), (20_000, 0.85), (20_000, 0.05)])
def test_estimates_are_corrected(n, share):
    """Estimates meet the true similarity; small mantissas, so chance matches matter."""
    rng, found, used = np.random.default_rng(1), [], []
    for _ in range(60):
        both = round(2 * n * share / (1 + share))
        x = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64) * np.uint64(2)
        e, u = hm.estimate(hm.registers(x[:n])[None], hm.registers(x[n - both :])[None], np.array([n]), np.array([n]))
        found.append(e[0])
        used.append(u[0])
    assert abs(np.mean(found) - share) < 0.04 and np.std(found) < 1.5 * np.sqrt(share * (1 - share) / np.mean(used)) + 0.02


def test_chance_matches():
    rng = np.random.default_rng(2)
    equal = [int((hm.registers(x[:5000]) == hm.registers(x[5000:])).sum()) for x in rng.integers(0, 1 << 63, (400, 10_000)).astype(np.uint64) * np.uint64(2)]
    assert abs(np.mean(equal) - hm.expected_matches(np.array([5000]), np.array([5000]))[0]) < 0.02


def test_nothing_is_compared_under_a_common_passage(spark):
    """Texts of one length that share four fifths of their words, but are no near copies, leave no index row under the passage; their copies are found."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(160)]
    texts = [[*(word() for _ in range(40)), *passage] for _ in range(120)]
    texts += [[*t[:20], word(), *t[21:]] for t in texts[:10]]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    described = sc.stored(sc._described(frame, 5, 0.8), "d")
    every = described.select("t1").distinct()
    filed = sc._filed(sc._sets(frame, described, every, 5), 0.8)
    named, mixed = sc._labelled(filed, spark.createDataFrame([], "node long, label long"))
    shared = filed.groupBy("key").count().where("count > 60").join(mixed, "key").count()
    assert shared == 0 and mixed.count() > 0
    pairs = sc._rest(named, mixed, 0.8).count()
    assert 10 <= pairs <= 40
    labels = {r.doc_id: r.label for r in sc.groups(frame).collect()}
    assert len(set(labels.values())) == 120 and all(labels[i] == labels[120 + i] for i in range(10))


def test_keep_one_with_maps_dots_and_repeats(spark):
    rows = [(1, "a b c d e f", {"k": 1}, "z"), (1, "a b c d e f", {"k": 1}, "y"), (2, "a b c d e f", None, "x"), (3, "other", {"k": 2}, "w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, `a.b` string")
    kept = sc.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"], r["a.b"], r["tags"]["k"]) for r in kept.collect()) == [(1, "y", 1), (3, "w", 2)]
