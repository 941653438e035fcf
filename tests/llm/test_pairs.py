"""SimHash groups and the benchmark index against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from strataweave.llm import positional_index as pi
from strataweave.llm import simhash_copies as sc
from strataweave.llm import simhash_pivots as sp

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(ids, fps, d=3):
    """Component label by row, by the smallest id."""
    at = list(range(len(fps)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                at[find(i)] = find(j)
    least = {}
    for i, r in enumerate(map(find, range(len(fps)))):
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprints(data):
    for _, t in data:
        if t is None or len(t) < 20_000:
            assert sp.fingerprint(t) == plain_fingerprint(t)
    assert sp.fingerprint("a b c d e f g", 5) == plain_fingerprint("a b c d e f g", 5)


def test_groups(spark, docs, data, empty):
    out = sp.near_duplicates(docs).collect()
    ids, fps = [i for i, _ in data], [sp.fingerprint(t) for _, t in data]
    want = sorted(map(str, zip(ids, (f"{f:016x}" for f in fps), plain_groups(ids, fps), strict=True)))
    assert sorted(str(tuple(r)) for r in out) == want
    assert sp.near_duplicates(empty).count() == 0


def plain_copies(data, shingle=5, least=0.8):
    """Group number by row: texts with Jaccard similarity of at least ``least``."""
    sets = []
    for _, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else {()})
    at = list(range(len(data)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                at[find(i)] = find(j)
    return [find(i) for i in range(len(data))]


@pytest.mark.parametrize("parts", [4, 23])
def test_near_copies(spark, docs, data, empty, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        kept = sc.keep_one(docs)
        assert kept.columns == docs.columns
        got = sorted(str(r.doc_id) for r in kept.collect())
        assert sc.keep_one(empty).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    least = {}
    for (i, _), g in zip(data, plain_copies(data), strict=True):
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    assert got == sorted("None" if none else str(i) for none, i in least.values())


@pytest.mark.parametrize("parts", [3, 40])
def test_a_large_family_and_a_common_passage(spark, parts):
    """Hundreds of near copies stay one group and hundreds of texts with one passage stay apart, however the ranges cut them."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    base, passage = [word() for _ in range(200)], [word() for _ in range(60)]
    family = [" ".join(w if i not in edits else word() for i, w in enumerate(base)) for edits in ({rng.randrange(200) for _ in range(2)} for _ in range(300))]
    others = [" ".join([*(word() for _ in range(120)), *passage, *(word() for _ in range(60))]) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(family + others)), "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.doc_id: r.label for r in sc.groups(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len({got[i] for i in range(300)}) == 1 and len({got[i] for i in range(300, 600)}) == 300
    assert not {got[i] for i in range(300)} & {got[i] for i in range(300, 600)}

def in_groups(spark, texts):
    """The groups of ``texts`` that the operator gives, and those that every pair's shingle sets give."""
    found = defaultdict(set)
    for r in sc.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        found[r.label].add(r.doc_id)
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    number = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(sets), len(number)), dtype=np.float32)
    for i, a in enumerate(sets):
        has[i, [number[x] for x in a]] = 1
    both, size = has @ has.T, has.sum(axis=1)
    for i, j in zip(*np.nonzero(5 * both >= 4 * (size[:, None] + size - both)), strict=True):
        x, y = find(int(i)), find(int(j))
        if x != y:
            up[max(x, y)] = min(x, y)
    plain = defaultdict(set)
    for i in range(len(texts)):
        plain[find(i)].add(i)
    tidy = lambda groups: sorted(sorted(g) for g in groups.values())
    return tidy(found), tidy(plain)


def words_of(rng, n):
    return [f"w{rng.randrange(100_000)}" for _ in range(n)]


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"c{rng.randrange(10**9)}"
    return out


@pytest.mark.parametrize("block_rows", [16, 256])
def test_stars_and_chains_of_copies(spark, monkeypatch, block_rows):
    monkeypatch.setattr(sc, "BLOCK_ROWS", block_rows)
    rng, texts = random.Random(5), []
    for _ in range(2):  # copies near to their original, not to each other
        first = words_of(rng, 200)
        texts += [first, *(changed(rng, first, 3) for _ in range(60))]
    step = words_of(rng, 120)
    for _ in range(40):  # each copy near to the one before
        step = changed(rng, step, 2)
        texts.append(step)
    rng.shuffle(texts)
    found, plain = in_groups(spark, [" ".join(t) for t in texts])
    assert found == plain
    assert max(map(len, plain)) > 55

def test_copies_under_a_common_passage(spark):
    """Many texts with one long passage; each has a copy that differs elsewhere."""
    rng = random.Random(6)
    passage, texts = words_of(rng, 300), []
    for _ in range(80):
        own = words_of(rng, 40)
        texts += [own + passage, changed(rng, own, 2) + changed(rng, passage, 2)]
    found, plain = in_groups(spark, [" ".join(t) for t in texts])
    assert found == plain
    assert 40 < len(plain) < 160


def test_every_copy_under_a_common_passage_is_found(spark):
    """A passage longer than the texts' own words, in over a thousand of them; four hundred have a copy with three words changed."""
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(3000)]
    passage = rng.choices(pool, k=300)
    texts = [rng.choices(pool, k=120) + passage for _ in range(1000)]
    texts += [[w if i not in edits else f"c{rng.randrange(10**6)}" for i, w in enumerate(t)] for t in texts[:400] for edits in [set(rng.sample(range(420), 3))]]
    found, plain = in_groups(spark, [" ".join(t) for t in texts])
    assert found == plain
    assert len(plain) <= 1000


@pytest.mark.parametrize("together", [50, 100_000])
def test_texts_that_can_have_a_copy(spark, monkeypatch, together):
    """The first step keeps every text with a near copy, however many shingles a task puts together, and drops those that only share a passage."""
    monkeypatch.setattr(sc, "TOGETHER", together)
    rng, texts = random.Random(11), []
    passage = words_of(rng, 30)
    for _ in range(60):
        texts.append(words_of(rng, 200) + passage)
    for _ in range(30):
        own = words_of(rng, rng.randrange(3, 200))
        texts += [own, changed(rng, own, len(own) // 100), own]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    described = sc._described(frame, 5, 0.8)
    kept = {r.t1 for r in sc._promising(sc.stored(described, "d")).collect()}
    of = {r.doc_id: r.t1 for r in described.collect()}
    plain = plain_copies([(i, " ".join(t)) for i, t in enumerate(texts)])
    linked = {i for i, g in enumerate(plain) if any(plain[j] == g and texts[j] != texts[i] for j in range(len(texts)))}
    assert linked and {of[i] for i in linked} <= kept
    assert not {of[i] for i in range(60)} & kept


def test_bounds():
    """Of two sets so similar, the first shingles have as many in common as asked."""
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 200)
        a = set(rng.sample(range(10**6), n))
        b = set(rng.sample(sorted(a), n - rng.randrange(n // 5 + 1))) | set(rng.sample(range(10**6, 2 * 10**6), rng.randrange(n // 8 + 1)))
        if 5 * len(a & b) >= 4 * len(a | b):
            first = lambda s: set(sorted(s)[: sc.bounds(len(s), 0.8)[0]])
            assert len(first(a) & first(b)) >= max(sc.bounds(len(a), 0.8)[1], sc.bounds(len(b), 0.8)[1])


def test_columns_of_any_name(spark):
    """Names of the operator's own columns clash with nothing."""
    names = ["_id", "_th", "th", "t1", "t2", "label", "n", "key", "first", "_rest"]
    rows = [(1, "a b c d e f", *"zyxwvutsrq"), (2, "a b c d e f", *"zyxwvutsrq"), (1, "a b c d e f", *"ayxwvutsrq"), (3, "another text", *"zyxwvutsrq")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = sc.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(tuple(r)[:3] for r in kept.collect()) == [(1, "a b c d e f", "a"), (3, "another text", "z")]
    bare = sc.keep_one(frame.select("doc_id", "text")).collect()
    assert sorted(r.doc_id for r in bare) == [1, 3]


@pytest.mark.parametrize("n", [5, 20, 25, 30])
def test_short_copies(spark, n):
    """Short texts that differ in the last word: no section needs to be the same."""
    rng, texts = random.Random(n), []
    for _ in range(100):
        own = words_of(rng, n)
        texts += [own, [*own[:-1], f"z{rng.randrange(10**9)}"]]
    found, plain = in_groups(spark, [" ".join(t) for t in texts])
    assert found == plain
    assert len(plain) == (200 if n == 5 else 100)


@pytest.mark.parametrize(("bucket", "spread"), [(2, 3), (64, 3), (3, 12)])
def test_links_are_all_found(spark, bucket, spread):
    """Dense clusters in tiny buckets go through several levels of refinement."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, spread))) for c in centres for _ in range(40)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)]
    found = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in sp.links(sp.pivot_rows(spark.createDataFrame(signed, "fp long")), 3, bucket).collect()}
    all_ = sorted(fps)
    assert found == {frozenset((a, b)) for i, a in enumerate(all_) for b in all_[:i] if (a ^ b).bit_count() <= 3}


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    assert np.abs(sp.pivot_table(x).astype(int) - sp.pivot_table(y)).max() <= 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 201)], "a long, b long").repartition(5)
    got = {r.node: r.label for r in sp.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 200: 200, 201: 200}


def plain_near(data, items, width=10, rarest=3, slop=5):
    """Number of items with a proximity match by row: every window's rarest terms, every place tried."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(LOW))
    texts, freq = [cut(t) for _, t in data], Counter(w for _, t in data for w in cut(t))
    sets = set()
    for i, t in items:
        w = cut(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            chosen = sorted((freq[w[p]], p) for p in range(k, k + n) if freq[w[p]])[:rarest]
            if len(chosen) == min(rarest, n) and i is not None:
                sets.add((str(i), tuple(sorted((p, w[p]) for _, p in chosen))))
    out = []
    for w in texts:
        places = defaultdict(list)
        for p, x in enumerate(w):
            places[x].append(p)
        near = set()
        for i, terms in sets:
            shifts = [[q - p for q in places[x]] for p, x in terms]
            if all(shifts) and any(all(any(s <= r <= s + slop for r in other) for other in shifts) for some in shifts for s in some):
                near.add(i)
        out.append(len(near))
    return out


def plain_contamination(data, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    sizes = set()
    for i, t in items:
        w = word.findall((t or "").translate(LOW))
        n = min(width, len(w))
        if n:
            sizes.add(n)
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in data:
        w = word.findall((t or "").translate(LOW))
        hit, names = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        names = sorted(str(x) for x in names if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def items_of(data):
    texts = [t for _, t in data if t]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    return [(1, cut(texts[0], 3, 20)), (2, cut(texts[0], 3, 20)), (10, texts[2].upper()), (3, "two words"), (4, None), (5, ""), (None, cut(texts[4], 0, 12)), (6, "no such words here at all, nothing of it is there"), (7, "1 1 1"), (8, cut(texts[5], 0, 9) + " changed " + cut(texts[5], 9, 25))]


def test_contamination(spark, docs, data, empty):
    items = items_of(data)
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(str(tuple(r)) for r in pi.contamination(docs, frame).collect())
    near = plain_near(data, items)
    assert got == sorted(str((*r, n)) for r, n in zip(plain_contamination(data, items), near, strict=True)) and any(near)
    assert pi.contamination(empty, frame).count() == 0
    none = pi.contamination(docs, frame.limit(0)).collect()
    assert len(none) == len(data) and not any(r.contaminated for r in none)
    left = pi.drop_contaminated(docs, frame)
    assert pi.drop_contaminated(empty, frame).count() == 0 and pi.drop_contaminated(docs, frame.limit(0)).count() == len(data)
    assert left.columns == docs.columns
    assert left.count() == sum(not r[-1] for r in plain_contamination(data, items))


@pytest.mark.parametrize("slop", [0, 1, 5])
def test_proximity(spark, slop):
    """Rare terms moved apart by nought to a dozen words, before and after one another, wherever they stand in the text."""
    rng = random.Random(3)
    items = [(7, "alpha beta gamma delta"), (8, "gamma kappa"), (9, "alpha missing words here beta kappa"), (10, "alpha"), (None, "beta gamma delta")]
    rows = []
    for i in range(120):
        w = ["yy"] * rng.randrange(30) + ["alpha"] + ["yy"] * rng.randrange(12) + ["beta"] + ["zz"] * rng.randrange(12) + ["gamma"] + ["zz"] * rng.randrange(8) + ["delta"] * (i % 3)
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), "kappa")
        if i % 7 == 0:
            rng.shuffle(w)
        rows.append((i, " ".join(w)))
    docs, frame = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.n_near for r in pi.contamination(docs, frame, slop=slop).collect()}
    want = dict(zip(range(120), plain_near(rows, items, slop=slop), strict=True))
    assert got == want and len(set(want.values())) > 1
