"""Operators that judge each row, against plain Python or the public library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from strataweave.llm import decision_list as dl
from strataweave.llm import hilbert_packing as hp
from strataweave.llm import license_join as lj
from strataweave.llm import token_counts as tc
from strataweave.llm import weak_pii as wp
from strataweave.llm import zstd_toxicity as zt

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def same(got, want):
    assert sorted(str(tuple(r)) for r in got) == sorted(str(tuple(r)) for r in want)


def test_token_counts(docs, data, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in data]
    same(tc.token_counts(docs, PIECES).collect(), want)
    assert tc.token_counts(empty, PIECES).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  ", "a  b", "  a", "a ", "a  ", " \n x", "▁", "▁▁ a▁", "<s> </s><unk>", "日本 語  x", "\x00 a", "a\u3000b   "])
def test_spaces(text):
    known = tc.Counts(PIECES, tc.prove(PIECES))
    assert known.count(text) == len(known.sp.encode(text))


def test_hilbert_is_a_curve():
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = hp.hilbert(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("parts", [1, 7, 300])
def test_ranges_hold_their_share(spark, monkeypatch, parts):
    """Crowded and empty places on the curve: every range is within one and a half shares, with far more ranges than cells at first."""
    monkeypatch.setattr(hp, "CELLS", 50)
    rng = np.random.default_rng(5)
    place = np.r_[rng.integers(0, 1 << 30, 2000), np.full(3000, 77), 5_000_000 + rng.integers(0, 50, 3000)]
    keys, n = (place << 32) | rng.integers(0, 1 << 32, 8000), rng.integers(1, 400, 8000)
    tokens = spark.createDataFrame([(int(k), int(m)) for k, m in zip(keys, n, strict=True)], "key long, n long")
    cuts, first = hp.ranges(tokens, parts, int(n.sum()))
    part = np.searchsorted(cuts, keys, side="right")
    sums = np.bincount(part, weights=n, minlength=len(first))
    assert (np.diff(cuts) > 0).all() and (np.cumsum(sums) - sums == first).all()
    assert sums.max() <= 1.5 * -(-n.sum() // parts) and parts / 2 <= len(first) <= parts
    assert len(hp.ranges(tokens.limit(0), parts, 0)[1]) == 0


@pytest.mark.parametrize("size", [2048, 7])
def test_packing_is_an_exact_round_trip(docs, data, empty, size):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    texts = [x for x in data if size > 7 or x[1] is None or len(x[1]) < 1000]
    frame = docs if size > 7 else docs.where("text is null or length(text) < 1000")
    got = hp.pack(frame, BPE, size=size, with_ids=True).collect()
    pieces = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.sequence_id, r.offset] = r
    rows, at, current = [], 0, []
    for (seq, off), r in sorted(pieces.items()):
        assert (seq, off) == divmod(at, size)
        at += r.length
        current += np.frombuffer(r.ids, dtype="<u4").tolist()
        if r.start + r.length == r.doc_tokens:
            rows.append((r.doc_id, current))
            current = []
    assert len(pieces) == len(got) and not current
    same(rows, [(i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x in texts])
    assert hp.pack(empty, BPE).count() == 0


def test_encoder_agrees_with_the_library(data):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(BPE), hp.Encoder(BPE)
    for x in [x or "" for _, x in data] + ["a\x85b\xa0c\x1cd", "ª²½ ǅ don't I'LL", "<|endoftext|>", "x" * 3000]:
        assert e(x) == t.encode(x, add_special_tokens=False).ids


def statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_statistics(docs, data, empty):
    got = dl.text_statistics(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    same(got.collect(), [(i, *statistics(t)) for i, t in data])
    assert dl.text_statistics(empty).count() == 0


def test_decision_list_is_learned_and_applied(spark, docs, data):
    labels = spark.createDataFrame([(i, int("#" not in (t or ""))) for i, t in data if i is not None], "doc_id long, quality int")
    many = docs.unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "concat(text, if(doc_id % 3 = 0, ' # $ % & #', '')) as text", *docs.columns[2:]))
    labels = labels.union(many.where("doc_id >= 1000").selectExpr("doc_id", "if(instr(text, '#') > 0, 0, 1)"))
    rules = dl.fit(many, labels.dropDuplicates(["doc_id"]), least=3)
    assert rules and all(c[0] in dl.features() for r in rules for c in r.conditions)
    out = dl.judge(many, rules).collect()
    assert len(out) == many.count()
    kept = {r.doc_id for r in out if r.kept}
    assert not any(i in kept for i, t in data if i is not None and statistics(t)[0] < 20)
    assert dl.keep_good(many, rules).columns == many.columns
    assert dl.fit(docs, labels.limit(0)) == []


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4)
    rules = dl.learn(x, bad, np.arange(3000) % 3 > 0)
    caught = np.zeros(3000, dtype=bool)
    for r in rules:
        caught |= dl._hold(x, r.conditions, 3000)
    assert (caught & bad).sum() > 0.9 * bad.sum() and (caught & ~bad).sum() < 0.05 * bad.sum()


def plain_rules(x, bad, grow, precision=0.9, least=8, longest=3):
    """Sequential covering in plain loops, every cut of every feature counted anew."""
    n, left, rules = len(bad), set(range(len(bad))), []
    cuts = {k: [(a + b) / 2 for a, b in zip(u, u[1:], strict=False)] for k, v in x.items() for u in [sorted(set(np.quantile(v, np.linspace(0, 1, 65)).tolist()))]}
    fits = lambda i, c: x[c[0]][i] <= c[2] if c[1] == "<=" else x[c[0]][i] > c[2]
    count = lambda rows: (sum(bool(bad[i]) for i in rows), sum(not bad[i] for i in rows))
    while True:
        inside, rule = [i for i in left if grow[i]], []
        while len(rule) < longest and count(inside)[0] >= least and count(inside)[1]:
            p0, n0 = count(inside)
            best = (0.0, None)
            for name, at_all in cuts.items():
                for at in at_all:
                    for op in ("<=", ">"):
                        p, q = count([i for i in inside if fits(i, (name, op, at))])
                        if p >= least and p + q < p0 + n0:
                            gain = p * (np.log2(p / (p + q)) - np.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-12:
                                best = (gain, (name, op, at))
            if best[1] is None:
                break
            rule.append(best[1])
            inside = [i for i in inside if fits(i, best[1])]
        if not rule:
            return rules
        test = [i for i in left if not grow[i]]
        caught = lambda c: count([i for i in test if all(fits(i, y) for y in c)])
        worth = lambda c: (caught(c)[0] - caught(c)[1]) / max(1, sum(caught(c)))
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        p, q = caught(rule)
        if p < max(2, least // 4) or p < precision * (p + q):
            return rules
        rules.append(tuple(rule))
        left -= {i for i in left if all(fits(i, y) for y in rule)}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_the_rules_are_those_of_plain_covering(seed):
    rng = np.random.default_rng(seed)
    x = {"a": rng.random(300).round(2), "b": rng.random(300).round(1), "c": rng.integers(0, 4, 300).astype(float)}
    bad = ((x["a"] > 0.7) & (x["b"] <= 0.5)) | ((x["c"] > 2) & (x["a"] <= 0.2)) ^ (rng.random(300) < 0.02)
    grow = np.arange(300) % 3 > 0
    got = dl.learn(x, bad, grow)
    assert got and [r.conditions for r in got] == plain_rules(x, bad, grow)[: len(got)] and len(got) == len(plain_rules(x, bad, grow))


def test_statistics_of_columns_with_their_names(spark):
    rows = [(1, "a b c " * 20, 9, "x", True, "y"), (1, "a b c " * 20, 9, "x", True, "y"), (None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words int, lines string, kept boolean, `odd.name` string")
    out = dl.judge(frame, [])
    assert out.columns == ["doc_id", "lines", "odd.name", *dl.STATISTICS, "base_failed", "kept"]
    assert sorted(str((r.doc_id, r.lines, r["odd.name"], r.n_words, r.kept)) for r in out.collect()) == ["(1, 'x', 'y', 60, False)", "(1, 'x', 'y', 60, False)", "(None, None, None, 0, False)"]
    good = dl.keep_good(frame.withColumn("text", dl.F.lit(" ".join(f"w{i}" for i in range(30)))), [])
    assert good.columns == frame.columns and good.count() == 3
    assert dl.fit(frame, spark.createDataFrame([], "doc_id long, quality int")) == []


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and wp.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


PRIVATE = [
    "mail jo.x@mail.example.com or a@b@c.d, é.x+y%z@a-b.co.uk. @x.y a@b a@b.c_d@e.f x@@y.z", "at 10.0.0.256 and 1.2.3.4.5.6.7.8 1.2.3 001.2.3.4 0000001.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 5500000000000004",
    "call +1 (052) 555-0934 or +49 30 1234567890123456 +1 + 2", "", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" x", "9" * 300 + "." + "1" * 300, "a" * 4000 + "@" + "b." * 500,
]


def test_base_spans():
    for t in PRIVATE:
        assert [(a, k, b) for a, b, k in wp.base_spans(t)] == plain_spans(t)


def plain_candidates(t):
    """All candidates, every looser one compared with every base span."""
    base = [(a, b, k) for a, k, b in plain_spans(t)]
    more = [(m.start(), m.end(), 2) for m in re.finditer("[0-9]+", t) if 12 <= len(m[0]) <= 19]
    more += [(m.start(), m.end(), 3) for m in re.finditer(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", t)]
    more += [(m.start(), m.end(), 4) for m in re.finditer("[0-9A-Za-z_-]+", t) if len(m[0]) >= 24 and re.search("[0-9]", m[0])]
    return [(*x, True) for x in base] + [(*x, False) for x in sorted(more) if all(x[1] <= a or b <= x[0] for a, b, _ in base)]


def plain_score(model, t, a, b, k):
    """The classifier's probability, its features laid out one by one."""
    base = (a, k, b) in plain_spans(t)
    w = model.weights.reshape(len(wp.KINDS), -1)[k]
    total, at = w[0], 1
    for v in wp.votes(t, a, b, k, base):
        total, at = total + w[at + v], at + 3
    span = t[a:b]
    n = Counter(span.lower())
    bits = -sum(c / len(span) * np.log2(c / len(span)) for c in n.values())
    share = sum(c in "0123456789" for c in span) / len(span)
    front = 0 if not a or t[a - 1].isspace() else 1 if t[a - 1] in "=:\"'(<[,;" else 2
    classes = [sum(len(span) >= x for x in wp.LENGTHS), sum(bits >= x for x in wp.ENTROPIES), sum(share > x for x in wp.SHARES), int(any(c != c.lower() for c in span) and any(c != c.upper() for c in span)), front]
    for size, x in zip(wp.SHAPE, classes, strict=True):
        total, at = total + w[at + x], at + size
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def test_all_candidates(data):
    rng = np.random.default_rng(4)
    bits = ["a@b.co ", "1.2.3.4", " ", "123-456-7890", "4111111111111111", "+1 052 555 0934", "_", "x9" * 14, "-", "sk-" + "A1" * 90, ".", "9" * 25, "@", "é", "card 5500000000000004"]
    texts = ["".join(rng.choice(bits, n)) for n in [5, 20, 200] * 30] + PRIVATE + [t for _, t in data if t and len(t) < 20_000]
    long = "k" * 500 + "7" + "Q" * 500
    for t in [*texts, f"secret {long}", "z " * 50_000 + long]:
        assert sorted(wp.candidates(t)) == sorted(plain_candidates(t))
    assert [c for c in wp.candidates(f"secret {long}") if c[2] == 4] == [(7, 1008, 4, False)]


def test_span_classifier_sees_the_span(spark):
    """Of spans with equal votes, those described like the ones that the labelers agree on score higher."""
    counts = {(4, wp._code((2, 1, 1, 1, 1)), 100): 500, (4, wp._code((2, 0, 2, 0, 0)), 300): 500, (4, wp._code((2, 1, 2, 2, 1)), 100): 50, (4, wp._code((2, 1, 2, 2, 1)), 300): 50}
    model = wp.train(counts)
    assert model.score(4, wp._code((2, 1, 2, 2, 1)), 100) > model.score(4, wp._code((2, 1, 2, 2, 1)), 300)


@pytest.mark.parametrize("others", [0, 60])
def test_candidates_within_a_long_span(others):
    """A number inside an e-mail that also holds many addresses is no candidate, however many spans the text has."""
    text = "a@b.co " * others + "1.2.3.4_" * 6 + "123-456-7890@a.com or 123-456-7890"
    more = [(a, b) for a, b, _, base in wp.candidates(text) if not base]
    assert more == [(len(text) - 12, len(text))]


def test_private_data(spark, docs, data, empty):
    rows = [(i, t) for i, t in enumerate(PRIVATE * 5)] + [(900, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = wp.candidate_rows(frame)
    model = wp.fit(found)
    out = {r.doc_id: r for r in wp.scan(found, model).collect()}
    for i, t in rows:
        base = plain_spans(t or "")
        text = ",".join(f"{wp.KINDS[k]}:{a}:{b}" for a, k, b in base)
        r = out[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in base) for x in range(4))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        spans = sorted((a, k, b) for a, b, k, base in plain_candidates(t or "") if base or plain_score(model, t, a, b, k) >= 0.5)
        assert r.spans == ",".join(f"{wp.KINDS[k]}:{a}:{b}" for a, k, b in spans) and r.n_spans == len(spans)
    assert "card:44:60" in out[2].spans.split(",")  # a good number beside others, which the base pattern runs together
    assert "secret:9:49" in out[5].spans
    masked = wp.mask(docs, wp.fit(wp.candidate_rows(docs)))
    assert masked.columns == docs.columns and masked.count() == len(data)
    assert wp.redact("a b@c.de f", [(2, 8, 0)]) == "a [EMAIL] f"
    none = wp.candidate_rows(empty)
    assert wp.scan(none, model).count() == 0 and wp.fit(none).score(0, 0, 0) == 0.5
    assert wp.candidate_rows(docs).count() == len(data) and wp.mask(empty, model).count() == 0


def test_reliabilities_are_recovered():
    """Votes drawn from known labelers: the estimate finds who is right how often."""
    rng = np.random.default_rng(1)
    right = [0.95, 0.9, 0.8, 0.7, 0.6]
    counts = Counter()
    for truth in rng.random(20_000) < 0.3:
        counts[0, wp._code(tuple(int(truth == (rng.random() < r)) for r in right))] += 1
    _, table = wp.estimate(dict(counts))
    assert np.allclose(table[0, :, 1, 1], right, atol=0.08)


def test_licenses(docs, data, spark, empty):
    extra = [
        "Released under the MIT License. Apache License, Version 2.0!", "CC BY-NC 4.0 under the mit licens", "under the under the mit license mit license under the MIT license",
        "This work is licensed under the GNU General Public License, version 3.", "Redistribution and use in source and binary forms, with or without any modification, are permitted provided", None, "", "x " * 500 + "permission is granted free of charge to any person obtaining a copy of this software and documentation files",
    ]
    whole = [" ".join(lj.words(t)) for t, _ in lj.TEMPLATES]
    for at in (0, 1, 13, 31, 32, 33, 50):  # a wording with other words in between, wherever it begins
        w = whole[1].split()
        extra.append("x " * at + " ".join(x if k % 3 else f"{x} zz" for k, x in enumerate(w)))
        extra.append("x " * at + " ".join(x if k % 3 else f"{x} zz zz" for k, x in enumerate(w)))
    for t in whole[7:]:  # full texts, with every sixth or third word changed
        w = t.split()
        extra += ["y " * 77 + " ".join(x if k % n else "changed" for k, x in enumerate(w)) + " y" * 300 for n in (6, 3)]
    rows = [(i, t) for i, t in data if i != 309] + [(2000 + i, t) for i, t in enumerate(extra)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = lj.templates(list(lj.TEMPLATES), 0.8)
    want = []
    for i, t in rows:
        w = word.findall((t or "").translate(LOW))
        places, base, more, score = [], set(), set(), 0.0
        for p, label in lj.PHRASES:
            p = p.split()
            for k in range(len(w)):
                if w[k : k + len(p)] == p:
                    places.append(k)
                    base.add(label)
        for item in items:
            need = set(item.words)
            if not need & set(w):
                continue
            for k in range(max(1, len(w))):
                n = len(need & set(w[k : k + -(-3 * len(item.words) // 2)]))
                if n >= 0.8 * len(need) - 1e-9:
                    more.add(item.label)
                    score = max(score, n / len(need))
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if places else score))
    same(lj.scan(frame, list(lj.PHRASES), list(lj.TEMPLATES)).collect(), want)
    found = {label for r in want for label in r[6].split(",")}
    assert found == {"", *(label for _, label in lj.TEMPLATES)}
    assert lj.scan(empty, list(lj.PHRASES), list(lj.TEMPLATES)).count() == 0
    assert {r.labels for r in lj.scan(frame, [], []).collect()} == {""}


def test_licenses_in_chunks(spark, docs, monkeypatch):
    whole = lj.scan(docs, list(lj.PHRASES), list(lj.TEMPLATES)).collect()
    monkeypatch.setattr(lj, "CHUNK_WORDS", 30)
    same(lj.scan(docs, list(lj.PHRASES), list(lj.TEMPLATES)).collect(), whole)


def test_toxicity_on_held_out_rows(spark, docs, data, empty):
    import random

    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    slurs = ["zorkface", "blurgh", "vexling", "quommet"]
    rows, labels = [], []
    for i in range(1500):
        w, toxic = rng.choices(vocabulary, k=rng.randint(30, 90)), int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(slurs))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = zt.fit(frame, marks)
    out = zt.score(frame, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [(r.score, labels[r.doc_id][1]) for r in out if r.held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held if x for b, y in held if not y]
    assert sum(pairs) / len(pairs) > 0.95
    got = zt.score(docs, model).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    assert zt.score(empty, model).count() == 0
    assert {r.score for r in zt.score(docs, zt.fit(docs, marks.limit(0))).collect()} == {0.5}
    twice = zt.fit(frame.union(frame), marks.union(marks))
    assert (twice.weights == model.weights).all() and twice.toxic == model.toxic and twice.ordinary == model.ordinary
    plain = plain_toxicity(model)
    assert {r.doc_id: r.score for r in out} == pytest.approx({i: plain(t) for i, t in rows}, abs=1e-9)
    assert sorted(r.score for r in got) == pytest.approx(sorted(plain(t) for _, t in data), abs=1e-9)


def plain_toxicity(model):
    """The score from lengths that two fresh compressors give, window by window."""
    import zstandard

    def length(content, window):
        whole = zstandard.ZstdCompressionDict(content + zt.TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        whole.precompute_compress(level=model.level)
        return len(zstandard.ZstdCompressor(dict_data=whole, level=model.level, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window + zt.TAIL))

    known = {}

    def score(text):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW).encode())
        saved = []
        for i in range(0, len(w), model.window):
            x = b" " + b" ".join(w[i : i + model.window]) + b" "
            if x not in known:
                known[x] = length(model.ordinary, x) - length(model.toxic, x)
            saved.append(known[x])
        saved = saved or [0]
        best = sorted(saved, reverse=True)[:3]
        best += [min(0, best[-1])] * (3 - len(best))
        strong, more, n = sum(x >= 2 for x in saved), sum(x >= 4 for x in saved), len(saved)
        x = [1, *best, np.log1p(strong), np.log1p(more), np.log1p(n), sum(saved) / n, 10 * strong / n, 10 * more / n]
        return 1 / (1 + np.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))

    return score


def test_whole_texts_train_and_ids_do_not_matter(spark):
    """Characters are bounded by fewer rows, never by parts of texts; other ids give the same model."""
    rng = random.Random(3)
    rows = [(5 * i + 1, " ".join(rng.choices(["mild", "plain", "quiet", "green", "stone", "river"], k=40)) + (" vile beast vile beast" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(200)]
    rows.append((4, "vile " * 5000, 1))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    used = []
    original = zt.train
    try:
        zt.train = lambda rows, **o: used.append(rows) or original(rows, **o)
        zt.fit(frame, frame, max_chars=20_000)
        zt.fit(frame, frame)
    finally:
        zt.train = original
    texts = {t for _, t, _ in rows}
    assert {t for t, _ in used[0]} < texts and sum(len(t) for t, _ in used[0]) < 30_000 and "vile " * 5000 not in {t for t, _ in used[0]}
    assert all(t in texts for t, _ in used[1])
    renamed = zt.train([(t, y) for t, y in reversed(used[1])])
    again = zt.train(used[1])
    assert (renamed.weights == again.weights).all() and renamed.toxic == again.toxic
