"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, and a span classifier is trained on the result.

Candidates are the spans of the four base patterns and of looser ones. Five
labelers vote yes (1), no (0) or abstain (2) on each: the strict pattern, a
checksum or range test, a gazetteer, the words in front, and the span's edges.
Candidates, their votes and a coarse description of the span (length, entropy,
share of digits, case, what stands in front) are found in one pass and stored,
without texts. What the driver gathers of them is counted by kind, votes and
description, so it is bounded by their combinations and covers the whole corpus.
Expectation-maximisation over the votes estimates each labeler's reliability per
kind without any labels; a logistic span classifier is trained on the posteriors
and scores spans from their votes and their description.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, pieces

KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("pattern", "check", "gazetteer", "context", "shape")
YES, NO, NONE = 1, 0, 2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits does, so the look-behind changes nothing but the time on long runs
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GROUP = re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_RUN = re.compile(r"[0-9A-Za-z_-]{24,}")
_DIGIT, _CUE = re.compile(r"[0-9]"), re.compile(r"[a-z]+")

#: Common ends of host names, leading digits of card issuers, and words that stand before personal data.
ENDS = frozenset("com org net edu gov mil int info io co uk de fr es it nl eu us ca au ch at be br jp cn in ru pl se no dk fi pt".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65", "22", "23", "24", "25", "26", "27", "35", "36", "38")
CUES = {
    "email": frozenset("email mail mailto contact write address correo".split()),
    "ip": frozenset("ip host server address client login".split()),
    "card": frozenset("card visa mastercard amex credit debit payment pay karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell telefon".split()),
    "secret": frozenset("token key secret password passwd pwd api bearer auth credential".split()),
}
AGAINST = {"card": frozenset("isbn order invoice serial".split()), "ip": frozenset("version release section chapter".split()), "secret": frozenset("commit sha checksum digest".split()), "email": frozenset(), "phone": frozenset("isbn".split())}


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping, in time linear in the text: from each @ outwards."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind number)`` of the base patterns that pass their checks, in order of start and kind."""
    out = [(a, b, 0) for a, b in _emails(text)]
    out += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    if "+" in text:
        out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """All spans to vote on, with whether a base pattern found them."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    starts = sorted(a for a, _, _ in base)
    ends = list(accumulate((b for _, b, _ in sorted(base)), max))  # the furthest end so far

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return not i or ends[i - 1] <= a

    more: list[tuple[int, int, int]] = []
    more += [(*m.span(), 2) for m in _GROUP.finditer(text)]
    more += [(*m.span(), 3) for m in _LOCAL_PHONE.finditer(text)]
    more += [(*m.span(), 4) for m in _RUN.finditer(text) if _DIGIT.search(text, *m.span())]
    for a, b, k in sorted(more):
        if free(a, b):
            out.append((a, b, k, False))
    return out


def entropy(span: str) -> float:
    """Bits per character by the span's own letters, without case."""
    n = len(span)
    return -sum(c / n * math.log2(c / n) for c in Counter(span.lower()).values())


def votes(text: str, a: int, b: int, kind: int, base: bool) -> tuple[int, ...]:
    """The labelers' votes, in the order of ``LABELERS``."""
    span, name = text[a:b], KINDS[kind]
    digits = "".join(c for c in span if "0" <= c <= "9")
    if name == "email":
        check = YES if len(span) <= 254 and ".." not in span and span[0] != "." else NO
        gazetteer = YES if span.rsplit(".", 1)[-1].lower() in ENDS else NO
    elif name == "ip":
        check = YES if all(p == "0" or p[0] != "0" for p in span.split(".")) else NO
        gazetteer = NO if digits[:1] == "0" or span.startswith(("255.", "0.")) else NONE
    elif name == "card":
        check = YES if luhn(digits) else NO
        gazetteer = YES if digits.startswith(ISSUERS) else NO
    elif name == "phone":
        check = YES if 9 <= len(digits) <= 15 else NO
        gazetteer = YES if span[0] == "+" and digits[0] != "0" else NONE
    else:
        letters = span.lower()
        check = YES if entropy(span) > 3 else NO
        gazetteer = YES if span.startswith(("sk-", "AKIA", "ghp_", "xox")) or len(span) in (32, 40, 64) and not set(letters) - set("0123456789abcdef") else NONE
    before = _CUE.findall(text[max(0, a - 32) : a].lower())[-3:]
    context = YES if CUES[name].intersection(before) else NO if AGAINST[name].intersection(before) else NONE
    edge = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    pattern = YES if base else NO if name == "card" and check == NO else NONE
    return (pattern, check, gazetteer, context, YES if edge else NO)


#: Upper bounds of the classes of length, entropy and share of digits; classes of what stands in front: nothing or a blank, a mark, anything else.
LENGTHS, ENTROPIES, SHARES = (8, 12, 16, 20, 28, 36, 48), (2.0, 3.0, 3.5), (0.0, 1 / 3, 2 / 3)
SHAPE = (len(LENGTHS) + 1, len(ENTROPIES) + 1, len(SHARES) + 1, 2, 3)


def shape(text: str, a: int, b: int) -> int:
    """The span's description: classes of length, entropy and digit share, whether it has both cases, and what stands in front, as one number below the product of ``SHAPE``."""
    span, out = text[a:b], 0
    front = 0 if a == 0 or text[a - 1].isspace() else 1 if text[a - 1] in "=:\"'(<[,;" else 2
    digits = sum("0" <= c <= "9" for c in span) / len(span)
    classes = (bisect_right(LENGTHS, len(span)), bisect_right(ENTROPIES, entropy(span)), bisect_left(SHARES, digits), int(span != span.lower() and span != span.upper()), front)
    for n, x in zip(SHAPE, classes, strict=True):
        out = out * n + x
    return out


def described(text: str | None) -> list[tuple[int, int, int, bool, int, int]]:
    """``(start, end, kind, base, votes, shape)`` of all candidates; null has none."""
    text = text or ""
    return [(a, b, k, base, _code(votes(text, a, b, k, base)), shape(text, a, b)) for a, b, k, base in candidates(text)]


WIDTH = 6


def candidate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, found)`` per row of ``docs``; ``found`` has ``WIDTH`` numbers a candidate. Null texts have none; rows keep their number; further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [[int(x) for c in described(t.as_py()) for x in c] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, found array<int>")


def vote_counts(found: DataFrame) -> DataFrame:
    """``(kind, code, shape, n)`` over the whole corpus, from ``candidate_rows``; ``code`` has the votes as base-3 digits. An empty table has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, int, int]] = Counter()
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            seen.update(map(tuple, flat[:, [2, 4, 5]].tolist()))
        cols = list(zip(*seen, strict=True)) if seen else [()] * 3
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols), pa.array(list(seen.values()), pa.int64())], names=["kind", "code", "shape", "n"])

    counts = found.select("found").mapInArrow(run, "kind int, code int, shape int, n long")
    return counts.groupBy("kind", "code", "shape").agg(F.sum("n").alias("n"))


def _code(v: tuple[int, ...]) -> int:
    out = 0
    for x in v:
        out = out * 3 + x
    return out


def _votes_of(code: int) -> tuple[int, ...]:
    out = []
    for _ in LABELERS:
        code, x = divmod(code, 3)
        out.append(x)
    return tuple(reversed(out))


def estimate(counts: dict[tuple[int, int], int], rounds: int = 50) -> tuple[dict[tuple[int, int], float], np.ndarray]:
    """Posteriors by (kind, code), and reliabilities [kind, labeler, truth, vote], by expectation-maximisation.

    Labelers start as right four times in five and share a prior of that weight,
    which also settles which of the two classes is which.
    """
    prior_weight, right = 10.0, 0.8
    start = np.array([[right, 1 - right, 1.0], [1 - right, right, 1.0]])  # [truth][vote no, yes, abstain]
    start /= start.sum(axis=1, keepdims=True)
    table = np.tile(start, (len(KINDS), len(LABELERS), 1, 1))
    share, post = np.full(len(KINDS), 0.5), {}
    for _ in range(rounds):
        logs = np.log(table)
        for kind, code in counts:
            score = [math.log(1 - share[kind]), math.log(share[kind])]
            for i, v in enumerate(_votes_of(code)):
                score = [score[t] + logs[kind, i, t, v] for t in (0, 1)]
            post[kind, code] = 1 / (1 + math.exp(min(700, score[0] - score[1])))
        table = np.tile(start * prior_weight, (len(KINDS), len(LABELERS), 1, 1))
        mass = np.full((len(KINDS), 2), prior_weight / 2)
        for (kind, code), n in counts.items():
            p = post[kind, code]
            mass[kind] += (n * (1 - p), n * p)
            for i, v in enumerate(_votes_of(code)):
                table[kind, i, 0, v] += n * (1 - p)
                table[kind, i, 1, v] += n * p
        table /= table.sum(axis=3, keepdims=True)
        share = np.clip(mass[:, 1] / mass.sum(axis=1), 1e-6, 1 - 1e-6)
    return post, table


#: Weights of a kind: one of its own, one for each vote of each labeler, one for each class of the description.
_OF_KIND = 1 + 3 * len(LABELERS) + sum(SHAPE)


def _features(kind: int, code: int, form: int) -> list[int]:
    """Numbers of the weights that count for a span."""
    at = kind * _OF_KIND
    out = [at] + [at + 1 + 3 * i + v for i, v in enumerate(_votes_of(code))]
    end = at + _OF_KIND
    for n in reversed(SHAPE):
        form, x = divmod(form, n)
        end -= n
        out.append(end + x)
    return out


@dataclass
class SpanClassifier:
    """A logistic model over kind, votes and description; ``score`` is the probability that a span is personal data."""

    weights: np.ndarray
    reliabilities: np.ndarray

    def score(self, kind: int, code: int, form: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[_features(kind, code, form)].sum(), -30, 30))))


def train(counts: dict[tuple[int, int, int], int], steps: int = 400, ridge: float = 1e-3) -> SpanClassifier:
    """EM over the votes, then logistic regression on the posteriors by kind, votes and description, weighted by the logarithm of the counts. Without counts every score is one half."""
    by_votes: Counter[tuple[int, int]] = Counter()
    for (kind, code, _), n in counts.items():
        by_votes[kind, code] += n
    post, table = estimate(by_votes)
    w = np.zeros(len(KINDS) * _OF_KIND)
    if counts:
        keys = sorted(counts)
        x, y = np.array([_features(*k) for k in keys]), np.array([post[k[:2]] for k in keys])
        n = np.log1p([counts[k] for k in keys])
        n /= n.sum()
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
            w -= 4 * (np.bincount(x.ravel(), weights=np.repeat(n * (p - y), x.shape[1]), minlength=len(w)) + ridge * w)
    return SpanClassifier(w, table)


def fit(found: DataFrame) -> SpanClassifier:
    """The classifier of the candidates in ``found`` (``candidate_rows``). Repeated rows count as often as they come; without candidates every score is one half."""
    return train({(r.kind, r.code, r.shape): r.n for r in vote_counts(found).collect()})


def taken(found: list[tuple[int, int, int, bool, int, int]], model: SpanClassifier, memo: dict) -> list[tuple[int, int, int]]:
    """Base spans and the candidates that the classifier takes, by start and kind."""
    out = []
    for a, b, k, base, code, form in found:
        if not base:
            key = (k, code, form)
            if key not in memo:
                memo[key] = model.score(*key)
            if memo[key] < 0.5:
                continue
        out.append((a, b, k))
    out.sort(key=lambda s: (s[0], s[2], s[1]))
    return out


def find(text: str | None, model: SpanClassifier, memo: dict) -> list[tuple[int, int, int]]:
    return taken(described(text), model, memo)


def _write(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(found: DataFrame, model: SpanClassifier) -> DataFrame:
    """Per row of ``candidate_rows``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans``.

    Places count code points, ends exclusive. A text without candidates, a null
    one too, has no spans. Rows keep their number; an empty table gives an empty
    result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            counts, digests, spans, many = [], [], [], []
            for t in batch.column(1):
                flat = t.as_py()
                rows = [tuple(flat[i : i + WIDTH]) for i in range(0, len(flat), WIDTH)]
                base = [r[:3] for r in rows if r[3]]
                counts.append([sum(k == i for _, _, k in base) for i in range(4)])
                digests.append(hashlib.sha256(_write(base).encode()).hexdigest())
                kept = taken(rows, model, memo)
                spans.append(_write(kept))
                many.append(len(kept))
            cols = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(many, pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every span (overlapping ones merged) replaced by its first kind in brackets."""
    out, end = [], 0
    for a, b, k in spans:
        if a >= end:
            out += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, model: SpanClassifier) -> DataFrame:
    """``docs`` with all columns, of any name and type, personal data in ``text`` replaced, and ``n_chars``, if there, counted anew. Null texts stay null, repeated rows stay, an empty table stays empty."""
    names, places = docs.columns, [f"c{i}" for i in range(len(docs.columns))]  # Spark's Arrow functions take no dots in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in pieces(batches):
            texts = [redact(x, find(x, model, memo)) if (x := t.as_py()) is not None else None for t in batch.column(names.index("text"))]
            cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names=places)

    out = docs.select(*[named(c).cast("string").alias(p) if c == "text" else named(c).alias(p) for c, p in zip(names, places, strict=True)])
    out = out.mapInArrow(run, out.schema)
    n_chars = lambda: F.length(places[names.index("text")]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[(n_chars() if c == "n_chars" else F.col(p)).alias(c) for c, p in zip(names, places, strict=True)])
