"""Toxicity by compression distance: is a window shorter with a dictionary of toxic text than with one of ordinary text?

Two separate zstandard dictionaries are trained on windows as they stand in
labelled texts: one on windows of ordinary texts, one on windows of toxic texts.
Most windows of a toxic text are ordinary, so the toxic dictionary is trained on
those that hold a short byte string which several times as many toxic as ordinary
texts have (all windows of toxic texts, if there is no such string). A window's
saving is its compressed length with the ordinary dictionary less that with the
toxic one. Every window is compressed in front of the same fixed bytes, which both
dictionaries end with: without them zstandard leaves very short inputs
uncompressed, and lengths would tell nothing.

A text's score comes from the savings of all its windows, calibrated to a
probability by logistic regression on labelled texts, each measured with
dictionaries that were not trained on it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPLIT = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: The fixed bytes after every window; length of the byte strings that are counted; saving from which a window counts as strong, and that much more again.
TAIL, GRAM, STRONG = b"0123456789abcdefghijklmnopqrstuvwxyz!?", 6, 2
#: Windows whose savings a worker remembers.
REMEMBERED = 300_000
FEATURES = 10


def words(text: str | None) -> list[bytes]:
    return [w for w in _SPLIT.split((text or "").encode("utf-8", "surrogatepass").lower()) if w]


def windows(text: str | None, size: int) -> list[bytes]:
    """The text's words in windows of ``size``, with a space at either end."""
    w = words(text)
    if size == 1:
        return [b" %b " % x for x in w]
    return [b" " + b" ".join(w[i : i + size]) + b" " for i in range(0, len(w), size)]


def _dictionary(samples: list[bytes], size: int, k: int) -> bytes:
    """Trained content; the samples' distinct ones themselves if there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def _support(texts: Iterable[str], only: set[bytes] | None = None) -> Counter[bytes]:
    """In how many texts each byte string of ``GRAM`` bytes occurs, windows laid end to end."""
    out: Counter[bytes] = Counter()
    for t in texts:
        b = b" " + b" ".join(words(t)) + b" "
        found = {b[i : i + GRAM] for i in range(len(b) - GRAM + 1)}
        out.update(found if only is None else found & only)
    return out


class Savings(dict):
    """Window -> bytes that the toxic dictionary saves over the ordinary one; short windows are remembered."""

    def __init__(self, toxic: bytes, ordinary: bytes, level: int):
        super().__init__()
        self.pair = []
        for content in (ordinary, toxic):
            d = zstandard.ZstdCompressionDict(content + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.pair.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __missing__(self, window: bytes) -> int:
        plain, toxic = (len(c.compress(window + TAIL)) for c in self.pair)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(window) < 200:
            self[window] = plain - toxic
        return plain - toxic


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    window: int
    level: int

    def __post_init__(self):
        self._savings = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_savings": None}

    def features(self, text: str | None) -> np.ndarray:
        """One; the three largest savings; how many are strong, how many more so, and how many windows there are, as logarithms; the mean saving; the shares of strong ones."""
        if self._savings is None:
            self._savings = Savings(self.toxic, self.ordinary, self.level)
        d = np.array(list(map(self._savings.__getitem__, windows(text, self.window))) or [0])
        top = np.sort(d)[::-1][:3]
        top = np.r_[top, [min(0, top[-1])] * (3 - len(top))]
        strong, more = d >= STRONG, d >= 2 * STRONG
        return np.r_[1.0, top, np.log1p(strong.sum()), np.log1p(more.sum()), np.log1p(len(d)), d.mean(), 10 * strong.mean(), 10 * more.mean()]

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def _common(seen: Counter[bytes], toxic: int) -> set[bytes]:
    """Byte strings that enough of so many toxic texts have."""
    return {g for g, n in seen.items() if n >= max(5, toxic // 100)}


def _dictionaries(rows: list[tuple[str, int]], seen: Counter[bytes], there: Counter[bytes], window: int, toxic_size: int, ordinary_size: int, often: float) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary of ``(text, label)`` rows; ``seen`` and ``there`` say how many of their toxic and ordinary texts have a byte string."""
    toxic, plain = [t for t, y in rows if y], [t for t, y in rows if not y]
    marks = {g for g in _common(seen, len(toxic)) if seen[g] / max(1, len(toxic)) > often * (there[g] + 1) / max(1, len(plain))}
    every = [w for t in toxic for w in windows(t, window)]
    telling = [w for w in every if any(w[i : i + GRAM] in marks for i in range(len(w) - GRAM + 1))] or every
    step, at, samples = 1 + sum(len(t) for t in plain) // (300_000 * 6 * window), 0, []
    for t in plain:
        w = windows(t, window)
        samples += w[-at % step :: step]
        at += len(w)
    return _dictionary(telling, toxic_size, 48), _dictionary(samples, ordinary_size, 64)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights by Newton's method, each step halved until the penalised loss falls; the first column is the constant."""
    weight = np.array([1e-6] + [ridge] * (x.shape[1] - 1))
    loss = lambda v: float(np.logaddexp(0, (1 - 2 * y) * (x @ v)).sum() + (weight * v * v).sum() / 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(weight), x.T @ (p - y) + weight * w)
        size, at = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > at:
            size /= 2
        w = w - size * step if size > 1e-6 else w
        if np.abs(size * step).max() < 1e-9 or size <= 1e-6:
            break
    return w


def train(rows: list[tuple[str, int]], window: int = 1, level: int = 9, toxic_size: int = 8192, ordinary_size: int = 65_536, often: float = 4.0, folds: int = 2) -> Model:
    """A model from ``(text, label)`` rows.

    For calibration each of ``folds`` parts of the rows is measured with
    dictionaries of the other parts; the model's own are trained on all rows.
    Equal rows count once. With one label only, or no rows, scores are the share
    of label 1 (one half without rows).
    """
    # in the order of a hash of the text: which fold a row is in depends on nothing else
    rows = sorted(dict.fromkeys(rows), key=lambda r: (xxhash.xxh64_intdigest(r[0].encode("utf-8", "surrogatepass"), 6), *r))
    parts = [rows[k::folds] for k in range(folds)]
    # byte strings are counted once a fold: what a model may count is all of them, or all but one fold's
    seen = [_support(t for t, y in p if y) for p in parts]
    least = min((sum(y for q in parts if q is not p for _, y in q) for p in parts), default=0)
    common = _common(sum(seen, Counter()), least)
    there = [_support((t for t, y in p if not y), common) for p in parts]

    def train_on(left_out: int | None) -> Model:
        used = [r for i, r in enumerate(rows) if left_out is None or i % folds != left_out]
        counts = [sum((c for k, c in enumerate(of) if k != left_out), Counter()) for of in (seen, there)]
        return Model(*_dictionaries(used, *counts, window, toxic_size, ordinary_size, often), np.zeros(FEATURES), window, level)

    model, x, y = train_on(None), np.zeros((len(rows), FEATURES)), np.array([float(l) for _, l in rows])
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.weights[0] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        for k in range(folds):
            other = train_on(k)
            for i in range(k, len(rows), folds):
                x[i] = other.features(rows[i][0])
        model.weights = _logistic(x, y, model.weights)
    return model


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, max_chars: int = 16_000_000, **options: float) -> Model:
    """A model from labelled rows, whole texts: at most about ``max_rows`` of them and ``max_chars`` characters in all, which bound what the driver holds.

    Rows whose ``crc32(doc_id) mod 5`` is 0 are never trained on. If there are
    more rows, fewer labels are drawn by a hash of their id; if there are more
    characters, fewer of these rows by a hash of their text. A text with more than
    a sixteenth of ``max_chars`` is no training row. Null ids, texts and labels are
    left out; a repeated id or label gives a row each, and equal rows count once.
    """
    labels = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out("doc_id")).distinct()
    n, drawn = labels.count(), lambda c, share: F.pmod(F.xxhash64(c), F.lit(1 << 20)) < int((1 << 20) * share)
    if n > max_rows:
        labels = labels.where(drawn("doc_id", max_rows / n))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= max_chars // 16)
    rows = texts.join(F.broadcast(labels), "doc_id").select("text", (F.col("toxic") == 1).cast("int").alias("toxic"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > max_chars:
        rows = rows.where(drawn("text", max_chars / chars))
    return train([(r.text, r.toxic) for r in rows.distinct().collect()], **options)


def held_out(doc_id: str) -> Column:
    """Whether a row is kept from training: ``crc32`` of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row, from all windows of the whole text.

    Null and empty texts have no windows and the score of no savings. A null id
    stays null and counts as held out. Rows keep their number; an empty table
    gives an empty result; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(model.features(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
