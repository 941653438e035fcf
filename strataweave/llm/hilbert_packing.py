"""Packing along a space-filling curve.

A document's token ids are hashed into a signed vector, the unit vector is
projected to three dimensions, and the point's place on a Hilbert curve is the
sort key: neighbours on the curve have similar words. Documents are dealt out
by ranges of that key, sorted, and laid end to end; sequences are cut every
``size`` tokens, so only the very last one has padding. A document may go over
several sequences.

Ranges are cut by exact token counts of all rows: the curve is divided into cells,
and cells with too many tokens are divided further, until each is small beside a
range; neighbouring cells make up a range. A key's low half is a hash of the
document, so thousands of copies with one place on the curve are still spread
over ranges. The cells' counts give each range its first token number; no task
sees more than its range, and no ids reach the driver, only a few counts a range.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored

DIMS, BITS, BUCKETS = 3, 10, 64
#: Bits of a key: the place on the curve and a hash of the document.
KEY_BITS = DIMS * BITS + 32
#: Tokens that a range has at most about (two bytes each).
RANGE_TOKENS = 64_000_000
#: Cells that one round may add without taking fewer bits at a time.
CELLS = 100_000
#: Characters whose class no Unicode version has changed; texts of these alone, without the special string, take the faster of the two public encoders, which has the same vocabulary.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]|<\\|endoftext\\|>")
#: Runs of letters or of blanks that the faster encoder, whose time grows with the square of a run, leaves to the library.
LONG = 2000
_LONG = re.compile(rf"(?<!\S)\S{{{LONG}}}|(?<!\s)\s{{{LONG}}}")


def _has_long_run(text: str) -> bool:
    """Whether a run is too long; it would fill a whole block of half that length, so most texts are settled by one blank a block."""
    half = LONG // 2
    for i in range(0, len(text) - half + 1, half):
        if text.find(" ", i, i + half) < 0 or text[i : i + half].isspace():
            return _LONG.search(text) is not None
    return False


class Encoder:
    """Ids of a text by the tokenizer file at ``path``, special strings inside texts handled as its library does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(path), None
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import base64

            import public_tokenizers
            import tiktoken

            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
            self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and not _PLAIN.search(text) and not _has_long_run(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def _hashes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By token id: its bucket and sign; and the projection of buckets to dimensions. Fixed, so keys agree between runs."""
    x = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    bucket, sign = (x >> np.uint64(40)) % np.uint64(BUCKETS), np.where((x >> np.uint64(63)) > 0, 1.0, -1.0)
    return bucket.astype(np.int64), sign, np.random.default_rng(7).standard_normal((BUCKETS, DIMS))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows x dimensions), coordinates below ``2 ** bits``."""
    x = points.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the turns of ever smaller cells
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(vectors: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Hilbert keys of hashed vectors; coordinates are squeezed by a fixed S-curve, so no pass over the corpus sets their range."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    flat = vectors / np.where(norm > 0, norm, 1) @ projection
    return hilbert(np.clip((1 / (1 + np.exp(-1.7 * flat)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def tokenized(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, key, n, ids)``: two bytes an id, ``end_id`` at the end; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        bucket, sign, projection = _hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids, vectors, marks = [], np.zeros((b.num_rows, BUCKETS)), np.zeros(b.num_rows, dtype=np.int64)
                for i, t in enumerate(b.column(1)):
                    x = np.array(encode(t.as_py() or ""), dtype="<u2")
                    vectors[i] = np.bincount(bucket[x], weights=sign[x], minlength=BUCKETS)
                    ids.append(np.append(x, np.uint16(end_id)).tobytes())
                    marks[i] = zlib.crc32(f"{b.column(0)[i]}".encode(), len(x))
                key = (curve_keys(vectors, projection) << 32) | marks
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "key", "n", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, key long, n long, ids binary")


def _with_range(df: DataFrame, cuts: np.ndarray) -> DataFrame:
    """``df`` with ``part``, the number of the range that ``key`` is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(b.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            part = np.searchsorted(cuts, key, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], names=[*b.schema.names, "part"])

    return df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", part int")


def ranges(tokens: DataFrame, parts: int, mass: int) -> tuple[np.ndarray, np.ndarray]:
    """First keys of the ranges but the first, and the ranges' first token numbers; about ``parts`` ranges of ``mass`` tokens in all.

    A range has at most one and a half times its share, unless rows with one key
    (equal ids and lengths at one place) have more.
    """
    want = max(1, -(-mass // parts))
    bits = max(4, int(4 * parts).bit_length())
    cell = lambda b: F.shiftright("key", KEY_BITS - b)
    rows = tokens.groupBy(cell(bits).alias("c")).agg(F.sum("n").alias("n")).toArrow()
    done = []
    while True:
        c, n = rows.column("c").to_numpy(), rows.column("n").to_numpy()
        heavy = (2 * n > want) & (bits < KEY_BITS)
        done.append((c[~heavy] << (KEY_BITS - bits), n[~heavy]))
        if not heavy.any():
            break
        step = min(KEY_BITS - bits, 12, max(3, int(CELLS // heavy.sum()).bit_length()))
        chosen = tokens.sparkSession.createDataFrame(pa.table({"h": c[heavy]}))
        of = tokens.join(F.broadcast(chosen) if heavy.sum() <= BROADCAST_ROWS else chosen, cell(bits) == F.col("h"), "left_semi")
        bits += step
        rows = of.groupBy(cell(bits).alias("c")).agg(F.sum("n").alias("n")).toArrow()
    key, n = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(key)
    key, before = key[order], np.cumsum(n[order]) - n[order]
    first = np.flatnonzero(np.r_[True, before[1:] // want != before[:-1] // want]) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first[1:]], before[first]


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, with ``ids`` on demand.

    Every id of every row lies in exactly one piece; sequences are full but for
    the last. Null and empty texts are the end id alone. Repeated rows are
    packed each; an empty table gives no pieces; further columns are ignored.
    ``tokenizer_path`` must be readable by every worker and have fewer than
    65,536 ids.
    """
    spark = docs.sparkSession
    tokens = stored(tokenized(docs, tokenizer_path, end_id, id_col, text_col), "tokens")
    mass = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cuts, first = ranges(tokens, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-mass // RANGE_TOKENS), 1), mass)
    parts = max(1, len(first))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b, out = whole.slice(i, 256), []
                for row, raw, part in zip(range(b.num_rows), b.column(1), b.column(2).to_pylist(), strict=True):
                    x = np.frombuffer(raw.as_buffer(), dtype="<u2").astype("<u4")
                    g = at.get(part, int(first[part]))
                    at[part] = g + len(x)
                    start = 0
                    while start < len(x):
                        n = min(len(x) - start, size - (g + start) % size)
                        piece = x[start : start + n].tobytes()
                        out.append((row, start, n, zlib.crc32(piece), len(x), (g + start) // size, (g + start) % size, piece if with_ids else None))
                        start += n
                if out:
                    row, *cols, ids = zip(*out, strict=True)
                    arrays = [b.column(0).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in cols)] + ([pa.array(ids, pa.binary())] if with_ids else [])
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    dealt = _with_range(tokens.select("doc_id", "key", "ids"), cuts).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "doc_id", F.xxhash64("ids"))
    kind = tokens.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:7]) + ", ids binary" * with_ids
    return dealt.select("doc_id", "ids", "part").mapInArrow(cut, schema)
