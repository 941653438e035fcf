"""Near-duplicate groups by HyperMinHash: compressed registers band together, their corrected estimate discards, full sets decide.

A text's shingle hashes are dealt to ``BUCKETS`` buckets. A register stores of its
bucket's smallest hash the number of leading zeros and the next ``MANTISSA`` bits:
16 bits that are right for sets of any size.

Registers are cut into bands; texts with an equal band meet, each with one leader
of the band, so a band that a third of all texts have makes no more pairs than
rows. Two registers can be equal by chance though their smallest hashes differ;
from the sets' sizes follows how many are to be expected, and the estimate of the
Jaccard similarity counts only the matches beyond these. Pairs whose estimate is
below the threshold by more than ``SLACK`` standard errors are discarded, the full
sets of the others are compared.

Bands miss some links, and a leader may be like none of its band. What they leave
apart is completed by the exact join of ``simhash_copies``, so the groups are those
that comparing all pairs would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, release, stored
from .simhash_copies import classes, groups

#: Buckets (a power of two), bits of a mantissa, and registers of a band.
BUCKETS, MANTISSA, BAND = 128, 10, 8
#: Standard errors below the threshold at which a pair is discarded.
SLACK = 4.0
_P = BUCKETS.bit_length() - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def registers(found: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes: ``zeros + 1`` above the mantissa; 0 for an empty bucket."""
    out = np.zeros(BUCKETS, dtype="<u2")
    if not len(found):
        return out
    h = found * _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    h.sort()  # the first of each bucket is its smallest
    bucket, first = np.unique(h >> np.uint64(64 - _P), return_index=True)
    least = h[first] << np.uint64(_P)
    zeros = np.minimum(53 - np.frexp((least >> np.uint64(11)).astype(np.float64))[1], 64 - _P - MANTISSA - 1)
    mantissa = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out[bucket] = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa
    return out


def expected_matches(n: np.ndarray, m: np.ndarray, points: int = 8) -> np.ndarray:
    """How many registers of two disjoint sets of these sizes are equal by chance.

    A register stands for an interval of hashes, of ``2^-MANTISSA`` of its level's
    width; both smallest hashes lie in it with the product of their densities.
    Each level is summed at a few points.
    """
    level = np.arange(1, 44)[:, None]
    at = ((1 + (np.arange(points) + 0.5) / points) * 2.0 ** -(level + _P)).ravel()
    width = np.repeat(2.0 ** -(level + _P + MANTISSA), points)
    density = lambda k: k[:, None] * np.exp((k[:, None] - 1) * np.log1p(-at)[None, :])
    each = density(n.astype(np.float64)) * density(m.astype(np.float64)) * (width**2 * (1 << MANTISSA) / points)
    return BUCKETS * each.sum(axis=1)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of pairs of registers (rows) of sets of these sizes, and how many buckets each rests on."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    free = np.maximum(used - equal, 0) / np.maximum(used, 1)  # only buckets that do not match anyway can match by chance
    chance = np.minimum(expected_matches(n, m) * free, equal)
    return (equal - chance) / np.maximum(used, 1), used


def sketches(sets: DataFrame) -> DataFrame:
    """``(t1, size, registers)`` of ``sets(t1, size, set)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            regs = [registers(np.frombuffer(x.as_buffer(), dtype="<u8")).tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(regs, pa.binary())], names=["t1", "size", "registers"])

    return sets.select("t1", "size", "set").mapInArrow(run, "t1 long, size int, registers binary")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype="<u2").reshape(len(col), BUCKETS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(band, t1)`` for every band with a used register; the band's number and registers are one 64-bit hash."""
    odd = np.array([pow(0xBF58476D1CE4E5B9, i + 1, 1 << 64) for i in range(BAND)], dtype=np.uint64)
    for b in pieces(batches):
        regs = _matrix(b.column(1)).reshape(b.num_rows, -1, BAND)
        h = (regs.astype(np.uint64) * odd).sum(axis=2, dtype=np.uint64) + np.arange(regs.shape[1], dtype=np.uint64) * _MIX
        h = (h ^ (h >> np.uint64(29))) * _MIX
        row, band = np.nonzero(regs.any(axis=2))
        yield pa.RecordBatch.from_arrays([pa.array(h[row, band].view(np.int64)), b.column(0).take(pa.array(row))], names=["band", "t1"])


def banded(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of texts with an equal band, each with the band's leader, whose estimate does not lie too far below ``similarity``."""
    sketch = stored(sketches(sets), "sketches")
    bands = stored(sketch.select("t1", "registers").mapInArrow(_bands, "band long, t1 long"), "bands")
    leaders = bands.groupBy("band").agg(F.min("t1").alias("a"), F.max("t1").alias("last")).where("a < last").select("band", "a")
    leaders = stored(leaders, "leaders")
    pairs = stored(bands.join(leaders, "band").where("a <> t1").select("a", F.col("t1").alias("b")).distinct(), "banded")
    release(bands, leaders)
    side = lambda n: sketch.select(F.col("t1").alias(n), F.col("size").alias(f"{n}_size"), F.col("registers").alias(f"{n}_regs"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_size", "b_size", "a_regs", "b_regs")

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found, used = estimate(_matrix(b.column(4)), _matrix(b.column(5)), b.column(2).to_numpy(), b.column(3).to_numpy())
            error = np.sqrt(similarity * (1 - similarity) / np.maximum(used, 1))
            keep = pa.array(found >= similarity - SLACK * error)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(plausible, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, similarity: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``.

    Texts whose sets of word shingles (A-Z lower-cased; a shorter text's whole
    sequence) have a Jaccard similarity of ``similarity`` or more are linked;
    ``component_id`` is the smallest doc_id reachable, and a row is kept if that
    is its own. Null, empty and blank texts have no shingles and are linked with
    nothing, not with each other either. A null doc_id counts as no candidate for
    the smallest; with nothing else its component is null and it is kept. Repeated
    rows are returned as often as they come. An empty table gives an empty result;
    further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    grouped = stored(groups(rows, shingle, similarity, proposed=lambda sets: banded(sets, similarity)), "grouped")
    each = classes(grouped.where("size > 0"))
    least = stored(each.groupBy("label", "own").agg(F.min("doc_id").alias("component")), "least")
    texts = each.select("label", "own", "t1", "t2").distinct()
    same = (texts["label"] == least["label"]) & texts["own"].eqNullSafe(least["own"])
    of = stored(texts.join(least, same).select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "component"), "of")
    out = grouped.join(of, (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left")
    component = F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
