"""SimHash near-duplicate groups found through pivot distance tables.

A fingerprint has 64 bits. The *pivot table* holds each distinct fingerprint's
Hamming distances to ``PIVOTS`` reference fingerprints; it is computed once and
stored. By the triangle inequality two fingerprints differ by at least the
largest difference of their distances.

Fingerprints within ``max_distance`` agree on all bits of at least one of
``max_distance + 1`` groups of bits, so only rows with equal bits of one group
meet. There they are sorted by the first distance, a sliding comparison ends when
that is too far off, pairs whose maximum coordinate difference exceeds
``max_distance`` are discarded, and the exact distance is computed for the
survivors only.

Groups with more than ``bucket_rows`` rows are not compared: their rows are
dealt out again by a quarter of the bits not yet fixed (the same argument holds
for these bits), until groups are small or so few bits are left that a group is
bounded by their combinations. Sizes come from a combining count, so neither a
common group nor a large cluster of near copies makes a quadratic task, and no
link is lost.

Exact copies share a fingerprint and are one row here. Links are joined to
components by minimum-label rounds with pointer jumping, each on stored tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored

#: Spread references: XXH64 of their number; any fixed set gives the same result.
PIVOTS = 16
SPREAD = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 42) for i in range(PIVOTS)], dtype=np.uint64)
_SIGNED = np.int64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned SimHash of the text's word shingles; 0 without words."""
    return _fingerprint((text or "").encode("utf-8", "surrogatepass"), shingle)


def _fingerprint(raw: bytes, shingle: int, block: int = 1 << 16) -> int:
    words = raw.lower().split()  # bytes: A-Z only, ASCII blanks only
    n = max(1, len(words) - shingle + 1) if words else 0
    if not n:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for i in range(0, n, block):
        part = words[i : i + block + shingle - 1]
        rows = zip(*(part[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
        h = np.fromiter((digest(join(r), 42) for r in rows), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8)[:, ::-1], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; the long has the fingerprint's 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_fingerprint((t.as_buffer().to_pybytes() if t.is_valid else b""), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(_SIGNED))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances (rows x PIVOTS) to the spread references."""
    return np.bitwise_count(fps[:, None] ^ SPREAD[None, :])


def _groups(bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` cut into ``parts`` runs of nearly equal length."""
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _mask(bits: list[int]) -> int:
    m = sum(1 << i for i in bits)
    return m - (1 << 64) if m >> 63 else m


def schedule(max_distance: int, least_bits: int = 12) -> list[list[int]]:
    """Masks of the fixed bits, level by level; level ``l`` refines each mask of level ``l - 1`` in ``max_distance + 1`` ways, in order."""
    parts, levels, free = max_distance + 1, [], [list(range(64))]
    while True:
        nxt = [[b for b in f if b not in g] for f in free for g in _groups(f, parts)]
        levels.append([_mask([b for b in range(64) if b not in n]) for n in nxt])
        free = nxt
        if max(map(len, free)) <= least_bits or len(levels) == 5:
            return levels


def pivot_rows(distinct: DataFrame) -> DataFrame:
    """``distinct`` with its pivot table: ``pv0`` and ``pv1`` hold the distances to the references, a byte each."""
    packed = []
    for half in (range(8), range(8, PIVOTS)):
        word = F.lit(0).cast("long")
        for i in half:
            far = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(SPREAD.view(_SIGNED)[i])))).cast("long")
            word = word.bitwiseOR(F.shiftleft(far, 8 * (i % 8)))
        packed.append(word)
    return distinct.withColumn("pv0", packed[0]).withColumn("pv1", packed[1])


def _compare(it: Iterator[pd.DataFrame], max_distance: int) -> Iterator[pd.DataFrame]:
    """Links within runs of equal (mask, key), over rows sorted by it and the first coordinate.

    The last rows of a batch that may still meet the next batch's are carried over.
    """
    tail = None
    for pdf in it:
        if tail is not None:
            pdf = pd.concat([tail, pdf], ignore_index=True)
        if not len(pdf):
            continue
        fp, m, key = pdf["fp"].to_numpy().view(np.uint64), pdf["m"].to_numpy(), pdf["key"].to_numpy()
        old = 0 if tail is None else len(tail)
        table = np.ascontiguousarray(pdf[["pv0", "pv1"]].to_numpy()).astype("<i8").view(np.uint8).reshape(len(fp), PIVOTS).astype(np.int16)
        shift, found, alive = 1, [], np.arange(len(fp) - 1)
        while len(alive):
            j = alive + shift
            alive, j = alive[j < len(fp)], j[j < len(fp)]
            # sorted by the first coordinate: once it is too far off, later rows are too
            near = (key[alive] == key[j]) & (m[alive] == m[j]) & (table[j, 0] - table[alive, 0] <= max_distance)
            alive, j = alive[near], j[near]
            new = j >= old  # pairs within the carried rows are known
            a, b = alive[new], j[new]
            far = np.abs(table[a] - table[b]).max(axis=1, initial=0) > max_distance
            a, b = a[~far], b[~far]
            linked = np.bitwise_count(fp[a] ^ fp[b]) <= max_distance
            found.append((fp[a[linked]], fp[b[linked]]))
            shift += 1
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (fp[:0], fp[:0])
        if len(a):
            yield pd.DataFrame({"a": a.view(_SIGNED), "b": b.view(_SIGNED)})
        last = (key == key[-1]) & (m == m[-1]) & (table[-1, 0] - table[:, 0] <= max_distance)
        tail = pdf[last]


def links(pivots: DataFrame, max_distance: int = 3, bucket_rows: int = 64) -> DataFrame:
    """``(a, b)``: all pairs of different fingerprints of ``pivots(fp, pv0, pv1)`` at most ``max_distance`` bits apart (some more than once)."""
    n = int(pivots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    levels = schedule(max_distance)
    rows, out = pivots.select("fp", "pv0", "pv1", F.lit(0).alias("m")), None
    for depth, masks in enumerate(levels):
        parts = len(masks) if depth == 0 else max_distance + 1
        known = F.array(*[F.lit(x).cast("long") for x in masks])
        each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: (F.col("m") * parts + i).cast("int")))
        keyed = rows.select("fp", "pv0", "pv1", each.alias("m")).withColumn("key", F.col("fp").bitwiseAND(F.element_at(known, F.col("m") + 1)))
        limit = bucket_rows if depth < len(levels) - 1 else 1 << 62
        sizes = stored(keyed.groupBy("m", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        met = keyed.join(sizes.where(F.col("n") <= limit), ["m", "key"], "left_semi").repartition(n, "m", "key")
        met = met.sortWithinPartitions("m", "key", F.col("pv0").bitwiseAND(F.lit(255)))
        part = stored(met.mapInPandas(lambda it: _compare(it, max_distance), "a long, b long"), f"links{depth}")
        out = part if out is None else out.unionByName(part)
        big = sizes.where(F.col("n") > limit)
        if big.isEmpty():
            break
        rows = stored(keyed.join(big, ["m", "key"], "left_semi").select("fp", "pv0", "pv1", "m"), "again")
    return out


#: Nodes that a task contracts at a time.
CONTRACTED = 500_000


def _contract(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over runs of a partition's edges, a bounded number of nodes at a time: each node with the smallest that it reaches there."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p] if p in up else p
        return x

    def forest() -> pd.DataFrame:
        rows = [(x, find(x)) for x in up]
        return pd.DataFrame({"a": [x for x, r in rows if x != r], "b": [r for x, r in rows if x != r]}, dtype="int64")

    for pdf in it:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
        if len(up) > CONTRACTED:
            yield forest()
            up.clear()
    yield forest()


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``; the label is the component's smallest node.

    Partitions first contract their own edges. Each round gives a node the
    smallest label around it and then that label's label. Both joins read
    stored tables, so adaptive execution can split a hot node's rows; minima
    combine before the shuffle. Ends when a round changes nothing.
    """
    forest = stored(edges.mapInPandas(_contract, "a long, b long").distinct(), "forest")
    both = stored(forest.union(forest.select("b", "a")).toDF("a", "b"), "edges")
    release(forest)
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = stored(labels.join(seen, labels.node == seen.a).select("node", "label", F.least("label", "near").alias("new")), "step")
        jump = step.select(F.col("node").alias("at"), F.col("new").alias("further"))
        after = step.join(jump, step.new == jump["at"]).select("node", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved"))
        release(labels)
        labels = stored(after, "labels")
        release(step)
        if labels.where("moved").isEmpty():
            release(both)
            return labels.select("node", "label")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 3, bucket_rows: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    ``component_id`` is the smallest doc_id of the component. Null and blank
    texts have fingerprint zero and link like any other; a null doc_id is kept
    and counts as no candidate for the smallest (all null: null). Repeated rows
    are returned as often as they come. An empty table gives an empty result;
    further columns are ignored.
    """
    fps = stored(fingerprints(docs, shingle, id_col, text_col), "fps")
    distinct = stored(pivot_rows(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))), "pivots")
    labels = components(links(distinct, max_distance, bucket_rows))
    named = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    named = stored(named, "named")
    least = stored(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "least")
    of = stored(named.join(least, "label").select(F.col("fp").alias("node"), "component_id"), "of")
    return fps.join(of, fps.fp == of.node).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
