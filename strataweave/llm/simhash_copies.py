"""Near copies by shingle similarity: SimHash and pivot tables link most of them, an exact set join the rest.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity ``s`` of 0.8 or more. No step caps partners or looks at a sample; the
groups are those that comparing all pairs would give.

1. **Which texts can have a near copy at all.** All shingles stand in the order
   of their hashes. Sets ``a`` and ``b`` so similar share at least ``s * |a|``
   shingles, so of the first ``(1 - s + LEAST) * |a|`` of each, at least
   ``LEAST * s * |a|`` are in both. These first shingles go to their hash's task,
   which tells the text those that another text has too; with fewer the text has
   no near copy, and it is not looked at again. A task first puts together what
   it read itself: a shingle that many of its texts have goes out as one mark, so
   a passage of a third of all texts makes a row a task.
2. **SimHash and pivot distance tables.** The remaining texts' fingerprints are
   linked as in ``simhash_pivots``: stored distances to reference fingerprints
   discard pairs by their maximum coordinate difference, survivors are verified,
   and the shingle sets of linked texts are compared in full.
3. **Exact completion.** The remaining texts' shingles are ordered from the rarest
   to the most frequent, counted over all of these texts. Of a pair, one of the
   first ``|a| - ceil(s * |a|) + 1`` of the larger set is among the first
   ``|b| - ceil(2s / (1 + s) * |b|) + 1`` of the smaller, so each text has probe
   rows under those and index rows under these, and only index rows meet probe
   rows of larger sets. A shingle without index rows is dropped: one that many
   texts share comes last in all of them, so a passage that does not make texts
   near copies by itself makes nothing to compare. First every text is compared
   with one leader of each shingle that joins different groups, then all rows of
   such shingles meet, in blocks of bounded size, unless already in one group:
   bounds by length and by place in the order discard pairs, and a pair that
   already met at the shingle before in both texts is not compared again.
   Survivors' full sets are compared.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, release, small, stored
from .simhash_pivots import components, links, pivot_rows

#: Share of a set by which step 1 looks further than for one common shingle.
LEAST = 0.1
#: Index rows and probe rows of one shingle that meet in a group of the exact join.
BLOCK_ROWS = 512
#: Shingles that a task of step 1 puts together at a time, and words whose hashes a worker remembers.
TOGETHER, REMEMBERED = 250_000, 100_000
#: Bytes of a text that are cut into words at a time.
STEP = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_ODD = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(64)], dtype=np.uint64)


class WordHashes(dict):
    """Word -> its XXH64, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def word_hashes(raw: bytes, known: WordHashes) -> np.ndarray:
    """Hashes of the words between ASCII blanks, A-Z lower-cased."""
    out, at = [], 0
    while at < len(raw):
        end = min(at + STEP, len(raw))
        if end < len(raw):
            m = _BLANK.search(raw, end)
            end = m.start() if m else len(raw)
        words = raw[at:end].lower().split()
        out.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingle_set(words: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence if it is shorter."""
    k = min(shingle, len(words))
    if not k:
        return words
    n = len(words) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h += words[i : i + n] * _ODD[i]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def simhash(found: np.ndarray) -> int:
    """64-bit SimHash of the set, signed: a bit is 1 if it is in over half the hashes."""
    if not len(found):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found)).view(">i8")[0])


def bounds(n: int, similarity: float) -> tuple[int, int]:
    """Of a set of ``n``: how many first shingles step 1 files, and how many of them another text must have."""
    least = int(np.ceil(similarity * n - 1e-9))
    more = lambda x: int(LEAST * x) + 1
    return n - least + more(n), more(least)


def _raw(t: pa.Scalar) -> bytes:
    return t.as_buffer().to_pybytes() if t.is_valid else b""


def _identity(words: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a sequence of words; zeros for none."""
    if not len(words):
        return 0, 0
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(words.tobytes()), dtype="<i8").tolist())


def _described(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``(doc_id, th, t1, t2, size, need, first)`` per row: hash of the raw text, the text's 128 bits, how many shingles it has, and its first shingles, with how many of them another text must have; a task names those of equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                t1, t2, size, need, first = [], [], [], [], []
                for t in b.column(2):
                    words = word_hashes(_raw(t), known)
                    one = _identity(words)
                    t1.append(one[0])
                    t2.append(one[1])
                    if not len(words) or one in seen:
                        size.append(seen.get(one, 0))
                        need.append(0)
                        first.append(None)
                    else:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        found = shingle_set(words, shingle)
                        seen[one] = len(found)
                        n, least = bounds(len(found), similarity)
                        size.append(len(found))
                        need.append(least)
                        first.append(found[:n].tobytes())
                cols = [pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(size, pa.int32()), pa.array(need, pa.int32()), pa.array(first, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "th", "t1", "t2", "size", "need", "first"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, th long, t1 long, t2 long, size int, need int, first binary")


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    return starts, np.diff(np.r_[starts, len(key)])


def _together(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``(t1, first)``: ``(key, t1, n)``. A key that one text has: its row, n 0. One that several have: a mark, n -1. Per text, under its own number as key, n such keys."""
    names = ["key", "t1", "n"]

    def flush(keys: list[np.ndarray], texts: list[int]) -> pa.RecordBatch:
        t1, key = np.repeat(np.array(texts, dtype=np.int64), [len(k) for k in keys]), np.concatenate(keys).view(np.int64)
        order = np.lexsort((t1, key))
        key, t1 = key[order], t1[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (t1[1:] != t1[:-1])]
        key, t1 = key[new], t1[new]
        starts, sizes = _runs(key)
        several = np.repeat(sizes > 1, sizes)
        own, n = np.unique(t1[several], return_counts=True)
        marks = key[starts[sizes > 1]]
        cols = (np.r_[key[~several], marks, own], np.r_[t1[~several], np.zeros_like(marks), own], np.r_[np.zeros((~several).sum()), np.full(len(marks), -1), n].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    keys, texts, held = [], [], 0
    for b in it:
        for t, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            keys.append(np.frombuffer(x.as_buffer(), dtype="<u8"))
            texts.append(t)
            held += len(keys[-1])
            if held >= TOGETHER:
                yield flush(keys, texts)
                keys, texts, held = [], [], 0
    if texts:
        yield flush(keys, texts)


def _known(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(t1, n)`` from the rows of ``_together``, sorted by (key, t1): counts pass on, and a row whose key another text or a mark has counts one."""
    tail = None
    for b in it:
        t = pa.Table.from_batches([b] if tail is None else [tail, b]).combine_chunks()
        key = t.column("key").to_numpy()
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))  # the last key's rows wait for the next batch
        yield _counted(t.slice(0, cut))
        tail = _merged(t.slice(cut))
    if tail is not None:
        yield _counted(pa.Table.from_batches([tail]))


def _merged(t: pa.Table) -> pa.RecordBatch:
    """One key's waiting rows; equal ones once."""
    return t.group_by(["key", "t1", "n"], use_threads=False).aggregate([]).select(["key", "t1", "n"]).combine_chunks().to_batches()[0]


def _counted(t: pa.Table) -> pa.RecordBatch:
    key, t1, n = (t.column(c).to_numpy() for c in ("key", "t1", "n"))
    sums = n > 0
    row = ~sums
    k, x, mark = key[row], t1[row], n[row] < 0
    starts, sizes = _runs(k)
    if len(k):
        low, high = np.minimum.reduceat(np.where(mark, np.iinfo(np.int64).max, x), starts), np.maximum.reduceat(np.where(mark, np.iinfo(np.int64).min, x), starts)
        other = np.repeat(np.logical_or.reduceat(mark, starts) | (low < high), sizes) & ~mark
        new = np.r_[True, (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | mark[:-1]]
        own, many = np.unique(x[other & new], return_counts=True)
    else:
        own, many = x, np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.r_[t1[sums], own]), pa.array(np.r_[n[sums], many].astype(np.int64))], names=["t1", "n"])


def _promising(described: DataFrame) -> DataFrame:
    """``(t1)`` of the texts that share enough of their first shingles with other texts to have a near copy."""
    n = int(described.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = described.where("first is not null").select("t1", "first").mapInArrow(_together, "key long, t1 long, n int")
    rows = rows.repartition(n, "key").sortWithinPartitions("key", "t1", "n")
    counts = stored(rows.mapInArrow(_known, "t1 long, n long").groupBy("t1").agg(F.sum("n").alias("n")), "counts")
    needs = described.where("first is not null").groupBy("t1").agg(F.min("need").alias("need"))
    out = stored(counts.join(needs, "t1").where("n >= need").select("t1"), "promising")
    release(counts)
    return out


def _sets(docs: DataFrame, described: DataFrame, promising: DataFrame, shingle: int) -> DataFrame:
    """``(t1, size, fp, set)`` of the promising texts, read from one raw text each."""
    each = described.groupBy("t1").agg(F.min("th").alias("th"))  # a row a text before the join: copies combine
    wanted = stored(each.join(promising, "t1", "left_semi"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                rows = {}
                for t in whole.column(0).slice(at, 512):
                    words = word_hashes(_raw(t), known)
                    one = _identity(words)[0]
                    if one not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(one)
                        rows[one] = shingle_set(words, shingle)
                cols = [pa.array(list(rows), pa.int64()), pa.array([len(x) for x in rows.values()], pa.int32()), pa.array([simhash(x) for x in rows.values()], pa.int64()), pa.array([x.tobytes() for x in rows.values()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["t1", "size", "fp", "set"])

    texts = docs.select(F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text")).join(small(wanted.select("th")), "th", "left_semi")
    found = texts.select("text").mapInArrow(run, "t1 long, size int, fp long, set binary")
    out = stored(found.groupBy("t1").agg(F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("set").alias("set")), "sets")
    release(wanted)
    return out


def _filed(sets: DataFrame, similarity: float) -> DataFrame:
    """``(key, before, t1, size, at, many, indexed)`` per text and shared shingle of its prefix, rarest first: the shingle before it (itself at the first), its place, how many rows the text has, and whether this is an index row too.

    Shingles that no other of these texts has come first in each text's order
    and meet nothing, so only the others are sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, x in zip(b.column(0), b.column(1), strict=True):
                key = np.frombuffer(x.as_buffer(), dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), t.as_py(), dtype=np.int64))], names=["key", "t1"])

    each = sets.select("t1", "set").mapInArrow(run, "key long, t1 long")
    often = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    shared = each.join(often, "key").groupBy("t1").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
    of = shared.join(sets.select("t1", "size"), "t1")
    least = F.ceil(F.lit(similarity) * F.col("size") - 1e-9)
    singles = (F.col("size") - F.size("keys")).alias("singles")
    room = (F.col("size") - least + 1 - F.col("size") + F.size("keys")).cast("int")
    first = of.where(room > 0).select("t1", "size", singles, F.slice("keys", F.lit(1), room).alias("keys"))
    rows = first.select("t1", "size", "singles", F.size("keys").alias("many"), F.col("keys.key").alias("all"), F.posexplode("keys.key").alias("i", "key"))
    before = F.when(F.col("i") == 0, F.col("key")).otherwise(F.get("all", F.col("i") - 1))
    at, most = (F.col("singles") + F.col("i")).cast("int"), F.col("size") - F.ceil(F.lit(2 * similarity / (1 + similarity)) * F.col("size") - 1e-9) + 1
    out = stored(rows.select("key", before.alias("before"), "t1", "size", at.alias("at"), "many", (at < most).alias("indexed")), "filed")
    release(often)
    return out


def _meet(it: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Pairs that the bounds leave, among rows sorted by (key, i, j, size); a group has a few hundred rows and is carried whole."""
    tail = None
    for pdf in it:
        pdf = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
        if len(pdf):
            same = (pdf[["key", "i", "j"]] == pdf[["key", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
            yield from _met(pdf[~same], similarity)
            tail = pdf[same]
    if tail is not None:
        yield from _met(tail, similarity)


def _met(pdf: pd.DataFrame, similarity: float) -> Iterator[pd.DataFrame]:
    key, i, j, probe, before, t1, label, size, at = (pdf[c].to_numpy() for c in ("key", "i", "j", "probe", "before", "t1", "label", "size", "at"))
    alive, shift, share, found, held = np.flatnonzero(~probe), 1, similarity / (1 + similarity), [], 0
    while len(alive):
        b = alive + shift
        a, b = alive[b < len(pdf)], b[b < len(pdf)]
        # sorted by size: once it is too large, later ones are too
        on = (key[a] == key[b]) & (i[a] == i[b]) & (j[a] == j[b]) & (size[a] >= similarity * size[b] - 1e-9)
        alive = a = a[on]
        b = b[on]
        want = share * (size[a].astype(np.int64) + size[b]) - 1e-9
        most = np.minimum(size[a] - at[a], size[b] - at[b])
        ok = probe[b] & (label[a] != label[b]) & (most >= want)
        ok &= (before[a] != before[b]) | (before[a] == key[a])
        a, b = t1[a[ok]], t1[b[ok]]
        if len(a):
            found.append((np.minimum(a, b), np.maximum(a, b)))
            held += len(a)
        shift += 1
        if held > 100_000 or (found and not len(alive)):
            yield pd.DataFrame(dict(zip("ab", map(np.concatenate, zip(*found, strict=True)), strict=True))).drop_duplicates()
            found, held = [], 0


def _labelled(filed: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The filed rows with their texts' groups, and ``(key, n, indexed, leader)`` of the shingles that have index rows and rows of several groups."""
    named = stored(filed.join(labels.withColumnRenamed("node", "t1"), "t1", "left").withColumn("label", F.coalesce("label", "t1")), "named")
    leader = F.max_by(F.struct("t1", "label", "size"), F.struct("many", "t1"))
    keys = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("indexed").alias("indexed"), leader.alias("leader"), F.min("label").alias("low"), F.max("label").alias("high"))
    return named, stored(keys.where("low < high and indexed > 0").select("key", "n", "indexed", "leader"), "mixed")


def _led(named: DataFrame, mixed: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each row with its shingle's leader, the row that most of its own shingles lead to others, where their groups and lengths allow."""
    met = named.select("key", "t1", "label", "size").join(mixed.select("key", "leader"), "key").where("label <> leader.label")
    met = met.where(F.least("size", "leader.size") >= F.greatest("size", "leader.size") * similarity - 1e-9)
    return met.select(F.least("t1", "leader.t1").alias("a"), F.greatest("t1", "leader.t1").alias("b")).distinct()


def _rest(named: DataFrame, mixed: DataFrame, similarity: float) -> DataFrame:
    """All pairs of an index row and a probe row of one shingle in different groups that the bounds leave."""
    n = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int")
    rows = named.join(mixed.select("key", blocks("indexed").alias("rows"), blocks("n").alias("columns")), "key")
    own = lambda c: F.pmod(F.xxhash64("t1"), F.col(c)).cast("int")
    each = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cell = lambda i, j, probe: F.struct(i.alias("i"), j.alias("j"), F.lit(probe).alias("probe"))
    probes = F.transform(each("rows"), lambda i: cell(i, own("columns"), True))
    indexed = F.when(F.col("indexed"), F.transform(each("columns"), lambda j: cell(own("rows"), j, False)))
    cells = F.explode(F.concat(probes, F.coalesce(indexed, F.filter(probes, lambda c: F.lit(False)))))
    rows = rows.select("key", "before", "t1", "label", "size", "at", cells.alias("c")).select("key", "c.*", "before", "t1", "label", "size", "at")
    dealt = rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "size", "t1")
    return dealt.mapInPandas(lambda it: _meet(it, similarity), "a long, b long").distinct()


def _proposed(sets: DataFrame, max_distance: int) -> DataFrame:
    """Pairs of texts with equal or linked fingerprints: each fingerprint with its smallest linked one, and every text with the first of its fingerprint."""
    firsts = stored(sets.groupBy("fp").agg(F.min("t1").alias("first")), "firsts")
    found = links(pivot_rows(firsts), max_distance)
    both = found.select("a", "b").union(found.select("b", "a")).toDF("a", "b")
    near = both.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("c")).select("a", F.explode(F.array("b", "c")).alias("b")).distinct()
    one = near.join(firsts.toDF("a", "x"), "a").join(firsts.toDF("b", "y"), "b").select("x", "y")
    same = sets.select("fp", "t1").join(firsts, "fp").where("t1 <> first").select(F.col("t1").alias("x"), F.col("first").alias("y"))
    return one.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` whose sets have at least this Jaccard similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (x, y))
                p, q = (p, q) if len(p) < len(q) else (q, p)
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    left = pairs.join(sets.select(F.col("t1").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("t1").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_distance: int = 3, proposed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(doc_id, th, t1, t2, size, label)`` per row of ``docs``: rows of one group of near copies share the label.

    ``th`` is Spark's hash of the raw text, ``t1`` and ``t2`` stand for its words,
    ``size`` is how many shingles it has. ``proposed`` gives the first pairs
    ``(a, b)`` from the sets ``(t1, size, fp, set)``, else the fingerprints do.
    Texts without words, null ones too, are one group. Texts whose first 64 of
    128 bits clash are kept apart in ``t2``. Repeated rows stay; an empty table
    gives an empty result; further columns, whatever their names, are ignored.
    """
    described = stored(_described(docs, shingle, similarity), "described")
    promising = _promising(described)
    rows = stored(described.drop("need", "first"), "rows")
    sets = _sets(docs, described, promising, shingle)
    release(described, promising)

    def joined(edges: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        wanted = stored(pairs, f"{name}_pairs")
        more = stored(similar(sets, wanted, similarity), name)
        both = stored(edges.union(more), "edges")
        release(wanted, more, edges)
        return both

    edges = joined(sets.select(F.col("t1").alias("a"), F.col("t1").alias("b")).limit(0), proposed(sets) if proposed else _proposed(sets, max_distance), "linked")
    filed = _filed(sets, similarity)
    for name, pairs in (("led", _led), ("rest", _rest)):
        labels = components(edges)
        named, mixed = _labelled(filed, labels)
        release(labels)
        edges = joined(edges, pairs(named, mixed, similarity), name)
        release(named, mixed)
    labels = components(edges)
    release(sets, filed, edges)
    return rows.join(labels.withColumnRenamed("node", "t1"), "t1", "left").select("doc_id", "th", "t1", "t2", rows["size"], F.coalesce("label", "t1").alias("label"))


def classes(grouped: DataFrame) -> DataFrame:
    """``(label, t1, t2, doc_id, th, n, own)`` of the stored ``grouped``, equal rows once with their number; groups are told apart by label and ``own``, which is null unless the text's number stands for several texts."""
    each = stored(grouped.groupBy("label", "t1", "t2", "doc_id", "th").agg(F.count(F.lit(1)).alias("n")), "each")
    clash = stored(each.groupBy("t1").agg(F.min("t2").alias("low"), F.max("t2").alias("high")).where("low < high").select("t1", F.lit(True).alias("alone")), "clash")
    return each.join(small(clash), "t1", "left").withColumn("own", F.when(F.col("alone"), F.col("t2"))).drop("alone")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_distance: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the one with the smallest doc_id.

    All columns stay, whatever their names and types. Null ids come last; of rows
    with one id the one with the smallest hash of its text stays, and of rows with
    equal id and text one, the least by its other columns as JSON. Null, empty and
    blank texts are one group. An empty table gives an empty result. Only rows
    whose id and text repeat are grouped, by these two.
    """
    grouped = stored(groups(docs, shingle, similarity, max_distance), "grouped")
    one = classes(grouped).groupBy("label", "own").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "n")).alias("k"))
    kept = stored(one.select(F.col("k.doc_id").alias("doc_id"), F.col("k.th").alias("th"), F.col("k.n").alias("n")), "kept")
    same = grouped.doc_id.eqNullSafe(kept.doc_id) & (grouped.th == kept.th)
    gone = stored(grouped.join(kept, same, "left_anti").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "gone")
    twice = stored(kept.where("n > 1").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")), "twice")
    release(grouped, kept)
    of = lambda keys: docs["doc_id"].eqNullSafe(keys["_id"]) & (F.xxhash64(docs["text"]) == keys["_th"])
    lost = small(gone)
    out = docs.join(lost, of(lost), "left_anti")
    if twice.isEmpty():
        return out
    again = small(twice)
    names = [named(c) for c in docs.columns]
    rest = F.to_json(F.struct(*[named(c) for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_")))
    rows = docs.join(again, of(again), "left_semi").select(F.struct(*names).alias("row"), F.col("doc_id").alias("k"), F.xxhash64("text").alias("h"), rest.alias("rest"))
    single = rows.groupBy("k", "h").agg(F.min_by("row", "rest").alias("row")).select("row.*")
    return out.join(again, of(again), "left_anti").union(single)
