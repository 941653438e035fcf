"""Structure repair of conversations: the cheapest edits that make roles alternate, found by cost layers of state bitsets.

A conversation is sound if its turns' role initials read ``(s?(ua)+)?``. That is a
grammar of four states: nothing yet, after s, after u, after a; the first and the
last accept. Before each turn a word of 16 layers of four bits tells from which
states the rest can be accepted at which cost: bit ``q`` of layer ``k`` is set if it
can from ``q`` at ``base + k``. All layers and states go through a turn at once:
keeping a turn is a mask and a shift by the states' distance, an edit of cost ``c``
shifts ``c`` layers further up. What the states need differs by 15 at most (any of
them gets to any other's continuation by two insertions and one deletion), so 16
layers are all there is to know, and a turn costs a word however long the
conversation is. The first layer with the start's bit is the least cost. The
bit-trace then goes forward and takes, of the edits whose target has its bit in the
layer that is left, the one with the least letter: a letter and a state determine
the next state, so this is the least audit of all cheapest ones.

Conversations of usual size are whole in one task. A longer one is cut into
segments of bounded size by its order. Each segment's task runs the words once for
each state at its end, which gives a 4 x 4 table of costs; a conversation's tables
are put together from its end to its start; then its turns stream through one task
in order, a segment at a time, since its digest has to read them in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import BLANKS, release, small, stored

#: Costs of the edits; a truncated turn that is not deleted costs ``TRUNCATED`` more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: Turns and bytes up to which a conversation, or a segment of a longer one, is held by a task.
LONG_TURNS, LONG_BYTES = 20_000, 32 << 20

_LAYERS = 16
_BIT = [sum(1 << (4 * k + q) for k in range(3 * _LAYERS)) for q in range(4)]
_WINDOW = (1 << 4 * _LAYERS) - 1
#: The state after a turn with this initial, by the state before; edits give only u and a.
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_FULL = {"u": "user", "a": "assistant"}
_GIVES = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_LEGAL = {"su", "ua", "au"}


def _before(word: int, initial: str) -> int:
    """The states from which a turn with this initial leads into the word's."""
    if initial == "u":
        to = word & _BIT[USER]
        return to >> 2 | to >> 1 | to << 1
    if initial == "a":
        return (word & _BIT[ASSISTANT]) >> 1
    return (word & _BIT[SYSTEM]) >> 1 if initial == "s" else 0


def _inserted(word: int) -> int:
    """The word with insertions; more than two in a row never help."""
    for _ in range(2):
        word |= (_before(word, "u") | _before(word, "a")) << 4 * INSERT
    return word


def _based(word: int, base: int) -> tuple[int, int]:
    if not word:
        return 0, base
    empty = ((word & -word).bit_length() - 1) // 4
    return word >> 4 * empty & _WINDOW, base + empty


def layers(turns: list[tuple[str, str]], after: list[int | None]) -> list[tuple[int, int]]:
    """``(word, base)`` before each of ``turns(initial, fault)`` and after the last; ``after`` has each state's cost there, None if it has none."""
    known = [c for c in after if c is not None]
    low = min(known, default=0)
    word = sum(1 << 4 * (c - low) + q for q, c in enumerate(after) if c is not None)
    out = [_based(_inserted(word), low)]
    for initial, fault in reversed(turns):
        word, base = out[-1]
        found = word << 4 * DELETE
        if fault not in ("blank", "duplicate"):
            more = 4 * TRUNCATED if fault == "truncated" else 0
            found |= _before(word, initial) << more
            found |= (_before(word, "u") | _before(word, "a")) << more + 4 * REROLE
        out.append(_based(_inserted(found), base))
    return out[::-1]


def left(at: tuple[int, int], state: int) -> int | None:
    """The least cost from ``state`` on."""
    bits = at[0] & _BIT[state]
    return at[1] + ((bits & -bits).bit_length() - 1) // 4 if bits else None


def trace(turns: list[tuple[str, str]], at: list[tuple[int, int]], state: int, last: bool) -> tuple[list[tuple[str, int, str]], int]:
    """``(edit, turn, initial)`` of the least audit from ``state`` on, and the state at the end; insertions at the end are made only by the ``last`` segment."""
    out, i = [], 0
    while True:
        cost = left(at[i], state)
        gives = _GIVES[state]
        if i < len(turns):
            initial, fault = turns[i]
            if left(at[i + 1], state) == cost - DELETE:
                out.append(("D", i, ""))
                i += 1
                continue
        elif not last or cost == 0:
            return out, state
        to = _NEXT[gives][state]
        if left(at[i], to) == cost - INSERT:
            out.append(("I", i, gives))
            state = to
            continue
        more = TRUNCATED if fault == "truncated" else 0
        kept = _NEXT.get(initial, {}).get(state)
        if kept is not None and left(at[i + 1], kept) == cost - more:
            out.append(("K", i, initial))
            state = kept
        else:
            out.append(("R", i, gives))
            state = to
        i += 1


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with planted faults and ``live``: false for a turn that is dropped.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops a turn, 1 empties its text, 2
    removes its full stops, question and exclamation marks, 3 repeats it, 4
    makes its role user. Nulls count as one blank; a null turn number stays null.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    role = F.when(kind == 4, "user").otherwise(told("role"))
    times = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("live"), times.alias("_time")).drop("_time")


def _described(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows with what the repair asks of each: initial, whether blank or cut off, and a digest of role and text."""
    live = F.coalesce(F.col("live"), F.lit(False)) if "live" in rows.columns else F.lit(True)
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    a = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), r.alias("role"), t.alias("text"), live.alias("live"))
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return a.select("*", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"), digest.alias("digest"))


#: What is counted along a conversation: sums, the outer initials, and the outer turn numbers.
SUMS = ("n_blank", "n_duplicate", "n_truncated", "n_illegal", "n_turns")
FIELDS = dict.fromkeys(SUMS, "long") | {"first": "string", "last": "string", "low": "long", "high": "long"}


class Counts:
    """Counts along a conversation, or a segment of one, in order."""

    def __init__(self, **known: object) -> None:
        for c in FIELDS:
            setattr(self, c, known.get(c, 0 if c in SUMS else None))

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        one = Counts(first=initial, last=initial, low=turn, high=turn, n_turns=int(turn is not None))
        if fault:
            setattr(one, f"n_{fault}", 1)
        self.join(one)

    def join(self, after: Counts) -> None:
        """Adds what follows."""
        if self.last is not None and after.first is not None:
            self.n_illegal += self.last + after.first not in _LEGAL
        if self.high is not None and self.high == after.low:
            self.n_turns -= 1
        for c in SUMS:
            setattr(self, c, getattr(self, c) + getattr(after, c))
        for c, before in (("first", True), ("last", False), ("low", True), ("high", False)):
            x, y = getattr(self, c), getattr(after, c)
            x, y = (x, y) if before else (y, x)
            setattr(self, c, y if x is None else x)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.n_turns


def _fault(blank: bool, again: bool, cut: bool) -> str:
    return "blank" if blank else "duplicate" if again else "truncated" if cut else ""


def _by(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    """Runs of rows with equal keys, over rows sorted by them."""
    run, key = [], None
    for b in batches:
        for r in b.to_pylist():
            if run and (k := tuple(r[c] for c in keys)) != key:
                yield run
                run = []
            if not run:
                key = tuple(r[c] for c in keys)
            run.append(r)
    if run:
        yield run


class Sink:
    """Results as batches: a row a conversation with counts, cost, audit and digest, or with ``each`` a row an edit."""

    def __init__(self, schema: pa.Schema, each: bool) -> None:
        self.schema, self.each, self.rows, self.held = schema, each, [], 0

    def open(self, conv: object) -> None:
        self.conv, self.audit, self.place, self.sha, self.any = conv, [], 0, hashlib.sha256(), False

    def edits(self, found: list[tuple[str, int, str]], rows: list[dict]) -> None:
        for edit, i, initial in found:
            role, text = ("", "") if edit == "I" else (rows[i]["role"], rows[i]["text"])
            role = _FULL[initial] if edit in "IR" else role
            if self.each:
                self._put({"conv_id": self.conv, "place": self.place, "edit": edit, "role": role, "text": text}, len(text))
            elif edit != "D":
                self.sha.update(("\n" * self.any + role + ":" + text).encode("utf-8", "surrogatepass"))
                self.any = True
            self.place += 1
        if not self.each:
            self.audit.append("".join(e for e, _, _ in found))

    def close(self, c: Counts, cost: int) -> None:
        if not self.each:
            counts = {"gaps": c.gaps, "blank": c.n_blank, "duplicate": c.n_duplicate, "truncated": c.n_truncated, "illegal": c.n_illegal}
            self._put({"conv_id": self.conv, **counts, "cost": cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}, 200)

    def _put(self, row: dict, size: int) -> None:
        self.rows.append(row)
        self.held += size + 50

    def full(self, bound: int = 4 << 20) -> Iterator[pa.RecordBatch]:
        """What is held, once it is more than ``bound``."""
        if self.held > bound:
            yield pa.RecordBatch.from_pylist(self.rows, self.schema)
            self.rows, self.held = [], 0


def _usual(rows: DataFrame, out: StructType, each: bool) -> DataFrame:
    """Conversations that a task holds as a whole."""
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(schema, each)
        for whole in _by(batches, "conv_id"):
            counts, seen, turns = Counts(), set(), []
            for r in whole:
                fault = _fault(r["blank"], r["digest"] in seen, r["cut"])
                seen.add(r["digest"])
                counts.add(r["turn"], r["initial"], fault)
                turns.append((r["initial"], fault))
            at = layers(turns, [0, None, None, 0])
            sink.open(whole[0]["conv_id"])
            sink.edits(trace(turns, at, START, True)[0], whole)
            sink.close(counts, left(at[0], START))
            yield from sink.full()
        yield from sink.full(0)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(run, out)


def _long(rows: DataFrame, segments: int, out: StructType, each: bool) -> DataFrame:
    """Conversations by segments: turns by ranges of their order, each range's costs, then one stream a conversation."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = stored(rows.withColumn("_id", F.monotonically_increasing_id()), "turns")  # equal turns are told apart, so that they can be cut
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "_id"]
    cut = numbered.repartitionByRange(segments, *order).sortWithinPartitions(*order)
    cut = stored(cut.select("*", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part")).drop("_id"), "segments")
    release(numbered)
    again = cut.groupBy("conv_id", "digest").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = stored(again.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "_first"), "again")
    flagged = cut.join(small(again), cut.conv_id.eqNullSafe(F.col("_conv")) & (cut.digest == F.col("_digest")), "left")
    flagged = stored(flagged.withColumn("again", F.coalesce(F.col("at") > F.col("_first"), F.lit(False))).drop("_conv", "_digest", "_first", "digest"), "flagged")
    release(cut, again)

    conv = out["conv_id"]
    counted = [StructField(c, LongType() if t == "long" else StringType()) for c, t in FIELDS.items()]
    piece, costs = StructField("part", IntegerType()), ArrayType(LongType())
    described_as = StructType([conv, piece, StructField("costs", costs), *counted])
    planned_as = StructType([conv, piece, StructField("after", costs), StructField("final", BooleanType()), StructField("cost", LongType()), *counted])
    out_arrow, described_arrow, planned_arrow = map(to_arrow_schema, (out, described_as, planned_as))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _by(batches, "conv_id", "part"):
            counts, turns = Counts(), []
            for r in run:
                fault = _fault(r["blank"], r["again"], r["cut"])
                counts.add(r["turn"], r["initial"], fault)
                turns.append((r["initial"], fault))
            ends = [layers(turns, [0 if q == end else None for q in range(4)])[0] for end in range(4)]
            costs = [left(ends[end], q) for q in range(4) for end in range(4)]
            yield pa.RecordBatch.from_pylist([{"conv_id": run[0]["conv_id"], "part": run[0]["part"], "costs": costs, **vars(counts)}], described_arrow)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _by(batches, "conv_id"):  # a row a segment, the last first
            after, steps, whole = [0, None, None, 0], [], Counts()
            for r in run:
                steps.append({"conv_id": r["conv_id"], "part": r["part"], "after": after, "final": not steps})
                ways = [[c + a for c, a in zip(r["costs"][4 * q : 4 * q + 4], after, strict=True) if c is not None and a is not None] for q in range(4)]
                after = [min(w, default=None) for w in ways]
            for r in reversed(run):
                whole.join(Counts(**{c: r[c] for c in FIELDS}))
            yield pa.RecordBatch.from_pylist([s | {"cost": after[START]} | vars(whole) for s in steps], planned_arrow)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, state, opened = Sink(out_arrow, each), START, False
        for run in _by(batches, "conv_id", "part"):
            r = run[0]
            if not opened:
                sink.open(r["conv_id"])
                state, opened = START, True
            turns = [(x["initial"], _fault(x["blank"], x["again"], x["cut"])) for x in run]
            found, state = trace(turns, layers(turns, r["after"]), state, r["final"])
            sink.edits(found, run)
            if r["final"]:
                sink.close(Counts(**{c: r[c] for c in FIELDS}), r["cost"])
                opened = False
            yield from sink.full()
        yield from sink.full(0)

    light = flagged.select("conv_id", "part", "at", "turn", "initial", "blank", "again", "cut").repartition(n, "conv_id", "part")
    described = stored(light.sortWithinPartitions("conv_id", "part", "at").mapInArrow(describe, described_as), "costs")
    ranked = described.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.desc("part"))
    plans = stored(ranked.mapInArrow(put_together, planned_as), "plans")
    release(described)
    steps = plans.withColumnsRenamed({"conv_id": "_conv", "part": "_part"})
    joined = flagged.join(small(steps), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))).drop("_conv", "_part")
    return joined.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "at").mapInArrow(stream, out)


def repair(rows: DataFrame, each: bool = False, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", long_turns: int = LONG_TURNS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The cheapest repair of every conversation of ``rows``.

    One row ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256)`` per conversation, or with ``each`` one row ``(conv_id,
    place, edit, role, text)`` per edit: the turns of the repaired conversation in
    order, deleted ones (D) among them. Turns are taken by number, nulls first,
    those of one number by role, then text. A turn's first fault counts: blank,
    a repetition of an earlier role and text, or an end without ``.``, ``!`` or
    ``?``. Null roles and texts count as one blank; an empty role has no legal
    neighbour. Rows whose column ``live`` is false or null are not there; a
    conversation without others has zeros, an empty audit and the digest of an
    empty text. A null conv_id is a conversation. Repeated rows are turns like
    others. An empty table gives an empty result; further columns are ignored.
    """
    all_rows = _described(rows, conv_id, turn, role, text)
    there = all_rows.where("live")
    size = F.sum(F.when(F.col("live"), F.octet_length("role") + F.octet_length("text")).cast("long"))
    sizes = stored(all_rows.groupBy("conv_id").agg(F.count_if("live").alias("n"), size.alias("bytes")), "sizes")
    long = (F.col("n") > long_turns) | (F.col("bytes") > long_bytes)
    n_long = sizes.agg(F.count_if(long).alias("n"), F.sum(F.when(long, F.col("n"))).alias("turns"), F.sum(F.when(long, F.col("bytes"))).alias("bytes")).first()
    conv = StructField("conv_id", all_rows.schema["conv_id"].dataType)
    whole = [StructField(c, LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [StructField(c, StringType()) for c in ("audit", "repaired_sha256")]
    edit = [StructField("place", LongType())] + [StructField(c, StringType()) for c in ("edit", "role", "text")]
    out = StructType([conv, *(edit if each else whole)])
    if not n_long.n:
        done = _usual(there, out, each)
    else:
        ids = small(sizes.where(long).select(F.col("conv_id").alias("_conv")), n_long.n)
        same = there.conv_id.eqNullSafe(F.col("_conv"))
        segments = 1 + max(n_long.turns // max(1, long_turns), n_long.bytes // max(1, long_bytes))
        done = _usual(there.join(ids, same, "left_anti"), out, each).unionByName(_long(there.join(ids, same, "left_semi"), segments, out, each))
    if each:
        return done
    zeros = [F.lit(0).cast("long").alias(f.name) for f in whole[:6]]
    nothing = sizes.where("n = 0").select("conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    return done.unionByName(nothing)
