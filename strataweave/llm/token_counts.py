"""Token counts with a whole-token shortcut for a sentencepiece BPE vocabulary.

``prove`` shows two things once, on the driver and without any corpus:

* no piece has a space mark after another character, so merges never reach
  across the start of a *pre-token* (a run of space marks and the characters up
  to the next), and a text's tokens are those of its pre-tokens in order;
* which pieces of one space mark and further characters the library encodes as
  that one token; these pre-tokens count one without merging.

All other pre-tokens are merged by the library itself, and remembered in a
bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Pre-tokens remembered by a worker, besides the proven ones; then the table starts anew.
REMEMBERED = 200_000


def prove(path: str) -> frozenset[str]:
    """The pre-tokens, without their mark, that are one token; an error if pre-tokens are not independent."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    crossing = [p for p in pieces if MARK in p.lstrip(MARK)]
    if crossing:
        raise ValueError(f"pieces with an inner space mark, such as {crossing[0]!r}: pre-tokens are not independent")
    words = [(p[1:], i) for i, p in enumerate(pieces) if p.startswith(MARK) and p[1:2] not in ("", MARK)]
    proven = {w for (w, i), ids in zip(words, sp.encode([w for w, _ in words], num_threads=1), strict=True) if ids == [i]}
    if MARK in pieces:  # a mark at the end of a text, which the library gives no way to ask for alone
        proven.add("")
    return frozenset(proven)


class Counts(dict):
    """Pre-token without its mark -> number of tokens; the library merges those that are not proven."""

    def __init__(self, path: str, proven: frozenset[str]):
        import sentencepiece

        super().__init__(dict.fromkeys(proven, 1))
        self.sp, self.proven = sentencepiece.SentencePieceProcessor(model_file=path), proven

    def __missing__(self, word: str) -> int:
        if len(self) > len(self.proven) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        n = len(self.sp.encode(word, num_threads=1))
        if len(word) < 200:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of the whole text, as the library counts them."""
        if not text:
            return 0
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return sum(map(self.__getitem__, parts))
        # an empty part is one more mark in front of the next part that is not empty
        n, marks = 0, 0
        for part in parts[:-1]:
            if part:
                n += self[" " * marks + part] if marks else self[part]
                marks = 0
            else:
                marks += 1
        return n + self[" " * marks + parts[-1]]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``.

    A null text counts as empty: no bytes, no tokens. Rows keep their number;
    a null id stays null. Texts of any length are counted whole. ``model_path``
    must be readable by every worker and by the driver, which sends the proven
    pre-tokens (bounded by the vocabulary) to the workers once. An empty table
    gives an empty result; further columns are ignored.
    """
    proven = docs.sparkSession.sparkContext.broadcast(prove(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Counts(model_path, proven.value)
        for b in batches:
            text = b.column(1)
            n = pa.array((known.count(t.as_py()) if t.is_valid else 0 for t in text), type=pa.int64())
            size = pc.cast(pc.fill_null(pc.binary_length(text), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
