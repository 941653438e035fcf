"""Quality rules: text statistics as DataFrame expressions, and a learned decision list.

The list is grown by sequential covering from labelled rows: a rule is a
conjunction of thresholds, grown condition by condition on two thirds of the
rows by information gain, pruned from the end on the other third, and taken if
it is right often enough there; the rows it covers are set aside and the next
rule follows. The rules become one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, blank_words, named

SYMBOLS = "#*$%&|<>"
WINDOW = 8


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text and with the statistics of the whole text.

    ``n_words``; ``word_chars``, code points in words; ``n_symbols``,
    characters of ``#*$%&|<>``; ``n_lines`` with a word; ``n_dup_lines`` of
    them equal to an earlier line; ``n_repeat_words``, words in windows of
    eight that occur twice or more in the text. Null counts as empty. Windows
    are compared by 64-bit hashes of their words' hashes. One row each, no
    shuffle; repeated rows stay; an empty table gives an empty result. A column
    of ``docs`` with the name of a statistic gives way to it.
    """
    others = [c for c in docs.columns if c != text and c not in STATISTICS]
    keep = [F.col("_in")[c].alias(c) for c in others]
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(whole, BLANKS, "")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    a = docs.select(
        F.struct(F.lit(0).alias("_0"), *[named(c) for c in others]).alias("_in"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(blank_words(F.col(text)), lambda w: F.xxhash64(w)).alias("words"),  # each word is hashed once
    )
    last = F.size("words") - (WINDOW - 1)
    hashes = F.when(last > 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    b = a.select(
        "_in", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("hashes"),
    )
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    ordered = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)
    c = b.withColumn("ordered", ordered).drop("hashes")
    twice = F.filter("ordered", lambda x, k: (F.get("ordered", k - 1).h.eqNullSafe(x.h)) | (F.get("ordered", k + 1).h.eqNullSafe(x.h)))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        F.array_sort(F.transform(twice, lambda x: x.i)),
        start,
        lambda acc, i: F.struct((acc.n + i + WINDOW - F.greatest(acc.end, i)).cast("long").alias("n"), (i + WINDOW).alias("end")),
        lambda acc: acc.n,
    )
    repeats = F.when(F.size("ordered") > 0, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words")
    # a generator of one row: filters on the statistics stay above it, else they would be computed again in each filter, word by word
    return c.select(*keep, F.inline(F.array(F.struct("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats))))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What rules may test, from the columns of ``text_statistics``."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
        "duplicate_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """All of ``feature <= or > threshold`` hold: the text is rejected."""

    conditions: tuple[tuple[str, str, float], ...]

    def expression(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, at in self.conditions:
            out = out & (columns[name] <= at if op == "<=" else columns[name] > at)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {at:g}" for n, op, at in self.conditions)


def _hold(x: dict[str, np.ndarray], conditions: tuple, n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for name, op, at in conditions:
        out &= x[name] <= at if op == "<=" else x[name] > at
    return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray, precision: float = 0.9, least: int = 8, longest: int = 3, most_rules: int = 12) -> list[Rule]:
    """Rules for the rows ``bad``; ``grow`` marks the rows to grow on, the others prune and test."""
    n, left, rules = len(bad), np.ones(len(bad), dtype=bool), []
    cuts = {k: (u[:-1] + u[1:]) / 2 for k, v in x.items() if len(u := np.unique(np.quantile(v, np.linspace(0, 1, 65)))) > 1} if n else {}  # halfway between values: room on either side
    while len(rules) < most_rules and n:
        g, conditions, inside = left & grow, (), left & grow
        while len(conditions) < longest and (bad & inside).sum() >= least and (~bad & inside).any():
            p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
            prior, best = math.log2(p0 / (p0 + n0)), (0.0, None)
            for name, at_all in cuts.items():
                v = x[name][inside]
                b = bad[inside]
                for at in at_all:
                    low = v <= at
                    for op, m in (("<=", low), (">", ~low)):
                        p, q = int((b & m).sum()), int((~b & m).sum())
                        if p >= least and p + q < p0 + n0 and (gain := p * (math.log2(p / (p + q)) - prior)) > best[0]:
                            best = (gain, (name, op, float(at)))
            if best[1] is None:
                break
            conditions += (best[1],)
            inside = g & _hold(x, conditions, n)
        if not conditions:
            break
        test = left & ~grow

        def worth(c: tuple, test: np.ndarray = test) -> float:
            m = test & _hold(x, c, n)
            p, q = int((bad & m).sum()), int((~bad & m).sum())
            return (p - q) / max(1, p + q)

        conditions = max((conditions[:k] for k in range(len(conditions), 0, -1)), key=worth)
        m = test & _hold(x, conditions, n)
        if (bad & m).sum() < max(2, least // 4) or (bad & m).sum() < precision * m.sum():
            break
        rules.append(Rule(conditions))
        left &= ~_hold(x, conditions, n)
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, **options: float) -> list[Rule]:
    """A decision list from at most about ``max_rows`` labelled rows.

    ``labels(doc_id, quality)``, quality 0 is bad; rows with a null are left
    out. If there are more, those whose hashed id falls below a share are
    taken; the bound makes the labels' side of the join small enough to
    broadcast and the statistics small enough for the driver. Equal label rows
    count once, a document with two labels is two rows, repeated documents are a
    row each. No labels or no documents: no rules.
    """
    labels = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").distinct()
    n = labels.count()
    if n > max_rows:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    of = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")
    cols = features()
    rows = text_statistics(of).where(~base_failed()).select("doc_id", "quality", *[c.alias(k) for k, c in cols.items()]).collect()
    rows.sort()
    x = {k: np.array([r[k] for r in rows], dtype=float) for k in cols}
    bad = np.array([r["quality"] == 0 for r in rows], dtype=bool)
    return learn(x, bad, np.arange(len(rows)) % 3 > 0, **options)


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: false at the first rule that holds, true if none does."""
    cols, out = features(), F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.expression(cols), F.lit(False)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` without its text and with statistics, ``base_failed`` and ``kept``.

    A null or empty text has no words, so it fails the base rules. Repeated
    rows stay; an empty table gives an empty result. Columns of ``docs`` with the
    name of a new one give way.
    """
    out = text_statistics(docs.drop("base_failed", "kept")).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs``, all columns, that pass."""
    with_copy = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("_row"), F.col("text"))
    return judge(with_copy, rules).where("kept").select("_row.*")
