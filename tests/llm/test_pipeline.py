"""The five stages, each on what the one before kept, against plain Python."""

import public_tokenizers
import pytest
from test_pairs import plain_contamination, plain_copies
from test_rows import statistics
from tokenizers import Tokenizer

import corpus_pipeline as cp
from strataweave.llm import decision_list as dl
from strataweave.llm import weak_pii as wp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(cp.STAGES)
    assert list(steps) == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    at = {"input": docs}
    last = "input"
    for name, stage in cp.STAGES:
        at[name] = written(stage(spark, at[last], sf), tmp_path / name)
        last = name
        if name != "packing":
            assert at[name].columns == COLUMNS
    rows = {name: {r.doc_id: r.text for r in df.collect()} for name, df in at.items() if name != "packing"}

    rules = dl.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

    def good(text):
        s = dict(zip(names, statistics(text), strict=True))
        per = lambda a, b: s[a] / max(1, s[b])
        x = {"words": s["n_words"], "chars_per_word": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"), "words_per_line": per("n_words", "n_lines"), "duplicate_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words")}
        if s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]:
            return False
        return not any(all(x[f] <= c if op == "<=" else x[f] > c for f, op, c in r.conditions) for r in rules)

    assert rows["quality"] == {i: t for i, t in rows["input"].items() if good(t)}
    data = sorted(rows["quality"].items())
    least = {}
    for (i, _), g in zip(data, plain_copies(data), strict=True):
        least[g] = min(least.get(g, i), i)
    assert rows["near_duplicates"] == {i: rows["quality"][i] for i in least.values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {r[0] for r in plain_contamination(sorted(rows["near_duplicates"].items()), items) if r[-1]}
    assert rows["decontamination"] == {i: t for i, t in rows["near_duplicates"].items() if i not in hit}
    model = wp.fit(wp.candidate_rows(at["decontamination"]))
    assert rows["personal_data"] == {i: wp.redact(t, wp.find(t, model, {})) for i, t in rows["decontamination"].items()}
    assert not any(wp.base_spans(t) for t in rows["personal_data"].values())
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in rows["personal_data"].items()}
    got = {}
    for r in at["packing"].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


@pytest.mark.parametrize("which", ["docs", "empty"])
def test_stages_on_edges(spark, sf, tmp_path, request, which):
    """Nulls, blanks, repeats and clashing columns, and no rows at all: every stage runs and keeps the columns."""
    frame = request.getfixturevalue(which)
    for name, stage in cp.STAGES:
        out = stage(spark, frame, sf)
        if name != "packing":
            assert out.columns == frame.columns
        n = out.count()
        assert n <= frame.count() or name == "packing"
        if name == "personal_data":
            assert n == frame.count()
