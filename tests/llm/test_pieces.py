"""Workers take few rows at a time, whatever batches Spark sends."""

from strataweave.llm import common, weak_pii


def test_personal_data_goes_by_pieces(spark, monkeypatch):
    rows = [(i, None if i % 7 == 0 else f"mail a{i}@example.com now") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def once(df):
        found = weak_pii.candidate_rows(df)
        return sorted(map(tuple, found.collect())), sorted(map(tuple, weak_pii.mask(df, weak_pii.fit(found)).collect()))

    whole = once(docs)
    assert ("[EMAIL]" in whole[1][1][1]) and len(whole[1]) == 30
    monkeypatch.setattr(weak_pii, "pieces", lambda batches: common.pieces(batches, 4))
    assert once(docs) == whole
