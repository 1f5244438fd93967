import os

import pytest
import test_decontamination
import test_exact_dedup
import test_jaccard_join

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pipeline_matches_brute_force(spark):
    import corpus_pipeline
    from eventlake.llm import language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    guess = {d: model.predict(t) for d, t in rows}
    rows = [(d, t) for d, t in rows if guess[d][0] != "und" and guess[d][1] >= 0.5]
    keep = {k for _, k, _, _ in test_exact_dedup.brute(rows)}
    rows = [r for r in rows if r[0] in keep]
    keep = {c for _, _, c in test_jaccard_join.brute(rows)}
    rows = [r for r in rows if r[0] in keep]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {d for d, *_ in test_decontamination.brute([r for r in rows if near_item(r[1], items)], items)}
    want = {d: len(t.encode().split()) for d, t in rows if d not in gone}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == {d: n for d, n in want.items() if n} and len(gone) > 0


def near_item(text, items):
    """Whether a text shares a window of three words with an item; the brute force is slow on the others, which can't hold one."""
    low = lambda t: test_decontamination.words(t.lower())
    mine = low(text)
    mine = {tuple(mine[i : i + 3]) for i in range(len(mine) - 2)}
    return any(mine & {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for _, t in items for w in [low(t)])


def test_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    english, german = "the cat sat on the mat with a hat and the dog", "der hund und die katze sind auf dem dach ßü"
    data = [(i, (english if i % 2 else german) + f" w{i}a w{i}b w{i}c w{i}d w{i}e w{i}f", "en" if i % 2 else "de", None, None) for i in range(40)]
    data += [(100, data[3][1].replace(" ", "\n"), "en", None, None), (101, None, None, None, None), (102, "", None, None, None), (103, "12 34", "en", None, None), (None, english + " zz yy xx", None, "s", 1)]
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "an item that no text holds at all"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == schema.replace("string", "").replace("long", "").replace(" ", "").split(",")
            out.write.parquet(str(tmp_path / f"s{i}"))
            docs = spark.read.schema(out.schema).parquet(str(tmp_path / f"s{i}"))
        seen.append(out.count())
    assert seen[0] == 42 and seen[1] == 41 and seen[2] == seen[3] == 41 and seen[4] == 41


def test_empty_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
