import pytest

from tests.llm import texts

pytest.importorskip("public_tokenizers")


def test_stages_in_turn(spark, tmp_path):
    import corpus_pipeline as cp

    item = texts.prose(45, 88)
    rows = texts.documents() + [(100 + i, texts.prose(90, 200 + i), "en", f"s{i % 3}", 0) for i in range(40)] + [(300, texts.prose(30, 90) + " " + item + " " + texts.prose(30, 91), "en", "s1", 0)]
    spark.createDataFrame(rows, texts.SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100, 140, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs)
    ids = [{r["doc_id"] for r in s.select("doc_id").distinct().collect()} for s in seen]
    assert not {2, 3, 4, 5, 6, 14} & ids[0] and set(range(100, 140)) <= ids[0]
    assert {0, 9, 16, 300} <= ids[1] and not {1, 10, 11} & ids[1] and seen[1].count() == len(ids[1])
    assert ids[1] - ids[2] == {300}
    assert ids[3] <= ids[2] and ids[4] == ids[3] and seen[4].count() == seen[3].count()
    order = [r["doc_id"] for r in seen[3].select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    assert [r["doc_id"] for r in seen[4].orderBy("start").collect()] == order and order != sorted(order, key=lambda i: (i is not None, i))
    whole = {tuple(r) for r in cp.run(spark, str(tmp_path)).collect()}
    assert whole == {tuple(r) for r in seen[4].collect()}


def test_columns_of_the_caller_come_through(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [r for r in texts.documents() if r[0] != 7 and r[0] != 8] + [(100 + i, texts.prose(90, 200 + i), None, f"s{i % 3}", None) for i in range(20)]
    own = ["copy", "_mix_key", "kept", "cut", "llr", "n_words", "row", "print", "component", "class"]
    docs = spark.createDataFrame(rows, texts.SHAPE)
    for k, c in enumerate(own):
        docs = docs.withColumn(c, docs["doc_id"] * 1000 + k)
    spark.createDataFrame([(i, 1, None) for i in range(100, 120, 2)] + [(101, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for number, (_, stage) in enumerate(cp.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        assert docs.count() > 10
        for r in docs.where("doc_id is not null").collect():
            assert [r[c] for c in own] == [r["doc_id"] * 1000 + k for k in range(len(own))]
    assert cp.token_stage(spark, docs, str(tmp_path)).count() == docs.count()


def test_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], texts.SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
