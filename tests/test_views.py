"""Document-entity rows: without a shuffle if ids are single, distinct in any case."""

from tierlink.plans import views as V


def test_document_entities(spark, tmp_path):
    for name, rows in (("single", [(1, "word word other"), (2, None), (3, "word")]), ("repeated", [(1, "word word"), (1, "word other"), (None, "word"), (None, "word")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found = V.doc_entities(spark, f"{tmp_path}/{name}")
        words = [(i, w) for i, t in rows for w in (t or "").split()]
        assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(set(words), key=str)
        assert ("Aggregate" in found._jdf.queryExecution().executedPlan().toString()) == (name == "repeated")
