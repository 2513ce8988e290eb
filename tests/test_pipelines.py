"""Index building and retrieval end to end on a small corpus."""

from pyspark.sql import functions as F

from tierlink.functions import hooks
from tierlink.plans import pipelines


def test_index_and_retrieval(spark, tmp_path):
    docs = spark.createDataFrame([("1", "Ada is author of Notes here"), ("2", "Bob knows Ada well"), ("3", "nothing here")], "doc_id string, text string")
    facts = spark.createDataFrame(
        [("4", "Ada", "born in", "London", "table", "t#row0", 0.8), ("5", "img", "describes", "Bob", "image", "img", 0.5), ("4", "x", "y", "z", "table", "t#row1", 0.8)],
        "doc_id string, head string, relation string, tail string, modality string, source_ref string, confidence double",
    )
    ids = docs.select("doc_id").union(spark.createDataFrame([("4",)], "doc_id string"))
    index = pipelines.build_index(pipelines.extract(docs), facts, ids, spark.createDataFrame([("5",)], "doc_id string"))
    assert {tuple(r) for r in index.edges.collect()} == {("ada", "is author of", "notes"), ("bob", "knows", "ada")}
    assert {tuple(r) for r in index.doc_entity.collect()} == {("1", "ada"), ("1", "notes"), ("2", "bob"), ("2", "ada"), ("4", "ada")}
    assert {tuple(r) for r in index.image_entity.collect()} == {("5", "bob")}
    index.write(str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/edges")).count() == 2
    got = pipelines.retrieve(spark.createDataFrame([(1, "Where is Notes by Ada"), (2, "bob")], "sample_id int, question string"), index)
    ranked = {r["sample_id"]: [] for r in got.collect()}
    for r in got.orderBy("sample_id", "position").collect():
        ranked[r["sample_id"]].append(r["doc_id"])
    assert ranked[1][0] == "1" and set(ranked[1]) == {"1", "2", "4"}
    assert set(ranked[2]) == {"2", "5"}


def test_hooks_can_be_replaced(spark):
    old = hooks._KINDS["generate"]
    try:
        hooks.register("generate", lambda p: p.upper())
        assert spark.range(1).select(hooks.apply("generate", F.lit("a b")).alias("r")).first()["r"] == "A B"
    finally:
        hooks._KINDS["generate"] = old
    v = spark.range(1).select(hooks.apply("embed", F.lit("x y")).alias("v")).first()["v"]
    assert len(v) == hooks.DIMENSIONS and abs(sum(x * x for x in v) - 1) < 1e-9
