"""BM25 scored where the documents lie equals BM25 from postings, and shuffles little."""

import random

from pyspark.sql import functions as F

from quillmesh.operators import retrieval as R


def test_scores_by_document_equal_scores_from_postings(spark, monkeypatch):
    r = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, [r.choice(words) for _ in range(r.choice([0, 1, 5, 300]))]) for i in range(700)]
    docs += [(900, None), (901, ["other"]), (902, ["w1"] * 3), (903, ["w1"] * 3)]
    tokens = spark.createDataFrame(docs, "doc_id int, tokens array<string>").repartition(5)
    queries = spark.createDataFrame([("a", ["w1", "w1", "w2"]), ("b", ["none"]), ("c", words), ("d", [])], "query_id string, terms array<string>")
    seen = lambda df: {(x.query_id, x.doc_id, round(x.score, 9), x["rank"]) for x in df.collect()}
    quick = R.bm25(tokens, queries, k=30)
    assert "MapInArrow" in quick._jdf.queryExecution().toString()
    assert quick.schema["doc_id"].dataType.simpleString() == "int"
    monkeypatch.setattr(R, "DENSE_WEIGHTS", 0)
    slow = R.bm25(tokens, queries, k=30)
    assert seen(quick) == seen(slow) and len(seen(quick)) == 60
    monkeypatch.undo()
    twice = tokens.unionAll(tokens.where("doc_id < 20"))
    assert "MapInArrow" not in R.bm25(twice, queries)._jdf.queryExecution().toString()
    assert R.bm25(tokens.where(F.lit(False)), queries).count() == 0
