"""Cases that tables of a larger scale, or texts in other letters, bring."""

from quillmesh.functions import text as T
from quillmesh.plans import ranking_queries as RQ


def test_endings_after_accented_letters_count(spark):
    rows = spark.createDataFrame([("the ñga ñga ñga",), ("the gañ gañ gañ",), ("the goga",), ("the of to",), ("the dagañu",)], "t string").select(T.language_of("t").alias("l")).collect()
    assert [r.l.lang for r in rows] == ["uz", "uz", "en", "en", "en"]


def test_five_fifths_are_one(spark):
    rows = spark.createDataFrame([("x " * n + "the " * m,) for n, m in ((5, 1), (15, 3), (35, 7), (36, 7))], "t string").select(T.language_of("t").alias("l")).collect()
    assert [r.l.lang for r in rows] == ["en", "en", "en", "uz"]


def test_an_order_may_bear_the_number_of_a_part(spark, tmp_path):
    spark.createDataFrame([(1000007, 1, 9.0), (5, 1, 8.0)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(5, 7), (1000007, 8)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(RQ.graph_expansion(spark, str(tmp_path)).collect()) == [(1, 1000007, 3.2), (1, 1000008, 3.6)]


def test_a_code_is_named_where_a_word_begins(spark):
    asked = ["31-modda erlyer relyer", "31-modda yerga oid", "31-modda (oila kodeksi)", "31-modda ayer uy-joy", "erlyer"]
    found = spark.createDataFrame([(q,) for q in asked], "q string").select(*T.article_reference("q", False)).collect()
    assert [tuple(r) for r in found] == [("31", None), ("31", "yer"), ("31", "oila"), ("31", "uy-joy"), (None, None)]
