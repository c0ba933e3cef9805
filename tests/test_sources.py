from quillmesh.sources import archive as A


def test_archive_and_line_files(spark, tmp_path):
    (tmp_path / "neg5.html").write_text("<p>body</p>")
    (tmp_path / "7.html").write_text("x")
    rows = {r.doc_id: r.content for r in A.read_archive(spark, str(tmp_path)).collect()}
    assert rows == {"-5": "<p>body</p>", "7": "x"}
    lines = tmp_path / "cases.jsonl"
    lines.write_text('// note\n\n{"id": "a", "n": 1}\n  // more\n{"id": "b"}\n')
    assert [(r.id, r.n) for r in A.read_lines(spark, str(lines), "id string, n int").orderBy("id").collect()] == [("a", 1), ("b", None)]


def test_states_and_rules(spark):
    fetched, known = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "doc_id string, content_sha256 string"), spark.createDataFrame([("a", "1"), ("b", "9")], "doc_id string, content_sha256 string")
    assert {r.doc_id: r.state for r in A.fetch_states(fetched, known).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    robots = spark.createDataFrame([("Crawl-delay: 45",), ("crawl-delay: 5",), ("",)], "x string")
    assert [r[0] for r in robots.select(A.crawl_delay(robots.x)).collect()] == [45.0, 20.0, 20.0]


def test_training_split_has_one_row_at_least(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "k int")
    assert {(r.k, r.part) for r in A.split_training(df, ["k"]).collect()} == {(i, "validation" if i == 0 else "train") for i in range(7)}


def test_index_refuses_repeated_ids(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, ["a"]), (1, ["b"])], "doc_id int, tokens array<string>")
    with pytest.raises(ValueError):
        A.write_index(df, str(tmp_path / "i"))
