"""Documents in pieces: sections, chunks, their merging, identity and labels.

Order is always an explicit ``pos``; everything that a loop would carry along is a window over it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import strip

TINY_TOKENS, WHOLE_TOKENS, PARTS_TOKENS, LEAST_CHARS = 100, 800, 2000, 20
MOST_TOKENS, MOST_CHARS, OVERLAP_CHARS = 6000, 15_000, 1500
LEVELS = ("part", "section", "subsection", "chapter")


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def carried_sections(lines: DataFrame, heading: Column, key: str = "doc_id") -> DataFrame:
    """Lines with the number of the section they stand in (0 before the first heading) and its title."""
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("is_heading", heading)
    return marked.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(upto)).withColumn("title", F.last(F.when(F.col("is_heading"), F.col("line")), ignorenulls=True).over(upto))


def section_texts(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section, title, body): lines of each section joined in order, headings left out."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_heading"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return sections.groupBy(key, "section").agg(F.first("title", ignorenulls=True).alias("title"), body.alias("body"))


def hierarchy_paths(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """Elements (key, pos, level, title) with the path of headers above; a new level ends all deeper ones."""
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = elements
    for i, level in enumerate(LEVELS):
        mine = F.last(F.when(F.col("level") == level, F.struct("pos", "title")), ignorenulls=True).over(upto)
        above = F.max(F.when(F.col("level").isin(*LEVELS[:i]), F.col("pos"))).over(upto) if i else F.lit(None).cast("int")
        out = out.withColumn(f"__{level}", mine).withColumn(f"__above_{level}", above)
    named = [F.when(F.coalesce(F.col(f"__{level}.pos") > F.col(f"__above_{level}"), F.lit(True)), F.col(f"__{level}.title")) for level in LEVELS]
    out = out.withColumn("path", F.filter(F.array(*named), lambda t: t.isNotNull()))
    return out.drop(*[f"__{x}" for x in LEVELS], *[f"__above_{x}" for x in LEVELS])


def split_by_marker(text: Column, marker: str) -> Column:
    """Array of (mark, text): the text before the first marker has a null mark. The marker has one group, its number."""
    marked = F.regexp_replace(text, marker, "$1")
    parts = F.split(marked, "", -1)
    pair = lambda x: F.struct(F.when(F.instr(x, "") > 0, F.split_part(x, F.lit(""), F.lit(1))).alias("mark"), F.when(F.instr(x, "") > 0, F.split_part(x, F.lit(""), F.lit(2))).otherwise(x).alias("text"))
    return F.filter(F.transform(parts, pair), lambda p: (p["text"] != "") | p["mark"].isNotNull())


def size_branches(articles: DataFrame, part_marker: str, item_marker: str) -> DataFrame:
    """Chunks of articles (doc_id, pos, article, content, tokens): whole, by parts, or by parts and items, as size asks."""
    parts = split_by_marker(F.col("content"), part_marker)
    items = split_by_marker(F.col("text"), item_marker)
    sized = articles.withColumn("parts", parts)
    whole = (F.col("tokens") <= WHOLE_TOKENS) | ((F.col("tokens") <= PARTS_TOKENS) & (F.size("parts") <= 1))
    by_part = ~whole & (F.col("tokens") <= PARTS_TOKENS)
    base = ["doc_id", "pos", "article"]
    none = F.lit(None).cast("string")
    one = sized.where(whole).select(*base, none.alias("part"), none.alias("item"), F.col("content").alias("text"), F.lit(0).alias("n"), F.lit(0).alias("m"))
    many = sized.where(~whole).select(*base, by_part.alias("by_part"), F.posexplode("parts").alias("n", "p")).select(*base, "by_part", "n", F.col("p.mark").alias("part"), F.col("p.text").alias("text"))
    two = many.where("by_part").select(*base, "part", none.alias("item"), "text", "n", F.lit(0).alias("m"))
    deep = many.where("NOT by_part").select(*base, "part", "n", F.posexplode(items).alias("m", "i")).select(*base, "part", F.col("i.mark").alias("item"), F.col("i.text").alias("text"), "n", "m")
    chunks = one.unionByName(two).unionByName(deep)
    name = F.concat_ws(":", F.col("doc_id").cast("string"), "article", F.concat(F.lit("p"), "part"), F.concat(F.lit("i"), "item"))
    return chunks.where(F.length(F.trim("text")) >= LEAST_CHARS).select("doc_id", "pos", "n", "m", "article", "part", "item", name.alias("chunk_id"), F.trim("text").alias("content"))


def merge_tiny(chunks: DataFrame, keys: list[str], same: list[str], tokens: str = "tokens", text: str = "content") -> DataFrame:
    """Runs of neighbouring tiny chunks that agree in ``same`` as one; any other chunk ends a run."""
    order = Window.partitionBy(*keys).orderBy("pos")
    tiny = F.col(tokens) < TINY_TOKENS
    marked = chunks.withColumn("tiny", tiny)
    joins = F.col("tiny") & F.lag("tiny").over(order)
    for column in same:
        joins = joins & F.col(column).eqNullSafe(F.lag(column).over(order))
    island = F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", text))), lambda x: x[text]), "\n")
    return marked.withColumn("island", island).groupBy(*keys, "island").agg(F.min("pos").alias("pos"), F.count("*").alias("merged"), F.sum(tokens).alias(tokens), body.alias(text), *[F.first(c).alias(c) for c in same])


def unique_ids(chunks: DataFrame, keys: list[str], chunk_id: str = "chunk_id") -> DataFrame:
    """The k-th repeat of an id gets ``#k``; the first keeps it."""
    k = F.row_number().over(Window.partitionBy(*keys, chunk_id).orderBy("pos"))
    return chunks.withColumn("__k", k).withColumn(chunk_id, F.when(F.col("__k") == 1, F.col(chunk_id)).otherwise(F.concat_ws("#", chunk_id, F.col("__k").cast("string")))).drop("__k")


def occurrences(chunks: DataFrame, by: list[str]) -> DataFrame:
    return chunks.withColumn("occurrence", F.row_number().over(Window.partitionBy(*by).orderBy("pos")))


def heading(title: Column, path: Column, article: Column, suffix: Column) -> Column:
    parts = F.concat(F.array(title), F.coalesce(path, F.array().cast("array<string>")), F.array(article, suffix))
    return F.concat(F.lit("["), F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), " > "), F.lit("]"))


def citation_label(title: Column, article: Column, part: Column, item: Column, occurrence: Column) -> Column:
    return F.concat_ws(", ", title, F.concat(article, F.lit("-modda")), F.concat(part, F.lit("-qism")), F.concat(item, F.lit("-band")), F.when(occurrence > 1, F.concat(F.lit("#"), occurrence.cast("string"))))


def split_oversized(chunks: DataFrame, key: str, text: str = "content", most: int = MOST_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(key, piece, text): texts over the limit cut at sentence ends, each piece beginning with the tail of the one before.

    Only oversized rows reach the Arrow function; others pass by.
    """
    stops = re.compile(r"(?<=[.!?…])\s+")

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        def cut(text):
            out, now = [], ""
            for sentence in stops.split(text):
                for part in [sentence[i : i + most] for i in range(0, max(len(sentence), 1), most)]:
                    if now and len(now) + 1 + len(part) > most:
                        out.append(now)
                        tail = now[-min(overlap, most - len(part) - 1) :] if len(part) + 1 < most else ""
                        now = f"{tail} {part}" if tail else part
                    else:
                        now = f"{now} {part}" if now else part
            return [*out, now]

        return texts.map(cut)

    large = F.length(text) > most
    small = chunks.where(~large | F.col(text).isNull()).select(key, F.lit(0).alias("piece"), text)
    return small.unionByName(chunks.where(large).select(key, F.posexplode(pieces(F.col(text))).alias("piece", text)))


def points(elements: DataFrame, is_start: Column, key: str = "doc_id", least: int = 80) -> DataFrame:
    """Numbered points of documents without articles: a point's lines, short points joined to the one before."""
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    grouped = elements.withColumn("point", F.sum(is_start.cast("int")).over(upto))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    made = grouped.groupBy(key, "point").agg(F.min("pos").alias("pos"), text.alias("text"))
    long = (F.length("text") >= least) | (F.row_number().over(Window.partitionBy(key).orderBy("point")) == 1)
    marked = made.withColumn("long", long)
    kept = marked.withColumn("kept", F.sum(F.col("long").cast("int")).over(Window.partitionBy(key).orderBy("point").rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("point", "text"))), lambda x: x["text"]), "\n")
    return kept.groupBy(key, "kept").agg(F.min("pos").alias("pos"), F.count("*").alias("joined"), joined.alias("text"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


# How a line that opens an article looks (number, then heading), where a long article may be cut, sizes in characters.
ARTICLE_LINES = [
    r"(?iu)^[\s\u00a0]*([0-9]+(?:[¹²³⁴-][0-9]*)?)\s*-\s*modda(?!\p{L})\s*[.．:]?\s*(.*)$",
    r"(?iu)^[\s\u00a0]*([0-9]+(?:[¹²³⁴-][0-9]*)?)\s*-\s*модда(?!\p{L})\s*[.．:]?\s*(.*)$",
    r"(?iu)^[\s\u00a0]*статья\s+([0-9]+(?:[¹²³⁴-][0-9]*)?)\s*[.．:]?\s*(.*)$",
    r"(?iu)^[\s\u00a0]*article\s+([0-9]+(?:[¹²³⁴-][0-9]*)?)\s*[.．:]?\s*(.*)$",
]
POINT = r"(?u)\n(?=\s*(?:[0-9]+[).]|[а-яa-z][)]|—|-)\s)"
MOST_CHUNK, LEAST_CHUNK, LEAST_TEXT = 4000, 400, 20


def packed(pieces: Column, joint: str, most: int = MOST_CHUNK, least: int = LEAST_CHUNK) -> Column:
    """Pieces joined in order: one that would pass ``most`` characters opens a new text, if the open one has ``least``."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, piece: Column) -> Column:
        size = F.length(acc["now"])
        closed = F.struct(F.array_append(acc["done"], acc["now"]).alias("done"), piece.alias("now"))
        open_ = F.struct(acc["done"].alias("done"), F.when(size > 0, F.concat(acc["now"], F.lit(joint), piece)).otherwise(piece).alias("now"))
        return F.when((size + F.length(piece) > most) & (size >= least), closed).otherwise(open_)

    return F.transform(F.aggregate(pieces, start, step, lambda acc: F.array_append(acc["done"], acc["now"])), strip)


def article_pieces(body: Column, most: int = MOST_CHUNK) -> Column:
    """A long article's text in pieces of at most ``most`` characters, cut at its points where these are near enough."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most).cast("int")), lambda i: F.substr(x, i * most + 1, F.lit(most)))
    return F.flatten(F.transform(F.filter(packed(F.split(body, POINT, -1), "\n", most), lambda x: x != ""), cut))


def article_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_CHUNK) -> DataFrame:
    """(key, pos, article, heading, text): a document cut at the lines that open articles, long articles at their points;
    one without such lines by paragraphs. Texts of less than 20 characters are left out. All within a row, in the JVM.
    """
    lines = F.split(F.translate(F.regexp_replace(text, r"\r\n?", "\n"), "\u00a0", " "), "\n", -1)
    number = lambda line: F.coalesce(*(F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in ARTICLE_LINES))
    heading = lambda line: F.coalesce(*(F.when(F.regexp_extract(line, p, 1) != "", strip(F.regexp_extract(line, p, 2))) for p in ARTICLE_LINES))
    read = docs.select(key, lines.alias("lines")).where(F.col("lines").isNotNull())
    # of each line that opens an article: its place and what it says; a first, empty one stands for the text before
    opened = F.filter(F.transform("lines", lambda line, i: F.struct(i.alias("at"), number(line).alias("article"), line.alias("line"))), lambda x: x["article"].isNotNull())
    opened = F.transform(opened, lambda x: F.struct(x["at"], x["article"], F.nullif(heading(x["line"]), F.lit("")).alias("heading")))
    before = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("article"), F.lit(None).cast("string").alias("heading")))
    read = read.withColumn("opened", opened)
    plain = read.where(F.size("opened") == 0).select(key, F.posexplode(F.filter(packed(F.split(F.array_join("lines", "\n"), r"\n{2,}", -1), "\n\n", most), lambda x: F.length(x) >= LEAST_TEXT)).alias("pos", "text"))
    heads = F.concat(before, F.col("opened"))
    section = lambda x, i: F.struct(x["article"], x["heading"], (x["at"] + 2).alias("first"), (F.coalesce(F.get("heads", i + 1)["at"], F.size("lines")) - x["at"] - 1).alias("n"))
    sections = read.where(F.size("opened") > 0).withColumn("heads", heads).select(key, "lines", F.posexplode(F.transform("heads", section)).alias("section", "s"))
    sections = sections.select(key, "section", "s.article", "s.heading", strip(F.array_join(F.slice("lines", F.col("s.first"), F.col("s.n")), "\n")).alias("body"))
    sections = sections.where((F.col("body") != "") | F.col("heading").isNotNull())
    title = F.concat_ws(" ", F.concat("article", F.lit("-modda.")), "heading")
    whole = F.concat_ws(" ", F.concat("article", F.lit("-modda.")), "heading", F.nullif("body", F.lit("")))
    parts = F.transform(article_pieces(F.col("body"), most), lambda part, i: strip(F.concat(title, F.lit(" ("), (i + 1).cast("string"), F.lit("-qism)\n"), part)))
    cut = sections.select(key, "section", "article", "heading", F.posexplode(F.when(F.length(whole) <= most, F.array(whole)).otherwise(parts)).alias("part", "text")).where(F.length("text") >= LEAST_TEXT)
    place = F.row_number().over(Window.partitionBy(key).orderBy("section", "part")) - 1
    nothing = F.lit(None).cast("string")
    return cut.select(key, place.cast("int").alias("pos"), "article", "heading", "text").unionByName(plain.select(key, "pos", nothing.alias("article"), nothing.alias("heading"), "text"))
