"""Groundedness: answers in claims, each checked against its citations, and answers put together again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import patterns as P
from quillmesh.functions import text as T

# Shapes of lines, and the least words and share a claim needs to be compared.
HEADING = r"^[A-ZЎҚҒҲ'‘’ʻʼ \-]{3,40}:?$"
BULLET = r"^(\s*(?:[-*•–—]\s+|\d{1,2}[.)]\s+))"
SENTENCE_END = r"(?<![0-9])(?<=[.!?…])\s+"
SUPPORT_WORDS, SUPPORT_SHARE = 3, 0.3
REASONS = ("no_citation", "empty_claim", "unknown_citation", "wrong_quantity", "wrong_document", "wrong_article", "unsupported")


def split_claims(answers: DataFrame, key: str = "answer_id", text: str = "answer") -> DataFrame:
    """(key, pos, text, is_claim, is_heading, prefix): lines, bullets as one claim each, other lines by sentences."""
    lines = answers.select(key, F.posexplode(F.split(text, r"\r?\n", -1)).alias("line_no", "raw")).withColumn("line", T.strip("raw"))
    bullet = F.regexp_extract("line", BULLET, 1)
    piece = lambda t, claim, head, prefix: F.struct(t.alias("text"), claim.alias("is_claim"), head.alias("is_heading"), prefix.alias("prefix"))
    no, yes, none = F.lit(False), F.lit(True), F.lit("")
    body = T.strip(F.substr(F.col("line"), F.length(bullet) + 1, F.length("line")))
    sentences = F.transform(F.filter(F.transform(F.split("line", SENTENCE_END, -1), lambda s: T.strip(s)), lambda s: s != ""), lambda s: piece(s, yes, no, none))
    parts = F.when(F.col("line") == "", F.array(piece(none, no, no, none))).when(F.col("line").rlike(HEADING), F.array(piece(F.col("line"), no, yes, none))).when(bullet != "", F.array(piece(body, body != "", no, bullet))).otherwise(sentences)
    spread = lines.select(key, "line_no", F.posexplode(parts).alias("n", "s")).select(key, "line_no", "n", "s.*")
    return spread.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("line_no", "n"))).drop("n")


def quantities(text: Column) -> Column:
    """Distinct ``value|unit`` of digits or one or two number words before a unit."""
    units = "|".join(sorted(P.QUANTITY_UNITS, key=len, reverse=True))
    values = P.NUMBER_WORDS_ONES | P.NUMBER_WORDS_TENS
    named = "|".join(sorted(values, key=len, reverse=True))
    unit_of = F.create_map(*[F.lit(x) for pair in P.QUANTITY_UNITS.items() for x in pair])
    value_of = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    tens, ones = [F.array(*[F.lit(v) for v in sorted(set(d.values()))]) for d in (P.NUMBER_WORDS_TENS, P.NUMBER_WORDS_ONES)]
    digits = rf"(?iU)\b(\d{{1,4}})\s+({units})\b"
    spelled = rf"(?iU)\b({named})(?:\s+({named}))?\s+({units})\b"
    all_of = lambda p, i: F.regexp_extract_all(text, F.lit(p), F.lit(i))
    plain = F.zip_with(all_of(digits, 1), all_of(digits, 2), lambda v, u: F.concat_ws("|", v.cast("int").cast("string"), unit_of[F.lower(u)]))
    a, b = F.lower, F.lower
    both = lambda x, y: F.when(F.array_contains(tens, value_of[a(x)]) & F.array_contains(ones, value_of[b(y)]), value_of[a(x)] + value_of[b(y)]).otherwise(value_of[a(x)])
    firsts = F.arrays_zip(all_of(spelled, 1).alias("x"), all_of(spelled, 2).alias("y"), all_of(spelled, 3).alias("u"))
    worded = F.transform(firsts, lambda r: F.concat_ws("|", F.when(r["y"] == "", value_of[a(r["x"])]).otherwise(both(r["x"], r["y"])).cast("string"), unit_of[F.lower(r["u"])]))
    return F.array_distinct(F.concat(plain, worded))


def quantities_clash(claimed: Column, sources: Column) -> Column:
    """Whether a claimed quantity differs from all quantities of its unit in the sources."""
    unit = lambda q: F.split_part(q, F.lit("|"), F.lit(2))
    return F.coalesce(F.exists(claimed, lambda q: ~F.array_contains(sources, q) & F.exists(sources, lambda s: unit(s) == unit(q))), F.lit(False))


def document_names(text: Column) -> Column:
    """Folded names of codes a text mentions, words that only point left out."""
    found = F.regexp_extract_all(text, F.lit(r"(?iU)([\w'ʻʼ‘’-]+(?:\s+[\w'ʻʼ‘’-]+){0,2})\s+kodeks\w*"), F.lit(1))
    pointing = F.array(*[F.lit(w) for w in ("yangi", "eski", "amaldagi", "joriy", "shu", "bu", "ushbu", "haqidagi", "mazkur", "o'sha", "ayni")])
    names = F.transform(found, lambda n: F.array_join(F.filter(F.split(F.lower(n), r"\s+", -1), lambda w: ~F.array_contains(pointing, w)), " "))
    return F.array_distinct(F.transform(F.filter(names, lambda n: n != ""), lambda n: F.translate(n, P.APOSTROPHES, "'" * len(P.APOSTROPHES))))


def check_claims(claims: DataFrame, citations: DataFrame, key: str = "answer_id", support: bool = True, threshold: float = SUPPORT_SHARE) -> DataFrame:
    """Claims with kind, tags, status (kept, flagged, dropped) and reason, by one ordered decision over computed columns.

    citations: key, tag, excerpt, doc_title, article. They are folded once each and gathered by claim before the decision.
    """
    compose = False
    only = claims.where("is_claim").select(key, "pos", "text", T.claim_tags("text").alias("tags"), T.is_legal_claim("text", compose).alias("legal"))
    bare = F.regexp_replace("text", P.CITATION_TAG, "")
    only = only.withColumn("words", T.content_words(bare, compose)).withColumn("claimed", quantities(F.col("text"))).withColumn("names", document_names(F.col("text"))).withColumn("articles", T.mentioned_articles("text"))
    source = F.concat_ws(" ", "excerpt", "doc_title", "article")
    read = citations.select(key, F.upper("tag").alias("tag"), T.content_words(source, compose).alias("source_words"), quantities(F.coalesce("excerpt", F.lit(""))).alias("source_quantities"), T.fold("doc_title", compose).alias("title"), F.array_union(F.regexp_extract_all(F.coalesce("article", F.lit("")), F.lit(r"\d+"), F.lit(0)), T.mentioned_articles(F.coalesce("excerpt", F.lit("")))).alias("source_articles"))
    named = only.select(key, "pos", "words", F.explode("tags").alias("tag")).join(read, [key, "tag"])
    share = F.when((F.size("words") >= SUPPORT_WORDS) & (F.size("source_words") > 0), F.size(F.array_intersect("words", "source_words")) / F.size("words"))
    gathered = named.groupBy(key, "pos").agg(F.count("*").alias("resolved"), F.flatten(F.collect_list("source_quantities")).alias("known"), F.collect_set("title").alias("titles"), F.flatten(F.collect_list("source_articles")).alias("available"), F.max(share).alias("best"))
    joined = only.join(gathered, [key, "pos"], "left")
    wrong_name = (F.size("titles") > 0) & F.exists("names", lambda n: ~F.exists("titles", lambda t: t.contains(n)))
    invented = (F.size("articles") > 0) & (F.size("available") > 0) & ~F.arrays_overlap("articles", "available")
    legal = F.col("legal")
    reason = (
        F.when(F.size("tags") == 0, F.when(legal, "no_citation"))
        .when(F.size("words") == 0, "empty_claim")
        .when(F.col("resolved").isNull(), "unknown_citation")
        .when(legal & F.coalesce(quantities_clash(F.col("claimed"), F.col("known")), F.lit(False)), "wrong_quantity")
        .when(legal & F.coalesce(wrong_name, F.lit(False)), "wrong_document")
        .when(legal & F.coalesce(invented, F.lit(False)), "wrong_article")
        .when(legal & F.lit(support) & (F.round("best", 9) < threshold), "unsupported")
    )
    decided = joined.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "kept").when(F.col("reason") == "unsupported", "flagged").otherwise("dropped"))
    return decided.select(key, "pos", "text", F.when(legal, "legal").otherwise("general").alias("kind"), "tags", "status", "reason")


def gate_report(checked: DataFrame, key: str = "answer_id") -> DataFrame:
    """Counts by answer; refused where no legal claim is left."""
    count = lambda c: F.count_if(c)
    kept = F.col("status") != "dropped"
    report = checked.groupBy(key).agg(count(F.col("status") == "kept").alias("kept"), count(F.col("status") == "flagged").alias("flagged"), count(~kept).alias("dropped"), count(kept & (F.col("kind") == "legal")).alias("kept_legal"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("pos"))).alias("first_reason"))
    return report.withColumn("refused", F.col("kept_legal") == 0)


def gate_reasons(checked: DataFrame, citations: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, reasons, used): why claims were dropped or flagged, each reason once, and the tags of known citations that what
    is kept bears, both in the order in which they first occur."""
    in_order = lambda values: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(values)), lambda x: x["v"])))
    seen = checked.withColumn("why", F.filter(F.array("reason"), lambda r: r.isNotNull()))
    reasons = seen.groupBy(key).agg(in_order(F.struct("pos", F.col("why").alias("v"))).alias("reasons"))
    borne = checked.where("status <> 'dropped'").select(key, "pos", F.posexplode("tags").alias("n", "tag"))
    known = borne.join(citations.select(key, F.upper("tag").alias("tag")).distinct(), [key, "tag"])
    used = known.groupBy(key).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "n", "tag"))), lambda x: x["tag"])).alias("used"))
    return reasons.join(used, key, "left").select(key, "reasons", F.coalesce("used", F.array().cast("array<string>")).alias("used"))


def reassemble(claims: DataFrame, checked: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, answer): what is kept in order; a heading goes when nothing up to the next one is left."""
    joined = claims.join(checked.select(key, "pos", "status"), [key, "pos"], "left").withColumn("stays", F.when(F.col("is_claim"), F.col("status") != "dropped").otherwise(F.col("text") != ""))
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    grouped = joined.withColumn("group", F.sum(F.col("is_heading").cast("int")).over(upto))
    alive = F.max(F.col("is_claim") & F.col("stays")).over(Window.partitionBy(key, "group"))
    kept = grouped.withColumn("alive", alive).where(F.col("stays") & (~F.col("is_heading") | F.col("alive")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat("prefix", "text").alias("t")))), lambda x: x["t"]), "\n")
    return kept.groupBy(key).agg(text.alias("answer"))


def complexity(question: Column, kind: Column, disputed: Column) -> Column:
    """complex, standard or simple, in the order these are asked."""
    size = F.size(T.words(question))
    return F.when(disputed | (size >= 60), "complex").when((kind == "analytical") | (size >= 25), "standard").when(kind == "factual", "simple").otherwise("standard")


def confidence(base: Column, kept: Column, total: Column, roles_missing: Column) -> Column:
    share = F.when(total > 0, kept / total).otherwise(F.lit(1.0))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), base * share * F.when(roles_missing, 0.8).otherwise(1.0)))
    return F.round(value.cast("decimal(18,9)"), 2).cast("double")  # as a decimal, so that halves go up wherever it runs


def caveats(conditions: list[tuple[Column, str]]) -> Column:
    return F.array_distinct(F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in conditions]), lambda x: x.isNotNull()))


def json_of(text: Column, schema: str) -> Column:
    """The JSON object of a model's answer: in a fence if there is one, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(braces), schema)


MOST_OBJECTS = 8  # a fixed value: candidates after which no more braces are looked at
TOKEN = r'(?s)"(?:[^"\\]++|\\.)*+"?|[{}]|[^"{}]++'
FENCE = r"(?s)```(?:json)?\s*(.+?)```"
SECTION_NAME = r"^[A-ZЎҚҒҲ' ʻʼ\-]{3,40}$"


def balanced(text: Column) -> Column:
    """The start of text, which begins with a brace, up to the brace that closes it; null if none does. Strings, with what
    they escape, are passed over whole."""
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("depth"), F.lit(False).alias("closed"))

    def step(acc: Column, token: Column) -> Column:
        depth = acc["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        return F.when(acc["closed"], acc).otherwise(F.struct((acc["size"] + F.length(token)).alias("size"), depth.alias("depth"), (depth == 0).alias("closed")))

    end = F.aggregate(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), start, step)
    return T.bound(end, lambda e: F.when(e["closed"], F.left(text, e["size"])))


def json_object(text: Column) -> Column:
    """The first JSON object of a model's answer, as a variant: what stands in fences is tried first, then what is balanced
    from each brace on, in order, until more than eight have been found; null if none can be read."""
    fenced = F.transform(F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)), T.strip)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substr(text, i, F.lit(1)) == "{")

    def step(found: Column, at: Column) -> Column:
        one = balanced(F.substr(text, at, F.length(text)))
        return F.when(F.size(found) > MOST_OBJECTS, found).otherwise(T.bound(one, lambda o: F.when(o.isNull(), found).otherwise(F.array_append(found, o))))

    candidates = F.when(text.contains("{"), F.aggregate(places, fenced, step)).otherwise(fenced)
    read = F.filter(candidates, lambda c: c.startswith("{") & F.coalesce(balanced(c) == c, F.lit(False)) & F.try_parse_json(c).isNotNull())
    return F.try_parse_json(F.get(read, F.lit(0)))


def answer_sections(answers: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """(key, pos, section, line): an answer's lines under its headings in capitals, a heading's own value first; lines
    before the first heading, and blank ones, are left out, bullets are taken off."""
    lines = answers.select(key, F.posexplode(F.split(text, r"\r\n?|\n", -1)).alias("pos", "line")).withColumn("line", T.strip("line")).where("line <> ''")
    head = T.strip(F.regexp_replace("line", ":+$", ""))
    before, after = T.strip(F.substring_index("line", ":", 1)), T.strip(F.substr("line", F.instr("line", ":") + 1, F.length("line")))
    alone = head.rlike(SECTION_NAME)
    valued = ~alone & F.col("line").contains(":") & before.rlike(SECTION_NAME) & (after != "")
    marked = lines.withColumn("name", F.when(alone, F.upper(head)).when(valued, F.upper(before)))
    bare = T.strip(F.regexp_replace("line", r"^\s*(?:[-*•–—]|[0-9]{1,2}[.)])\s+", ""))
    marked = marked.withColumn("line", F.when(valued, after).when(~alone, bare))
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.withColumn("section", F.last("name", ignorenulls=True).over(upto))
    return carried.where("section IS NOT NULL AND line IS NOT NULL").select(key, "pos", "section", "line")


def stated_confidence(values: Column) -> Column:
    """The first number of a section's lines, between 0 and 1: percentages and numbers over 1 are divided by 100; else 0.5."""
    number = r"([0-9]+(?:[.,][0-9]+)?)\s*%?"
    said = F.get(F.filter(values, lambda v: v.rlike(number)), F.lit(0))

    def read(v: Column) -> Column:
        n = F.replace(F.regexp_extract(v, number, 1), F.lit(","), F.lit(".")).cast("double")
        return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v.contains("%") | (n > 1), n / 100).otherwise(n))))

    return F.coalesce(T.bound(said, read), F.lit(0.5))


def argument_lines(text: Column) -> Column:
    """Array of (strength, claim, tags) from lines ``[strength] claim. Asos: [C1]``."""
    p = r"(?im)^\s*[-*]?\s*\[(kuchli|o['ʻ]rta|zaif)\]\s*(.+?)\s*(?:asos\s*:\s*(.*))?$"
    part = lambda i: F.regexp_extract_all(text, F.lit(p), F.lit(i))
    return F.transform(F.arrays_zip(part(1).alias("s"), part(2).alias("c"), part(3).alias("t")), lambda r: F.struct(F.lower(r["s"]).alias("strength"), r["c"].alias("claim"), T.claim_tags(r["t"]).alias("tags")))


def refusal(coverage: Column, document: Column, article: Column) -> Column:
    return F.coalesce(coverage, document, article)


def any_of(text: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in markers])
