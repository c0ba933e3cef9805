"""Queries of the text functions over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.plans.base import Registry, table

REGISTRY = Registry()
query = REGISTRY.query
WS = r"[\s\x0b\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
TOKENS = "regexp_extract_all(lower(text), '[a-zʻʼ0-9]+')"


@query(f"SELECT doc_id, CAST(2 * len(list_filter(regexp_split_to_array(text, '{WS}'), lambda x: x <> '')) AS BIGINT) AS tokens FROM documents")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate("text").cast("bigint").alias("tokens"))


@query("SELECT doc_id, regexp_matches(text, '[\\x{0400}-\\x{04FF}]') AS has_cyrillic, round(len(regexp_extract_all(text, '[A-Za-z]')) / greatest(length(text), 1), 6) AS latin_share, CASE WHEN len(regexp_extract_all(text, '[\\x{0400}-\\x{04FF}]')) > len(regexp_extract_all(text, '[A-Za-z]')) THEN 'cyrl' ELSE 'latn' END AS script FROM documents")
def script_ratio(spark, sf_dir):
    share = F.round(F.regexp_count("text", F.lit("[A-Za-z]")) / F.greatest(F.length("text"), F.lit(1)), 6)
    return table(spark, sf_dir, "documents").select("doc_id", T.has_cyrillic("text").alias("has_cyrillic"), share.alias("latin_share"), T.script_of("text").alias("script"))


@query(f"SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def term_frequencies(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.search_tokens("text")).alias("term"))
    return tokens.groupBy("term", "doc_id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS dl, round(0.25 + 0.75 * len(t) / avg(len(t)) OVER (), 6) AS norm FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def document_norms(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.size(T.search_tokens("text")).cast("bigint").alias("dl"))
    mean = sizes.agg(F.avg("dl").alias("mean"))
    return sizes.crossJoin(F.broadcast(mean)).select("doc_id", "dl", F.round(0.25 + 0.75 * F.col("dl") / F.col("mean"), 6).alias("norm"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[ \\t\\x{00A0}\\x{2000}-\\x{200B}\\x{FEFF}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))) AS folded FROM documents")
def folded_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold("text")).alias("folded"))


@query("""
SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
  '([oOgG])[''‘’ʻʼ`´′]', '\\1' || chr(1), 'g'), '[''‘’ʻʼ`´′]', 'ʼ', 'g'), chr(1), 'ʻ'), '[\\x{2010}-\\x{2015}\\x{2212}]', '-', 'g'), '[ \\t\\x{00A0}\\x{2000}-\\x{200B}\\x{FEFF}]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)),
  lambda x: trim(x)), chr(10)), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents""")
def canonical_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.canonical("text")).alias("digest"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\b\\d{1,4}\\s*[-–]?\\s*modda') THEN 'article_lookup' WHEN regexp_matches(text, '(?i)\\b(mumkinmi|haqlimi|oqibat)') THEN 'analytical' WHEN regexp_matches(text, '(?i)\\b(muddat|tartib|ariza|shikoyat|apellyatsiya|kassatsiya|protsessual)') THEN 'procedural' ELSE 'factual' END AS kind FROM conversations")
def query_kind(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.query_kind("text").alias("kind"))


@query("SELECT doc_id, CAST(len(list_distinct(w)) AS BIGINT) AS n_words FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda x: length(x) >= 4 AND x NOT IN ('yoki', 'uchun', 'bilan', 'lekin', 'ammo', 'agar', 'chunki', 'hamda', 'ya''ni', 'kabi', 'qilib', 'qilish', 'bo''lgan', 'bo''ladi', 'bo''lsa', 'emas', 'hech', 'faqat', 'ushbu', 'mazkur', 'ular', 'keyin', 'oldin', 'ko''ra', 'asosan', 'holda', 'tomonidan')) AS w FROM documents)")
def content_word_counts(spark, sf_dir):
    found = F.regexp_extract_all(T.fold("text"), F.lit("[a-z0-9']+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in T.P.STOP_WORDS])
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w)))).cast("bigint").alias("n_words"))


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
SELECT word, CASE """ + " ".join(f"WHEN word LIKE '%{s}' AND length(word) - {len(s)} >= 4 THEN left(word, length(word) - {len(s)})" for s in T.P.SUFFIXES) + " ELSE word END AS stem FROM w")
def stemmed_vocabulary(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.without_suffix("word").alias("stem"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS n_lines, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(regexp_extract_all(text, '[.!?]')) AS BIGINT) AS n_stops FROM documents")
def text_census(spark, sf_dir):
    lines = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""))
    return table(spark, sf_dir, "documents").select("doc_id", lines.cast("bigint").alias("n_lines"), F.length("text").cast("bigint").alias("n_chars"), F.regexp_count("text", F.lit("[.!?]")).cast("bigint").alias("n_stops"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '') AS lang, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_links FROM pages")
def html_heads(spark, sf_dir):
    nul = lambda c: F.nullif(c, F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", nul(F.trim(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))).alias("title"), nul(F.regexp_extract("html", '<html lang="([a-z]+)"', 1)).alias("lang"), F.regexp_count("html", F.lit("<a href=")).cast("bigint").alias("n_links"))


@query("SELECT page_id, CAST(pos AS BIGINT) AS pos, target FROM (SELECT page_id, unnest(r) AS target, generate_subscripts(r, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS r FROM pages))")
def html_links(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("pos", "target")).select("page_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "target")


@query("""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?is)<sup>\\s*(\\d+)\\s*</sup>', '-\\1', 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b)
SELECT page_id, md5(regexp_replace(regexp_replace(t, '[ \\t\\x{00A0}\\x{2000}-\\x{200B}\\x{FEFF}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS text_digest FROM c""")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean_html("html")).alias("text_digest"))


@query("SELECT doc_id, CAST(pos AS BIGINT) AS pos, line FROM (SELECT doc_id, unnest(r) AS line, generate_subscripts(r, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS r FROM documents)) WHERE length(line) BETWEEN 1 AND 40 AND regexp_matches(line, '^[A-Z][A-Z !,.]+$')")
def shouting_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.where(F.length("line").between(1, 40) & F.col("line").rlike("^[A-Z][A-Z !,.]+$")).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "line")


@query("""
WITH s AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark),
p AS (SELECT doc_id, item_id, count(*) AS both_n FROM (SELECT doc_id, unnest(w) AS x FROM s) JOIN (SELECT item_id, unnest(w) AS x FROM b) USING (x) GROUP BY 1, 2)
SELECT doc_id, item_id, round(both_n / (len(s.w) + len(b.w) - both_n), 6) AS jaccard FROM p JOIN s USING (doc_id) JOIN b USING (item_id) WHERE both_n / (len(s.w) + len(b.w) - both_n) >= 0.2""")
def jaccard_pairs(spark, sf_dir):
    """Documents against the stated benchmark passages, by an equi-join on words: only passages' words are shuffled."""
    bag = lambda df, key: df.select(key, F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    docs, items = bag(table(spark, sf_dir, "documents"), "doc_id"), bag(table(spark, sf_dir, "benchmark"), "item_id")
    left = docs.select("doc_id", F.size("w").alias("a"), F.explode("w").alias("x"))
    right = items.select("item_id", F.size("w").alias("b"), F.explode("w").alias("x"))
    both = left.join(right, "x").groupBy("doc_id", "item_id", "a", "b").agg(F.count("*").alias("n"))
    share = F.col("n") / (F.col("a") + F.col("b") - F.col("n"))
    return both.where(share >= 0.2).select("doc_id", "item_id", F.round(share, 6).alias("jaccard"))


@query("SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '\\[([^\\[\\]\\n]{2,80})\\]', 1))) AS BIGINT) AS n_placeholders FROM documents")
def placeholder_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.placeholders("text")).cast("bigint").alias("n_placeholders"))


@query("SELECT event_id, CASE WHEN d IS NULL THEN NULL ELSE d END AS found FROM (SELECT event_id, strftime(ts, '%Y-%m-%d') AS d FROM events)")
def dates_in_text(spark, sf_dir):
    said = F.concat(F.lit("on "), F.date_format("ts", "dd.MM.yyyy"), F.lit(" recorded"))
    return table(spark, sf_dir, "events").select("event_id", T.extract_date(said).alias("found"))


@query("SELECT o_orderkey, CAST(len(r) AS BIGINT) AS n_numbers, r[1] AS first, r[len(r)] AS last FROM (SELECT o_orderkey, CASE WHEN span > 0 THEN list_transform(range(lo, lo + span + 1), lambda x: CAST(x AS VARCHAR)) ELSE [CAST(lo AS VARCHAR), CAST(lo + span AS VARCHAR)] END AS r FROM (SELECT o_orderkey, o_orderkey % 500 + 1 AS lo, o_custkey % 50 AS span FROM orders))")
def article_runs(spark, sf_dir):
    low = F.col("o_orderkey") % 500 + 1
    run = F.concat_ws(" - ", low.cast("string"), (low + F.col("o_custkey") % 50).cast("string"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", T.expand_articles(run).alias("r"))
    return found.select("o_orderkey", F.size("r").cast("bigint").alias("n_numbers"), F.element_at("r", 1).alias("first"), F.element_at("r", -1).alias("last"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || '-' || CAST(p_partkey % 7 + 1 AS VARCHAR) AS article FROM part")
def article_numbers(spark, sf_dir):
    heading = F.concat(F.col("p_size").cast("string"), F.lit(" -"), (F.col("p_partkey") % 7 + 1).cast("string"), F.lit(" -modda. "), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.article_number(heading).alias("article"))


LEGAL_WORDS = "modda|kodeks|qonun|farmon|nizom|plenum|band|qism|norma|qaror|hujjat|huquq|majburiyat|javobgar|jarima|sanksiya|sanktsiya|da''vo|sud|shartnoma|mulk|meros|nafaqa|soliq|muddat|ariza|shikoyat|apellyatsiya|kassatsiya|belgilan|nazarda\\s+tutil|taqiqlan|ruxsat\\s+etil|majbur|haqli|bekor\\s+qilin|amal\\s+qilad"


@query(f"""
WITH t AS (SELECT conv_id, turn, translate(lower(text), '‘’ʻʼ`´′', '{"''" * 7}') AS folded, len(list_distinct(list_transform(regexp_extract_all(text, '(?i)\\[\\s*(C\\d{{1,3}})\\s*\\]', 1), lambda x: upper(x)))) AS n FROM conversations)
SELECT conv_id, turn, n > 0 OR regexp_matches(folded, '(^|[^\\p{{L}}\\p{{N}}_])({LEGAL_WORDS})') AS legal, CAST(n AS BIGINT) AS n_tags FROM t""")
def legal_claims(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_legal_claim("text").alias("legal"), F.size(T.claim_tags("text")).cast("bigint").alias("n_tags"))


@query()
def transliterated(spark, sf_dir):
    """Cyrillic folding over texts written in Cyrillic from the documents' letters (no such texts in the tables)."""
    made = F.translate(F.lower("text"), "abvgdejziyklmnoprstufx", "абвгдежзийклмнопрстуфх")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.to_latin(made)).alias("latin"), F.round(T.cyrillic_ratio(made), 6).alias("share"), T.looks_russian(made).alias("russian"))


@query()
def ngram_embeddings(spark, sf_dir):
    vectors = table(spark, sf_dir, "benchmark").select("item_id", T.hashed_ngrams("text").alias("v"))
    return vectors.select("item_id", F.size("v").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("squared_norm"))


@query()
def message_pieces(spark, sf_dir):
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_message("text", 4000)).alias("pos", "piece"))
    return pieces.select("doc_id", "pos", F.length("piece").alias("size"))


@query("SELECT DISTINCT source, lang, CAST(count(*) OVER (PARTITION BY source, lang) AS BIGINT) AS n, CAST(dense_rank() OVER (PARTITION BY lang ORDER BY source) AS BIGINT) AS place FROM documents")
def source_census(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.dense_rank().over(Window.partitionBy("lang").orderBy("source")).cast("bigint"))
