"""Text normalisation, extraction and predicates as Column functions.

All of them stay inside the JVM but for Unicode composition, an Arrow function that gets only the rows that need it.
Regular expressions use ``(?U)`` and ``(?iu)`` where letters beyond ASCII count.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import patterns as P

APOSTROPHE_CLASS = "[" + P.APOSTROPHES + "]"
BLANK = r"(?U)\s"

# A class of several ranges is slow to test at every place of a text, so single ranges that it cannot meet go before it.
NOT_LOWER, NOT_VISIBLE, NOT_ASCII = "(?![a-z])", "(?![!-~])", r"(?![\x00-\x7F])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space, of any kind, at both ends; looked for from both ends, not at every place between."""
    return F.regexp_extract(_col(c), r"(?sU)\A\s*+(.*\S)?", 1)


def composed(c: Column | str, form: str = "NFC") -> Column:
    """Unicode normal form; only rows with characters that can change are sent to Python."""

    @F.pandas_udf("string")
    def normalise(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    unsafe = NOT_ASCII + r"(?![ʻʼ])(?![А-я])[^\u0000-\u009F¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-žƀ-ǃǍ-ǰɐ-ʯʻ-ˁЀ-ҁҊ-ӿ‐‒-‖‘-‣]"
    c = _col(c)
    return F.coalesce(normalise(F.when(c.rlike(unsafe), c)), c)


def has_cyrillic(c: Column | str) -> Column:
    return _col(c).rlike(r"[Ѐ-ӿ]")


def cyrillic_ratio(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.length(c) == 0, 0.0).otherwise(F.regexp_count(c, F.lit(r"[Ѐ-ӿ]")) / F.length(c))


def to_latin(c: Column | str) -> Column:
    """Uzbek Cyrillic in Latin letters: groups of letters first, then single ones; soft signs are left out."""
    grouped = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), P.SEVERAL_LETTERS, _col(c))
    return F.translate(grouped, P.ONE_LETTER_FROM + P.LEFT_OUT, P.ONE_LETTER_TO)


def to_cyrillic(c: Column | str) -> Column:
    """Uzbek Latin in Cyrillic letters: groups of letters first, longest first, then single ones; any apostrophe makes a group."""
    x = F.translate(_col(c), P.APOSTROPHES, P.TURNED_COMMA * len(P.APOSTROPHES))
    grouped = reduce(lambda y, pair: F.replace(y, F.lit(pair[0]), F.lit(pair[1])), P.LATIN_GROUPS, x)
    return F.translate(grouped, P.LATIN_LETTERS + P.TURNED_COMMA, P.CYRILLIC_LETTERS + "ъ")


def language_of(c: Column | str) -> Column:
    """Struct (lang, script) by script, letters that one language alone has, dictionary words and endings.

    Blank and undecided texts are Uzbek in Latin letters. Endings stand before anything but ASCII letters, digits and the
    underscore, which ``\\b`` of Java doesn't say: there an accented letter goes on with a word.
    """
    c = _col(c)
    folded = fold_without_apostrophes(c)
    tokens = F.filter(F.split(folded, r"[^\p{L}']+", -1), lambda w: w != "")
    hits = lambda dictionary: F.size(F.filter(tokens, lambda w: w.isin(*dictionary)))
    tenths = F.regexp_count(c, F.lit(r"[oO]['ʻ]|[gG]['ʻ]")) * 10 + F.regexp_count(c, F.lit(r"(?i)(?<!\w)\w*(ning|ga|dan|da|lar|ymiz|siz)(?!\w)")) * 5 + F.regexp_count(c, F.lit("[qxQX]")) * 2
    uz, ru, en = hits(P.UZBEK_DICTIONARY), hits(P.RUSSIAN_DICTIONARY), hits(P.ENGLISH_DICTIONARY)
    cyrillic = F.when(c.rlike("[ЎўҚқҒғҲҳ]") | (uz > ru), "uz").otherwise("ru")
    latin = F.when((uz - en) * 10 + tenths > 0, "uz").when(en > 0, "en").otherwise("uz")
    script = script_of(c)
    blank = F.coalesce(F.trim(c) == "", F.lit(True))
    return F.struct(F.when(blank, "uz").when(script == "cyrl", cyrillic).otherwise(latin).alias("lang"), F.when(blank, "latn").otherwise(script).alias("script"))


def lint_lines(c: Column | str) -> Column:
    """Array of (line, column, rule): words of mixed script, and apostrophes after o or g that aren't the turned comma."""
    rules = [("mixed-script", r"(?U)\b(?=\w*[A-Za-z])(?=\w*[Ѐ-ӿ])\w+"), ("apostrophe", "[oOgG]['‘’`´′ʼ]")]

    def of_line(line, n):
        found = [F.when(F.regexp_instr(line, F.lit(pattern)) > 0, F.struct((n + 1).alias("line"), F.regexp_instr(line, F.lit(pattern)).alias("column"), F.lit(rule).alias("rule"))) for rule, pattern in rules]
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.split(_col(c), "\n", -1), of_line))


def blanked_code(line: Column) -> Column:
    """A line of Markdown with what stands between backticks as blanks, so that columns stay; a last, open one stays."""
    parts = F.split(line, "`", -1)
    inside = lambda i: (i % 2 == 1) & (i < F.size(parts) - 1)
    shown = F.transform(parts, lambda part, i: F.when(inside(i), F.concat(F.lit(" "), F.repeat(F.lit(" "), F.length(part)), F.lit(" "))).otherwise(part))
    joined = F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), F.lit(""), lambda acc, i: F.concat(acc, F.when((i > 0) & ~inside(i) & ~inside(i - 1), F.lit("`")).otherwise(F.lit("")), F.get(shown, i)))
    return F.when(F.contains(line, F.lit("`")), joined).otherwise(line)


# The linter's rules: how they cut a line, and what a line and a piece that they tell of hold; lines that it
# passes over, and the mark that excuses a line.
LINT_RULES = {"aralash-yozuv": (r"[\p{L}ʻʼ'’]++|[^\p{L}ʻʼ'’]++", "[Ѐ-ӿ]", r"[A-Za-z].*[Ѐ-ӿ]|[Ѐ-ӿ].*[A-Za-z]"), "apostrof-o-g": (r"[oOgG]['‘’`´]|[oOgG]|[^oOgG]++", "[oOgG]['‘’`´]", "^[oOgG]['‘’`´]$")}
LINT_NOISE, LINT_EXCUSE = r"^\s*(?:import |export \* |from )|https?://", "lint-uz-ignore"


def lint_places(docs: DataFrame, key: str = "doc_id", text: str = "text", markdown: bool = False) -> DataFrame:
    """(key, line, column, rule, word) of every word of mixed script and every apostrophe after o or g that isn't the turned
    comma; in Markdown code is passed over, and everywhere lines that bear the excuse, or follow one that does."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "raw"))
    by_line = Window.partitionBy(key).orderBy("n")
    lines = lines.withColumn("before", F.lag("raw").over(by_line)).withColumn("line", F.col("raw"))
    if markdown:
        fence = F.col("raw").rlike(r"^\s*```")
        fences = F.sum(fence.cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0))
        lines = lines.withColumn("line", F.when(fence | (fences % 2 == 1), "").otherwise(blanked_code(F.col("raw"))))
    excused = F.col("raw").contains(LINT_EXCUSE) | F.coalesce(F.col("before").contains(LINT_EXCUSE), F.lit(False))
    lines = lines.where(~excused & ~F.col("line").rlike(LINT_NOISE))
    lines = lines.select(key, "n", "line")
    out = None
    for rule, (pieces, inside, told) in LINT_RULES.items():
        cut = lines.where(F.col("line").rlike(inside)).select(key, "n", F.posexplode(F.regexp_extract_all("line", F.lit(pieces), F.lit(0))).alias("i", "word"))
        before = F.sum(F.length("word")).over(Window.partitionBy(key, "n").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
        placed = cut.withColumn("column", (F.coalesce(before, F.lit(0)) + 1).cast("int")).where(F.col("word").rlike(told))
        found = placed.select(key, (F.col("n") + 1).alias("line"), "column", F.lit(rule).alias("rule"), "word")
        out = found if out is None else out.unionByName(found)
    return out


def looks_russian(c: Column | str) -> Column:
    """Cyrillic text with three marking words, or over 1.5 % of letters that Uzbek lacks, in its first 4000 characters."""
    c = _col(c)
    head = F.substring(c, 1, 4000)
    words = F.regexp_count(head, F.lit(r"(?iU)\b(" + "|".join(P.RUSSIAN_WORDS) + r")\b"))
    letters = F.regexp_count(head, F.lit("[ЫЬЭыьэ]")) / F.greatest(F.length(head), F.lit(1))
    return has_cyrillic(c) & ((words >= 3) | (letters > 0.015))


def _latin_unless_russian(c: Column) -> Column:
    """Only Cyrillic rows are looked at closely; a lambda keeps the long expression out of generated code."""
    return F.when(has_cyrillic(c), bound(c, lambda x: F.when(looks_russian(x), x).otherwise(to_latin(x)))).otherwise(c)


def canonical(c: Column | str, transliterate: bool = False) -> Column:
    """The form that is stored: composed, with one kind of line end, apostrophe, dash and space."""
    x = F.regexp_replace(composed(c), r"\r\n?", "\n")
    if transliterate:
        x = _latin_unless_russian(x)
    other = lambda kept: APOSTROPHE_CLASS.replace(kept, "")
    x = F.regexp_replace(x, NOT_LOWER + "(?![ -&])" + other(P.TURNED_COMMA) + "(?<=[oOgG].)", P.TURNED_COMMA)
    x = F.regexp_replace(x, NOT_LOWER + "(?![ -&])" + other(P.MODIFIER_APOSTROPHE) + "(?<![oOgG].)", P.MODIFIER_APOSTROPHE)
    x = single_spaces(F.regexp_replace(x, NOT_ASCII + P.DASHES, "-"))
    x = F.regexp_replace(x, r"\n\n\n+", "\n\n")
    # Lines are cut only where one begins or ends with white space.
    by_line = lambda t: F.when(t.rlike(r"(?U)\n(?:(?=[^\S\n])|(?<=[^\S\n]\n))"), F.array_join(F.transform(F.split(t, "\n", -1), strip), "\n")).otherwise(t)
    return strip(bound(x, by_line))


def single_spaces(c: Column) -> Column:
    """Each run of spaces of any kind as one; single plain ones aren't touched."""
    space = P.SPACES.rstrip("+")
    return F.regexp_replace(c, f"{NOT_VISIBLE}(?:{space.replace('[ ', '[')}{space}*| {space}+)", " ")


def fold(c: Column | str, compose: bool = True) -> Column:
    """The form that is searched: Latin unless Russian, ASCII apostrophes, single spaces, lower case."""
    return F.lower(strip(single_spaces(_ascii_apostrophes(c, compose))))


def _ascii_apostrophes(c: Column | str, compose: bool) -> Column:
    x = composed(c) if compose else _col(c)
    return F.regexp_replace(_latin_unless_russian(x), NOT_LOWER + "(?![ -_])" + APOSTROPHE_CLASS.replace("'", ""), "'")


def fold_without_apostrophes(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(_col(c), APOSTROPHE_CLASS, ""))


def fold_for_index(c: Column | str) -> Column:
    return fold_without_apostrophes(to_latin(c))


def fix_apostrophes(c: Column | str, keep_contractions: bool = False) -> Column:
    """Apostrophes after o and g as the turned comma, others between letters as the modifier."""
    x = _col(c)
    if keep_contractions:
        x = F.regexp_replace(x, f"(?i)(?<=[a-z]){APOSTROPHE_CLASS}(?=(?:s|t|re|ve|ll|d|m)\\b)", "")
    x = F.regexp_replace(x, f"(?<=[oOgG]){APOSTROPHE_CLASS}", P.TURNED_COMMA)
    x = F.regexp_replace(x, f"(?U)(?<=\\p{{L}})(?<![oOgG]){APOSTROPHE_CLASS}(?=\\p{{L}})", P.MODIFIER_APOSTROPHE)
    return F.replace(x, F.lit(""), F.lit("'")) if keep_contractions else x


def script_of(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.regexp_count(c, F.lit(r"[Ѐ-ӿ]")) > F.regexp_count(c, F.lit("[A-Za-z]")), "cyrl").otherwise("latn")


def polished(c: Column | str) -> Column:
    """Output without spaces before marks, double spaces and runs of blank lines; ``5 - modda`` becomes ``5-modda``."""
    x = F.regexp_replace(_col(c), r"[ \t]+([,.;:!?])", "$1")
    x = F.regexp_replace(x, r"(?i)(\d+)\s*-\s*(modda|band|qism)", "$1-$2")
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(x, r"(?m)[ \t]+$", ""))


def article_number(c: Column | str) -> Column:
    """``234`` or ``234-1`` from a heading; null where there is none."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(_col(c), p, 1), F.lit("")) for p in P.ARTICLE_NUMBER])
    return F.replace(F.regexp_replace(found, P.SPACES, ""), F.lit("–"), F.lit("-"))


def expand_articles(c: Column | str) -> Column:
    """The numbers that a run such as ``65 va 66`` or ``24 — 35`` stands for."""
    return bound(strip(c), _expanded)


def _expanded(c: Column) -> Column:
    separators = r"(?U)\s*(?:,|\bva\b|\bhamda\b|—|–|(?<=\s)-(?=\s))\s*"
    parts = F.filter(F.split(c, separators, -1), lambda x: x != "")
    is_range = c.rlike(r"—|–|(?<=\s)-(?=\s)")
    return bound(parts, lambda p: F.when(is_range & (F.size(p) == 2), _range(p)).otherwise(p))


def _range(parts: Column) -> Column:
    """Both ends of a range as all numbers between, where they are plain or primes of one number and not too far apart."""
    first, last = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    whole = lambda x: x.rlike(r"^\d{1,9}$")
    as_int = lambda x: x.try_cast("int")
    fits = lambda a, b: (as_int(b) - as_int(a)).between(1, P.LONGEST_ARTICLE_RANGE)
    base_a, base_b = F.split_part(first, F.lit("-"), F.lit(1)), F.split_part(last, F.lit("-"), F.lit(1))
    tail_a, tail_b = F.regexp_extract(first, r"^[^-]*-(.*)$", 1), F.regexp_extract(last, r"^[^-]*-(.*)$", 1)
    plain = F.transform(F.sequence(as_int(first), as_int(last)), lambda n: n.cast("string"))
    primed = F.transform(F.sequence(as_int(tail_a), as_int(tail_b)), lambda n: F.concat_ws("-", base_a, n.cast("string")))
    return F.when(whole(first) & whole(last), F.when(fits(first, last), plain).otherwise(parts)).when((base_a == base_b) & whole(tail_a) & whole(tail_b) & fits(tail_a, tail_b), primed).otherwise(parts)


def month_number(word: Column | str) -> Column:
    return bound(F.lower(_col(word)), lambda low: F.coalesce(*[F.when(low.startswith(name), number) for name, number in P.MONTHS]))


def _iso(year: Column, month: Column, day: Column) -> Column:
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat_ws("-", year, two(month), two(day))


def extract_date(c: Column | str) -> Column:
    """The first date as ``YYYY-MM-DD``, in four shapes tried in order; days and months aren't checked against a calendar."""
    c = _col(c)
    digit = NOT_LOWER + "(?![ -/])"
    named = rf"(?iU){digit}\b(\d{{4}})[-\s]*(?:yil|йил)\s+(\d{{1,2}})[-\s]*(\w+)"
    spelled = rf"(?U){digit}\b(\d{{1,2}})\s+([А-Яа-яA-Za-zЁёЎўҚқҒғҲҳ]{{3,12}})\s+(\d{{4}})\b"
    dotted = rf"(?U){digit}\b(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})\b"
    group = lambda p, i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    month1, month2 = month_number(group(named, 3)), month_number(group(spelled, 2))
    return F.coalesce(
        F.when(month1.isNotNull(), _iso(group(named, 1), month1, group(named, 2))),
        F.when(month2.isNotNull(), _iso(group(spelled, 3), month2, group(spelled, 1))),
        F.when(c.rlike(dotted), _iso(group(dotted, 3), group(dotted, 2), group(dotted, 1))),
        group(rf"(?U){digit}\b(\d{{4}}-\d{{2}}-\d{{2}})\b", 1),
    )


def words(c: Column | str) -> Column:
    return F.filter(F.split(_col(c), r"(?U)\s+", -1), lambda x: x != "")


def token_estimate(c: Column | str) -> Column:
    return F.size(words(c)) * 2


def search_tokens(c: Column | str, compose: bool = True) -> Column:
    """Tokens of the ranking index: ASCII letters, digits and the two letter apostrophes of the folded text, whose spaces
    don't matter here."""
    return F.regexp_extract_all(F.lower(_ascii_apostrophes(c, compose)), F.lit("[a-zʻʼ0-9]+"), F.lit(0))


def without_suffix(word: Column | str) -> Column:
    """One case ending taken off, the first of the list that leaves four letters."""
    w = _col(word)
    out = F.when(F.lit(False), w)
    for ending in P.SUFFIXES:
        out = out.when(w.endswith(ending) & (F.length(w) - len(ending) >= P.LEAST_STEM), F.left(w, F.length(w) - len(ending)))
    return out.otherwise(w)


def content_words(c: Column | str, compose: bool = True) -> Column:
    """Distinct stems of words of four letters and more that carry content."""
    found = F.regexp_extract_all(fold(c, compose), F.lit("[a-z0-9']+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in P.STOP_WORDS])
    kept = F.filter(found, lambda w: (F.length(w) >= P.LEAST_WORD) & ~F.array_contains(stop, w))
    return F.array_distinct(F.transform(kept, without_suffix))


def stem_twice(word: Column | str, least: int = 3) -> Column:
    """Two rounds of endings, leaving three letters."""
    w = _col(word)
    for _ in range(2):
        out = F.when(F.lit(False), w)
        for ending in P.SUFFIXES:
            out = out.when(w.endswith(ending) & (F.length(w) - len(ending) >= least), F.left(w, F.length(w) - len(ending)))
        w = out.otherwise(w)
    return w


def query_stems(c: Column | str, most: int = 32) -> Column:
    """At most 32 distinct stems of a query's words of three letters and more."""
    found = F.regexp_extract_all(fold_without_apostrophes(c), F.lit(r"(?U)[\p{L}\p{N}]+"), F.lit(0))
    stop = F.array(*[F.lit(w.replace("'", "")) for w in P.STOP_WORDS])
    return F.slice(F.array_distinct(F.transform(F.filter(found, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)), lambda w: stem_twice(w))), 1, most)


def jaccard(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def language_purity(c: Column | str, foreign_words: list[str]) -> Column:
    """1 less penalties for Cyrillic letters and foreign words, between 0 and 1."""
    c = _col(c)
    total = F.greatest(F.size(words(c)), F.lit(1))
    foreign = F.regexp_count(c, F.lit(r"(?iU)\b(" + "|".join(foreign_words) + r")\b"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cyrillic_ratio(c) - 2 * foreign / total))


def clean_html(c: Column | str) -> Column:
    """Text of an HTML fragment: scripts out, ``<sup>n</sup>`` as ``-n``, line breaks kept, five entities read."""
    x = F.regexp_replace(_col(c), r"(?is)<(script|style)\b.*?</\1>", " ")
    x = F.regexp_replace(x, r"(?is)<sup>\s*(\d+)\s*</sup>", "-$1")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>", "\n"), r"(?s)<[^>]*>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return strip(F.regexp_replace(x, P.SPACES, " "))


def split_message(c: Column | str, limit: int) -> Column:
    """Pieces of at most ``limit`` characters, cut at line ends where lines fit."""
    lines = F.flatten(F.transform(F.split(_col(c), "\n", -1), lambda line: F.when(F.length(line) <= limit, F.array(line)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(line) - 1) / limit).cast("int")), lambda i: F.substr(line, i * limit + 1, F.lit(limit))))))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))
    step = lambda acc, line: F.when(acc["now"].isNull(), F.struct(acc["done"].alias("done"), line.alias("now"))).when(F.length(acc["now"]) + 1 + F.length(line) <= limit, F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.lit("\n"), line).alias("now"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), line.alias("now")))
    return F.aggregate(lines, empty, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))


def placeholders(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit(r"\[([^\[\]\n]{2,80})\](?!\()"), F.lit(1)))


def telegram_html(c: Column | str) -> Column:
    """Markdown as the few tags a messenger takes: escaped first, then code, headings, links, bold and italic."""
    x = F.replace(F.replace(F.replace(_col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    x = F.regexp_replace(x, r"(?s)```(?:\w+)?\n?(.*?)```", "<pre>$1</pre>")
    x = F.regexp_replace(F.regexp_replace(x, r"`([^`\n]+)`", "<code>$1</code>"), r"(?m)^#{1,6}\s+(.+)$", "<b>$1</b>")
    x = F.regexp_replace(x, r"\[([^\]]+)\]\((https?://[^)\s]+)\)", '<a href="$2">$1</a>')
    x = F.regexp_replace(x, r"\*\*([^*\n]+)\*\*", "<b>$1</b>")
    return F.regexp_replace(x, r"(?<![*\w])\*([^*\n]+)\*(?![*\w])", "<i>$1</i>")


def query_kind(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.rlike(P.ARTICLE_REFERENCE), "article_lookup").when(c.rlike(P.ANALYTICAL), "analytical").when(c.rlike(P.PROCEDURAL), "procedural").otherwise("factual")


def article_reference(c: Column | str, compose: bool = True) -> tuple[Column, Column]:
    """(number, document hint) that a query names; both null without a number. A code is named where a word begins like it,
    not where ``yer`` ends some other word."""
    c = _col(c)
    number = F.coalesce(*[F.nullif(F.regexp_extract(c, P.ARTICLE_IN_QUERY, i), F.lit("")) for i in (1, 2)])
    short = lambda folded: [F.when(folded.rlike(rf"(?U)\b{name}\b"), full) for name, full in P.CODE_SHORTHAND.items()]
    hint = bound(fold(c, compose), lambda folded: F.coalesce(*short(folded), *[F.when(folded.rlike(rf"(?U)\b{w}"), w) for w in P.CODE_WORDS]))
    return number, F.when(number.isNotNull(), hint)


def is_legal_claim(c: Column | str, compose: bool = True) -> Column:
    return _col(c).rlike(P.CITATION_TAG) | fold(c, compose).rlike(P.LEGAL_MARKERS)


def claim_tags(c: Column | str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(_col(c), F.lit(P.CITATION_TAG), F.lit(1)), F.upper))


def mentioned_articles(c: Column | str) -> Column:
    """Article numbers that a text names, both ends of ranges."""
    p = r"(?iu)(\d+(?:\s*[-–]\s*\d+)?)\s*[-–]\s*(?:modda|модда)|(?:статья|ст\.)\s*(\d+)"
    found = F.concat(*[F.regexp_extract_all(_col(c), F.lit(p), F.lit(i)) for i in (1, 2)])
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(found, lambda x: F.split(x, "[-–]", -1))), strip), lambda x: x != ""))


def hashed_ngrams(c: Column | str, size: int = 512) -> Column:
    """Unit vector of signed hashed character 3- to 5-grams (FNV-1a)."""
    import numpy as np

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text):
            vector = np.zeros(size, np.float32)
            for word in (text or "").split():
                marked = f" {word} "
                for n in (3, 4, 5):
                    for i in range(len(marked) - n + 1):
                        h = 2166136261
                        for byte in marked[i : i + n].encode():
                            h = (h ^ byte) * 16777619 & 0xFFFFFFFF
                        vector[h % size] += 1 if h >> 31 == 0 else -1
            norm = float(np.sqrt(vector @ vector))
            return (vector / norm if norm else vector).tolist()

        return texts.map(one)

    return embed(_col(c))
