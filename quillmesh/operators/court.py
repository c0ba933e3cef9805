"""Court decisions: fields, sections, references and penalties read, rules checked and profiles made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T

# Headings of the parts of a decision, roles, codes and kinds of penalty, in the order they are tried.
SECTIONS = [("circumstances", ["aniqladi", "topdi", "установил", "aniqlandi"]), ("reasoning", ["asoslar", "sud xulosalari", "мотивировочная", "sud fikricha"]), ("conclusion", ["hukm qildi", "qaror qildi", "ajrim qildi", "hal qildi", "приговорил", "решил", "определил"])]
HEADING = r"^\s*[A-ZЎҚҒҲА-Я][A-ZЎҚҒҲА-Я'ʻʼ\s]{3,40}?\s*:?\s*$"
HEADING_LINE = r"(?m)^(?=[^\S\n]*[A-ZЎҚҒҲА-Я][A-ZЎҚҒҲА-Я'ʻʼ \t]{3,40}?[^\S\n]*:?[^\S\n]*$)[^\S\n]*"
NAME = r"[A-ZЎҚҒҲ][a-zʻʼ']+(?:[^\S\n]+[A-ZЎҚҒҲ]\.[^\S\n]*[A-ZЎҚҒҲ]\.|[^\S\n]+[A-ZЎҚҒҲ][a-zʻʼ']+){0,2}"
ROLES = [("sudlanuvchi", "sudlanuvchi"), ("ayblanuvchi", "ayblanuvchi"), ("jabrlanuvchi", "jabrlanuvchi"), ("davogar", "da[ʼ'`]?vogar|истец"), ("javobgar", "javobgar|ответчик"), ("prokuror", "prokuror|прокурор"), ("himoyachi", "himoyachi|advokat|защитник"), ("tarjimon", "tarjimon|переводчик"), ("guvoh", "guvoh")]
CASE_NUMBER = r"(?iu)(?:ish\w*\s*(?:raqami|№|N)|№|дело\s*№)\s*[:\-]?\s*([0-9][0-9A-Za-z\-/№.]{2,30})"
JUDGE = rf"(?i:sudya\w*|raislik[^\S\n]+qiluvchi|раислик|судья)[^\S\n]*[:\-]?[^\S\n]*({NAME})"
CODES = ["jinoyat-protsessual kodeksi", "fuqarolik protsessual kodeksi", "iqtisodiy protsessual kodeksi", "jinoyat-ijroiya kodeksi", "jinoyat kodeksi", "fuqarolik kodeksi", "mehnat kodeksi", "oila kodeksi", "soliq kodeksi", "yer kodeksi", "uy-joy kodeksi", "bojxona kodeksi", "budjet kodeksi", "ma'muriy javobgarlik to'g'risidagi kodeks"]
SHORT_CODES = {"jk": "jinoyat kodeksi", "fk": "fuqarolik kodeksi", "jpk": "jinoyat-protsessual kodeksi", "fpk": "fuqarolik protsessual kodeksi", "mk": "mehnat kodeksi", "mjtk": "ma'muriy javobgarlik to'g'risidagi kodeks"}
LAW_REFERENCE = r"(?iu)([A-Za-zʻʼ'\-\s]{3,60}?kodeks\w*|\bJK\b|\bFK\b|\bJPK\b|\bFPK\b|\bMK\b|\bMJTK\b)[a-zʻʼ'\s]{0,12}?((?:\d{1,4}(?:\s*[-–]\s*\d{1,3})?[\s,va]{0,6}){1,8})\s*[-–]\s*moddas?\w*(?:\s*(\d{1,2})\s*[-–]\s*qism\w*)?"
EVIDENCE = r"(?iU)\b(guvoh\w*\s+ko[ʻ']?rsatuv\w*|ko[ʻ']?rsatuv\w*|ekspert\w*\s+xulosa\w*|xulosa\w*|protokol\w*|hujjat\w*|dalil\w*|videoyozuv\w*|audioyozuv\w*|tekshiruv\s+bayonnoma\w*|surishtiruv\s+materiallar\w*)\b"
PENALTIES = [("prison", r"ozodlikdan\s+mahrum\s+qil\w*"), ("restriction", r"ozodlikni\s+cheklash"), ("correction", r"axloq\s+tuzatish\s+ishlar\w*"), ("community", r"majburiy\s+jamoat\s+ishlar\w*"), ("fine", "jarima"), ("recovery", r"undiril\w*|undirib\s+beril\w*")]
TERM = r"(?iu)(\d+(?:[.,]\d+)?)\s*(yil|oy|kun|foiz|%|baravar|barobar|BHM|bazaviy\s+hisoblash\s+miqdor\w*|so[ʻ']?m)"
COURT = r"(?iu)([A-ZЎҚҒҲA-Za-zʻʼ'\-\s]{4,60}?(?:tumanlararo|tuman|shahar|viloyat|respublika)[A-Za-zʻʼ'\-\s]{0,40}?sudi)"
APPEAL = r"(?iu)[^.\n]{0,160}(?:apellyatsiya|kassatsiya|shikoyat)[^.\n]{0,160}\."
# The clauses that the patterns of hearings, appeals and references are looked for in: none of them has a mark that ends its clause.
HEARING_CLAUSE = r"(?:\A|(?![a-z])[.\n])([^.\n]*?(?iu:majlis|yig[ʻ']?ilish)[^.\n]*)"
APPEAL_CLAUSE = r"(?:\A|(?![a-z])[.\n])([^.\n]*?(?iu:apellyatsiya|kassatsiya|shikoyat)[^.\n]{0,160}\.)"
LAW_CLAUSE = r"(?:\A|(?![a-z])[.:;!?()])([^.:;!?()]*?(?iu:modda)[^.:;!?()]*)"
HEARING = r"(?iu)[^.\n]{0,120}(?:majlis\w*|yig[ʻ']?ilish\w*)[^.\n]{0,120}"
SUSPENDED = r"(?iu)shartli\s+ravishda|shartli\s+hukm|jazoni\s+o[ʻ']?tashdan\s+ozod"


def split_sections(decisions: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """(key, section, body): intro before the first known heading, then the named parts; none without headings."""
    lines = decisions.select(key, F.posexplode(F.split(text, r"\r?\n", -1)).alias("pos", "line"))
    folded = F.rtrim(F.regexp_replace(T.fold("line", False), r":\s*$", ""))
    name = T.bound(folded, lambda x: F.coalesce(*[F.when(x.startswith(v), section) for section, variants in SECTIONS for v in variants]))
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("mark", F.when(F.col("line").rlike(HEADING), name))
    placed = marked.withColumn("section", F.coalesce(F.last("mark", ignorenulls=True).over(upto), F.lit("intro"))).withColumn("any", F.count("mark").over(Window.partitionBy(key)))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("mark").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return placed.where("any > 0").groupBy(key, "section").agg(T.strip(body).alias("body"))


def header_fields(text: Column, intro: Column | None = None) -> list[Column]:
    """Case number, court, judge, dates of decision and hearing, and kind; all but number and kind from the intro."""
    intro = text if intro is None else intro
    nul = lambda c: F.nullif(c, F.lit(""))
    kinds = lambda low: F.when(low.rlike(r"(?U)\bhukm\b|приговор"), "hukm").when(low.rlike(r"(?U)\bqaror\b|решение"), "qaror").when(low.rlike(r"(?U)\bajrim\b|определение"), "ajrim")
    kind = T.bound(F.lower(F.left(text, F.lit(400))), kinds)
    court = nul(F.trim(F.regexp_replace(F.regexp_extract(intro, COURT, 1), r"\s+", " ")))
    hearing = F.regexp_extract(F.regexp_extract(intro, HEARING_CLAUSE, 1), HEARING, 0)
    return [nul(F.regexp_extract(text, CASE_NUMBER, 1)).alias("case_number"), court.alias("court"), nul(F.regexp_extract(intro, JUDGE, 1)).alias("judge"), T.extract_date(intro).alias("decided_at"), T.extract_date(hearing).alias("hearing_at"), kind.alias("kind")]


def with_sections(decisions: DataFrame, text: str = "text") -> DataFrame:
    """Decisions with the columns intro, circumstances, reasoning and conclusion; of repeated headings the last counts.

    Lines that are headings become marks, between which the parts are cut out. Without headings all is intro, up to 1500
    characters, and the other parts are empty.
    """
    marked = F.col(text)
    for section, variants in SECTIONS:
        name = f"(?iu:{'|'.join(variants)})"
        marked = F.regexp_replace(marked, rf"(?m)^(?=[^\S\n]*{name}){HEADING_LINE}{name}.*$", f"\x01{section}\x02")
    trim = lambda c: F.btrim(c, F.lit(" \t\r\n"))
    m = F.col("__marked")
    intro = F.when(F.instr(m, "\x01") > 0, trim(F.substring_index(m, "\x01", 1))).otherwise(F.left(m, F.lit(1500)))
    parts = [trim(F.substring_index(F.when(F.instr(m, f"\x01{name}\x02") > 0, F.substring_index(m, f"\x01{name}\x02", -1)).otherwise(""), "\x01", 1)).alias(name) for name, _ in SECTIONS]
    return decisions.withColumn("__marked", marked).select(*decisions.columns, intro.alias("intro"), *parts)


def _party(pattern: str) -> str:
    return rf"(?i:{pattern})[^\S\n]*[:\-—]?[^\S\n]*({NAME})"


def role_array(text: Column) -> Column:
    """Array of the roles of party_array, each once."""
    return F.array_compact(F.array(*[F.when(text.rlike(_party(pattern)), role) for role, pattern in ROLES]))


def party_array(text: Column) -> Column:
    """Array of (role, name), each person once a role."""

    def of_role(role: str, pattern: str) -> Column:
        names = F.regexp_extract_all(text, F.lit(_party(pattern)), F.lit(1))
        first = lambda found: F.filter(found, lambda n, i: F.array_position(F.transform(found, F.lower), F.lower(n)) == i + 1)
        return F.transform(T.bound(names, first), lambda n: F.struct(F.lit(role).alias("role"), n.alias("name")))

    return F.concat(*[of_role(role, pattern) for role, pattern in ROLES])


def reference_array(text: Column) -> Column:
    """Array of distinct (code, article, part), runs of articles spread out."""
    group = lambda m, i: F.regexp_extract(m, LAW_REFERENCE, i)
    clauses = F.regexp_extract_all(text, F.lit(LAW_CLAUSE), F.lit(1))
    found = F.flatten(F.transform(clauses, lambda s: F.regexp_extract_all(s, F.lit(LAW_REFERENCE), F.lit(0))))
    zipped = F.transform(found, lambda m: F.struct(group(m, 1).alias("a"), group(m, 2).alias("b"), group(m, 3).alias("c")))
    spread = lambda r: T.bound(resolve_code(r["a"]), lambda code: F.transform(T.expand_articles(r["b"]), lambda n: F.struct(code.alias("code"), n.alias("article"), F.nullif(r["c"], F.lit("")).alias("part"))))
    return F.array_distinct(F.filter(F.flatten(F.transform(zipped, spread)), lambda x: x["code"].isNotNull()))


def parties(decisions: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """(key, role, name), each person once a role."""
    return decisions.select(key, F.explode(party_array(F.col(text))).alias("p")).select(key, "p.*")


def resolve_code(raw: Column) -> Column:
    short = lambda folded: [F.when(folded == name, full) for name, full in SHORT_CODES.items()]
    return T.bound(T.fold(raw, False), lambda folded: F.coalesce(*short(folded), *[F.when(folded.contains(name), name) for name in sorted(CODES, key=len, reverse=True)]))


def law_references(decisions: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """(key, code, article, part), runs of articles spread out, each once."""
    return decisions.select(key, F.explode(reference_array(F.col(text))).alias("r")).select(key, "r.*")


def evidence(text: Column) -> Column:
    trimmed = F.transform(F.split(text, r"[\n;]|(?<=[.!?])\s+", -1), lambda s: F.regexp_replace(s, r"^[\s–—•-]+|[\s–—•-]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda s: (F.length(s) >= 15) & s.rlike(EVIDENCE)))


def penalty(text: Column) -> Column:
    """Struct (kind, amount, unit, suspended); null without a known kind."""
    kind = F.coalesce(*[F.when(text.rlike("(?iu)" + p), name) for name, p in PENALTIES])
    amount = F.replace(F.regexp_extract(text, TERM, 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), amount.alias("amount"), F.nullif(F.lower(F.regexp_extract(text, TERM, 2)), F.lit("")).alias("unit"), text.rlike(SUSPENDED).alias("suspended")))


# What the rules look for in folded texts, limits, and weights of severities.
GUILT = r"aybdor\s+deb\s+top|aybi\s+isbotlan|jinoyat\s+sodir\s+etgan"
MITIGATING = r"yengillashtiruvchi|birinchi\s+marta|voyaga\s+yetmagan|zararni\s+qopla\w*|chin\s+ko[ʻ']?ngildan\s+pushaymon|homilador|nogiron"
AGGRAVATING = r"og[ʻ']?irlashtiruvchi|takroran|bir\s+necha\s+marta|uyushgan\s+guruh|sudlanganlik\s+holati|retsidiv"
LAST_WORD = r"oxirgi\s+so[ʻ']?z"
INTERPRETER_NEED = r"tilini\s+bilmay\w*|tarjima\s+qilin\w*|rus\s+tilida\s+so[ʻ']?ragan"
PRECEDENT = r"plenum|oliy\s+sud|sud\s+amaliyot\w*|yuqori\s+turuvchi\s+sud|umumlashtir\w*\s+amaliyot"
PRIOR_CONVICTION = r"sudlanganlik|ilgari\s+sudlangan|oldingi\s+hukm|takroran\s+sodir"
PRIOR_ADDRESSED = r"sudlanganlik\w*\s+(?:olib\s+tashlan|bekor\s+qilin|hisobga\s+olin)|retsidiv\s+deb\s+top|og[ʻ']?irlashtiruvchi\s+holat"
FAST_TRIAL = r"qisqartirilgan\s+tartib|maxsus\s+tartib|kelishuv\s+shartnoma\w*|soddalashtirilgan"
PLEA_DEAL = r"aybni\s+tan\s+ol\w*|kelishuv|yarashuv"
RECANTED = r"ko[ʻ']rsatma\w*\s+(?:o[ʻ']zgart|rad\s+et|bekor\s+qil|qaytarib\s+ol)"
ONE_SIDED, OTHER_SIDE = r"yengillashtiruvchi|birinchi\s+marta|pushaymon|zararni\s+qopla", r"og[ʻ']irlashtiruvchi|takroran|uyushgan\s+guruh|retsidiv"
HIGHEST_ARTICLE, MOST_YEARS, APPEAL_DAYS, MOST_DELIBERATION = 1600, 25, (10, 20), 30
PROSPECT_WEIGHTS = {"critical": 0.30, "major": 0.12, "minor": 0.03, "info": 0.0}
PROSPECT_LABELS = [(0.60, "yuqori — bir nechta jiddiy shakl kamchiligi"), (0.30, "o'rtacha — asos bo'lishi mumkin bo'lgan kamchiliklar bor"), (0.10, "past — sezilarli shakl kamchiligi topilmadi"), (0.0, "kamchilik topilmadi")]
TYPICAL_YEARS = [("o'g'irlik", 1, 5), ("talonchilik", 3, 10), ("firibgarlik", 2, 7), ("o'ldirish", 8, 20), ("bosqinchilik", 5, 15), ("giyohvand", 3, 10), ("pora", 3, 10), ("zorlash", 5, 15), ("o'zlashtirish", 3, 10)]
LENIENT, HARSH, VERY_FAST_DAYS, FAST_DAYS = 0.4, 1.5, 3, 7


def read_decisions(decisions: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """One row a decision with all that the rules look at: array expressions over the row, nothing is shuffled."""
    cut = with_sections(decisions.select(key, T.canonical(text).alias("raw")), "raw")
    raw, part = F.col("raw"), F.col
    narrated = F.concat_ws("\n", part("circumstances"), part("reasoning"))
    appeal = F.regexp_extract(F.regexp_extract(F.when(part("conclusion") != "", part("conclusion")).otherwise(raw), APPEAL_CLAUSE, 1), APPEAL, 0)
    read = cut.select(
        key,
        *header_fields(raw, part("intro")),
        role_array(F.concat_ws("\n", part("intro"), part("circumstances"))).alias("roles"),
        evidence(narrated).alias("evidence"),
        reference_array(raw).alias("laws"),
        penalty(part("conclusion")).alias("penalty"),
        F.trim(appeal).alias("appeal_note"),
        (part("reasoning") != "").alias("has_reasoning"),
        (part("conclusion") != "").alias("has_conclusion"),
        T.fold(raw, False).alias("body"),
        T.fold(F.concat_ws(" ", part("reasoning"), part("circumstances")), False).alias("narrative"),
        T.fold(F.concat_ws(" ", part("circumstances"), part("conclusion")), False).alias("deed"),
        T.fold(part("conclusion"), False).alias("verdict"),
    )
    criminal = F.coalesce(F.col("kind") == "hukm", F.lit(False)) | F.exists("laws", lambda c: c["code"].contains("jinoyat kodeksi"))
    return read.withColumn("criminal", criminal).withColumn("convicting", F.concat_ws(" ", "verdict", "narrative").rlike(GUILT))


def _rules(read: DataFrame, key: str, rules: list[tuple[str, str, Column, Column | str]], value: str) -> DataFrame:
    """(key, code, check, value) for every rule (code, check, condition, value) that holds."""
    made = [F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(check).alias("check"), (worth if isinstance(worth, Column) else F.lit(worth)).alias(value))) for code, check, condition, worth in rules]
    return read.select(key, F.explode(F.filter(F.array(*made), lambda r: r.isNotNull())).alias("f")).select(key, "f.*")


def findings(read: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, code, check, severity): seven checks with 24 codes; PROC-001 once for each field that is missing."""
    col, size = F.col, F.size
    criminal, years = col("criminal"), (col("penalty.kind") == "prison") & (col("penalty.unit") == "yil")
    role = lambda name: F.array_contains("roles", name)
    material = F.exists("laws", lambda c: ~c["code"].rlike("protsessual|ijroiya"))
    punished = col("penalty").isNotNull()
    decided, heard = col("decided_at").try_cast("date"), col("hearing_at").try_cast("date")
    days = F.regexp_extract("appeal_note", r"(?i)(\d{1,3})\s*kun", 1).try_cast("int")
    number = lambda c: F.split_part(c["article"], F.lit("-"), F.lit(1)).try_cast("int")
    # Codes, checks and severities, in the order of the checks.
    rules = [("PROC-001", "protsessual", col(field).isNull(), "major") for field in ("case_number", "court", "judge", "decided_at")] + [
        ("PROC-002", "protsessual", ~col("has_conclusion"), "critical"),
        ("PROC-003", "protsessual", size("roles") == 0, "major"),
        ("PROC-004", "protsessual", criminal & ~role("prokuror"), "minor"),
        ("EVID-001", "dalillar", size("evidence") == 0, F.when(col("convicting"), "critical").otherwise("major")),
        ("EVID-002", "dalillar", col("convicting") & (size("evidence") == 1), "major"),
        ("EVID-003", "dalillar", (size("evidence") > 0) & ~col("has_reasoning"), "major"),
        ("LAW-001", "qonun", size("laws") == 0, "critical"),
        ("LAW-002", "qonun", (size("laws") > 0) & punished & ~material, "critical"),
        ("LAW-003", "qonun", (size("laws") > 0) & criminal & ~F.exists("laws", lambda c: c["code"].contains("jinoyat kodeksi")), "critical"),
        ("LAW-004", "qonun", F.exists("laws", lambda c: number(c) > HIGHEST_ARTICLE), "major"),
        ("PROP-001", "mutanosiblik", years & (col("penalty.amount") > MOST_YEARS), "critical"),
        ("PROP-002", "mutanosiblik", (col("penalty.kind") == "prison") & col("narrative").rlike(MITIGATING) & ~col("narrative").rlike(AGGRAVATING), "major"),
        ("PROP-003", "mutanosiblik", punished & ~col("has_reasoning"), "major"),
        ("RIGHT-001", "huquqlar", criminal & ~role("himoyachi"), "critical"),
        ("RIGHT-002", "huquqlar", criminal & ~col("body").rlike(LAST_WORD), "major"),
        ("RIGHT-003", "huquqlar", col("body").rlike(INTERPRETER_NEED) & ~role("tarjimon"), "critical"),
        ("RIGHT-004", "huquqlar", col("appeal_note") == "", "minor"),
        ("TIME-001", "muddat", decided < heard, "critical"),
        ("TIME-002", "muddat", F.datediff(decided, heard) > MOST_DELIBERATION, "minor"),
        ("TIME-003", "muddat", ~days.between(*APPEAL_DAYS), "major"),
        ("TIME-004", "muddat", decided.isNull(), "minor"),
        ("PREC-001", "amaliyot", col("body").rlike(PRIOR_CONVICTION) & ~col("body").rlike(PRIOR_ADDRESSED), "major"),
        ("PREC-002", "amaliyot", ~col("body").rlike(PRECEDENT) & col("has_reasoning"), "info"),
    ]
    return _rules(read, key, rules, "severity")


def prospect(found: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, score, label, n): weights of the severities added up to 1 at most, and what an appeal may hope for."""
    weight = F.coalesce(*[F.when(F.col("severity") == severity, weight) for severity, weight in PROSPECT_WEIGHTS.items()])
    total = F.least(F.lit(1.0), F.round(F.sum(weight), 9))
    label = F.coalesce(*[F.when(total >= least, name) for least, name in PROSPECT_LABELS])
    return found.groupBy(key).agg(F.round(total, 2).alias("score"), label.alias("label"), F.count("*").alias("n"))


def integrity_flags(read: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, code, check, weight): five groups of rules with 15 codes. Patterns take both apostrophes a folded text may hold."""
    col, criminal = F.col, F.col("criminal")
    role = lambda name: F.array_contains("roles", name)
    years = F.when((col("penalty.kind") == "prison") & (col("penalty.unit") == "yil"), col("penalty.amount"))
    typical = F.coalesce(*[F.when(col("deed").contains(crime), F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))) for crime, low, high in TYPICAL_YEARS])
    lenient = years / typical["low"] < LENIENT
    suspended, punished = F.coalesce(col("penalty.suspended"), F.lit(False)), col("penalty").isNotNull()
    gap = F.datediff(col("decided_at").try_cast("date"), col("hearing_at").try_cast("date"))
    guilty = col("verdict").contains("aybdor")
    unfit = F.exists("evidence", lambda e: T.fold(e, False).rlike("qabul qilinmaydigan|noqonuniy"))
    # Codes, groups and weights.
    rules = [
        ("SENT-001", "sentencing", lenient, 0.35),
        ("SENT-002", "sentencing", ~lenient & (years / typical["high"] > HARSH), 0.20),
        ("SENT-003", "sentencing", years.isNotNull() & suspended, 0.10),
        ("PROC-001", "procedural", criminal & col("body").rlike(FAST_TRIAL), 0.05),
        ("PROC-002", "procedural", criminal & ~role("himoyachi"), 0.30),
        ("PROC-003", "procedural", col("body").rlike(PLEA_DEAL) & suspended, 0.15),
        ("EVID-001", "evidence", unfit & guilty, 0.30),
        ("EVID-002", "evidence", col("body").rlike(RECANTED), 0.15),
        ("EVID-003", "evidence", (F.size("evidence") <= 1) & guilty, 0.25),
        ("TIME-001", "timing", criminal & gap.between(0, VERY_FAST_DAYS), 0.15),
        ("TIME-002", "timing", criminal & gap.between(VERY_FAST_DAYS + 1, FAST_DAYS), 0.05),
        ("STRUC-001", "structural", ~col("has_reasoning"), 0.25),
        ("STRUC-002", "structural", (F.size("laws") == 0) & punished, 0.30),
        ("STRUC-003", "structural", criminal & punished & ~role("jabrlanuvchi"), 0.05),
        ("STRUC-004", "structural", col("narrative").rlike(ONE_SIDED) & ~col("narrative").rlike(OTHER_SIDE) & suspended, 0.15),
    ]
    return _rules(read, key, rules, "weight")


def integrity_scores(flags: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, score, n): weights added up to 1 at most."""
    return flags.groupBy(key).agg(F.round(F.least(F.lit(1.0), F.round(F.sum("weight"), 9)), 2).alias("score"), F.count("*").alias("n"))


# Days to appeal by kind of case and stage, and the stages in order.
APPEAL_DEADLINES = {("civil", "first_instance"): 30, ("civil", "appeal"): 30, ("criminal", "first_instance"): 20, ("criminal", "appeal"): 30, ("administrative", "first_instance"): 15, ("economic", "first_instance"): 30, ("economic", "appeal"): 30}


def appeal_deadline_days(case_type: Column, stage: Column) -> Column:
    """Days to appeal, null where there is no appeal."""
    return F.coalesce(*[F.when((case_type == kind) & (stage == at), days) for (kind, at), days in APPEAL_DEADLINES.items()])


STAGES = ("pretrial", "first_instance", "appeal", "cassation", "supervisory", "execution")


def next_stage(stage: Column) -> Column:
    """The stage after one, null after the last and for others."""
    return F.coalesce(*[F.when(stage == now, after) for now, after in zip(STAGES, STAGES[1:], strict=False)])


def expired_deadlines(deadlines: Column, today: Column) -> Column:
    """Of an array of (action, due) those that were due before today."""
    return F.filter(deadlines, lambda d: d["due"] < today)


# Severities from the gravest on; those of the last kind ask for no correction.
SEVERITIES = ("critical", "major", "minor", "info")


def corrections(found: DataFrame, recommendations: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, corrections): what the findings (key, code, severity, pos) recommend by code (code, recommendation), the
    gravest first, then in the order in which they were found, each once."""
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    said = found.where(F.col("severity") != SEVERITIES[-1]).join(recommendations, "code").groupBy(key, "recommendation").agg(F.min(F.struct(place.alias("place"), "pos", "code")).alias("first"))
    in_order = F.sort_array(F.collect_list(F.struct("first", "recommendation")))
    return said.groupBy(key).agg(F.transform(in_order, lambda x: x["recommendation"]).alias("corrections"))


def evidence_by_strength(items: Column, strong: bool) -> Column:
    """Of an array of (strength, admissible): strong and admissible ones, or weak or inadmissible ones."""
    keep = (lambda e: (e["strength"] == "strong") & e["admissible"]) if strong else (lambda e: (e["strength"] == "weak") | ~e["admissible"])
    return F.filter(items, keep)


def flags_in_order(found: DataFrame, categories: list[str], key: str = "case_id", category: str = "check") -> DataFrame:
    """(key, lines): findings of a case grouped by a fixed order of categories, one line each with its mark and code."""
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(category))
    line = F.concat(F.lit("- ["), F.col(category), F.lit("] "), F.col("code"))
    return found.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("place"), F.col("code").alias("code"), line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def judge_matches(read: DataFrame, needle: str) -> DataFrame:
    """Decisions of judges whose folded name holds the folded needle."""
    return read.where(T.fold("judge", False).contains(needle.lower()))


def judge_notice(read: DataFrame) -> DataFrame:
    """One row: cases and distinct judges, and whether a profile of them would mix several."""
    return read.agg(F.count("*").alias("n_cases"), F.countDistinct("judge").alias("n_judges")).withColumn("mixed", F.col("n_judges") > 1)


def clipped(text: Column, most: int = 120) -> Column:
    """Evidence as it is shown: on one line, cut with an ellipsis."""
    line = T.strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(line) > most, F.concat(T.strip(F.left(line, F.lit(most - 1))), F.lit("…"))).otherwise(line)


def judge_profiles(read: DataFrame, scores: DataFrame, key: str = "case_id") -> DataFrame:
    joined = read.join(scores.select(key, "score"), key, "left").where("judge IS NOT NULL")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    risk = F.least(F.lit(1.0), F.pow(F.avg(F.pow(F.coalesce("score", F.lit(0.0)), 1.5)), 1 / 1.5))
    return joined.groupBy("judge").agg(F.count("*").alias("n_cases"), count(F.col("penalty.kind") == "prison").alias("n_prison"), count(F.col("penalty.suspended")).alias("n_suspended"), count(F.col("penalty.kind") == "fine").alias("n_fines"), F.round(F.avg(F.when(F.col("penalty.unit") == "yil", F.col("penalty.amount"))), 4).alias("mean_years"), F.round(risk, 6).alias("risk"))


def advice_confidence(strong: Column, weak: Column) -> Column:
    return F.when(strong + weak == 0, 0.3).otherwise(F.least(F.lit(0.9), F.greatest(F.lit(0.1), strong / (strong + weak))))
