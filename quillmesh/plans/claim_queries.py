"""Queries of claim checking over conversations, and of court decisions over texts written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import claims as G
from quillmesh.operators import court as CT
from quillmesh.operators import metrics as M
from quillmesh.plans.base import Registry, table

REGISTRY = Registry()
query = REGISTRY.query
ANSWERS = "SELECT conv_id * 1000 + turn AS answer_id, text AS answer FROM conversations WHERE role = 'assistant'"


def _answers(spark, sf_dir):
    """Assistant turns, their first sentence tagged, and the turn before as source."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.regexp_replace("text", r"^([^.]*)\.", "$1 [C1].").alias("answer"))
    sources = turns.select((F.col("conv_id") * 1000 + F.col("turn") + 1).alias("answer_id"), F.lit("C1").alias("tag"), F.col("text").alias("excerpt"), F.lit("Mehnat kodeksi").alias("doc_title"), (F.col("turn") + 100).cast("string").alias("article"))
    return answers, sources


@query(f"""
WITH l AS (SELECT answer_id, unnest(r) AS line, generate_subscripts(r, 1) AS n FROM (SELECT answer_id, string_split(answer, chr(10)) AS r FROM ({ANSWERS})))
SELECT answer_id, count(*) AS n_lines, count(CASE WHEN trim(line) = '' THEN 1 END) AS n_blank, count(CASE WHEN regexp_matches(trim(line), '^[-*•–—]\\s+|^\\d{{1,2}}[.)]\\s+') THEN 1 END) AS n_bullets FROM l GROUP BY 1""")
def claim_lines(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.col("text").alias("answer"))
    split = G.split_claims(turns)
    by_line = split.groupBy("answer_id", "line_no").agg(F.max(F.col("prefix") != "").alias("bullet"), F.max((F.col("text") == "") & ~F.col("is_claim")).alias("blank"))
    return by_line.groupBy("answer_id").agg(F.count("*").alias("n_lines"), F.count_if("blank").alias("n_blank"), F.count_if("bullet").alias("n_bullets"))


@query()
def claim_split(spark, sf_dir):
    """Whole answers with their lists, headings and blank lines; SQL has no look-behind for sentence ends, a test compares."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.col("text").alias("answer"))
    return G.split_claims(turns).select("answer_id", F.col("pos").cast("bigint").alias("pos"), "text", "is_claim", "is_heading")


@query()
def claim_gate(spark, sf_dir):
    answers, sources = _answers(spark, sf_dir)
    return G.gate_report(G.check_claims(G.split_claims(answers), sources))


@query()
def claim_decisions(spark, sf_dir):
    answers, sources = _answers(spark, sf_dir)
    return G.check_claims(G.split_claims(answers), sources).select("answer_id", "pos", "kind", "status", "reason")


@query()
def answers_reassembled(spark, sf_dir):
    answers, sources = _answers(spark, sf_dir)
    split = G.split_claims(answers)
    return G.reassemble(split, G.check_claims(split, sources)).select("answer_id", F.length("answer").alias("size"))


@query("""
WITH q AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN conv_id % 10 = 0 OR n >= 60 THEN 'complex' WHEN n >= 25 THEN 'standard' ELSE 'simple' END AS route FROM q""")
def complexity_route(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", G.complexity(F.col("text"), F.lit("factual"), F.col("conv_id") % 10 == 0).alias("route"))


@query("SELECT o_orderkey, CAST(round(CAST(least(1.0, greatest(0.0, (o_orderkey % 10) / 10.0 * CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 5 - 1) / (o_custkey % 5) ELSE 1.0 END * CASE WHEN o_orderkey % 3 = 0 THEN 0.8 ELSE 1.0 END)) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS confidence FROM orders")
def answer_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    total = F.col("o_custkey") % 5
    return rows.select("o_orderkey", G.confidence((F.col("o_orderkey") % 10) / 10.0, total - 1, total, F.col("o_orderkey") % 3 == 0).alias("confidence"))


@query("""
WITH s AS (SELECT o_orderkey, list_distinct([o_custkey % 3, o_custkey % 5, 7]) AS a, list_distinct([o_orderkey % 3, o_orderkey % 4, 7]) AS b FROM orders)
SELECT o_orderkey, round(0.4 * abs((o_orderkey % 7) / 7 - (o_orderkey % 11) / 11) + 0.4 * (1 - len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))) + 0.2 * 0.5, 6) AS disagreement FROM s""")
def disagreement(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    a, b = F.array_distinct(F.array(cust % 3, cust % 5, F.lit(7).cast("bigint"))), F.array_distinct(F.array(key % 3, key % 4, F.lit(7).cast("bigint")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(M.disagreement((key % 7) / 7, (key % 11) / 11, a, b, F.lit(0.5)), 6).alias("disagreement"))


def _decisions(spark, sf_dir):
    """Court decisions written from orders; what each holds follows from remainders of its key, as the SQL below says.

    The narrow keys are spread first, so that one small file of orders is not one task of long texts.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")).repartition(spark.sparkContext.defaultParallelism)
    key = F.col("o_orderkey")
    when = lambda condition, line: F.when(F.expr(condition.replace("k", "o_orderkey")), line if not isinstance(line, str) else F.lit(line))
    judge = F.concat(F.lit("Sudya: Karimov A."), F.element_at(F.array(*[F.lit(c) for c in "ABDEG"]), (key % 5 + 1).cast("int")), F.lit("."))
    text = F.concat_ws(
        "\n",
        F.when(key % 16 == 7, "QAROR.").otherwise("HUKM."),
        when("k % 7 <> 0", F.concat(F.lit("Ish raqami: 1-"), key.cast("string"), F.lit("/24"))),
        when("k % 11 <> 0", "Toshkent shahar sudi."),
        when("k % 13 <> 0", judge),
        when("k % 17 <> 0", F.date_format("day", "dd.MM.yyyy")),
        when("k % 5 <> 1", F.concat(F.lit("Sud majlisi "), F.date_format(F.date_sub("day", (key % 45 - 3).cast("int")), "yyyy-MM-dd"), F.lit(" kuni."))),
        when("k % 3 <> 1", "Sudlanuvchi Aliyev B.B."),
        when("k % 3 = 0", "Himoyachi Yusupov B.B."),
        when("k % 4 = 0", "Prokuror Rahimov C.C."),
        when("k % 6 < 4", "Jabrlanuvchi Olimov D.D."),
        F.lit("ANIQLADI:"),
        when("k % 4 <> 0", "Guvoh koʻrsatuvlari va ekspert xulosasi oʻrganildi."),
        when("k % 4 = 2", "Protokol va hujjatlar koʻrib chiqildi."),
        when("k % 24 = 10", "Dalil noqonuniy deb topilgan."),
        when("k % 10 < 5", "Oʻgʻirlik holati."),
        when("k % 10 BETWEEN 5 AND 7", "Bosqinchilik holati."),
        when("k % 9 = 0", "Yengillashtiruvchi holat bor."),
        when("k % 18 = 0", "Uyushgan guruh bor."),
        when("k % 8 = 3", "Ilgari sudlangan shaxs."),
        when("k % 12 = 5", "Sud tilini bilmaydi."),
        when("k % 14 = 6", "Guvoh koʻrsatmasini oʻzgartirgan."),
        when("k % 21 = 2", "Ish soddalashtirilgan tarzda koʻrildi."),
        when("k % 22 = 4", "Yarashuv tuzildi."),
        when("k % 4 = 1", "Sudlanuvchiga oxirgi soʻz berildi."),
        when("k % 10 <> 9", "Jinoyat kodeksining 169-moddasi 2-qismi qoʻllanildi."),
        when("k % 20 = 9", "Jinoyat-protsessual kodeksining 455-moddasi qoʻllanildi."),
        when("k % 15 = 4", "Fuqarolik kodeksining 1700 va 1702-moddalari qoʻllanildi."),
        when("k % 5 = 0", "ASOSLAR:"),
        when("k % 5 = 0", "Sud fikri shunday."),
        when("k % 10 = 0", "Oliy sud Plenumi hisobga olindi."),
        when("k % 19 <> 0", F.when(key % 16 == 7, "QAROR QILDI:").otherwise("HUKM QILDI:")),
        when("k % 19 <> 0", F.concat((key % 30 + 1).cast("string"), F.lit(" yil ozodlikdan mahrum qilinsin."))),
        when("k % 19 <> 0 AND k % 2 = 0", "Jazo shartli ravishda."),
        when("k % 19 <> 0 AND k % 3 = 2", "Shaxs aybdor deb topilsin."),
        when("k % 19 <> 0 AND k % 6 <> 5", F.concat(F.lit("Shikoyat "), (key % 20 + 5).cast("string"), F.lit(" kun ichida beriladi."))),
    )
    return orders.select(key.alias("case_id"), text.alias("text"))


COURT_SQL = """
WITH d AS (
  SELECT o_orderkey AS k, o_orderkey AS case_id, CASE WHEN o_orderkey % 13 <> 0 THEN 'Karimov A.' || substr('ABDEG', CAST(o_orderkey % 5 + 1 AS INT), 1) || '.' END AS judge, CAST(o_orderdate AS DATE) AS day,
    CASE WHEN o_orderkey % 5 <> 1 THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 45 - 3 AS INT) END AS heard,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 5 <> 1 THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 45 - 3 AS INT) END AS decided,
    CAST(o_orderkey % 4 <> 0 AS INT) + CAST(o_orderkey % 4 = 2 AS INT) + CAST(o_orderkey % 24 = 10 AS INT) AS ev,
    o_orderkey % 10 <> 9 AS jk, o_orderkey % 20 = 9 AS jpk, o_orderkey % 15 = 4 AS fk, o_orderkey % 5 = 0 AS reasoned, o_orderkey % 19 <> 0 AS concluded,
    o_orderkey % 19 <> 0 AND o_orderkey % 3 = 2 AS guilty, o_orderkey % 19 <> 0 AND o_orderkey % 2 = 0 AS suspended, o_orderkey % 30 + 1 AS years, o_orderkey % 16 <> 7 OR o_orderkey % 10 <> 9 AS criminal FROM orders
), e AS (SELECT *, jk OR jpk OR fk AS laws, date_diff('day', heard, decided) AS gap FROM d),
"""
FINDINGS_SQL = COURT_SQL + """
f AS (SELECT case_id, unnest(list_filter([
  CASE WHEN k % 7 = 0 THEN 'PROC-001|major' END, CASE WHEN k % 11 = 0 THEN 'PROC-001|major' END, CASE WHEN judge IS NULL THEN 'PROC-001|major' END, CASE WHEN decided IS NULL THEN 'PROC-001|major' END,
  CASE WHEN NOT concluded THEN 'PROC-002|critical' END, CASE WHEN k % 3 = 1 AND k % 4 <> 0 AND k % 6 >= 4 THEN 'PROC-003|major' END, CASE WHEN criminal AND k % 4 <> 0 THEN 'PROC-004|minor' END,
  CASE WHEN ev = 0 THEN CASE WHEN guilty THEN 'EVID-001|critical' ELSE 'EVID-001|major' END END, CASE WHEN guilty AND ev = 1 THEN 'EVID-002|major' END, CASE WHEN ev > 0 AND NOT reasoned THEN 'EVID-003|major' END,
  CASE WHEN NOT laws THEN 'LAW-001|critical' END, CASE WHEN laws AND concluded AND NOT jk AND NOT fk THEN 'LAW-002|critical' END, CASE WHEN laws AND criminal AND NOT jk THEN 'LAW-003|critical' END, CASE WHEN fk THEN 'LAW-004|major' END,
  CASE WHEN concluded AND years > 25 THEN 'PROP-001|critical' END, CASE WHEN concluded AND k % 9 = 0 AND k % 18 <> 0 THEN 'PROP-002|major' END, CASE WHEN concluded AND NOT reasoned THEN 'PROP-003|major' END,
  CASE WHEN criminal AND k % 3 <> 0 THEN 'RIGHT-001|critical' END, CASE WHEN criminal AND k % 4 <> 1 THEN 'RIGHT-002|major' END, CASE WHEN k % 12 = 5 THEN 'RIGHT-003|critical' END, CASE WHEN NOT concluded OR k % 6 = 5 THEN 'RIGHT-004|minor' END,
  CASE WHEN gap < 0 THEN 'TIME-001|critical' END, CASE WHEN gap > 30 THEN 'TIME-002|minor' END, CASE WHEN concluded AND k % 6 <> 5 AND NOT (k % 20 + 5 BETWEEN 10 AND 20) THEN 'TIME-003|major' END, CASE WHEN decided IS NULL THEN 'TIME-004|minor' END,
  CASE WHEN k % 8 = 3 THEN 'PREC-001|major' END, CASE WHEN reasoned AND k % 10 <> 0 THEN 'PREC-002|info' END], lambda x: x IS NOT NULL)) AS m FROM e),
g AS (SELECT case_id, split_part(m, '|', 1) AS code, split_part(m, '|', 2) AS severity FROM f)
"""
FLAGS_SQL = COURT_SQL + """
f AS (SELECT case_id, judge, unnest(list_filter([
  CASE WHEN concluded AND k % 10 BETWEEN 5 AND 7 AND years / 5 < 0.4 THEN 'SENT-001|0.35' END, CASE WHEN concluded AND (k % 10 < 5 AND years / 5 > 1.5 OR k % 10 BETWEEN 5 AND 7 AND years / 15 > 1.5) THEN 'SENT-002|0.20' END, CASE WHEN suspended THEN 'SENT-003|0.10' END,
  CASE WHEN criminal AND k % 21 = 2 THEN 'PROC-001|0.05' END, CASE WHEN criminal AND k % 3 <> 0 THEN 'PROC-002|0.30' END, CASE WHEN suspended AND k % 22 = 4 THEN 'PROC-003|0.15' END,
  CASE WHEN guilty AND k % 24 = 10 THEN 'EVID-001|0.30' END, CASE WHEN k % 14 = 6 THEN 'EVID-002|0.15' END, CASE WHEN guilty AND ev <= 1 THEN 'EVID-003|0.25' END,
  CASE WHEN criminal AND gap BETWEEN 0 AND 3 THEN 'TIME-001|0.15' END, CASE WHEN criminal AND gap BETWEEN 4 AND 7 THEN 'TIME-002|0.05' END,
  CASE WHEN NOT reasoned THEN 'STRUC-001|0.25' END, CASE WHEN NOT laws AND concluded THEN 'STRUC-002|0.30' END, CASE WHEN criminal AND concluded AND k % 6 >= 4 THEN 'STRUC-003|0.05' END, CASE WHEN suspended AND k % 9 = 0 AND k % 18 <> 0 THEN 'STRUC-004|0.15' END], lambda x: x IS NOT NULL)) AS m FROM e),
g AS (SELECT case_id, split_part(m, '|', 1) AS code, CAST(split_part(m, '|', 2) AS DOUBLE) AS weight FROM f),
s AS (SELECT case_id, CAST(round(least(1.0, round(sum(weight), 9)), 2) AS DOUBLE) AS score, count(*) AS n FROM g GROUP BY 1)
"""


@query("SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 7 <> 0 THEN '1-' || o_orderkey || '/24' END AS case_number, CASE WHEN o_orderkey % 11 <> 0 THEN 'Toshkent shahar sudi' END AS court, judge, strftime(decided, '%Y-%m-%d') AS decided_at, strftime(heard, '%Y-%m-%d') AS hearing_at, CASE WHEN o_orderkey % 16 = 7 THEN 'qaror' ELSE 'hukm' END AS kind FROM orders JOIN (" + COURT_SQL + " z AS (SELECT 1) SELECT case_id, judge, decided, heard FROM e) ON case_id = o_orderkey")
def court_headers(spark, sf_dir):
    return CT.with_sections(_decisions(spark, sf_dir)).select("case_id", *CT.header_fields(F.col("text"), F.col("intro")))


@query("SELECT o_orderkey AS case_id, 'prison' AS kind, CAST(o_orderkey % 30 + 1 AS DOUBLE) AS amount, 'yil' AS unit, o_orderkey % 2 = 0 AS suspended FROM orders WHERE o_orderkey % 19 <> 0")
def court_penalties(spark, sf_dir):
    sections = CT.split_sections(_decisions(spark, sf_dir)).where("section = 'conclusion'")
    return sections.select("case_id", CT.penalty(F.col("body")).alias("p")).select("case_id", "p.*")


@query("""
SELECT o_orderkey AS case_id, 'jinoyat kodeksi' AS code, '169' AS article, '2' AS part FROM orders WHERE o_orderkey % 10 <> 9
UNION ALL SELECT o_orderkey, 'jinoyat-protsessual kodeksi', '455', NULL FROM orders WHERE o_orderkey % 20 = 9
UNION ALL SELECT o_orderkey, 'fuqarolik kodeksi', a, NULL FROM orders, (VALUES ('1700'), ('1702')) v(a) WHERE o_orderkey % 15 = 4""")
def court_references(spark, sf_dir):
    return CT.law_references(_decisions(spark, sf_dir))


@query("SELECT o_orderkey AS case_id, s AS section FROM orders, (VALUES ('intro'), ('circumstances'), ('reasoning'), ('conclusion')) t(s) WHERE CASE s WHEN 'reasoning' THEN o_orderkey % 5 = 0 WHEN 'conclusion' THEN o_orderkey % 19 <> 0 ELSE true END")
def court_sections(spark, sf_dir):
    return CT.split_sections(_decisions(spark, sf_dir)).select("case_id", "section")


@query("""
SELECT o_orderkey AS case_id, role, name FROM orders, (VALUES ('sudlanuvchi', 'Aliyev B.B.'), ('himoyachi', 'Yusupov B.B.'), ('prokuror', 'Rahimov C.C.'), ('jabrlanuvchi', 'Olimov D.D.')) t(role, name)
WHERE CASE role WHEN 'sudlanuvchi' THEN o_orderkey % 3 <> 1 WHEN 'himoyachi' THEN o_orderkey % 3 = 0 WHEN 'prokuror' THEN o_orderkey % 4 = 0 ELSE o_orderkey % 6 < 4 END""")
def court_parties(spark, sf_dir):
    return CT.parties(_decisions(spark, sf_dir))


@query(FINDINGS_SQL + "SELECT case_id, code, severity, count(*) AS n FROM g GROUP BY 1, 2, 3")
def court_findings(spark, sf_dir):
    return CT.findings(CT.read_decisions(_decisions(spark, sf_dir))).groupBy("case_id", "code", "severity").agg(F.count("*").alias("n"))


@query(FINDINGS_SQL + """, s AS (SELECT case_id, CAST(least(1.0, round(sum(CASE severity WHEN 'critical' THEN 0.3 WHEN 'major' THEN 0.12 WHEN 'minor' THEN 0.03 ELSE 0 END), 9)) AS DOUBLE) AS score, count(*) AS n FROM g GROUP BY 1)
SELECT case_id, round(score, 2) AS score, CASE """ + " ".join("WHEN score >= {} THEN '{}'".format(least, name.replace("'", "''")) for least, name in CT.PROSPECT_LABELS) + " END AS label, n FROM s")
def court_prospects(spark, sf_dir):
    return CT.prospect(CT.findings(CT.read_decisions(_decisions(spark, sf_dir))))


@query(FLAGS_SQL + "SELECT case_id, code, weight FROM g")
def integrity_flags(spark, sf_dir):
    return CT.integrity_flags(CT.read_decisions(_decisions(spark, sf_dir))).select("case_id", "code", "weight")


@query(FLAGS_SQL + "SELECT judge, count(*) AS n_cases, count(CASE WHEN concluded THEN 1 END) AS n_prison, count(CASE WHEN suspended THEN 1 END) AS n_suspended, CAST(0 AS BIGINT) AS n_fines, round(avg(CASE WHEN concluded THEN years END), 4) AS mean_years, round(least(1.0, pow(avg(pow(coalesce(score, 0), 1.5)), 1 / 1.5)), 6) AS risk FROM e LEFT JOIN s USING (case_id) WHERE judge IS NOT NULL GROUP BY 1")
def judge_profiles(spark, sf_dir):
    read = CT.read_decisions(_decisions(spark, sf_dir))
    return CT.judge_profiles(read, CT.integrity_scores(CT.integrity_flags(read)))


CATEGORIES = ["protsessual", "dalillar", "qonun", "mutanosiblik", "huquqlar", "muddat", "amaliyot"]


@query(FINDINGS_SQL + """, o AS (SELECT case_id, code, list_position(['PROC', 'EVID', 'LAW', 'PROP', 'RIGHT', 'TIME', 'PREC'], split_part(code, '-', 1)) AS place FROM g)
SELECT case_id, string_agg('- [' || ['protsessual', 'dalillar', 'qonun', 'mutanosiblik', 'huquqlar', 'muddat', 'amaliyot'][place] || '] ' || code, chr(10) ORDER BY place, code) AS lines FROM o GROUP BY 1""")
def court_report_lines(spark, sf_dir):
    return CT.flags_in_order(CT.findings(CT.read_decisions(_decisions(spark, sf_dir))), CATEGORIES)


@query("SELECT o_orderkey, CASE WHEN t = 0 THEN CASE WHEN a THEN 30 ELSE 30 END WHEN t = 1 THEN CASE WHEN a THEN 30 ELSE 20 END WHEN t = 2 THEN CASE WHEN a THEN NULL ELSE 15 END ELSE 30 END AS days FROM (SELECT o_orderkey, o_orderkey % 4 AS t, o_custkey % 2 = 0 AS a FROM orders)")
def appeal_days_by_stage(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("civil", "criminal", "administrative", "economic")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    stage = F.when(F.col("o_custkey") % 2 == 0, "appeal").otherwise("first_instance")
    return table(spark, sf_dir, "orders").select("o_orderkey", CT.appeal_deadline_days(kind, stage).alias("days"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 + o_orderkey % 3 = 0 THEN 0.3 ELSE round(least(0.9, greatest(0.1, (o_custkey % 4) / (o_custkey % 4 + o_orderkey % 3))), 6) END AS confidence FROM orders")
def advice_confidence(spark, sf_dir):
    strong, weak = F.col("o_custkey") % 4, F.col("o_orderkey") % 3
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(CT.advice_confidence(strong, weak), 6).alias("confidence"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def model_json(spark, sf_dir):
    said = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return table(spark, sf_dir, "events").select("event_id", G.json_of(said, "k bigint").alias("j")).select("event_id", "j.k")


@query("SELECT conv_id, turn, regexp_matches(lower(text), 'topilmadi|aniqlanmadi|javob bera olmayman') AS refused, CAST(length(text) AS BIGINT) AS size FROM conversations WHERE role = 'assistant'")
def refusals(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.select("conv_id", "turn", G.any_of(F.lower("text"), ["topilmadi", "aniqlanmadi", "javob bera olmayman"]).alias("refused"), F.length("text").cast("bigint").alias("size"))


@query()
def quantity_pairs(spark, sf_dir):
    made = F.concat((F.col("o_orderkey") % 30 + 1).cast("string"), F.lit(" kun ichida, o'n besh yil va uch oy muddat"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(G.quantities(made)), ",").alias("q"), G.quantities_clash(F.array(F.lit("2|yil")), G.quantities(made)).alias("clash"), T.extract_date(made).alias("d"))
