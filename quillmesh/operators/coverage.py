"""What a corpus can't answer, told before it is searched: foreign law, thin source classes, missing articles and documents.

Also the lookups these rest on: an article's chunks, its variants, ambiguous numbers and labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators.claims import document_names
from quillmesh.operators.graph import substring_pairs

# Foreign jurisdictions in the order they are asked (pattern, name, whether it speaks for itself), legal
# sources, and classes of sources (key, label, what asks for them, how titles of the class look, types of the class).
JURISDICTIONS = [
    (r"aqsh|amerika qo'shma shtatlari", "AQSh", False), (r"rossiya", "Rossiya", False), (r"qozog'iston|qozogiston", "Qozog'iston", False),
    (r"qirg'iziston|qirgiziston", "Qirg'iziston", False), (r"tojikiston", "Tojikiston", False), (r"turkmaniston", "Turkmaniston", False),
    (r"\bturkiya\b", "Turkiya", False), (r"\bxitoy\b", "Xitoy", False), (r"germaniya", "Germaniya", False), (r"fransiya", "Fransiya", False),
    (r"buyuk britaniya", "Buyuk Britaniya", False), (r"ukraina", "Ukraina", False), (r"\bbelarus", "Belarus", False),
    (r"yevropa ittifoqi|\byei\b", "Yevropa Ittifoqi", False), (r"\bgdpr\b", "Yevropa Ittifoqi (GDPR)", True), (r"yevropa kengashi", "Yevropa Kengashi", False),
]
LEGAL_SOURCE = r"(?iu)konstitutsiya|qonun|kodeks|direktiva|reglament|qaror|tuzatish|huquqi\b|normas|akt\b|nizom"
SOURCE_CLASSES = [
    ("plenum", "Oliy sud Plenumi qarorlari", r"(?iu)plenum", None, "plenum"),
    ("hokim", "hokim qarorlari", r"(?iu)hokim\w*\s+(?:\d{4}[-\s]?yil.{0,40}?)?(?:qaror|farmoyish|buyru)", r"(?iu)hokim(?:ning|i)\s+qarori", None),
    ("xalqaro", "xalqaro shartnoma va konvensiyalar", r"(?iu)xalqaro\s+(?:\w+\s+){0,2}?(?:shartnoma|konvensiya|huquq|majburiyat)|konvensiya", r"(?iu)konvensiya|xalqaro shartnoma", None),
    ("vazirlik", "vazirlik buyruqlari", r"(?iu)vazirli(?:gi|k)ning\s+buyru", r"(?iu)vazirligining buyru", None),
]
LEAST_DOCUMENTS, EXCERPT, WEB_EXCERPT = 10, 600, 240


def foreign_jurisdiction(question: Column) -> Column:
    """The first foreign jurisdiction a question names together with a legal source, or by itself."""
    low, legal = F.lower(question), question.rlike(LEGAL_SOURCE)
    return F.coalesce(*[F.when(low.rlike(pattern) if alone else legal & low.rlike(pattern), name) for pattern, name, alone in JURISDICTIONS])


def class_counts(documents: DataFrame, key: str = "doc_id", title: str = "title", doc_type: str = "doc_type") -> DataFrame:
    """(class, n): distinct documents of each source class, zero ones too; one row."""
    of = lambda probe, kind: F.col(doc_type) == kind if kind else F.col(title).rlike(probe)
    return documents.agg(*[F.countDistinct(F.when(of(probe, kind), F.col(key))).alias(name) for name, _, _, probe, kind in SOURCE_CLASSES])


def coverage_gaps(questions: DataFrame, documents: DataFrame, question: str = "question", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Questions with kind (yurisdiksiya, manba-turi or null) and subject of what the corpus lacks; jurisdictions go first."""
    counts = class_counts(documents)
    named = questions.withColumn("__foreign", F.when(F.trim(question) != "", foreign_jurisdiction(F.col(question))))
    joined = named.crossJoin(F.broadcast(counts))  # one row
    thin = F.coalesce(*[F.when(F.col(question).rlike(asked) & (F.col(name) < least), label) for name, label, asked, _, _ in SOURCE_CLASSES])
    kind = F.when(F.col("__foreign").isNotNull(), "yurisdiksiya").when(thin.isNotNull(), "manba-turi")
    return joined.select(*questions.columns, kind.alias("kind"), F.coalesce("__foreign", thin).alias("subject"))


def missing_documents(questions: DataFrame, titles: DataFrame, key: str = "question_id", question: str = "question", title: str = "title") -> DataFrame:
    """(key, document): the first code a question names that no folded title holds."""
    named = questions.select(key, F.posexplode(document_names(F.col(question))).alias("pos", "name"))
    found = substring_pairs(named.select(F.col("name").alias("needle")).distinct(), titles.select(T.fold(title, False).alias("hay"))).select(F.col("needle").alias("name")).distinct()
    lost = named.join(found, "name", "left_anti")
    return lost.groupBy(key).agg(F.concat(F.min_by("name", "pos"), F.lit(" kodeksi")).alias("document"))


def missing_articles(questions: DataFrame, chunks: DataFrame, key: str = "question_id", question: str = "question") -> DataFrame:
    """(key, article): the article a question names that no chunk (title, article) has, in the hinted document if one is named."""
    number, hint = T.article_reference(question, False)
    asked = questions.select(key, number.alias("article"), hint.alias("hint")).where("article IS NOT NULL")
    labels = chunks.select(T.fold("title", False).alias("title"), F.explode(F.array_distinct(F.concat(F.array("article"), F.split("article", "-", -1)))).alias("article")).distinct()
    held = asked.join(labels, "article").where(F.col("hint").isNull() | F.col("title").contains(F.col("hint"))).select(key).distinct()
    return asked.join(held, key, "left_anti").select(key, "article")


def article_chunks(chunks: DataFrame, limit: int = 4) -> DataFrame:
    """Of every (doc_id, article) the chunks of its first element by pos, by part, item and id, the first ``limit``."""
    by = Window.partitionBy("doc_id", "article")
    first = chunks.withColumn("__first", F.min_by("element_id", "pos").over(by)).where("element_id = __first").drop("__first")
    order = by.orderBy(F.coalesce("part", F.lit("")), F.coalesce("item", F.lit("")), "chunk_id")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)


def article_variants(chunks: DataFrame) -> DataFrame:
    """(doc_id, article, n): distinct elements that carry one article number."""
    return chunks.where("article <> ''").groupBy("doc_id", "article").agg(F.countDistinct("element_id").alias("n"))


def article_hierarchies(chunks: DataFrame) -> DataFrame:
    """(doc_id, article, hierarchies): the distinct paths, joined, under which a document has one article number, sorted;
    more than one mean that the number alone doesn't name an article."""
    path = F.concat_ws(" > ", "path")
    return chunks.where("article <> ''").groupBy("doc_id", "article").agg(F.sort_array(F.collect_set(path)).alias("hierarchies"))


def ambiguous_articles(chunks: DataFrame) -> DataFrame:
    """(doc_id, n): numbers of a document that more than one element carries."""
    return article_variants(chunks).where("n > 1").groupBy("doc_id").agg(F.count("*").alias("n"))


def article_labels(chunks: DataFrame) -> DataFrame:
    """(doc_id, labels) distinct and sorted."""
    return chunks.where("article <> ''").groupBy("doc_id").agg(F.sort_array(F.collect_set("article")).alias("labels"))


def hybrid_score(cosine: Column, keyword: Column, article_match: Column) -> Column:
    return 0.7 * cosine + 0.3 * keyword + F.when(article_match, 0.5).otherwise(0.0)


def citation(tag: Column, title: Column, article: Column, content: Column, status: Column, web: bool = False) -> Column:
    """What an answer cites: the excerpt cut, an unknown status taken for one in force."""
    known = F.when(status.isin("in_force", "repealed", "pending"), status).otherwise("in_force")
    return F.struct(F.upper(tag).alias("tag"), title.alias("doc_title"), article.alias("article"), F.left(content, F.lit(WEB_EXCERPT if web else EXCERPT)).alias("excerpt"), known.alias("status"))


def collected_norms(found: DataFrame, topic: str = "topic", chunk: str = "chunk_id") -> DataFrame:
    """Results of several queries (topic, query_no, rank, chunk_id) in the order of queries, each chunk once a topic."""
    order = Window.partitionBy(topic, chunk).orderBy("query_no", "rank")
    return found.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def unsupported_articles(answer: Column, allowed: Column) -> Column:
    """Articles an answer mentions that its sources don't have."""
    return F.array_except(T.mentioned_articles(answer), allowed)


def gold_issues(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, issue) of gold cases (pos, id, query, expected_articles, doc_hint, category); null where a case is sound.

    In order: a repeated id, a short query, an article number in it (but in lookups), no article expected, one not there.
    """
    labels = chunks.select(F.lower("title").alias("title"), F.explode(F.array_distinct(F.concat(F.array("article"), F.split("article", "-", -1)))).alias("want")).distinct()
    wanted = cases.select("pos", F.coalesce("doc_hint", F.lit("")).alias("hint"), F.explode("expected_articles").alias("want"))
    held = wanted.join(labels, "want").where(F.col("title").contains(F.lower("hint"))).select("pos", "want").distinct().withColumn("held", F.lit(True))
    lost = wanted.join(held, ["pos", "want"], "left").groupBy("pos").agg(F.bool_or(F.col("held").isNull()).alias("absent"))
    lookup = F.col("category") == "modda-lookup"
    again = F.row_number().over(Window.partitionBy("id").orderBy("pos")) > 1
    joined = cases.withColumn("again", again).join(lost, "pos", "left")
    issue = F.when(F.col("again"), "identifikator takrorlangan").when(~lookup & (F.size(T.words("query")) < 4), "savol juda qisqa").when(~lookup & F.col("query").rlike(r"(?iu)\d+\s*[-–]?\s*modda"), "savolda modda raqami bor").when(F.size("expected_articles") == 0, "kutilgan modda ko'rsatilmagan").when(F.coalesce("absent", F.lit(False)), "kutilgan modda korpusda yo'q")
    return joined.select("pos", "id", issue.alias("issue"))


def suite_outcomes(cases: DataFrame) -> DataFrame:
    """Cases with their answers checked: what passed, and which layer failed.

    cases: answer, refused, expect_refusal, expect_any, forbid, expect_articles, cited, retrieved, gate_dropped, max_words.
    Where a refusal is expected only it and the forbidden phrases count.
    """
    low, col = F.lower("answer"), F.col
    inside = lambda phrase: low.contains(F.lower(phrase))
    refusal = ~col("expect_refusal") | col("refused")
    forbid = ~F.exists("forbid", inside)
    expect = col("expect_refusal") | F.forall("expect_any", lambda group: F.exists(group, inside)) & (F.trim("answer") != "")
    articles = col("expect_refusal") | (F.size("expect_articles") == 0) | F.arrays_overlap("expect_articles", "cited")
    length = col("expect_refusal") | col("max_words").isNull() | (F.size(T.words("answer")) <= col("max_words"))
    checked = cases.withColumns({"passed_refusal": refusal, "passed_forbid": forbid, "passed_expect": expect, "passed_articles": articles, "passed_length": length})
    passed = col("passed_refusal") & col("passed_forbid") & col("passed_expect") & col("passed_articles") & col("passed_length")
    lost = F.when(F.arrays_overlap("retrieved", "expect_articles") & (col("gate_dropped") > 0), "gate").otherwise("retrieval")
    diagnosis = F.when(passed, "—").when(~col("passed_articles"), lost).when((col("gate_dropped") > 0) & (F.trim("answer") == ""), "gate").otherwise("model")
    return checked.withColumn("passed", passed).withColumn("diagnosis", diagnosis)


def suite_report(outcomes: DataFrame, by: str) -> DataFrame:
    """(by, n, pass_rate, drop_rate)."""
    share = F.try_divide(F.sum("gate_dropped"), F.sum(F.col("gate_dropped") + F.col("gate_kept")))
    return outcomes.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"), F.round(F.coalesce(share, F.lit(0.0)), 6).alias("drop_rate"))


def against_targets(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """(metric, value, target, met): measured values against targets (metric, target, at_least)."""
    met = F.when(F.col("at_least"), F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    return targets.join(metrics, "metric", "left").select("metric", "value", "target", F.coalesce(met, F.lit(False)).alias("met"))
