"""The search as one plan over a batch of queries: gate, expansion, three channels, fusion, routing, validity, reranking,
references and a least score, in this order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import retrieval as R
from quillmesh.sources.store import written

TOP_K, CANDIDATES, LINKED = 8, 100, 3
EXACT_HITS = 10
LOOKUP = "article_lookup"


@dataclass
class Corpus:
    """What is searched. chunks: chunk_id, doc_id, title, article, status, valid_from, valid_to, and what a scorer reads.
    lexical: from (query_id, terms) and k to (query_id, chunk_id, rank), as a stored index or ``retrieval.bm25`` gives it.
    triggers (domain, trigger, weight) and documents (domain, pos, document) are the routing, thesaurus (phrase, term) the
    expansion, edges (src_doc, src_article, pos, dst_doc, dst_article) the references; each may be left out."""

    chunks: DataFrame
    lexical: Callable[[DataFrame, int], DataFrame]
    triggers: DataFrame | None = None
    documents: DataFrame | None = None
    thesaurus: DataFrame | None = None
    edges: DataFrame | None = None


def expanded(queries: DataFrame, thesaurus: DataFrame | None) -> DataFrame:
    """(query_id, terms) of the lexical channel; lookups of an article stay as they are."""
    if thesaurus is None:
        return queries.select("query_id", T.search_tokens("query").alias("terms"))
    added = R.expand_query(queries.where(F.col("kind") != LOOKUP), thesaurus).select("query_id", F.col("query").alias("longer"))
    joined = queries.join(added, "query_id", "left")
    return joined.select("query_id", T.search_tokens(F.coalesce("longer", "query")).alias("terms"))


def routes(queries: DataFrame, corpus: Corpus) -> DataFrame | None:
    """(query_id, confidence, documents, primary) of the queries that a domain wins."""
    if corpus.triggers is None or corpus.documents is None:
        return None
    won = R.route(queries, corpus.triggers).join(corpus.documents, "domain")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("score"), "domain", "pos", "document")))
    return won.groupBy("query_id").agg(F.max("confidence").alias("confidence"), ordered.alias("found")).select("query_id", "confidence", F.transform("found", lambda x: x["document"]).alias("documents"), F.element_at("found", 1)["document"].alias("primary"))


def linked_chunks(top: DataFrame, corpus: Corpus, reference: Column, limit: int) -> DataFrame:
    """(query_id, chunk_id, score, order) of the first chunks of articles that results refer to, ``limit`` a query, in the
    order of results and of their references; articles among the results, and chunks that don't hold then, are left out."""
    norms = top.where("article IS NOT NULL").select("query_id", "doc_id", "article").distinct()
    wanted = top.join(corpus.edges, (F.col("doc_id") == F.col("src_doc")) & (F.col("article") == F.col("src_article")))
    wanted = wanted.select("query_id", "as_of", F.col("dst_doc").alias("doc_id"), F.col("dst_article").alias("article"), F.struct("rank", "pos").alias("order"), (F.col("score") * R.GRAPH_FACTOR).alias("score"))
    wanted = wanted.join(norms, ["query_id", "doc_id", "article"], "left_anti").groupBy("query_id", "as_of", "doc_id", "article").agg(F.min("order").alias("order"), F.min_by("score", "order").alias("score"))
    first = R.first_of(corpus.chunks.join(wanted.select("doc_id", "article").distinct(), ["doc_id", "article"], "left_semi"), ["doc_id", "article"], ["chunk_id"])
    held = R.as_of_filter(wanted.join(first, ["doc_id", "article"]), reference, True).join(top.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("order"))
    return held.withColumn("place", place).where(F.col("place") <= limit)


def hybrid_search(queries: DataFrame, corpus: Corpus, vector: DataFrame, today: str, gaps: DataFrame | None = None, scorer: Column | None = None, top_k: int = TOP_K, min_score: float | None = None, linked: int = LINKED) -> DataFrame:
    """(query_id, rank, chunk_id, score, source) for queries (query_id, query, as_of), as_of null for today.

    vector: (query_id, chunk_id, rank) of that channel. gaps: (query_id, kind), queries with a kind have no results.
    scorer, over the columns of chunks, orders the first max(3 top_k, 20) results that hold and replaces their scores.
    Chunks that results refer to stand after them. Each step keeps some hundred rows a query at most.
    """
    asked = queries.where(F.trim("query") != "")
    if gaps is not None:
        asked = asked.join(gaps.where("kind IS NOT NULL").select("query_id"), "query_id", "left_anti")
    asked = written(asked.withColumn("kind", T.query_kind("query")).withColumn("folded", T.fold("query")), "asked")  # read by all channels
    routed = routes(asked, corpus)
    routed = None if routed is None else written(routed, "routed")
    number, hint = T.article_reference("query", False)
    named = asked.select("query_id", number.alias("article"), hint.alias("hint")).where("article IS NOT NULL")
    if routed is not None:
        named = named.join(routed.select("query_id", "primary"), "query_id", "left").withColumn("hint", F.coalesce("hint", "primary"))
    exact = R.article_channel(corpus.chunks, named.select("query_id", "article", "hint"), EXACT_HITS)
    weight = R.channel_weights("kind")
    weighed = asked.select("query_id", weight[0].alias("w_vector"), weight[1].alias("w_lexical"))
    lexical = corpus.lexical(expanded(asked, corpus.thesaurus), CANDIDATES)
    fused = R.fuse([(vector.join(weighed, "query_id"), F.col("w_vector")), (lexical.join(weighed, "query_id"), F.col("w_lexical")), (exact, R.EXACT_WEIGHT)], "chunk_id")
    found = fused.drop("rank").join(corpus.chunks, "chunk_id").join(asked.select("query_id", "as_of"), "query_id")
    if routed is not None:
        found = found.join(routed.drop("primary"), "query_id", "left").withColumn("folded", T.fold("title"))
        matches = F.coalesce(F.exists("documents", lambda d: F.col("folded").contains(d)), F.lit(False))
        found = found.withColumn("score", R.boosted(F.col("score"), matches, F.col("confidence"))).drop("documents", "confidence", "folded")
    reference = F.coalesce("as_of", F.lit(today))
    held = written(R.ranked(R.as_of_filter(found, reference, True), "query_id", "score", "chunk_id"), "held")
    if scorer is not None:
        held = R.rerank_head(held.where(F.col("rank") <= max(3 * top_k, 20)), scorer, top_k)
        held = held.withColumn("score", F.coalesce("rescored", "score")).withColumn("rank", F.col("new_rank")).drop("rescored", "new_rank")
    top = held.where(F.col("rank") <= top_k)
    out = top.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "score", F.lit("hybrid").alias("source"))
    if corpus.edges is not None and linked:
        more = linked_chunks(top, corpus, reference, linked)
        size = top.groupBy("query_id").agg(F.count("*").alias("size"))
        more = more.join(size, "query_id").select("query_id", (F.col("size") + F.col("place")).alias("rank"), "chunk_id", "score", F.lit("graph").alias("source"))
        out = out.unionByName(more)
    return out if min_score is None else out.where(F.col("score") >= min_score)
