"""Ranking: inverted index, BM25, exact vector search, rank fusion, routing and context packing.

Every operator takes a batch of queries. Scores are rounded before ties are broken, as parallel sums differ in the last
bits; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
RRF_K, CONFIDENT_RANK = 3, 15
EXACT_WEIGHT, GRAPH_FACTOR = 2.0, 0.4
TAG_COST, CONTEXT_BUDGET = 40, 6000
BROADCAST_ROWS = 100_000
PHRASES = 10_000
QUERY_BLOCK = 10_000
QUERY_STRIDE = 1000
DENSE_WEIGHTS, DOCUMENT_STRIDE = 2_000_000, 256


def ranked(df: DataFrame, group: str, score: str, key: str, k: int | None = None) -> DataFrame:
    """Adds rank within each group by falling score, then key; at most k rows a group."""
    order = Window.partitionBy(group).orderBy(F.round(score, 9).desc(), F.col(key))
    out = df.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def build_index(tokens: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings (term, key, tf), lengths (key, dl) and term frequencies (term, df) from (key, tokens)."""
    postings = tokens.select(key, F.explode("tokens").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
    return postings, tokens.select(key, F.size("tokens").cast("bigint").alias("dl")), postings.groupBy("term").agg(F.count("*").alias("df"))


def bm25(tokens: DataFrame, queries: DataFrame, key: str = "doc_id", k: int = 50, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, key, score, rank) of the best k documents of each query (query_id, terms).

    While the queries are few and keys are numbers that don't repeat, documents are scored where they lie, see
    ``_bm25_by_document``. Otherwise postings of the queries' terms are built: terms are filtered before anything is
    shuffled, by a broadcast while they are few and by a semi-join otherwise. A term repeated in a query counts as often.
    Texts are tokenised and shuffled once: each document also emits one row of the empty term, from which sizes are counted,
    and what reads the postings asks for the same columns, so that one exchange serves all.
    """
    wanted = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    if dict(tokens.dtypes)[key] in ("int", "bigint") and tokens.where(F.col(key).isNull()).isEmpty():
        sizes = wanted.agg(F.count_distinct("query_id"), F.count_distinct("term"), F.count("*"), F.count("query_id")).first()
        small = 0 < sizes[0] * sizes[1] <= DENSE_WEIGHTS and sizes[1] <= BROADCAST_ROWS and sizes[2] == sizes[3]
        if small and tokens.groupBy(key).count().where("count > 1").isEmpty():
            return _bm25_by_document(tokens, wanted.toArrow(), key, k, k1, b)
    terms = wanted.select("term").unionAll(tokens.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast(terms) if few else terms
    spread = tokens.select(key, F.size("tokens").alias("dl"), F.explode(F.concat("tokens", F.array(F.lit("")))).alias("term"))
    postings = spread.join(side, "term", "left_semi").groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    held = F.col("tf") > 0
    stats = postings.agg(F.count_if(held & (F.col("term") == "")).alias("n"), F.avg(F.when(held & (F.col("term") == ""), F.col("dl"))).alias("average"))
    return score_postings(postings, wanted.crossJoin(F.broadcast(stats)), key, k, k1, b)


def _bm25_by_document(tokens: DataFrame, wanted, key: str, k: int, k1: float, b: float) -> DataFrame:
    """The same from a bounded block of queries (an Arrow table of query_id, term, times) that every task gets.

    Texts are read twice, for the frequencies of the terms and for the scores, and are not shuffled: a task hands on a number
    a term, and then its best k documents of each query.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    context = tokens.sparkSession.sparkContext
    vocabulary, names = wanted["term"].unique().sort(), wanted["query_id"].unique()
    times = np.zeros((len(vocabulary), len(names)))
    np.add.at(times, (pc.index_in(wanted["term"], vocabulary).to_numpy(), pc.index_in(wanted["query_id"], names).to_numpy()), wanted["times"].to_numpy())
    shared = context.broadcast((vocabulary, names, times))

    def counted(batches, vocabulary):
        """(keys, lengths, row, term, tf) of some documents at a time; documents without tokens, null, don't count."""
        for batch in batches:
            for first in range(0, batch.num_rows, DOCUMENT_STRIDE):
                part = batch.slice(first, DOCUMENT_STRIDE)
                part = part.filter(part["tokens"].is_valid())
                held = part["tokens"]
                size = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
                term = pc.fill_null(pc.index_in(held.flatten(), vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(size)), size)[term >= 0]
                pair, tf = np.unique(row * len(vocabulary) + term[term >= 0], return_counts=True)
                yield part, size, pair // len(vocabulary), pair % len(vocabulary), tf

    def frequencies(batches):
        vocabulary, _, _ = shared.value
        df, n, total = np.zeros(len(vocabulary) + 1, np.int64), 0, 0
        for _, size, _, term, _ in counted(batches, vocabulary):
            df += np.bincount(term, minlength=len(df))
            n, total = n + len(size), total + int(size.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-1, -2, *at], pa.int32()), "n": pa.array([n, total, *df[at]], pa.int64())})

    df, n, total = np.zeros(len(vocabulary)), 0, 0
    for term, number in tokens.select("tokens").mapInArrow(frequencies, "term int, n bigint").groupBy("term").agg(F.sum("n")).collect():  # one row a term of the queries
        if term >= 0:
            df[term] = number
        else:
            n, total = (number, total) if term == -1 else (n, number)
    average = total / n if total else 1.0
    weights = context.broadcast(times * np.log(1 + (n - df + 0.5) / (df + 0.5))[:, None])

    def best(batches):
        """The task's best k documents of each query; ties go to smaller keys."""
        vocabulary, names, _ = shared.value
        kept = np.full((len(names), k), -np.inf), np.full((len(names), k), np.iinfo(np.int64).max), np.zeros((len(names), k))
        for part, size, row, term, tf in counted(batches, vocabulary):
            if not len(term):
                continue
            some, place = np.unique(term, return_inverse=True)
            gains = np.zeros((len(size), len(some)))
            gains[row, place] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / average))
            scores = (gains @ weights.value[some]).T
            keys, rounded = part[key].to_numpy(zero_copy_only=False), np.round(scores, 9)
            at, of = np.nonzero((scores > 0) & (rounded >= kept[0][:, -1:]))
            touched = np.unique(at)
            owner = np.concatenate([at, np.repeat(touched, k)])
            value = np.concatenate([rounded[at, of], kept[0][touched].ravel()])
            named = np.concatenate([keys[of], kept[1][touched].ravel()])
            exact = np.concatenate([scores[at, of], kept[2][touched].ravel()])
            order = np.lexsort((named, -value, owner))
            rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            order, rank = order[rank < k], rank[rank < k]
            for held, new in zip(kept, (value, named, exact), strict=True):
                held[owner[order], rank] = new[order]
        at, rank = np.nonzero(np.isfinite(kept[0]))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(kept[1][at, rank]).cast(part_type), pa.array(kept[2][at, rank])], names=["query_id", key, "score"])

    part_type = pa.int64() if dict(tokens.dtypes)[key] == "bigint" else pa.int32()
    kind = tokens.sparkSession.createDataFrame(wanted.slice(0, 0)).schema["query_id"].dataType.simpleString()
    found = tokens.select(key, "tokens").mapInArrow(best, f"query_id {kind}, {key} {dict(tokens.dtypes)[key]}, score double")
    return ranked(found, "query_id", "score", key, k)


def score_postings(postings: DataFrame, wanted: DataFrame, key: str, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The best k documents from postings (term, key, tf, dl) of all terms of queries (query_id, term, times, n, average)."""
    frequency = postings.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    weighed = wanted.join(frequency, "term").select("query_id", "term", "times", "average", (F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
    gain = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("average")))
    scored = postings.join(weighed, "term").groupBy("query_id", key).agg(F.sum(gain).alias("score"))
    return ranked(scored, "query_id", "score", key, k)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(a: Column | str) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """(query_id, key, score, rank): exact cosine neighbours of a bounded block of query vectors (query_id, query_vector).

    The stated queries are taken in blocks of ``QUERY_BLOCK`` rows, each broadcast for one pass over the vectors, so what
    is broadcast is bounded; each task keeps its best k of every query of the block before the shuffle.
    """
    parts = -(-queries.count() // QUERY_BLOCK)
    out = vectors.sparkSession.createDataFrame([], f"query_id bigint, {key} bigint, score double, rank int")
    for part in range(parts):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        out = out.unionByName(_knn_block(vectors, block, k, key, vector, exclude_self))
    return out


def _knn_block(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str, exclude_self: bool) -> DataFrame:
    import numpy as np
    import pandas as pd

    block = queries.toPandas()  # about QUERY_BLOCK rows
    matrix = np.array(block["query_vector"].tolist(), np.float64).reshape(len(block), -1)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    ids = block["query_id"].to_numpy()
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def best(batches):
        """The task's best k + 1 vectors of each query, over all its batches; ties at the last place go to smaller keys."""
        ids, matrix = shared.value
        most = k + 1
        kept = np.full((len(ids), most), -np.inf), np.full((len(ids), most), np.iinfo(np.int64).max), np.zeros((len(ids), most))
        for frame in batches:
            if not len(frame) or not len(ids):
                continue
            rows = np.array(frame[vector].tolist(), np.float64)
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
            keys = frame[key].to_numpy()
            for first in range(0, len(ids), QUERY_STRIDE):
                scores = matrix[first : first + QUERY_STRIDE] @ rows.T
                rounded = np.round(scores, 9)
                at, row = np.nonzero(rounded >= kept[0][first : first + QUERY_STRIDE, -1:])
                touched = np.unique(at)
                owner = np.concatenate([at, np.repeat(touched, most)])
                value = np.concatenate([rounded[at, row], kept[0][first + touched].ravel()])
                named = np.concatenate([keys[row], kept[1][first + touched].ravel()])
                exact = np.concatenate([scores[at, row], kept[2][first + touched].ravel()])
                order = np.lexsort((named, -value, owner))
                place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
                order, place = order[place < most], place[place < most]
                for held, new in zip(kept, (value, named, exact), strict=True):
                    held[first + owner[order], place] = new[order]
        at, place = np.nonzero(np.isfinite(kept[0]))
        yield pd.DataFrame({"query_id": ids[at], key: kept[1][at, place], "score": kept[2][at, place]})

    found = vectors.select(key, vector).mapInPandas(best, f"query_id bigint, {key} bigint, score double")
    if exclude_self:
        found = found.where(F.col(key) != F.col("query_id"))
    return ranked(found, "query_id", "score", key, k)


def fuse(channels: list[tuple[DataFrame, Column | float]], key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """(query_id, key, score, rank): weighted reciprocal ranks of several rankings (query_id, key, rank) added up."""
    parts = [df.select("query_id", key, ((weight if isinstance(weight, Column) else F.lit(weight)) / (k + F.col("rank"))).alias("part")) for df, weight in channels]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return ranked(union.groupBy("query_id", key).agg(F.sum("part").alias("score")), "query_id", "score", key)


def channel_weights(kind: Column | str) -> tuple[Column, Column]:
    """(vector, lexical) weights by query kind."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    lookup = kind == "article_lookup"
    return F.when(lookup, 0.4).otherwise(0.8), F.when(lookup, 0.6).otherwise(0.2)


def is_confident(top: Column, reranked: Column) -> Column:
    return F.when(reranked, top >= 0).otherwise(top >= 1 / (RRF_K + CONFIDENT_RANK))


def article_channel(chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Chunks (chunk_id, article, title) whose article number, or a part of it, is the one a query (query_id, article, hint) names.

    1.2 for the whole number and 1.0 for a part; chunks of the hinted document where there are any, else all.
    """
    parts = chunks.select("chunk_id", "title", "article", F.explode(F.array_distinct(F.concat(F.array("article"), F.split("article", "-", -1)))).alias("part"))
    hits = parts.join(queries, parts["part"] == queries["article"]).select("query_id", "chunk_id", F.when(parts["article"] == queries["article"], 1.2).otherwise(1.0).alias("score"), F.coalesce(F.lower("title").contains(F.col("hint")), F.lit(False)).alias("hinted"))
    hits = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.max("hinted").alias("hinted"))
    any_hint = F.max("hinted").over(Window.partitionBy("query_id"))
    return ranked(hits.withColumn("some", any_hint).where("hinted OR NOT some").drop("hinted", "some"), "query_id", "score", "chunk_id", k)


def phrases_held(queries: DataFrame, phrases: DataFrame, phrase: str) -> DataFrame:
    """queries with each row of phrases whose phrase their folded text holds: by a broadcast of phrases while they are few,
    else by an equi-join on runs of letters."""
    if phrases.limit(PHRASES + 1).count() <= PHRASES:
        return queries.join(F.broadcast(phrases), F.col("folded").contains(F.col(phrase)))
    from quillmesh.operators.graph import substring_pairs

    pairs = substring_pairs(phrases.select(F.col(phrase).alias("needle")).distinct(), queries.select(F.col("folded").alias("hay")).distinct())
    return queries.join(pairs.select(F.col("hay").alias("folded"), F.col("needle").alias(phrase)), "folded").join(phrases, phrase)


def route(queries: DataFrame, triggers: DataFrame, least_share: float = 0.6, min_score: float = 1.0) -> DataFrame:
    """(query_id, domain, score, confidence): domains whose triggers (domain, trigger, weight, phrase_bonus) a folded query holds.

    The domains of at least 0.6 of the best score win; confidence is the best score's share of the total.
    """
    hit = phrases_held(queries, triggers, "trigger").groupBy("query_id", "domain").agg(F.sum("weight").alias("score"))
    every = Window.partitionBy("query_id")
    hit = hit.withColumn("best", F.max("score").over(every)).withColumn("total", F.sum("score").over(every))
    return hit.where((F.col("best") >= min_score) & (F.col("score") >= least_share * F.col("best"))).select("query_id", "domain", "score", (F.col("best") / F.col("total")).alias("confidence"))


def boosted(score: Column, matches: Column, confidence: Column, boost: float = 0.8) -> Column:
    return F.when(matches, score * (1 + boost * confidence)).otherwise(score)


def expand_query(queries: DataFrame, thesaurus: DataFrame) -> DataFrame:
    """(query_id, query, added): thesaurus (phrase, term) terms of the phrases a folded query holds, then stems of its long words."""
    from quillmesh.functions import text

    added = phrases_held(queries, thesaurus, "phrase").where(~F.col("folded").contains(F.lower("term")))
    first = added.groupBy("query_id", "term").agg(F.min(F.struct((-F.length("phrase")).alias("size"), "phrase")).alias("at"))
    terms = first.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("terms"))
    own = F.split("folded", " ", -1)
    stems = F.array_distinct(F.filter(F.transform(F.regexp_extract_all("folded", F.lit("[a-zʻʼ']{5,}"), F.lit(0)), lambda w: F.when(text.without_suffix(w) != w, text.without_suffix(w))), lambda w: w.isNotNull() & ~F.array_contains(own, w)))
    joined = queries.join(terms, "query_id", "left").withColumn("added", F.array_distinct(F.concat(F.coalesce("terms", F.array().cast("array<string>")), stems)))
    return joined.select("query_id", F.when(F.size("added") == 0, F.col("query")).otherwise(F.concat_ws(" ", "query", F.array_join("added", " "))).alias("query"), "added")


def pack_context(results: DataFrame, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """Results (query_id, rank, tokens) while their tokens and tags fit, stopping at the first that doesn't; tag C1, C2 ...

    No more than budget / TAG_COST results can fit, so others are left out before they meet in a task.
    """
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.col("tokens") + TAG_COST).over(order)
    some = results.where(F.col("rank") <= budget // TAG_COST)
    return some.withColumn("used", running).where(F.col("used") <= budget).withColumn("tag", F.concat(F.lit("C"), F.col("rank").cast("string")))


def numbered(df: DataFrame, group: str, order: str, parts: int = 200) -> DataFrame:
    """Adds rank, the place of a row within its group in order of a number that doesn't repeat there, without bringing a
    group into one task: rows are numbered within ranges of the number, and ranges begin after those before them."""
    bounds = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < F.col(order))) if bounds else F.lit(0)
    dealt = df.withColumn("__part", part)
    sizes = dealt.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(group).alias("__group"), F.col("__part").alias("__at"), F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy(group, "__part").orderBy(order))
    joined = dealt.withColumn("__own", own).join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__at")))
    return joined.withColumn("rank", F.col("__start") + F.col("__own")).drop("__part", "__own", "__group", "__at", "__start")


def keyword_coverage(stems: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score): share of a query's stems, weighted by ln((n + 1) / (df + 1)) + 1, that a document holds."""
    held = stems.select(key, F.explode(F.array_distinct("stems")).alias("stem"))
    wanted = queries.select("query_id", F.explode(F.array_distinct("stems")).alias("stem"))
    held = held.join(F.broadcast(wanted.select("stem").distinct().limit(BROADCAST_ROWS)), "stem", "left_semi") if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else held.join(wanted.select("stem").distinct(), "stem", "left_semi")
    n = stems.agg(F.count("*").alias("n"))
    df = held.groupBy("stem").agg(F.count("*").alias("df"))
    weights = wanted.join(df, "stem", "left").crossJoin(F.broadcast(n)).select("query_id", "stem", (F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("weight"))
    total = weights.groupBy("query_id").agg(F.sum("weight").alias("total"))
    return held.join(weights, "stem").groupBy("query_id", key).agg(F.sum("weight").alias("got")).join(F.broadcast(total), "query_id").select("query_id", key, (F.col("got") / F.col("total")).alias("score"))


def rerank_head(results: DataFrame, scorer: Column, k: int) -> DataFrame:
    """The first max(3 k, 20) results in order of scorer, the rest after them as they were; only the first ones are ordered."""
    head = max(3 * k, 20)
    first = results.where(F.col("rank") <= head).withColumn("rescored", scorer)
    order = Window.partitionBy("query_id").orderBy(F.round("rescored", 9).desc_nulls_last(), "rank")
    first = first.withColumn("new_rank", F.row_number().over(order).cast("bigint"))
    rest = results.where(F.col("rank") > head).withColumn("rescored", F.lit(None).cast(first.schema["rescored"].dataType))
    return first.unionByName(rest.withColumn("new_rank", F.col("rank").cast("bigint")))


def graph_neighbours(results: DataFrame, edges: DataFrame, limit: int = 3, key: str = "node") -> DataFrame:
    """(query_id, node, score): targets of the results' edges (src, dst) not already there, the first ``limit`` in order of node."""
    reached = results.join(edges, results[key] == edges["src"]).groupBy("query_id", F.col("dst").alias(key)).agg((F.max("score") * GRAPH_FACTOR).alias("score"))
    fresh = reached.join(results.select("query_id", key), ["query_id", key], "left_anti")
    return fresh.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(key))).where(F.col("n") <= limit).drop("n")


def as_of_filter(df: DataFrame, reference: Column, explicit: bool = False) -> DataFrame:
    """Rows in force at a reference date: by status, then valid_from, then valid_to, half-open; dates are ISO strings.

    With an explicit date a repealed row stays if its end is known.
    """
    status = F.col("status") != "repealed"
    if explicit:
        status = status | F.col("valid_to").isNotNull()
    begun = F.col("valid_from").isNull() | (F.col("valid_from") <= reference)
    return df.where(status & begun & (F.col("valid_to").isNull() | (F.col("valid_to") > reference)))


def first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")
