"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``2 r`` bits apart have a value at most r bits from each. Every distinct fingerprint emits all
values within r bits (r = 1: itself and 64 others), these are shuffled on their value, and fingerprints that meet are
linked. Those that meet at one value are at most ``2 r`` bits apart from each other and, being distinct, no more than 65,
so linking each to the next in order keeps every component and emits no pairs within a group; each link is verified by
counting bits. Copies share one fingerprint and take part once. Components come from randomised contraction.

A fingerprint: ASCII letters lower-cased, words between ASCII white space, shingles of ``SHINGLE`` words joined by one
space, repeats included (fewer words: the whole sequence; none: fingerprint zero), XXH64 of each with seed 42; a bit is
set where it is set in more than half of the hashes.

``one_of_each_group`` also links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, most of
which lie further off than two bits. Texts with an equal band of least hashes meet (of 32 bands of 5, so three pairs in a
million of similarity 0.8 never do), each with the four before it in an order that changes with the band, and every link
is verified by the sets themselves. In bands that more than five different texts share, pairs whose sketches differ much
are passed over, and texts that are not in one group by then are joined exactly at the rare shingles they share, if enough
of both sets comes after the first of these.

Defined cases: null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay repeated. A
null id never names a component: that is the smallest id reachable, null only where all are. Only the id and text columns
are read. Long texts are hashed in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quillmesh.llm.common import map_rows, materialise
from quillmesh.llm.components import components, merged

SHINGLE, SEED, RADIUS = 3, 42, 2
BLOCK = 16_384
WIDE, SIMILAR, BANDS, BAND_ROWS, LAGS = 5, 0.8, 32, 5, 4
SKETCH = 3  # longs that hold one bit of each least hash
CLOSEST_ROUNDS = 2
UNLIKE = 33  # of 160 least hashes, whose lowest two bits differ in 24 on average (4.5 standard deviation) at 0.8
TEXTS_PER_SALT = 2000
MULTIPLIERS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    begins, ends = begins[: len(words) - width + 1], ends[width - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(begins), BLOCK):
        hashes = np.array([xxh64_intdigest(joined[b:e], seed) for b, e in zip(begins[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(begins)).tolist())


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp bigint): the fingerprint as a signed number."""
    kind = docs.schema[id_column].dataType.simpleString()

    def rows(source):
        for key, text in source:
            value = fingerprint(text, shingle)
            yield key, value - (1 << 64) if value >> 63 else value

    return map_rows(docs.select(id_column, text_column), rows, f"{id_column} {kind}, fp bigint")


def ball_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) within ``RADIUS`` bits that keep every component."""
    masks = [0] + [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    emitted = distinct.select("fp", F.explode(F.array([F.lit(m).cast("bigint") for m in masks])).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"))
    met = emitted.select("fp", F.lag("fp").over(Window.partitionBy("value").orderBy("fp")).alias("before"))
    verified = met.where("before IS NOT NULL AND before <> fp AND bit_count(fp ^ before) <= " + str(RADIUS))
    return verified.select(F.col("before").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    known = materialise(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    distinct = known.groupBy("fp").agg(F.min(id_column).alias("first"))
    roots = components(ball_links(distinct)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return known.join(named, "fp").select(id_column, "fp", "component_id")


def min_hashes(text: str | None) -> tuple[int, list[int], list[int]]:
    """A key of the text's words, the hashes of ``BANDS`` bands of ``BAND_ROWS`` least hashes of its shingles, and a sketch.

    The sketch is the lowest bit of each least hash, packed in ``SKETCH`` longs, and then the second lowest.
    """
    from xxhash import xxh64_intdigest

    joined, shingles = shingle_set(text)
    if not len(shingles):
        return 0, [], []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        mixed = shingles[at : at + 1024, None] * MULTIPLIERS
        np.minimum(least, ((mixed ^ (mixed >> np.uint64(32))) * MIX).min(axis=0), out=least)
    key = np.array([xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)
    bands = [xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(BANDS, BAND_ROWS))]
    planes = np.zeros((2, 64 * SKETCH), np.uint8)
    planes[:, : len(least)] = least & np.uint64(1), least >> np.uint64(1) & np.uint64(1)
    return int(key[0]), np.array(bands, np.uint64).view(np.int64).tolist(), np.packbits(planes, axis=1).reshape(-1).view(np.int64).tolist()


def shingle_set(text: str | None) -> tuple[bytes, np.ndarray]:
    """The words joined by spaces and the sorted distinct hashes of their shingles of ``WIDE`` words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if not words:
        return joined, np.zeros(0, np.uint64)
    width = min(WIDE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    return joined, np.unique(np.array([xxh64_intdigest(joined[b:e], SEED) for b, e in zip(begins.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64))


def similarity(a: str | None, b: str | None) -> float:
    """Jaccard similarity of the shingle sets of two texts."""
    one, other = shingle_set(a)[1], shingle_set(b)[1]
    common = len(np.intersect1d(one, other, assume_unique=True))
    return common / max(len(one) + len(other) - common, 1)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the pairs of keys whose texts are similar."""

    def rows(source):
        for a, b, one, other in source:
            if similarity(one, other) >= SIMILAR:
                yield a, b

    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("one")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("other")), "b")
    return map_rows(both.select("a", "b", "one", "other"), rows, "a bigint, b bigint")


def similar_links(keyed: DataFrame, text_column: str) -> DataFrame:
    """(a, b): links between fingerprints of texts that share a band and have a similarity of ``SIMILAR`` or more.

    Pairs within an already linked group need no check, so each text's pair of most bands is checked first, in rounds, and
    the others only across the groups found. Of bands of more than LAGS + 1 texts only pairs with like sketches are checked; these are
    not all pairs of such a band anyway, and ``_remaining_pairs`` finds exactly what they leave apart.
    """
    one = F.min(F.struct(F.col("__row").alias("row"), F.col("__fp").alias("fp"), F.col("__bands").alias("bands"), F.col("__sketch").alias("sketch")))
    light = materialise(keyed.where("size(__bands) > 0").groupBy(F.col("__key").alias("key")).agg(one.alias("one")).select("key", "one.*"), "distinct-keys")
    bands = light.select("key", "sketch", F.explode("bands").alias("value"))
    met = materialise(bands.join(bands.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "value"), "bands")
    rows = light.join(met.select("key").distinct(), "key", "left_semi").select(F.col("row").alias("__row"))
    chosen = keyed.select("__row", F.col("__key").alias("key"), F.col(text_column).alias("text")).join(rows, "__row", "left_semi").drop("__row")
    chosen = materialise(chosen, "distinct-texts", compression="zstd")  # of texts that meet another, once each
    salt = F.pmod(F.xxhash64("value", "key"), F.ceil(F.col("n") / TEXTS_PER_SALT))
    order = Window.partitionBy("value", "salt").orderBy(F.xxhash64("key", "value"), "key")
    before = [F.lag(F.struct("key", "sketch"), n).over(order) for n in range(1, LAGS + 1)]
    lagged = met.withColumn("salt", salt).select("key", "sketch", "n", F.array(*before).alias("before"))
    paired = lagged.select("key", "sketch", "n", F.explode("before").alias("at")).where("at IS NOT NULL").where((F.col("n") <= LAGS + 1) | (_unlike("sketch", "at.sketch") <= UNLIKE))
    paired = paired.select("key", F.col("at.key").alias("other"))
    pairs = materialise(paired.groupBy(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).agg(F.count("*").alias("n")), "candidates")
    found: list[DataFrame] = []
    open_pairs, roots = pairs, None
    for _ in range(CLOSEST_ROUNDS):
        closest = _closest(open_pairs)
        found.append(materialise(_verified(closest, chosen), "links"))
        roots = components(found[-1]) if roots is None else merged(roots, found[-1])
        of = lambda c, roots=roots: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        apart = open_pairs.join(closest, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        open_pairs = materialise(apart.where("root_a IS NULL OR root_b IS NULL OR root_a <> root_b").select("a", "b", "n"), "open-pairs")
    found.append(materialise(_verified(open_pairs.select("a", "b"), chosen), "links"))
    links = _all(found).unionAll(_verified(_remaining_pairs(met, roots, found[-1], chosen), chosen))
    prints = light.select("key", "fp")
    named = links.join(prints.toDF("a", "fp_a"), "a").join(prints.toDF("b", "fp_b"), "b")
    return named.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _closest(pairs: DataFrame) -> DataFrame:
    """(a, b): of each text's pairs (a, b, n) the one of most bands, either way."""
    ends = pairs.select("a", "b", "n").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    best = ends.groupBy("a").agg(F.max(F.struct("n", F.xxhash64("a", "b").alias("h"), "b")).alias("best"))
    return best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()


def _unlike(one: str, other: str):
    """The number of least hashes that differ by their sketches."""
    differ = lambda i: F.col(one)[i].bitwiseXOR(F.col(other)[i])
    return sum((F.bit_count(differ(i).bitwiseOR(differ(i + SKETCH))) for i in range(SKETCH)), F.lit(0))


def _remaining_pairs(met: DataFrame, roots: DataFrame, links: DataFrame, chosen: DataFrame) -> DataFrame:
    """(a, b): pairs that may be similar of texts in different groups, among those whose band more than LAGS + 1 texts share.

    Groups are those of roots, joined by links.
    """
    none = met.sparkSession.createDataFrame([], "a bigint, b bigint")
    large = met.where(F.col("n") > LAGS + 1)
    if large.isEmpty():
        return none
    roots = merged(roots, links).select(F.col("node").alias("key"), "root")
    rooted = large.join(roots, "key", "left").select("value", "key", F.coalesce("root", "key").alias("root"))
    several = rooted.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("value")
    left = materialise(rooted.join(several, "value", "left_semi").select("key", "root").distinct(), "remaining")
    if left.isEmpty():
        return none
    def every(source):
        for key, text in source:
            yield from ((h, key) for h in shingle_set(text)[1].view(np.int64).tolist())

    texts = chosen.select("key", "text").join(left, "key")
    shingles = materialise(map_rows(texts.select("key", "text"), every, "h bigint, key bigint", flush=50_000), "shingles")
    counted = shingles.join(shingles.groupBy("h").agg(F.count("*").alias("n")), "h")
    of_text = Window.partitionBy("key")
    ranked = counted.select("h", "key", "n", F.row_number().over(of_text.orderBy("n", "h")).alias("rank"), F.count("*").over(of_text).alias("size"))
    rarest = ranked.where(f"rank <= size - ceil({SIMILAR} * size) + 1 AND n > 1").select("h", "key", "rank", "size")  # similar texts share one of these
    heads = materialise(rarest.join(left, "key"), "rarest")
    shared_heads = heads.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    heads = heads.join(shared_heads, "h", "left_semi")
    one = heads.select("h", F.col("key").alias("a"), F.col("root").alias("root_a"), F.col("size").alias("size_a"), F.col("rank").alias("rank_a"))
    other = heads.select("h", F.col("key").alias("b"), F.col("root").alias("root_b"), F.col("size").alias("size_b"), F.col("rank").alias("rank_b"))
    # Nothing before the first shingle that two texts share is common, so this one and those after it have to suffice.
    suffices = f"1 + least(size_a - rank_a, size_b - rank_b) >= {SIMILAR} / (1 + {SIMILAR}) * (size_a + size_b) - 1e-6"
    both = one.join(other, "h").where(f"a < b AND root_a <> root_b AND least(size_a, size_b) >= {SIMILAR} * greatest(size_a, size_b) AND {suffices}")
    return both.select("a", "b").distinct()


def one_of_each_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of linked rows: least by id (null last), then the longest text, then its place.

    Rows are linked by fingerprints within ``RADIUS`` bits, or by similar texts.
    """
    names = docs.columns
    at, id_at = names.index(text_column), names.index(id_column)
    docs = docs.toDF(*(f"c{i}" for i in range(len(names))))  # so that no name clashes with those added here
    id_column, text_column = f"c{id_at}", f"c{at}"
    schema = StructType([*docs.schema.fields, StructField("__fp", LongType()), StructField("__size", LongType()), StructField("__key", LongType()), StructField("__bands", ArrayType(LongType())), StructField("__sketch", ArrayType(LongType()))])

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                texts = part.column(at).to_pylist()
                prints = np.array([fingerprint(text, shingle) for text in texts], np.uint64).view(np.int64)
                sizes = pa.array([len(text or "") for text in texts], pa.int64())
                keys, bands, sketches = zip(*map(min_hashes, texts), strict=True)
                added = [pa.array(prints), sizes, pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, "__fp", "__size", "__key", "__bands", "__sketch"])

    keyed = materialise(docs.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()), "keyed", compression="zstd")
    distinct = keyed.select(F.col("__fp").alias("fp")).distinct()
    links = ball_links(distinct).unionAll(similar_links(keyed, text_column))
    roots = components(links).select(F.col("node").alias("__fp"), "root")
    order = F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id"), (-F.col("__size")).alias("size"), F.col("__row").alias("row"))
    of_print = keyed.groupBy("__fp").agg(F.min(order).alias("least"))
    kept = of_print.join(roots, "__fp", "left").groupBy(F.coalesce("root", "__fp").alias("root")).agg(F.min("least")["row"].alias("__row"))
    return keyed.join(kept, "__row", "left_semi").select(*docs.columns).toDF(*names)


def hex_digits(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
