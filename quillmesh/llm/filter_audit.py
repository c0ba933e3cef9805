"""Filter interaction audit: what each filter removes in every order, from counts by the set of filters a document fails.

Copies are found by routing texts: tasks partition an RDD by XXH64 of the text, sort by it, and keep for the fingerprint
at hand a chain of (whole text, smallest id); ids that aren't the smallest of their text are copies. A task first does
the same with the texts that it reads itself: an id above another of the same text is a copy at once, and only one
record a text and task, with the smallest id, is routed with its text. So a text that a third of all rows share costs
one task as many records as there are tasks, and neither side holds more than ``HELD`` bytes of texts.

Every document then is a mask of the filters it fails. With the labels joined by id, combineByKey merges vectors of
counts by mask, one vector a part. What each of the 120 orders of five filters keeps and removes follows from these
vectors alone: a filter removes the masks that have its bit and none of the bits before it.

Defined cases. A null text is empty; a null part counts with the empty one. Rows without an id are never copies and make
none; rows that repeat the smallest id with its text aren't copies either. A label counts if any row of labels with the
id has it. An empty table has no parts. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
HELD = 64 << 20  # bytes of texts that a reading task keeps before it routes them
ROUTED = 32 << 20  # bytes of texts to a partition at most, as if no text came twice
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"
RESULT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"

ORACLE_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), masks AS (
  SELECT doc_id, part, CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS mask
  FROM texts
), known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, mask
), letters AS (SELECT substr('ABCDE', i, 1) AS l, 1 << (i - 1) AS bit FROM generate_series(1, 5) g(i) ORDER BY i),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [CAST(a.bit AS INTEGER), CAST(b.bit AS INTEGER), CAST(c.bit AS INTEGER), CAST(d.bit AS INTEGER), CAST(e.bit AS INTEGER)] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, s AS step, bits[s] AS bit, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INTEGER) AS before FROM orders, generate_series(1, 5) g(s)
), audited AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE mask & (before | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0) AS removed,
    sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
FROM audited
"""


def text_mask(text: str, data: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = data.split()
    upper = len(data) - len(data.translate(None, UPPER))
    marks = len(data.translate(None, MARKS)) < len(data)
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * upper > 10 * len(text)) << 2 | marks << 3


class Chains:
    """The texts of one fingerprint: of each the mask, the smallest id and how many rows of each part have it."""

    def __init__(self):
        self.chains: dict[int, list[list]] = {}
        self.held = 0

    def add(self, digest: int, data: bytes, mask: int, doc_id, parts: dict[str, int]) -> Iterator[tuple]:
        """Takes a text in; gives (id, part, rows, mask) of ids that are no longer the smallest."""
        chain = self.chains.setdefault(digest, [])
        known = next((link for link in chain if link[0] == data), None)
        if known is None:
            chain.append([data, mask, doc_id, dict(parts)])
            self.held += len(data)
            return
        if doc_id == known[2]:
            for part, n in parts.items():
                known[3][part] = known[3].get(part, 0) + n
            return
        if doc_id < known[2]:
            known[2], doc_id, known[3], parts = doc_id, known[2], dict(parts), known[3]
        for part, n in parts.items():
            yield doc_id, part, n, mask | COPY

    def smallest(self) -> Iterator[tuple[int, list]]:
        for digest, chain in self.chains.items():
            for link in chain:
                yield digest, link
        self.chains, self.held = {}, 0


def _read(rows: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
    """(fingerprint, (text, mask, smallest id, parts)) of each text, and (any number, (None, id, part, rows, mask)) of
    what is settled here."""
    chains, settled = Chains(), 0
    for doc_id, part, text in rows:
        data = text.encode()
        mask = text_mask(text, data)
        found = [(None, part, 1, mask)] if doc_id is None else chains.add(xxhash.xxh64_intdigest(data), data, mask, doc_id, {part: 1})
        for row in found:
            settled += 1
            yield settled * 0x9E3779B97F4A7C15 % (1 << 64), (None, *row)
        if chains.held > HELD:
            yield from ((digest, tuple(link)) for digest, link in chains.smallest())
    yield from ((digest, tuple(link)) for digest, link in chains.smallest())


def _settle(records: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
    """(id, part, rows, mask) of records in the order of fingerprints."""
    chains, now = Chains(), None

    def ended() -> Iterator[tuple]:
        for _, (_, mask, doc_id, parts) in chains.smallest():
            for part, n in parts.items():
                yield doc_id, part, n, mask

    for digest, record in records:
        if record[0] is None:
            yield record[1:]
            continue
        if digest != now:
            yield from ended()
            now = digest
        yield from chains.add(digest, *record)
    yield from ended()


def document_masks(docs: DataFrame, part_column: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n), one row each; n counts rows that are equal in all three."""
    rows: RDD = docs.select("doc_id", F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")).rdd
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // ROUTED))
    routed = rows.mapPartitions(_read).repartitionAndSortWithinPartitions(dealt, lambda digest: digest)
    kind = docs.schema["doc_id"].dataType.simpleString()
    settled = docs.sparkSession.createDataFrame(routed.mapPartitions(_settle), f"doc_id {kind}, part string, n bigint, mask int", verifySchema=False)
    return settled.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def copy_ids(docs: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose text a smaller id has."""
    return document_masks(docs).where(F.col("mask").bitwiseAND(COPY) != 0).select("doc_id").distinct()


def _counted(vector: np.ndarray, row: tuple) -> np.ndarray:
    mask, n, good, toxic = row
    vector[mask] += (n, n * good, n * toxic)
    return vector


def mask_vectors(masks: DataFrame, labels: DataFrame) -> RDD:
    """(part, counts of rows, good and toxic ones by mask)."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    rows = masks.join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False))).rdd.map(lambda r: (r[0], tuple(r[1:])))
    return rows.combineByKey(lambda row: _counted(np.zeros((1 << len(FILTERS), 3), np.int64), row), _counted, lambda a, b: a + b)


def order_rows(part: str, counts: np.ndarray) -> list[tuple]:
    """One row an order and step."""
    masks, out = np.arange(len(counts)), []
    removed_at: dict[str, int] = dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            failing, left = masks & bit != 0, masks & before == 0
            n, good, toxic = (int(x) for x in counts[failing & left].sum(axis=0))
            removed_at[name] += n
            before |= bit
            kept, fails = int(counts[masks & before == 0, 0].sum()), int(counts[failing, 0].sum())
            out.append((part, "".join(order), step, kept, n, fails - n, int(counts[bit, 0]), good, toxic))
    return [(*row, removed_at[row[1][row[2] - 1]]) for row in out]


def audit(docs: DataFrame, labels: DataFrame, part_column: str = "lang") -> DataFrame:
    """The audit of docs (doc_id, text and the column of parts) by labels (doc_id, quality, toxic)."""
    rows = mask_vectors(document_masks(docs, part_column), labels).flatMap(lambda pair: order_rows(*pair))
    return docs.sparkSession.createDataFrame(rows, RESULT)
