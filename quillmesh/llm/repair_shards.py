"""Token ids in binary shards, compressed by a Re-Pair grammar per shard.

Documents are range-partitioned and sorted by id, encoded with the tokenizers library, given an end id each and gathered
into shards of about ``SHARD_TOKENS`` ids. In a shard the most frequent neighbouring pairs are replaced by nonterminals,
round after round; a round takes the ``RULES_PER_ROUND`` most frequent pairs of which no symbol is both a left and a
right one, so their occurrences cannot overlap; of a run of one symbol every second pair from the left is replaced. A pair
must occur ``LEAST_COUNT`` times, fewer would not pay for its rule, and a shard is done when a round shortens it by less
than ``LEAST_GAIN``. Pairs never cross documents, so a document decodes by itself. A shard is one binary value:

    magic "RPG1" | u32 first nonterminal, rules, documents, bytes per symbol | u32 left, right of each rule |
    u32 expansion length of each rule | i64 ids | u8 id present | u64 symbol offsets (documents + 1) | symbols

All numbers are little-endian. The rules and expansion lengths serve random access: ``decode_document`` reads one document,
``decode_span`` a range of ids of the shard, skipping whole symbols by their lengths. Shards are stored as rows of a
Parquet table in the shared folder with their partition and number, in id order.

Defined cases: null texts are empty and hold the end id alone. Null ids come first. Rows with the same id are ordered by
text and all kept. Only the id and text columns are read. A document longer than a shard is a shard of its own.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import grouped_batches, map_rows, shared_path
from quillmesh.llm.tiktoken_codec import vocabulary_path
from quillmesh.llm.units import encoder_for

TOKENIZER_FILE = "byte_bpe_50k.json"
END_ID = 0
SHARD_TOKENS = 1 << 18
RULES_PER_ROUND, LEAST_COUNT, LEAST_GAIN = 512, 8, 0.01
MAGIC = b"RPG1"
HEAD = struct.Struct("<4sIIII")


def _frequent_pairs(pairs: np.ndarray, shift: int, least: int) -> np.ndarray:
    """The pairs (left << shift | right) that occur ``least`` times or more, most frequent first, ties by number.

    Occurrences of two equal symbols overlap; about half of them can be replaced and are counted.
    """
    ordered = np.sort(pairs)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(first, len(ordered)))
    first, counts = first[counts >= least], counts[counts >= least]
    found = ordered[first]
    counts = np.where(found >> shift == found & ((1 << shift) - 1), (counts + 1) // 2, counts)
    order = np.lexsort((found, -counts))
    return found[order[counts[order] >= least]]


def _choose(pairs: np.ndarray, shift: int, room: int) -> tuple[list[int], list[int]]:
    """(lefts, rights) of the leading pairs such that no symbol is the left of one and the right of another.

    Occurrences of different chosen pairs so never overlap. A pair of two equal symbols keeps its symbol to itself.
    """
    chosen: list[int] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    for pair in pairs[: 4 * RULES_PER_ROUND].tolist():
        left, right = pair >> shift, pair & ((1 << shift) - 1)
        if left in rights or right in lefts or left == right and (left in lefts or right in rights):
            continue
        chosen.append(pair)
        lefts.add(left)
        rights.add(right)
        if left == right:
            lefts.add(right)
        if len(chosen) >= min(room, RULES_PER_ROUND):
            break
    chosen.sort()
    return [pair >> shift for pair in chosen], [pair & ((1 << shift) - 1) for pair in chosen]


def _places(left: np.ndarray, right: np.ndarray, joined: np.ndarray, lefts: list[int], rights: list[int], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the chosen pairs occur, and which each is; of a run of one symbol every second place from its left."""
    rows, columns = {x: i for i, x in enumerate(dict.fromkeys(lefts), 1)}, {x: i for i, x in enumerate(dict.fromkeys(rights), 1)}
    row_of, column_of = np.zeros(symbols, np.uint16), np.zeros(symbols, np.uint16)
    row_of[list(rows)], column_of[list(columns)] = list(rows.values()), list(columns.values())
    rule_of = np.full((len(rows) + 1, len(columns) + 1), -1, np.int32)
    rule_of[[rows[x] for x in lefts], [columns[x] for x in rights]] = np.arange(len(lefts))
    at = np.flatnonzero((row_of[left] > 0) & joined)
    place = rule_of[row_of[left[at]], column_of[right[at]]]
    at, place = at[place >= 0], place[place >= 0]
    if any(a == b for a, b in zip(lefts, rights, strict=True)) and len(at):
        number = np.arange(len(at))
        begins = np.concatenate([[True], at[1:] != at[:-1] + 1])
        keep = (number - np.maximum.accumulate(np.where(begins, number, 0))) % 2 == 0
        at, place = at[keep], place[keep]
    return at, place


def compress(ids: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbol offset after each document, rules (n, 2)) for ids whose documents end at the offsets ``ends``."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    last[ends[ends > 0] - 1] = True
    small = max(first, int(symbols.max(initial=0))) < 1 << 16
    shift, kind = (16, np.uint32) if small else (32, np.uint64)
    rules: list[np.ndarray] = []
    made = 0
    while len(symbols) > 1:
        if small and first + made == 1 << 16:  # no 16-bit symbol is left
            small, shift, kind = False, 32, np.uint64
        room = (1 << 16 if small else 1 << 31) - first - made
        left, right, joined = symbols[:-1], symbols[1:], ~last[:-1]
        pairs = (left.astype(kind) << kind(shift) | right)[joined]
        lefts, rights = _choose(_frequent_pairs(pairs, shift, LEAST_COUNT), shift, room) if room > 0 and len(pairs) else ([], [])
        if not lefts:
            break
        at, place = _places(left, right, joined, lefts, rights, max(first + made, int(symbols.max()) + 1))
        symbols[at] = first + made + place
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        before = len(symbols)
        symbols, last = symbols[keep], last[keep]
        rules.append(np.stack([np.array(lefts, np.uint32), np.array(rights, np.uint32)], axis=1))
        made += len(lefts)
        if before - len(symbols) < LEAST_GAIN * before and not (small and first + made == 1 << 16):
            break
    offsets = np.flatnonzero(last) + 1
    return symbols, offsets, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    sizes = np.ones(len(rules), np.uint32)
    for i, (left, right) in enumerate(rules.tolist()):  # a rule's parts come before it
        sizes[i] = (sizes[left - first] if left >= first else 1) + (sizes[right - first] if right >= first else 1)
    return sizes


def write_shard(keys: list, documents: list[np.ndarray], first: int) -> bytes:
    """One shard of documents' ids; every document holds at least its end id."""
    ids = np.concatenate(documents)
    symbols, offsets, rules = compress(ids, np.cumsum([len(d) for d in documents]), first)
    width = 2 if (int(symbols.max()) if len(symbols) else 0) < 1 << 16 else 4
    present = np.array([key is not None for key in keys], np.uint8)
    numbers = np.array([key if key is not None else 0 for key in keys], "<i8")
    parts = [HEAD.pack(MAGIC, first, len(rules), len(documents), width), rules.astype("<u4").T.tobytes(), expansion_lengths(rules, first).astype("<u4").tobytes(), numbers.tobytes(), present.tobytes(), np.concatenate([[0], offsets]).astype("<u8").tobytes(), symbols.astype(f"<u{width}").tobytes()]
    return b"".join(parts)


class Shard:
    """Reads a shard; only what is asked for is expanded."""

    def __init__(self, data: bytes):
        magic, self.first, n_rules, n_docs, width = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(2, n_rules)
        self.sizes = take("<u4", n_rules)
        numbers, present = take("<i8", n_docs), take("u1", n_docs)
        self.keys = [n if p else None for n, p in zip(numbers.tolist(), present.tolist(), strict=True)]
        self.offsets = take("<u8", n_docs + 1).astype(np.int64)
        self.symbols = take(f"<u{width}", int(self.offsets[-1]) if n_docs else 0)

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        high = symbols >= self.first
        out[high] = self.sizes[symbols[high] - self.first]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.uint32)
        while (high := symbols >= self.first).any():
            begin = np.cumsum(high + 1) - 1 - high
            out = np.empty(len(symbols) + int(high.sum()), np.uint32)
            rule = symbols[high] - self.first
            out[begin[~high]] = symbols[~high]
            out[begin[high]], out[begin[high] + 1] = self.rules[0][rule], self.rules[1][rule]
            symbols = out
        return symbols

    def decode_document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.offsets[k] : self.offsets[k + 1]])

    def decode_span(self, start: int, count: int) -> np.ndarray:
        """Ids start .. start + count of the shard."""
        ends = np.cumsum(self.lengths(self.symbols))
        a = int(np.searchsorted(ends, start, "right"))
        b = int(np.searchsorted(ends, start + count, "left")) + 1
        return self.expand(self.symbols[a:b])[start - (int(ends[a - 1]) if a else 0) :][:count]

    def documents(self) -> list[np.ndarray]:
        ids = self.expand(self.symbols)
        sizes = np.concatenate([[0], np.cumsum(self.lengths(self.symbols))])[self.offsets]
        return [ids[a:b] for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]


def write_shards(docs: DataFrame, path: str, tokenizer_path: str | None = None, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the table (part, number, inside, documents, tokens, shard binary) of all documents to path.

    inside: ids of the partition's earlier shards.
    """
    named = tokenizer_path or vocabulary_path(TOKENIZER_FILE)

    def rows(source):
        encoder = encoder_for(named)
        first = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
        part, number, size, inside = TaskContext.get().partitionId(), 0, 0, 0
        keys: list = []
        held: list[np.ndarray] = []
        for batch in grouped_batches(source, 2000, 1, 1_000_000):
            for (key, _), ids in zip(batch, encoder.encode_many([text for _, text in batch]), strict=True):
                held.append(np.append(ids, np.uint32(end_id)))
                keys.append(key)
                size += len(held[-1])
                if size >= shard_tokens:
                    yield part, number, inside, len(held), size, write_shard(keys, held, first)
                    keys, held, size, number, inside = [], [], 0, number + 1, inside + size
        if held:
            yield part, number, inside, len(held), size, write_shard(keys, held, first)

    # A hash of the text, and one of the row's place for equal rows, split an id that many rows bear.
    keyed = docs.select(F.col(id_column).cast("bigint").alias("key"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("n"))
    ordered = keyed.repartitionByRange("key", "h", "n").sortWithinPartitions("key", "h").select("key", "text")
    map_rows(ordered, rows, "part int, number int, inside bigint, documents int, tokens bigint, shard binary", flush=16).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards at path."""
    stored = spark.read.parquet(path)
    totals = {row["part"]: row["tokens"] for row in stored.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect()}  # one number a partition
    running, before = 0, []
    for part in sorted(totals):
        before.append((part, running))
        running += totals[part]
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before bigint"))
    placed = stored.select("part", "inside", "shard").join(offsets, "part").select((F.col("inside") + F.col("before")).alias("begin"), "shard")

    def rows(source):
        for begin, data in source:
            shard = Shard(data)
            for key, ids in zip(shard.keys, shard.documents(), strict=True):
                yield key, begin, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                begin += len(ids)

    return map_rows(placed, rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encode_and_read(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    path = shared_path(docs.sparkSession, "repair-shards")
    write_shards(docs, path, tokenizer_path)
    return read_documents(docs.sparkSession, path)
