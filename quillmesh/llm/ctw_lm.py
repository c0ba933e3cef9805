"""Language-model scores by context-tree weighting over bytes.

A text is lower-cased (A-Z), its words joined by single spaces, and an end byte 255 added. Every byte is eight binary
decisions; each decision has a tree of the byte contexts of 0 to ``DEPTH`` bytes before, with Krichevsky-Trofimov (KT)
estimates at its nodes, weighted half and half with the product of the children at every depth. The tree has every
context of the training texts, however rare, so a byte's probability follows from its (DEPTH + 1)-gram alone.

Counts of all (DEPTH + 1)-grams of the training texts are gathered by a shuffle. The trees below contexts of two bytes
don't depend on each other, so they are dealt by these two bytes to ``SLICES`` slices, and each task builds those of one
slice at a time. What they weigh at two bytes is summed to the 256 contexts of one byte, and these and the root, a bounded
table, are weighted on the driver and broadcast. The texts are packed in chunks of ``CHUNK_BYTES``; each chunk asks every
slice once for the grams that it holds, whatever their number in it, and gets their logarithms back by a shuffle.

The base score is a unigram model of words with one added to each count. Words of at least ``WORD_SHARE`` of the training
tokens, a bounded number, are broadcast; only the other words of texts are shuffled to their counts. Words are counted by
the 64-bit XXH64 of their bytes.

Defined cases: null texts are empty and consist of the end alone. Without training rows all counts are 0. Null and
repeated ids are kept; rows have a key of their own. Only id and text are read. Texts are taken whole, in blocks.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import grouped_batches, map_rows, materialise

DEPTH = 5
WORD_SHARE = 2.0**-20
END = 255
PAD = bytes([END]) * DEPTH
END_WORD = b" end"  # no word holds a space
SLICES = 1024
SLICE_KEYS = (np.arange(1 << 16, dtype=np.int64) * 40503 & 0xFFFF) >> 6 << 48  # by the last two bytes, over a gram's 48 bits
GRAM = (1 << 48) - 1
BLOCK_BYTES = 1_500_000
CHUNK_BYTES, CHUNK_ROWS = 4_000_000, 1 << 15
ASKED_BYTES = 4_000_000
MERGE_ROWS = 3_000_000
FLUSH_WORDS = 300_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def hash_of(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


class Bytes:
    """Padded bytes of some texts: symbols, the places that are coded and the text of each place."""

    def __init__(self, texts: list[bytes]):
        joined = b"".join([PAD + text + PAD[:1] for text in texts])
        self.data = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.ends = np.cumsum(sizes + DEPTH)
        coded = np.ones(len(self.data), bool)
        for k in range(DEPTH):
            coded[self.ends - sizes - DEPTH + k] = False
        self.at = np.flatnonzero(coded)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])

    def grams(self) -> np.ndarray:
        """Codes of context and symbol: the last byte highest, the symbol lowest."""
        code = np.zeros((len(self.data), 8), np.uint8)  # of little-endian numbers
        code[:, 0] = self.data
        for d in range(1, DEPTH + 1):
            code[d:, DEPTH + 1 - d] = self.data[:-d]
        return code.view("<i8")[:, 0][self.at]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of batches with the words of their texts, of about BLOCK_BYTES."""
    for batch in batches:
        texts = batch.column(at)
        first, size = 0, 0
        for i in range(batch.num_rows):
            size += len(texts[i].as_py() or "")
            if size >= BLOCK_BYTES or i == batch.num_rows - 1:
                yield batch.slice(first, i + 1 - first), [words_of(t) for t in texts.slice(first, i + 1 - first).to_pylist()]
                first, size = i + 1, 0


COUNTS = "kind int, code bigint, n bigint"


def gather_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(kind, code, n): kind 0 counts byte grams, kind 1 words by hash."""
    schema = pa.schema([("kind", pa.int32()), ("code", pa.int64()), ("n", pa.int64())])

    def out(kind: int, codes: np.ndarray, counts: np.ndarray):
        for at in range(0, len(codes), 100_000):
            part = codes[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(counts[at : at + 100_000])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        words: Counter = Counter()

        def word_rows():
            words_now = list(words)
            return out(1, np.array([hash_of(w) for w in words_now], np.int64), np.array([words[w] for w in words_now], np.int64))

        for _, texts in _blocks(batches, 0):
            for found in texts:
                words.update(found)
            words[END_WORD] += len(texts)
            codes = np.sort(Bytes([b" ".join(found) for found in texts]).grams())
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            grams.append((codes[first], np.diff(np.append(first, len(codes)))))
            if sum(len(g[0]) for g in grams) > MERGE_ROWS:
                grams = [_merged(grams)]
                if len(grams[0][0]) > MERGE_ROWS // 2:
                    yield from out(0, *grams.pop())
            if len(words) > FLUSH_WORDS:
                yield from word_rows()
                words.clear()
        if grams:
            yield from out(0, *_merged(grams))
        yield from word_rows()

    return docs.select(text_column).mapInArrow(run, COUNTS).groupBy("kind", "code").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0, by recurrence up to 8 and Stirling's series."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    inverse = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + inverse / 12 - inverse**3 / 360 + inverse**5 / 1260 - inverse**7 / 1680 - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the KT block probability of counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


SMALL = 1 << 16
GAMMAS = {shift: log_gamma(np.arange(SMALL) + shift) for shift in (0.5, 1.0)}


def log_kt_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log_kt of whole numbers, by tables where they are small."""

    def gamma(counts: np.ndarray, shift: float) -> np.ndarray:
        found = GAMMAS[shift][np.minimum(counts, SMALL - 1)]
        large = counts >= SMALL
        found[large] = log_gamma(counts[large] + shift)
        return found

    return gamma(zeros, 0.5) + gamma(ones, 0.5) - gamma(zeros + ones, 1.0) - math.log(math.pi)


def bit_counts(counts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts (contexts, 2^level nodes) of a 0 and a 1 at the decisions of one bit, highest first."""
    split = counts.reshape(len(counts), 1 << level, 2, 128 >> level).sum(axis=3, dtype=np.float64)
    return split[:, :, 0], split[:, :, 1]


def byte_classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, a byte of each class): bytes never seen that part from the seen ones at one decision are alike."""
    seen: dict[tuple[int, int], int] = {}
    classes = np.zeros(256, np.int64)
    shown: list[int] = []
    for byte in range(256):
        level = next((n for n in range(9) if not counts.reshape(1 << n, -1)[byte >> (8 - n)].any()), 8)
        key = (level, byte >> (8 - level))
        if counts[byte]:
            key = (9, byte)
        if key not in seen:
            seen[key] = len(shown)
            shown.append(byte)
        classes[byte] = seen[key]
    return classes, np.array(shown)


class Tree:
    """A tree that is held whole, for small corpora: contexts, their children and the log10 probabilities of the next byte at each as the deepest known context."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]]):
        """orders[d]: sorted contexts of d bytes (last byte highest) and their counts (contexts, 256)."""
        sizes = [len(contexts) for contexts, _ in orders]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.dead = int(offsets[-1])
        self.inner = int(offsets[-2])  # contexts of the full depth have no children
        self.columns, shown = byte_classes(orders[0][1][0])
        self.width = len(shown)
        self.child = np.full((self.inner + 1, self.width), self.dead, np.int32)
        parents: list[np.ndarray] = [np.zeros(0, np.int64)]
        for d in range(1, len(orders)):
            contexts = orders[d][0]
            parent = np.searchsorted(orders[d - 1][0], contexts >> 8)
            parents.append(parent)
            self.child[offsets[d - 1] + parent, self.columns[contexts & 255]] = offsets[d] + np.arange(len(contexts))
        self.log_p = np.zeros((self.dead, self.width), np.float32)
        for level in range(8):
            self._weigh(orders, parents, offsets, level, shown)
        self.log_p *= np.float32(1 / math.log(10))

    def _weigh(self, orders, parents, offsets, level: int, shown: np.ndarray) -> None:
        """Adds the log probabilities of one bit's decisions to the tables."""
        half = math.log(0.5)
        used, node = np.unique(shown >> (8 - level), return_inverse=True)
        bit = shown >> (7 - level) & 1
        zeros_ones = [tuple(side[:, used] for side in bit_counts(counts, level)) for _, counts in orders]
        keep: list[np.ndarray] = [None] * len(orders)  # the weight of a node's own estimate
        rest: list[np.ndarray] = [None] * len(orders)  # what the further child says of a 1
        below = None
        for d in range(len(orders) - 1, -1, -1):
            zeros, ones = zeros_ones[d]
            own = log_kt(zeros, ones)
            if d == len(orders) - 1:
                keep[d], rest[d], weighted = np.ones_like(own), np.full_like(own, 0.5), own
            else:
                inner = np.zeros_like(own)
                left0, left1 = zeros.copy(), ones.copy()
                np.add.at(inner, parents[d + 1], below)
                np.subtract.at(left0, parents[d + 1], zeros_ones[d + 1][0])
                np.subtract.at(left1, parents[d + 1], zeros_ones[d + 1][1])
                left0, left1 = np.maximum(left0, 0), np.maximum(left1, 0)
                inner += log_kt(left0, left1)
                weighted = half + np.logaddexp(own, inner)
                keep[d] = np.exp(half + own - weighted)
                rest[d] = (left1 + 0.5) / (left0 + left1 + 1)
            below = weighted
        base, remaining = np.zeros((1, len(used))), np.ones((1, len(used)))
        for d in range(len(orders)):
            zeros, ones = zeros_ones[d]
            if d:
                base, remaining = base[parents[d]], remaining[parents[d]]
            estimate = (ones + 0.5) / (zeros + ones + 1)
            one = base + remaining * (keep[d] * estimate + (1 - keep[d]) * rest[d])
            self.log_p[offsets[d] : offsets[d + 1]] += np.where(bit == 1, np.log(one)[:, node], np.log1p(-one)[:, node])
            base, remaining = base + remaining * keep[d] * estimate, remaining * (1 - keep[d])

    def places(self, texts: Bytes) -> np.ndarray:
        """The deepest known context at each coded byte."""
        child = self.child.reshape(-1)
        now = np.zeros(len(texts.at), np.int64)
        best = now
        for d in range(1, DEPTH + 1):
            now = child[np.minimum(now, self.inner) * self.width + self.columns[texts.data[texts.at - d]]].astype(np.int64)
            best = np.where(now == self.dead, best, now)
        return best

    def log10_of(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end."""
        coded = Bytes(texts)
        values = self.log_p.reshape(-1)[self.places(coded) * self.width + self.columns[coded.data[coded.at]]]
        return np.add.reduceat(values.astype(np.float64), coded.starts)


def _nodes(codes: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context and the bits before, count of a 0, of a 1) of the decisions of one bit; codes are sorted."""
    keys = codes >> (8 - bit)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    both, ones = np.add.reduceat(counts, first), np.add.reduceat(counts * (codes >> (7 - bit) & 1), first)
    return keys[first], both - ones, ones


class Subtrees:
    """The trees below some contexts of ``TOP`` bytes, with all their contexts."""

    TOP = 2

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        """codes: sorted byte grams and their counts."""
        self.depths = [(codes, counts)] if len(codes) else []
        while 0 < len(self.depths) <= DEPTH - self.TOP:
            longer, n = self.depths[0]
            self.depths.insert(0, _merged([(longer >> 16 << 8 | longer & 255, n)]))
        self.bits = [self._weigh(bit) for bit in range(8)]

    def _weigh(self, bit: int):
        """By depth: nodes, places of parents, weights of the nodes' own estimates; and the weighted logarithms at the top."""
        half = math.log(0.5)
        nodes = [_nodes(codes, counts, bit) for codes, counts in self.depths]
        parents = [np.searchsorted(above[0], below[0] >> (8 + bit) << bit | below[0] & ((1 << bit) - 1)) for above, below in zip(nodes, nodes[1:], strict=False)]
        keep, weighted = [None] * len(nodes), np.zeros(0)
        for d in reversed(range(len(nodes))):
            own = log_kt_of(*nodes[d][1:])
            if d == len(nodes) - 1:
                keep[d], weighted = np.ones_like(own), own
            else:
                weighted = half + np.logaddexp(own, np.bincount(parents[d], weighted, len(own)))
                keep[d] = np.exp(half + own - weighted)
        return nodes, parents, keep, weighted

    def tops(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The contexts of TOP bytes, their counts of the next byte and weighted logarithms of the 255 decisions."""
        codes, n = self.depths[0] if self.depths else (np.zeros(0, np.int64),) * 2
        contexts = np.unique(codes >> 8)
        counts, logs = np.zeros((len(contexts), 256), np.int64), np.zeros((len(contexts), 255))
        counts[np.searchsorted(contexts, codes >> 8), codes & 255] = n
        for bit, (nodes, _, _, weighted) in enumerate(self.bits if self.depths else ()):
            keys = nodes[0][0]
            logs[np.searchsorted(contexts, keys >> bit), (1 << bit) - 1 + (keys & ((1 << bit) - 1))] = weighted
        return contexts, counts, logs

    def log10_of(self, codes: np.ndarray, upper: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 probability of the last byte of grams; upper: what contexts above TOP say, and the weight that they leave."""
        total = np.zeros(len(codes))
        for bit, (nodes, parents, keep, _) in enumerate(self.bits):
            before = (codes & 255) >> (8 - bit)
            base, rest = (side[codes >> 40, (1 << bit) - 1 + before] for side in upper)
            states = []
            for d, (keys, zeros, ones) in enumerate(nodes):
                if d:
                    above = [side[parents[d - 1]] for side in states[-1]]
                else:
                    above = [side[keys >> (8 + bit), (1 << bit) - 1 + (keys & ((1 << bit) - 1))] for side in upper]
                own = (ones + 0.5) / (zeros + ones + 1)
                states.append((above[0] + above[1] * keep[d] * own, above[1] * (1 - keep[d])))
            left = np.arange(len(codes))
            for d in reversed(range(len(nodes))):  # the deepest node that is known
                wanted = codes[left] >> (8 * (DEPTH + 1 - self.TOP - d)) << bit | before[left]
                keys = nodes[d][0]
                place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[place] == wanted
                base[left[hit]], rest[left[hit]] = (side[place[hit]] for side in states[d])
                left = left[~hit]
            one = base + rest * 0.5
            total += np.where(codes >> (7 - bit) & 1, np.log(one), np.log1p(-one))
        return total / math.log(10)


SLICED = "slice int, chunk bigint, codes binary, counts binary"


def _sliced(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each slice in sorted keys, and where it is."""
    cuts = [0, *(np.flatnonzero(np.diff(keys >> 48)) + 1).tolist(), len(keys)]
    return ((int(keys[at] >> 48), slice(at, end)) for at, end in zip(cuts, cuts[1:], strict=False) if at < end)


def _trained_rows(grams: DataFrame) -> DataFrame:
    """Training grams (code, n) by slice; their chunk is -1, before all others."""

    def rows(source):
        for held in grouped_batches(((code, n, "") for code, n in source), MERGE_ROWS // 6, 2, 1):
            codes, counts = (np.array(side, np.int64) for side in list(zip(*held, strict=True))[:2])
            keys = codes | SLICE_KEYS[codes >> 32]
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            for number, at in _sliced(keys):
                yield number, -1, (keys[at] & GRAM).tobytes(), counts[at].tobytes()

    return map_rows(grams.select("code", "n"), rows, SLICED)


def _each_slice(source) -> Iterator[tuple[int, Subtrees, Iterator[tuple[int, bytes]]]]:
    """(slice, its trees, the (chunk, grams) asked of it); source is sorted by slice and chunk."""
    for number, of_slice in itertools.groupby(source, lambda row: row[0]):
        parts, first = [(np.zeros(0, np.int64),) * 2], None
        for row in of_slice:
            if row[1] >= 0:
                first = row
                break
            parts.append((np.frombuffer(row[2], np.int64), np.frombuffer(row[3], np.int64)))
        asked = itertools.chain([first] if first else [], of_slice)
        yield number, Subtrees(*_merged(parts)), ((chunk, codes) for _, chunk, codes, _ in asked)


def upper_table(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """By last byte and decision: what contexts of no and one byte say of a 1, and the weight left to longer ones."""

    def rows(source):
        for _, trees, _ in _each_slice(source):
            for context, counts, logs in zip(*trees.tops(), strict=True):
                yield int(context) >> 8, int(context), counts.tobytes(), logs.tobytes()

    def fold(tops: pa.Table) -> pa.Table:
        tops = tops.sort_by("context")  # sums of one order, so that reruns agree
        counts = sum(np.frombuffer(x, np.int64) for x in tops["counts"].to_pylist())
        logs = sum(np.frombuffer(x, np.float64) for x in tops["logs"].to_pylist())
        return pa.table({"last": tops["last"][:1], "counts": pa.array([counts.tobytes()]), "logs": pa.array([logs.tobytes()])})

    tops = map_rows(_trained_rows(grams).repartition("slice").sortWithinPartitions("slice"), rows, "last int, context int, counts binary, logs binary")
    counts, inner = np.zeros((256, 256), np.int64), np.zeros((256, 255))
    for last, n, logs in tops.groupBy("last").applyInArrow(fold, "last int, counts binary, logs binary").collect():  # 256 rows at most
        counts[last], inner[last] = np.frombuffer(n, np.int64), np.frombuffer(logs, np.float64)
    half = math.log(0.5)
    base, rest = np.zeros((256, 255)), np.zeros((256, 255))
    for bit in range(8):
        at = slice((1 << bit) - 1, (2 << bit) - 1)
        zeros, ones = bit_counts(counts, bit)
        own = log_kt(zeros, ones)
        weighted = half + np.logaddexp(own, inner[:, at])
        zeros0, ones0 = zeros.sum(axis=0), ones.sum(axis=0)
        own0 = log_kt(zeros0, ones0)
        keep0 = np.exp(own0 - np.logaddexp(own0, weighted.sum(axis=0)))
        keep = np.exp(half + own - weighted)
        base[:, at] = keep0 * (ones0 + 0.5) / (zeros0 + ones0 + 1) + (1 - keep0) * keep * (ones + 0.5) / (zeros + ones + 1)
        rest[:, at] = (1 - keep0) * (1 - keep)
    return base, rest


class Model:
    def __init__(self, upper: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, counts: np.ndarray, tokens: int, types: int):
        """upper: as of upper_table; hashes, counts: the frequent words, by hash."""
        self.upper, self.hashes, self.counts, self.tokens, self.types = upper, hashes, counts, tokens, types


def train(docs: DataFrame, text_column: str = "text") -> tuple[Model, DataFrame, DataFrame]:
    """The bounded part of the model, and the tables (code, n) of all byte grams and of the words left out of it."""
    counted = materialise(gather_counts(docs, text_column), "ctw-counts")
    sums = {row["kind"]: (row["total"], row["types"]) for row in counted.groupBy("kind").agg(F.sum("n").alias("total"), F.count("*").alias("types")).collect()}
    grams, words = counted.where("kind = 0").select("code", "n"), counted.where("kind = 1").select("code", "n")
    tokens, types = sums.get(1, (0, 0))
    least = F.lit(WORD_SHARE * tokens)
    frequent = words.where(F.col("n") >= least).toArrow()  # 1 / WORD_SHARE words at most
    order = np.argsort(frequent["code"].to_numpy())
    return Model(upper_table(grams), frequent["code"].to_numpy()[order], frequent["n"].to_numpy()[order], tokens, types), grams, words.where(F.col("n") < least)


def chunks(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(chunk, slice, data): ids and normalised texts of a chunk as a compressed Arrow stream; slice is after all others."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema[id_column].dataType)

    def rows(source):
        held_in = TaskContext.get().partitionId() << 20
        for number, held in enumerate(grouped_batches(source, CHUNK_ROWS, 1, CHUNK_BYTES)):
            ids, texts = zip(*held, strict=True)
            batch = pa.record_batch({"id": pa.array(ids, kind), "text": pa.array([b" ".join(words_of(text)) for text in texts], pa.large_binary())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(batch)
            yield held_in + number, SLICES, sink.getvalue().to_pybytes()

    return map_rows(docs.select(id_column, text_column), rows, "chunk bigint, slice int, data binary")


def _unpacked(data: bytes) -> tuple[list, list[bytes]]:
    table = pa.ipc.open_stream(data).read_all()
    return table["id"].to_pylist(), table["text"].to_pylist()


def _keyed(texts: list[bytes]) -> Iterator[tuple[Bytes, np.ndarray]]:
    """Blocks of texts, and each coded byte's gram with its slice."""
    for held in grouped_batches(((text,) for text in texts), 2000, 0, BLOCK_BYTES):
        block = Bytes([text for (text,) in held])
        codes = block.grams()
        yield block, codes | SLICE_KEYS[codes >> 32]


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _all_distinct(blocks: Iterable[tuple[Bytes, np.ndarray]]) -> np.ndarray:
    """The distinct grams of blocks of texts, by slice."""
    return _distinct(np.concatenate([_distinct(keys) for _, keys in blocks]))


MIX = np.uint64(0x9E3779B97F4A7C15)


class Places:
    """Where keys stand in a sorted array that has them all: by a table of hashes, and by search for those that clash."""

    def __init__(self, known: np.ndarray):
        self.known = known
        bits = max((8 * len(known)).bit_length(), 10)
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, np.int32)
        self.table[self._slots(known)] = np.arange(len(known), dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * MIX >> self.shift).view(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        place = self.table[self._slots(keys)]
        other = np.flatnonzero(self.known[place] != keys)
        place[other] = np.searchsorted(self.known, keys[other])
        return place


def gram_logs(placed: DataFrame, grams: DataFrame, model) -> DataFrame:
    """(chunk, slice, data): log10 probabilities, as 32-bit floats, of the distinct grams of each chunk, in order."""

    def ask(source):
        for chunk, data in source:
            keys = _all_distinct(_keyed(_unpacked(data)[1]))
            for number, at in _sliced(keys):
                yield number, chunk, (keys[at] & GRAM).tobytes(), None

    def answer(source):
        for number, trees, asked in _each_slice(source):
            for held in grouped_batches(asked, 1 << 20, 1, ASKED_BYTES):
                codes, place = np.unique(np.frombuffer(b"".join([codes for _, codes in held]), np.int64), return_inverse=True)
                logs = trees.log10_of(codes, model.value.upper).astype(np.float32)[place]
                at = 0
                for chunk, codes in held:
                    yield chunk, number, logs[at : at + len(codes) // 8].tobytes()
                    at += len(codes) // 8

    asked = map_rows(placed.select("chunk", "data"), ask, SLICED)
    together = _trained_rows(grams).unionAll(asked).repartition("slice").sortWithinPartitions("slice", "chunk")
    return map_rows(together, answer, "chunk bigint, slice int, data binary")


PARTIAL = "row bigint, {id} {kind}, n_bytes bigint, n_tokens bigint, known bigint, logs double, score double, rare array<bigint>"


class Scorer:
    ROOM = 400_000

    def __init__(self, model: Model):
        self.model = model
        self.logs: dict[bytes, float] = {}

    def _learn(self, fresh: list[bytes]) -> None:
        """log10 (count + 1) of the frequent among fresh words, NaN for the others."""
        hashes = np.array([hash_of(w) for w in fresh], np.int64)
        known = self.model.hashes
        values = np.full(len(fresh), np.nan)
        if len(known):
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[place] == hashes
            values[hit] = np.log10(self.model.counts[place[hit]] + 1)
        self.logs.update(zip(fresh, values.tolist(), strict=True))

    def rows(self, texts: list[bytes], logs: np.ndarray):
        """(bytes, tokens, frequent tokens, sum of their logs, score, hashes of the others) of each text; logs of their distinct grams."""
        blocks = list(_keyed(texts))
        places = Places(_all_distinct(blocks))
        scores: list[float] = []
        for block, keys in blocks:
            scores += np.add.reduceat(logs[places.of(keys)].astype(np.float64), block.starts).tolist()
        for text, score in zip(texts, scores, strict=True):
            words = [*text.split(), END_WORD]
            fresh = list(set(words).difference(self.logs))
            if len(self.logs) + len(fresh) > self.ROOM:
                self.logs.clear()
                fresh = list(set(words))
            if fresh:
                self._learn(fresh)
            values = np.fromiter(map(self.logs.__getitem__, words), float, len(words))
            rare = np.isnan(values)
            yield sum(map(len, words)) - len(END_WORD) + max(len(words) - 1, 1), len(words), int((~rare).sum()), float(values[~rare].sum()), score, [hash_of(words[i]) for i in np.flatnonzero(rare).tolist()]
            if len(self.logs) > self.ROOM:
                self.logs.clear()


def score(docs: DataFrame, trained: tuple[Model, DataFrame, DataFrame], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every text."""
    model, grams, others = trained
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()
    schema = PARTIAL.format(id=id_column, kind=kind)
    placed = materialise(chunks(docs, id_column, text_column), "ctw-chunks")

    def rows(source):
        scorer = Scorer(shared.value)
        logs: list[np.ndarray] = []
        for chunk, number, data in source:  # a chunk's logarithms by slice, then its texts
            if number < SLICES:
                logs.append(np.frombuffer(data, np.float32))
                continue
            ids, texts = _unpacked(data)
            for i, (key, found) in enumerate(zip(ids, scorer.rows(texts, np.concatenate(logs)), strict=True)):
                yield chunk * CHUNK_ROWS + i, key, *found
            logs = []

    together = gram_logs(placed, grams, shared).unionAll(placed).repartition("chunk").sortWithinPartitions("chunk", "slice")
    partial = materialise(map_rows(together, rows, schema, flush=500), "ctw-scores")
    found = partial.select("row", F.explode("rare").alias("code")).join(others, "code").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs"))
    joined = partial.drop("rare").join(found, "row", "left")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * math.log10(model.tokens + model.types + 1)
    return joined.select(id_column, "n_bytes", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"))
