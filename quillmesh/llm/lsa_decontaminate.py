"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages are TF-IDF rows over their own words, with document frequencies counted over the whole corpus. A
randomised SVD, distributed over the passages, gives the latent space: a random sketch Y = A O, its pull-back A'Y
summed by word, an orthonormal basis, and a second pass for the small Gram matrix. Every document is then scanned in
overlapping windows of the passages' scales. In each stretch, passages of which too few words stand there to be found are
left out first, exactly. Of the others, a window's cosine in the latent space picks candidates, and so do, whatever the
cosine, enough of a passage's words for a copy around the window: the words of passages that stand in many documents have
too little weight for the cosine. A candidate is checked in the document's words: the longest common subsequence with the passage around the window, and the share of the passage's
answer words (its ``ANSWER_SHARE`` of highest weight) that stand there. A common subsequence of ``COPY`` of the passage is
a copy; one of ``PARAPHRASE`` with ``ANSWER`` of the answer words is a paraphrase.

The passages are the stated query set: they are taken in blocks of about ``BLOCK`` items and ``BLOCK_WORDS`` words, each
block one pass over the corpus, so what is broadcast is bounded. Within a block the rank is ``RANK`` at most; a block of fewer passages loses nothing.

Defined cases: null or empty texts match nothing, and neither do passages without words. Passages of fewer than
``SHORT`` words must stand in one piece. Passages with one text match alike under each id; repeated documents are reported
each. Extra columns are not read. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import map_rows

BLOCK, BLOCK_WORDS, RANK, OVERSAMPLE, SEED = 1000, 200_000, 256, 16, 7
COSINE, COPY, PARAPHRASE, ANSWER = 0.35, 0.8, 0.5, 0.8
ANSWER_SHARE, SHORT, LEAST_SCALE = 0.25, 8, 16
WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        return -1


def document_frequencies(docs: DataFrame, words: set[str], text_column: str = "text") -> tuple[int, dict[str, int]]:
    """Documents in all, and how many hold each of the words."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(words))

    def rows(source):
        counts: dict[str, int] = {}
        total = 0
        for (text,) in source:
            total += 1
            for word in shared.value.intersection(words_of(text)):
                counts[word] = counts.get(word, 0) + 1
        yield None, total
        yield from counts.items()

    found = map_rows(docs.select(text_column), rows, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # bounded by the block's words
    by_word = {row["word"]: row["n"] for row in found}
    return by_word.pop(None, 0), by_word


def latent_space(items: DataFrame, vocabulary: dict[str, int], idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """(words, k) right singular vectors of the passages' TF-IDF matrix by a distributed randomised SVD."""
    context = items.sparkSession.sparkContext
    size = len(vocabulary)
    width = min(rank + OVERSAMPLE, size)
    names, weights = context.broadcast(_Numbers(vocabulary)), context.broadcast(idf)
    omega = np.random.default_rng(SEED).standard_normal((size, width)).astype(np.float32)
    sketch = context.broadcast(omega)

    def row_of(text):
        at = np.array([i for i in map(names.value.__getitem__, words_of(text)) if i >= 0], np.int64)
        at, count = np.unique(at, return_counts=True)
        return at, count * weights.value[at]

    def pull_back(source):
        sums: dict[int, np.ndarray] = {}
        for (text,) in source:
            at, value = row_of(text)
            y = value @ sketch.value[at]
            for i, v in zip(at.tolist(), value.tolist(), strict=True):
                sums[i] = sums.get(i, 0) + v * y
        yield from ((i, vector.astype(float).tolist()) for i, vector in sums.items())

    pulled = map_rows(items.select("text"), pull_back, "i int, vector array<double>")
    summed = pulled.select("i", F.posexplode("vector")).groupBy("i", "pos").agg(F.sum("col").alias("col")).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("pos", "col")))["col"].alias("vector")).collect()
    z = np.zeros((size, width))
    for row in summed:
        z[row["i"]] = row["vector"]
    basis, _ = np.linalg.qr(z)
    shared = context.broadcast(basis)

    def gram(source):
        total = np.zeros((width, width))
        for (text,) in source:
            at, value = row_of(text)
            c = value @ shared.value[at]
            total += np.outer(c, c)
        yield from ((i, row.tolist()) for i, row in enumerate(total))

    partial = map_rows(items.select("text"), gram, "i int, vector array<double>").select("i", F.posexplode("vector")).groupBy("i", "pos").agg(F.sum("col").alias("col")).collect()
    small = np.zeros((width, width))
    for row in partial:
        small[row["i"], row["pos"]] = row["col"]
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    kept = np.argsort(-values)[:rank]
    kept = kept[values[kept] > max(values.max(), 0) * 1e-9]
    return (basis @ vectors[:, kept]).astype(np.float32)


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one big number's bits for all of a at once."""
    masks: dict[str, int] = {}
    for i, word in enumerate(a):
        masks[word] = masks.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        mask = masks.get(word)
        if mask:
            hit = row & mask
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


class Block:
    """A bounded block of passages ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], vocabulary: dict[str, int], idf: np.ndarray, space: np.ndarray):
        self.names = _Numbers(vocabulary)
        self.idf = np.append(idf, idf.mean() if len(idf) else 1.0)  # the last is for words outside
        self.inside = np.append(np.ones(len(idf)), 0.0)
        self.rows = np.vstack([space * idf[:, None].astype(np.float32), np.zeros((1, space.shape[1]), np.float32)])
        self.keys, self.words, self.answers = [], [], []
        scales: dict[int, list[int]] = {}
        latent, shares = [], []
        for key, text in items:
            words = words_of(text)
            if not words:
                continue
            at = np.array([vocabulary[w] for w in words])
            point = self.rows[at].sum(axis=0)
            distinct, count = np.unique(at, return_counts=True)
            norm = float(np.sqrt(((count * idf[distinct]) ** 2).sum()))
            kept = float(np.linalg.norm(point))
            order = distinct[np.lexsort((distinct, -idf[distinct]))][: max(1, math.ceil(ANSWER_SHARE * len(distinct)))]
            spelled = {vocabulary[w]: w for w in words}
            scales.setdefault(max(LEAST_SCALE, 1 << (len(words) - 1).bit_length()), []).append(len(self.keys))
            self.keys.append(key)
            self.words.append(words)
            self.answers.append({spelled[i] for i in order.tolist()})
            latent.append(point / (kept or 1))
            shares.append(COSINE * kept / (norm or 1))
        self.points = np.array(latent, np.float32).reshape(len(latent), space.shape[1])
        self.floor = np.array(shares)
        self.scales = {scale: np.array(at) for scale, at in sorted(scales.items())}
        self.scale_of = np.zeros(len(self.keys), np.int64)
        for scale, at in self.scales.items():
            self.scale_of[at] = scale
        # of each word the passages that hold it, how often, and whether it is one of their answer words
        self.own = [np.unique([vocabulary[w] for w in words]) for words in self.words]
        held = [(i, at, n, int(w in answers)) for at, (words, answers) in enumerate(zip(self.words, self.answers, strict=True)) for w, n in Counter(words).items() for i in (vocabulary[w],)]
        table = np.array(sorted(held), np.int64).reshape(len(held), 4)
        self.first = np.searchsorted(table[:, 0], np.arange(len(vocabulary) + 1))
        self.passages, self.counts, self.is_answer = table[:, 1].astype(np.int32), table[:, 2].astype(np.int32), table[:, 3].astype(np.int8)
        sizes = np.array([len(words) for words in self.words], float)
        self.copy_words, self.paraphrase_words = COPY * sizes - 1e-9, PARAPHRASE * sizes - 1e-9
        self.answer_words = np.array([ANSWER * len(answers) for answers in self.answers]) - 1e-9

    def _possible(self, ids: np.ndarray) -> np.ndarray:
        """Passages that the words around could hold: enough of their words for a copy, or for a paraphrase with its answer words."""
        present = np.unique(ids)
        present = present[np.searchsorted(present, 0) :]
        sizes = self.first[present + 1] - self.first[present]
        at = np.repeat(self.first[present] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        common = np.bincount(self.passages[at], self.counts[at], len(self.keys))
        answers = np.bincount(self.passages[at], self.is_answer[at], len(self.keys))
        return np.flatnonzero((common >= self.copy_words) | (common >= self.paraphrase_words) & (answers >= self.answer_words))

    def candidates(self, words: list[str]):
        """(passage, window start, window end, cosine) where the latent cosine is high enough or the words suffice for a copy.

        Stretches of windows are looked at together: first the passages that the words around them could hold at all, then
        each window's bounds, then the cosines of the windows left with those passages.
        """
        if not self.keys:
            return
        ids = np.array(list(map(self.names.get, words, repeat(-1))), np.int32)
        weights = self.idf[ids] ** 2
        every = np.concatenate([[0], np.cumsum(weights)])
        inside = np.concatenate([[0], np.cumsum(weights * self.inside[ids])])
        largest = max(self.scales)
        stride = 4 * largest
        for begin in range(0, len(words), stride):
            possible = self._possible(ids[max(0, begin - 2 * largest) : begin + stride + 2 * largest])
            for scale in np.unique(self.scale_of[possible]).tolist():
                passages = possible[self.scale_of[possible] == scale]
                last = max(len(words) - scale, 0)
                starts = np.arange(begin, min(begin + stride, last + scale // 4), scale // 4).clip(max=last)
                if not len(starts):
                    continue
                ends = np.minimum(starts + scale, len(words))
                whole = every[ends] - every[starts]
                exact = np.stack([self._copy_bound(p, ids, starts, ends) >= self.copy_words[p] for p in passages.tolist()], axis=1)
                at = np.flatnonzero((inside[ends] - inside[starts] > self.floor[passages].min() ** 2 * whole) | exact.any(axis=1))
                if not len(at):
                    continue
                sums = np.array([self.rows[ids[s:e]].sum(axis=0) for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                cosines = sums @ self.points[passages].T / np.sqrt(np.maximum(whole[at], 1e-12))[:, None]
                for w, p in np.argwhere((cosines >= self.floor[passages]) | exact[at]).tolist():
                    yield int(passages[p]), int(starts[at[w]]), int(ends[at[w]]), float(cosines[w, p])

    def _copy_bound(self, passage: int, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many words around each window stand in the passage, which no common subsequence exceeds."""
        size = len(self.words[passage])
        begin, end = max(0, int(starts.min()) - size), int(ends.max()) + size
        own, near = self.own[passage], ids[begin:end]
        inside = own[np.minimum(np.searchsorted(own, near), len(own) - 1)] == near
        sums = np.concatenate([[0], np.cumsum(inside)])
        return sums[np.minimum(ends + size, begin + len(inside)) - begin] - sums[np.maximum(starts - size, 0) - begin]

    def check(self, passage: int, words: list[str], start: int, end: int) -> tuple[float, float]:
        """Shares of the passage in the longest common subsequence, and of its answer words, around a window."""
        wanted = self.words[passage]
        near = words[max(0, start - len(wanted)) : end + len(wanted)]
        if len(wanted) < SHORT:
            found = any(near[i : i + len(wanted)] == wanted for i in range(len(near) - len(wanted) + 1))
            return float(found), float(found)
        answers = self.answers[passage]
        return common_subsequence(wanted, near) / len(wanted), len(answers.intersection(near)) / len(answers)

    def matches(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item, cosine, common share, answer share) of every passage found in a text, by item."""
        words = words_of(text)
        if not words or not self.keys:
            return []
        best: dict[int, tuple[float, float, float]] = {}
        for passage, start, end, cosine in self.candidates(words):
            if best.get(passage, (0,))[0] >= COPY:
                continue
            common, answer = self.check(passage, words, start, end)
            if (common >= COPY or common >= PARAPHRASE and answer >= ANSWER) and (common, answer) > best.get(passage, (0, 0))[:2]:
                best[passage] = common, answer, cosine
        return sorted((self.keys[p], c, m, a) for p, (m, a, c) in best.items())


def blocks(docs: DataFrame, benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", size: int = BLOCK):
    """The benchmark's passages in blocks of about ``size``, or fewer where they are long."""
    items = benchmark.select(F.col(id_column).alias("item"), F.col(text_column).alias("text")).where("text IS NOT NULL")
    n, words = items.agg(F.count("*"), F.coalesce(F.sum(F.regexp_count("text", F.lit(r"(?U)\w+"))), F.lit(0))).first()
    parts = max(-(-n // size), -(-words // BLOCK_WORDS))
    for part in range(parts):
        chosen = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        listed = sorted(((row["item"], row["text"]) for row in chosen.collect()), key=lambda x: (x[0] is not None, x))
        vocabulary = {word: i for i, word in enumerate(sorted({w for _, text in listed for w in words_of(text)}))}
        if not vocabulary:
            continue
        total, frequency = document_frequencies(docs, set(vocabulary))
        idf = np.log((1 + total) / (1 + np.array([frequency.get(word, 0) for word in vocabulary]))) + 0.1
        yield Block(listed, vocabulary, idf, latent_space(chosen, vocabulary, idf))


SCHEMA = "item_id bigint, cosine double, common_share double, answer_share double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, common_share, answer_share, kind) for every passage found in a document."""
    spark = docs.sparkSession
    kind = docs.schema[doc_column].dataType.simpleString()
    out = spark.createDataFrame([], f"{doc_column} {kind}, {SCHEMA}")
    for block in blocks(docs, benchmark):
        shared = spark.sparkContext.broadcast(block)

        def rows(source, shared=shared):
            for key, text in source:
                for match in shared.value.matches(text):
                    yield key, *match

        out = out.unionAll(map_rows(docs.select(doc_column, text_column), rows, f"{doc_column} {kind}, {SCHEMA}"))
    return out.withColumn("kind", F.when(F.col("common_share") >= COPY, "copy").otherwise("paraphrase"))
