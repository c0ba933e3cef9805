"""Hard-negative mining by branch-and-bound over ball trees.

Every task packs its rows into ball trees and writes them, so vectors are never shuffled. Anchors come in blocks of a
stated size, which are broadcast and meet every tree. A node with centre c and radius r bounds the inner product of all
its rows with an anchor q by q.c - |q|r and q.c + |q|r, and knows the range of its labels. The search leaves out nodes
whose upper bound is strictly beneath the current k-th score, nodes outside the score window, and nodes without a row of
a fitting label; equal scores are never pruned, so ties go to the smaller id. A block is searched twice: for positives,
then for the negatives in each positive's window. A task hands on k rows of each window at most. The search starts from
the k-th score that a sample of the block's own anchors reaches: these are rows of the table, so it is a lower bound of
the final one, and keeps most tasks from handing on anything for most anchors.

Defined cases. Rows without an id, a label or a vector, and vectors with a null or non-finite component, take no part.
Short vectors count as padded with zeros, an empty one is a zero vector. Scaled components are held to +-2^24, so that
scores fit a long. Rows of the anchor's own id are neither its positives nor its negatives; rows that repeat an id, or
a whole row, are rows of their own, but an anchor that is repeated whole is mined once. An anchor without positives, and
a positive without a row in its window (each with a negative score), give no rows. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import materialise, shared_path

SCALE = 256
TOP = 5
LOW, HIGH = 80, 100  # a negative's score in hundredths of the positive's
LEAF = 64
TREE_BYTES = 8 << 20  # of a tree's vectors
BLOCK = 32_768  # anchors of a block, for vectors of up to 64 components
STRIDE = 2048  # anchors that are searched together
LARGEST = 1 << 24
NONE = -(1 << 62)

TREE = "dim int, ids binary, labels binary, vectors binary, spans binary, centres binary, radii binary"
FOUND = "anchor int, slot int, anchor_id bigint, positive_id bigint, positive_score bigint, score bigint, id bigint"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def scaled_rows(vectors: DataFrame, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v in whole numbers."""
    values = F.col(vector_column).cast("array<double>")
    whole = F.transform(values, lambda x: F.least(F.greatest(F.floor(x * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    usable = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    out = vectors.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & F.coalesce(usable, F.lit(False)))
    return out.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(label_column).cast("bigint").alias("label"), whole.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, padded with zeros to the longest."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    dim = int(lengths.max(initial=0))
    if (lengths == dim).all():
        return values.reshape(len(lengths), dim).astype(np.int32)
    out = np.zeros((len(lengths), dim), np.int32)
    out[np.arange(dim) < lengths[:, None]] = values
    return out


def widened(a: np.ndarray, dim: int) -> np.ndarray:
    """The first dim components, zeros where there are fewer."""
    return a[:, :dim] if a.shape[1] >= dim else np.pad(a, ((0, 0), (0, dim - a.shape[1])))


@dataclass
class Tree:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    spans: np.ndarray  # of each node: first and last row, first child (0: a leaf), least and greatest label
    centres: np.ndarray
    radii: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Tree:
        """Splits by label while there are few, then at the median between two far rows."""
        order, points = np.arange(len(ids)), vectors.astype(np.float64)
        spans, centres, radii = [[0, len(ids), 0, 0, 0]], [], []
        at = 0
        while at < len(spans):
            first, last = spans[at][:2]
            own = order[first:last]
            some = points[own]
            centre = some.mean(axis=0)
            away = ((some - centre) ** 2).sum(axis=1)
            centres.append(centre)
            radii.append(math.sqrt(away.max(initial=0.0)))
            spans[at][3:] = [int(labels[own].min()), int(labels[own].max())]
            if last - first > LEAF:
                kinds = np.unique(labels[own])
                if 1 < len(kinds) <= (last - first) // (4 * LEAF):
                    ranked = np.argsort(labels[own], kind="stable")
                    half = int(np.searchsorted(labels[own][ranked], kinds[len(kinds) // 2]))
                else:
                    far = some[away.argmax()]
                    other = some[((some - far) ** 2).sum(axis=1).argmax()]
                    half = (last - first) // 2
                    ranked = np.argpartition(some @ (other - far), half)
                order[first:last] = own[ranked]
                spans[at][2] = len(spans)
                spans += [[first, first + half, 0, 0, 0], [first + half, last, 0, 0, 0]]
            at += 1
        return cls(ids[order], labels[order], vectors[order], np.array(spans, np.int64), np.array(centres).reshape(len(spans), -1), np.array(radii))

    def row(self) -> tuple:
        return (self.vectors.shape[1], *(a.tobytes() for a in (self.ids, self.labels, self.vectors, self.spans, self.centres, self.radii)))

    @classmethod
    def read(cls, dim: int, ids: bytes, labels: bytes, vectors: bytes, spans: bytes, centres: bytes, radii: bytes) -> Tree:
        read = lambda b, kind, shape=(-1,): np.frombuffer(b, kind).reshape(shape)
        rows, nodes = len(ids) // 8, len(radii) // 8
        return cls(read(ids, np.int64), read(labels, np.int64), read(vectors, np.int32, (rows, dim)), read(spans, np.int64, (nodes, 5)), read(centres, np.float64, (nodes, dim)), read(radii, np.float64))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = width = 0

    def tree() -> pa.RecordBatch:
        packed = Tree.build(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([widened(h[2], width) for h in held])).row()
        return pa.RecordBatch.from_arrays([pa.array([packed[0]], pa.int32()), *(pa.array([b], pa.binary()) for b in packed[1:])], names=["dim", "ids", "labels", "vectors", "spans", "centres", "radii"])

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, 1024)
            at += some.num_rows
            held.append((some.column(0).to_numpy(), some.column(1).to_numpy(), matrix(some.column(2))))
            rows, width = rows + some.num_rows, max(width, held[-1][2].shape[1])
            if rows * max(width, 1) * 4 >= TREE_BYTES:
                yield tree()
                held, rows, width = [], 0, 0
    if held:
        yield tree()


def ball_trees(rows: DataFrame) -> DataFrame:
    """One row a tree of the scaled rows, written to the shared folder."""
    return materialise(rows.mapInArrow(_pack, TREE), "ball-trees")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors, by floating point where that is exact."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dim, 1) < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


@dataclass
class Windows:
    """What a block looks for. Without positives: of each anchor the best rows of its label. With them: of each positive
    the best rows of other labels between low and high."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    owner: np.ndarray  # of each window: its anchor's place, in ascending order
    slot: np.ndarray
    positive: np.ndarray
    score: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    top: int
    start: np.ndarray  # a lower bound of each window's last score

    @classmethod
    def of_anchors(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, top: int) -> Windows:
        n, zero = len(ids), np.zeros(len(ids), np.int64)
        return cls(ids, labels, vectors, np.arange(n), zero, zero, zero, np.full(n, NONE), np.full(n, -NONE), True, top, np.full(n, NONE)).started()

    def of_positives(self, owner: np.ndarray, slot: np.ndarray, positive: np.ndarray, score: np.ndarray, low: int, high: int, top: int) -> Windows:
        order = np.lexsort((slot, owner))
        owner, slot, positive, score = (x[order] for x in (owner, slot, positive, score))
        return Windows(self.ids, self.labels, self.vectors, owner, slot, positive, score, -(-low * score // 100), high * score // 100, False, top, np.full(len(owner), NONE)).started()

    def fits(self, scores: np.ndarray, w: np.ndarray, ids: np.ndarray, labels: np.ndarray, least: np.ndarray) -> np.ndarray:
        a = self.owner[w]
        right = (labels == self.labels[a][:, None]) if self.same else (labels != self.labels[a][:, None])
        return right & (ids != self.ids[a][:, None]) & (scores >= np.maximum(self.low[w], least)[:, None]) & (scores <= self.high[w][:, None])

    def started(self) -> Windows:
        few = min(STRIDE, len(self.ids))
        for at in range(0, len(self.owner) if few > self.top else 0, 1024):
            w = np.arange(at, min(at + 1024, len(self.owner)))
            scores = products(self.vectors[self.owner[w]], self.vectors[:few])
            found = np.where(self.fits(scores, w, self.ids[:few], self.labels[:few], self.start[w]), scores, NONE)
            self.start[w] = np.partition(found, few - self.top, axis=1)[:, few - self.top]
        return self


class Search:
    """The best rows of a task's trees for every window of a block."""

    def __init__(self, windows: Windows):
        self.windows = windows
        shape = (len(windows.owner), windows.top)
        self.scores, self.ids, self.least = np.full(shape, NONE), np.full(shape, -NONE), windows.start.copy()
        self.visited = 0

    def add(self, tree: Tree) -> None:
        q = self.windows
        for first in range(0, len(q.ids), STRIDE):
            w = np.arange(np.searchsorted(q.owner, first), np.searchsorted(q.owner, first + STRIDE))
            if len(w):
                self._descend(tree, first, w)

    def _descend(self, tree: Tree, first: int, all_windows: np.ndarray) -> None:
        q = self.windows
        anchors = widened(q.vectors[first : first + STRIDE], tree.vectors.shape[1]).astype(np.float64)
        middle, reach = anchors @ tree.centres.T, np.linalg.norm(anchors, axis=1)[:, None] * tree.radii
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-3  # of rounding; scores are whole
        upper, lower = middle + reach + slack, middle - reach - slack
        stack = [(0, all_windows)]
        while stack:
            node, w = stack.pop()
            begin, end, child, least_label, most_label = tree.spans[node]
            own = q.owner[w]
            label = q.labels[own]
            labels = (label >= least_label) & (label <= most_label) if q.same else (label != least_label) | (label != most_label)
            w = w[labels & (upper[own - first, node] >= np.maximum(self.least[w], q.low[w])) & (lower[own - first, node] <= q.high[w])]
            if not len(w):
                continue
            if child:
                stack += [(child + 1, w), (child, w)] if upper[q.owner[w] - first, child].sum() >= upper[q.owner[w] - first, child + 1].sum() else [(child, w), (child + 1, w)]
            else:
                self._leaf(tree, begin, end, w)

    def _leaf(self, tree: Tree, begin: int, end: int, w: np.ndarray) -> None:
        q = self.windows
        self.visited += len(w)
        some, back = np.unique(q.owner[w], return_inverse=True)
        scores = products(q.vectors[some], tree.vectors[begin:end])[back]
        at, row = np.nonzero(q.fits(scores, w, tree.ids[begin:end], tree.labels[begin:end], self.least[w]))
        if not len(at):
            return
        touched = np.unique(w[at])
        owner = np.concatenate([w[at], np.repeat(touched, q.top)])
        score = np.concatenate([scores[at, row], self.scores[touched].ravel()])
        ids = np.concatenate([tree.ids[begin:end][row], self.ids[touched].ravel()])
        order = np.lexsort((ids, -score, owner))
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        order, owner, place = order[place < q.top], owner[place < q.top], place[place < q.top]
        self.scores[owner, place], self.ids[owner, place] = score[order], ids[order]
        self.least[touched] = np.maximum(self.least[touched], self.scores[touched, -1])

    def found(self) -> pa.RecordBatch:
        q = self.windows
        w, place = np.nonzero(self.scores != NONE)
        columns = (q.owner[w].astype(np.int32), q.slot[w].astype(np.int32), q.ids[q.owner[w]], q.positive[w], q.score[w], self.scores[w, place], self.ids[w, place])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "slot", "anchor_id", "positive_id", "positive_score", "score", "id"])


def search(trees: DataFrame, windows: Windows) -> DataFrame:
    """The best rows over all trees, numbered from 1 in each window."""
    shared = trees.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Search(shared.value)
        for batch in batches:
            for at in range(batch.num_rows):
                task.add(Tree.read(*(c[at].as_py() for c in batch.columns)))
        yield task.found()

    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    return trees.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= windows.top)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = TOP, negatives: int = TOP, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); vectors as scaled_rows gives them,
    is_anchor over their columns. Blocks are written one by one, nothing but one block passes the driver."""
    spark = vectors.sparkSession
    trees = ball_trees(vectors)
    chosen = materialise(vectors.where(is_anchor).distinct(), "anchors")
    width = max(64, chosen.agg(F.max(F.size("v"))).first()[0] or 0)
    blocks = -(-chosen.count() // max(1, block * 64 // width))
    dealt, out = shared_path(spark, "anchor-blocks"), shared_path(spark, "hard-negatives")
    chosen.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(max(1, blocks))).cast("int")).repartition("block").write.partitionBy("block").parquet(dealt)
    for at in range(blocks):
        own = spark.read.schema("vec_id bigint, label bigint, v array<int>, block int").parquet(dealt).where(F.col("block") == at).orderBy("vec_id").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        ids, labels, rows = (own.column(name).chunk(0) for name in ("vec_id", "label", "v"))
        anchors = Windows.of_anchors(ids.to_numpy(), labels.to_numpy(), matrix(rows), positives)
        near = search(trees, anchors).select("anchor", "rank", "id", "score").toArrow().to_pydict()
        windows = anchors.of_positives(*(np.array(near[name], np.int64) for name in ("anchor", "rank", "id", "score")), low, high, negatives)
        search(trees, windows).selectExpr("anchor_id", "positive_id", "rank", "id AS negative_id", "positive_score", "score AS negative_score").write.parquet(f"{out}/block={at}")
    return spark.read.schema(RESULT).parquet(out).drop("block") if blocks else spark.createDataFrame([], RESULT)


ORACLE_SQL = """
WITH parts AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM parts a JOIN parts b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank, n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
