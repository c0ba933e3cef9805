"""Operators 11 to 13 against brute-force versions, and their defined cases."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import filter_audit, hard_negatives, pareto_mix
from quillmesh.llm.common import table

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, label int, embedding array<float>"


def brute_negatives(rows, anchors, positives=5, negatives=5):
    """rows: (id, label, whole vector)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, label, v in sorted(set(r for r in rows if anchors(r[0]))):
        scored = sorted((-dot(v, w), i, other) for i, other, w in rows if i != a)
        near = [(-s, i) for s, i, other in scored if other == label][:positives]
        for score, p in near:
            fitting = [(-s, i) for s, i, other in scored if other != label and 80 * score <= -100 * s <= 100 * score]
            out += [(a, p, rank, n, score, s) for rank, (s, n) in enumerate(fitting[:negatives], 1)]
    return Counter(out)


def mined(spark, rows, anchors, **options):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    return Counter(tuple(r) for r in hard_negatives.mine(hard_negatives.scaled_rows(df), anchors, **options).collect())


@pytest.mark.parametrize("block, leaf, stride", [(32_768, 4, 2048), (3, 2, 2)])
def test_negatives_equal_brute_force_with_ties(spark, monkeypatch, block, leaf, stride):
    for name, value in (("LEAF", leaf), ("STRIDE", stride), ("TREE_BYTES", 2000)):
        monkeypatch.setattr(hard_negatives, name, value)
    random.seed(block)
    rows = [(i, random.randrange(4), [random.choice((-0.02, 0.0, 0.01, 0.05, 0.3, 0.31)) for _ in range(6)]) for i in range(400)]
    whole = [(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, label, v in rows]
    want = brute_negatives(whole, lambda i: i % 20 == 0)
    assert mined(spark, rows, F.col("vec_id") % 20 == 0, block=block) == want and len(want) > 100


def test_trees_prune_and_bound():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 400
    labels = rng.integers(0, 3, 4000)
    vectors = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 3).astype(np.int32)
    tree = hard_negatives.Tree.read(*hard_negatives.Tree.build(np.arange(4000), labels, vectors).row())
    for (first, last, _, low, high), centre, radius in zip(tree.spans, tree.centres, tree.radii):
        assert np.linalg.norm(tree.vectors[first:last] - centre, axis=1).max() <= radius + 1e-6
        assert (tree.labels[first:last].min(), tree.labels[first:last].max()) == (low, high)
    search = hard_negatives.Search(hard_negatives.Windows.of_anchors(np.arange(50), labels[:50], vectors[:50], 5))
    search.add(tree)
    leaves = int((tree.spans[:, 2] == 0).sum())
    assert search.visited < 0.25 * leaves * 50  # most leaves are pruned
    scores = vectors[:50].astype(np.int64) @ vectors.T.astype(np.int64)
    for a in range(50):
        fitting = sorted(((-scores[a, i], i) for i in range(4000) if labels[i] == labels[a] and i != a))[:5]
        assert fitting == [(-s, i) for s, i in zip(search.scores[a], search.ids[a])]


def test_negatives_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (1, 1, [1.0]), (2, 1, []), (3, 2, [0.9, 2.0]), (3, 2, [0.9, 2.0]), (4, 2, [1.0, 0.0]), (5, None, [1.0, 1.0]), (6, 2, None), (7, 2, [1.0, None]), (8, 2, [1.0, nan]), (9, 2, [inf, 1.0]), (None, 2, [1.0, 1.0]), (10, 1, [-1.0, -1.0]), (11, 1, [1e30, 0.0]), (12, 2, [1e30, 0.0])]
    pad = lambda v: tuple(min(max(math.floor(256 * float(np.float32(x))), -(1 << 24)), 1 << 24) for x in v)
    whole = [(i, label, pad(v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clashing = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], VECTORS + ", rank int, score int, v string")
    got = Counter(tuple(r) for r in hard_negatives.mine(hard_negatives.scaled_rows(clashing), F.col("vec_id") % 2 == 0).collect())
    assert got == brute_negatives(whole, lambda i: i % 2 == 0) and any(k[0] == 0 for k in got)
    assert mined(spark, [], F.col("vec_id") == 0) == Counter()
    assert mined(spark, [(1, 1, [1.0])], F.col("vec_id") == 0) == Counter()


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, free, rest = {}, set(names), sum(sizes.values())
    while free:
        share = {n: rest * weight[n] / sum(weight[m] for m in free) for n in free}
        over = {n for n in free if share[n] > 3 * sizes[n]}
        if not over:
            return target | share
        for n in over:
            target[n] = 3 * sizes[n]
            rest -= target[n]
        free -= over
    return target


@pytest.mark.parametrize("emphasis", [0.0, pareto_mix.EMPHASIS])
def test_mix_meets_targets(spark, emphasis):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = pareto_mix.mix(docs, emphasis=emphasis).collect()
    again = pareto_mix.mix(docs.repartition(7, "text"), emphasis=emphasis).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    texts = {r.doc_id: (r.source, len((r.text or "").encode().split())) for r in docs.collect()}
    sizes = Counter()
    for source, size in texts.values():
        sizes[source] += size
    want = brute_targets(sizes)
    by_source = {}
    for r in rows:
        assert (r.source, r.size) == texts[r.doc_id] and r.taken == r.copies * r.size <= 3 * r.size
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        by_source.setdefault(r.source, []).append(r)
    for source, own in by_source.items():
        taken, whole = sum(r.taken for r in own), int(want[source] // sizes[source])
        left = [r.size for r in own if r.copies == whole and r.size]
        assert want[source] - taken < min(left, default=1) and taken <= want[source] + 1e-6  # no document is left that would fit
        assert {r.copies for r in own} <= {whole, whole + 1} or not all(r.size for r in own)


def test_mix_prefers_long_documents_as_far_as_asked(spark):
    """Pareto sampling over many sources: inclusion rates follow min(1, scale x size^emphasis)."""
    rows = [(i, f"s{i % 3}", "w " * (1 + 255 * (i // 3 % 2))) for i in range(12_000)]
    docs = spark.createDataFrame([(i, t, s) for i, s, t in rows], "doc_id bigint, text string, source string")
    taken = pareto_mix.mix(docs, weights=(5, 2, 1)).where("source = 's2'").collect()
    rates = {size: np.mean([r.copies for r in taken if r.size == size]) for size in (1, 256)}
    assert rates[256] / rates[1] == pytest.approx(4, rel=0.15)  # 256 ** 0.25


def test_mix_of_odd_rows(spark, odd, empty):
    rows = pareto_mix.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 3 * r.size for r in rows)
    assert {r.taken for r in rows if r.doc_id in (2, 3)} == {0}
    assert pareto_mix.mix(empty).count() == 0
    same = spark.createDataFrame([(1, "a b c", "x")] * 9000 + [(None, None, None)] * 50 + [(None, "q", "y")] * 300, "doc_id bigint, text string, source string")
    mixed = pareto_mix.mix(same, weights=(1, 9))
    sums = {r.source: (r.n, r.target, r.taken) for r in mixed.groupBy("source").agg(F.count("*").alias("n"), F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert sums["x"][0] == 9000 and sums["x"][1] - sums["x"][2] < 3 and sums["y"][1:] == (900.0, 900)
    out = pareto_mix.mixed_rows(odd, pareto_mix.mix(odd))
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in rows)


def brute_audit(docs, labels):
    """docs: (id, lang, text); runs every order filter by filter."""
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails, words = [], lambda t: t.encode().split()
    for i, _, text in docs:
        t = text or ""
        w = words(t)
        own = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        fails.append({k for k, v in own.items() if v})
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {lang or "" for _, lang, _ in docs}:
        own = [k for k, d in enumerate(docs) if (d[1] or "") == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                removed = [k for k in left if f in fails[k]]
                left = [k for k in left if f not in fails[k]]
                shapley[f] += len(removed)
                failing = sum(f in fails[k] for k in own)
                out[part, "".join(order), step] = [len(left), len(removed), failing - len(removed), sum(fails[k] == {f} for k in own), sum(docs[k][0] in good for k in removed), sum(docs[k][0] in toxic for k in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): list(r[3:]) for r in filter_audit.audit(docs, labels).collect()}


def test_audit_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD", 2000)  # texts go on several times within a task
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    odd = [(None, "en", "copy " * 120), (500_001, None, "copy " * 120), (500_001, "en", "copy " * 120), (500_002, "", "copy " * 120), (500_003, "fr", None), (500_004, "fr", ""), (500_005, "fr", "AB #x " * 30_000), (1, "en", "again")]
    more = docs.select("doc_id", "lang", "text").unionByName(spark.createDataFrame(odd * 2, "doc_id bigint, lang string, text string")).repartition(5)
    more_labels = labels.select("doc_id", "quality", "toxic").unionByName(spark.createDataFrame([(500_002, 1, None), (500_002, None, 1), (None, 1, 1), (1, 1, 1), (1, 0, 0)], "doc_id bigint, quality int, toxic int"))
    rows = [tuple(r) for r in more.collect()]
    want = brute_audit(rows, [tuple(r) for r in more_labels.collect()])
    assert audited(more, more_labels) == want and ("", "ABCDE", 1) in want
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    assert {r.doc_id for r in filter_audit.copy_ids(more).collect()} == {i for i, _, t in rows if i is not None and least[t or ""] < i}


def test_chains_keep_texts_of_one_fingerprint_apart():
    records = [(7, (b"one", 1, 5, {"a": 1})), (7, (b"two", 1, 4, {"a": 1})), (7, (b"one", 1, 3, {"b": 2})), (8, (None, 9, "c", 1, 0))]
    assert sorted(filter_audit._settle(iter(records))) == [(3, "b", 2, 1), (4, "a", 1, 1), (5, "a", 1, 1 | filter_audit.COPY), (9, "c", 1, 0)]


def test_audit_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audited(odd, labels) == brute_audit([(r.doc_id, r.lang, r.text) for r in odd.collect()], [])
    assert audited(empty, labels) == {}
