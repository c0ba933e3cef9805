import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import ctw_lm, language_id, quality_nbsvm
from quillmesh.llm.common import remainder, table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SMALL, "documents")


def test_remainder_is_crc32_of_the_id_as_text(spark):
    rows = spark.range(50).select("id", remainder("id", 7).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 7 for r in rows)


def test_op1_tells_held_out_quality(spark, docs):
    labels = table(spark, SMALL, "labels")
    model = quality_nbsvm.train(docs, labels.where(remainder("doc_id", 3) != 1))
    scored = quality_nbsvm.score(docs, model).join(labels.where(remainder("doc_id", 3) == 1), "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in scored]) > 0.9


def test_op1_on_odd_rows_and_without_labels(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 0), (8, 1), (8, 0), (None, 1), (4, 7)], "doc_id bigint, quality int")
    model = quality_nbsvm.train(odd, labels)
    rows = quality_nbsvm.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    none = quality_nbsvm.train(empty, labels.where("false"))
    assert [r.score for r in quality_nbsvm.score(odd.limit(1), none).collect()] == [0.5] and quality_nbsvm.score(empty, none).count() == 0


def test_descent_separates():
    rows = [np.array([i % 2, 2]) for i in range(40)]
    signs = np.array([1.0 if i % 2 else -1.0 for i in range(40)])
    weights, bias = quality_nbsvm.descend(rows, [np.ones(2)] * 40, signs, np.ones(40))
    assert all(s * (weights[at].sum() + bias) > 0.9 for at, s in zip(rows, signs, strict=True))


def brute_probability(word, chances):
    """Sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    return sum(chances.get(word[:k], 0.0) * brute_probability(word[k:], chances) for k in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    path = language_id.vocabulary_path(language_id.PIECES_FILE)
    numbers = language_id.pieces(path)
    rng = np.random.default_rng(0)
    chances = rng.random((len(numbers) + 1, 2)) / 1e3
    words = ["the", "nation", "été", "q", "字"]
    model = language_id.Model(path, ["a", "b"], np.zeros(2), chances)
    scores = model.word_scores(words)
    for at, word in enumerate(words):
        marked = language_id.BEGIN + word
        for lang in range(2):
            held = {p: chances[i, lang] for p, i in numbers.items()}
            held |= {c: chances[0, lang] for c in marked if c not in numbers}
            assert math.isclose(scores[at, lang], math.log(brute_probability(marked, held)), rel_tol=1e-9)


def segmentations(word, chances):
    """(pieces, probability) of every segmentation."""
    if not word:
        yield [], 1.0
    for k in range(1, len(word) + 1):
        if word[:k] in chances:
            for rest, p in segmentations(word[k:], chances):
                yield [word[:k], *rest], chances[word[:k]] * p


def test_expected_uses_equal_brute_force():
    """Also of words long enough to be rescaled several times, and with letters outside the vocabulary."""
    path = language_id.vocabulary_path(language_id.PIECES_FILE)
    numbers = language_id.pieces(path)
    rng = np.random.default_rng(1)
    chances = rng.random((len(numbers) + 1, 2)) / 1e3
    chances[0] = 1e-9
    words = ["the", "nation", "été", "q", "字字", "internationales", "q"]
    weights, langs = np.array([3.0, 1, 2, 5, 1, 2, 7]), np.array([0, 1, 0, 1, 0, 1, 0])
    got = language_id.expected_uses(words, weights, langs, language_id.filled(chances), language_id.piece_table(path))
    want = np.zeros_like(chances)
    for word, weight, lang in zip(words, weights, langs, strict=True):
        marked = language_id.BEGIN + word
        held = {p: chances[i, lang] for p, i in numbers.items()} | {c: chances[0, lang] for c in marked if c not in numbers}
        found = list(segmentations(marked, held))
        total = sum(p for _, p in found)
        for pieces, p in found:
            for piece in pieces:
                want[numbers.get(piece, 0), lang] += weight * p / total
    assert np.allclose(got[: len(chances)], want, rtol=1e-8, atol=1e-12)


def test_long_words_of_unknown_letters_have_finite_scores():
    """As after training on 1e14 pieces: the unknown piece has 1e-15, and words have up to 500 letters."""
    path = language_id.vocabulary_path(language_id.PIECES_FILE)
    chances = np.full((len(language_id.pieces(path)) + 1, 2), 0.1 / 1e14)
    chances[language_id.pieces(path)["the"], 0] = 1.0
    model = language_id.Model(path, ["a", "b"], np.log([0.5, 0.5]), chances)
    texts = ["字" * 500, "ꦲ" * 40, "the" * 160 + "字", "x" * 499, "the 字字字"]
    rows = list(language_id.predict_rows(model, iter(enumerate(texts))))
    assert all(0 <= score <= 1 and lang in "ab" for _, lang, score in rows)
    assert rows[2][1:] == ("a", 1.0)
    assert rows[4][1] == "a" and math.isclose(rows[4][2], 2 / 3, rel_tol=1e-4)  # in b "▁the" is as likely, but not "▁" and "the"
    one, many = model.word_scores(["字" * 250])[0], model.word_scores(["字" * 500])[0]
    assert np.isfinite(many).all() and (many < one).all()


def test_op2_predicts_held_out_languages(spark, docs):
    model = language_id.train(docs.where(remainder("doc_id", 5) != 0))
    rows = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(remainder("doc_id", 5) == 0).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_op2_on_odd_rows(odd, empty):
    rows = language_id.predict(odd, language_id.train(odd)).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {"und"} and {r.score for r in rows if r.doc_id in (2, 3, 4)} == {0.0}
    nothing = language_id.train(empty)
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"} and language_id.predict(empty, nothing).count() == 0


def test_log_gamma():
    x = np.array([0.5, 1.0, 3.0, 7.9, 8.0, 1000.5, 1e9])
    assert np.allclose(ctw_lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


def kt(zeros, ones):
    p, a, b = 1.0, 0, 0
    for bit in [0] * zeros + [1] * ones:
        p *= ((b if bit else a) + 0.5) / (a + b + 1)
        a, b = a + (bit == 0), b + (bit == 1)
    return p


def test_kt_block_probability():
    for zeros, ones in ((0, 0), (3, 0), (2, 5), (7, 7)):
        assert math.isclose(math.exp(ctw_lm.log_kt(np.array([[float(zeros)]]), np.array([[float(ones)]]))[0, 0]), kt(zeros, ones), rel_tol=1e-9)


def test_two_level_tree_is_weighted_as_by_hand():
    """Symbols a and b differ in the last two bits only; contexts of depth 1 split their counts."""
    def counts(a, b):
        return np.bincount([97] * a + [98] * b, minlength=256)[None].astype(float)

    none = (np.zeros(0, np.int64), np.zeros((0, 256)))
    tree = ctw_lm.Tree([(np.zeros(1, np.int64), counts(6, 4)), (np.array([97, 98]), np.concatenate([counts(5, 1), counts(1, 3)]))] + [none] * (ctw_lm.DEPTH - 1))
    assert np.allclose(np.power(10.0, tree.log_p[:, tree.columns].astype(float)).sum(axis=1), 1, atol=1e-5)
    # The decision at bit 1 of 97 = ..01, 98 = ..10: a is 0, b is 1 there.
    root, inner = kt(6, 4), (0.5 * kt(5, 1) + 0.5 * kt(5, 1)) * (0.5 * kt(1, 3) + 0.5 * kt(1, 3))
    keep = 0.5 * root / (0.5 * root + 0.5 * inner)
    own, child = 6.5 / 11, 5.5 / 7
    wanted = keep * own + (1 - keep) * child
    bits = [(97 >> (7 - i)) & 1 for i in range(8)]
    got = 10 ** float(tree.log_p[tree.child[0, tree.columns[97]], tree.columns[97]])
    others = 1.0
    for level in (0, 1, 2, 3, 4, 5, 7):  # decisions that are certain in training
        total = (6 if level == 7 else 10, 5 if level == 7 else 6, 1 if level == 7 else 4)
        r, i = kt(total[0], 0), kt(total[1], 0) * kt(total[2], 0)
        k = r / (r + i)
        others *= k * (total[0] + 0.5) / (total[0] + 1) + (1 - k) * (total[1] + 0.5) / (total[1] + 1)
    assert bits[6] == 0 and math.isclose(got, wanted * others, rel_tol=2e-3)


def test_op6_base_is_exact_and_the_model_learns(spark, docs):
    trained = ctw_lm.train(docs.where(remainder("doc_id", 7) != 2))
    rows = {r.doc_id: r for r in ctw_lm.score(docs, trained).collect()}
    words = {r.doc_id: [*r.text.encode().lower().split(), None] for r in docs.collect()}
    counts = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total, types = sum(counts.values()), len(counts)
    for i, ws in words.items():
        assert rows[i].n_tokens == len(ws) and rows[i].n_known == sum(counts[w] > 0 for w in ws) and rows[i].train_tokens == total
        assert math.isclose(rows[i].base_score, sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in ws), abs_tol=1e-6)
    assert sum(r.score for r in rows.values()) > -sum(r.n_bytes for r in rows.values()) * math.log10(2) * 3.5


def test_op6_keeps_contexts_however_rare(spark):
    """Contexts that are rarer than one in 2^17 bytes count as much as in a tree that is held whole."""
    random = np.random.default_rng(6)
    words = ["".join(chr(97 + c) for c in random.integers(0, 26, n)) for n in random.integers(2, 9, 800)]
    texts = [" ".join(words[w] for w in random.integers(0, len(words), 300)) for _ in range(130)]
    train, others = texts[:120], [*texts[115:], "", "unseen Zebra \u00fc\u4e2d", words[0]]
    grams = ctw_lm.Bytes([t.encode() for t in train]).grams()
    assert len(grams) > 2**17
    orders = []
    for d in range(ctw_lm.DEPTH + 1):
        contexts, place = np.unique(grams >> 8 * (ctw_lm.DEPTH + 1 - d), return_inverse=True)
        counts = np.zeros((len(contexts), 256), np.float32)
        np.add.at(counts, (place, grams & 255), 1)
        orders.append((contexts, counts))
    frame = lambda some: spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string").repartition(3)
    rows = {r.doc_id: r.score for r in ctw_lm.score(frame(others), ctw_lm.train(frame(train))).collect()}
    # The tree's columns are of bytes seen in training or alike, so it knows every byte's probability.
    want = ctw_lm.Tree(orders).log10_of([t.lower().encode() for t in others])
    assert np.allclose([rows[i] for i in range(len(others))], want, rtol=1e-5)


def test_op6_on_odd_rows(odd, empty):
    rows = ctw_lm.score(odd, ctw_lm.train(odd)).collect()
    assert len(rows) == odd.count() and all(r.score < 0 and r.n_tokens >= 1 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    nothing = ctw_lm.score(odd, ctw_lm.train(empty)).collect()
    assert {(r.n_known, r.train_tokens) for r in nothing} == {(0, 0)} and all(abs(r.base_score) < 1e-9 for r in nothing)
    assert ctw_lm.score(empty, ctw_lm.train(empty)).count() == 0
