"""Models and fingerprints against slow versions written from their definitions."""

import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from quillmesh.llm import language_id, lsa_decontaminate, quality_nbsvm, repair_shards, simhash_ball, url_rules, wav_landmarks


def test_descent_reaches_the_dual_s_optimum():
    rng = np.random.default_rng(4)
    dense = rng.normal(size=(14, 6))
    signs = np.where(rng.random(14) < 0.5, 1.0, -1.0)
    costs = rng.uniform(0.2, 1.5, 14)
    weights, bias = quality_nbsvm.descend([np.arange(6)] * 14, list(dense), signs, costs, epochs=3000)
    with_bias = np.hstack([dense, np.ones((14, 1))]) * signs[:, None]
    kernel, alpha = with_bias @ with_bias.T, np.zeros(14)
    for _ in range(60_000):  # projected gradient on the same dual
        alpha = np.clip(alpha + 0.5 / np.linalg.eigvalsh(kernel)[-1] * (1 - kernel @ alpha), 0, costs)
    want = alpha @ with_bias
    assert np.allclose([*weights[:6], bias], want, atol=2e-4)
    slack = np.maximum(0, 1 - with_bias @ want)
    assert math.isclose(0.5 * want @ want + costs @ slack, alpha.sum() - 0.5 * want @ want, rel_tol=1e-3)  # no gap


def test_ratios_are_smoothed_class_shares():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(40)]
    labels = (rng.random(40) < 0.4).astype(np.int64)
    model = quality_nbsvm.fit(rows, labels, (30, 10))
    held = [[1 + sum(f in row for row, y in zip(rows, labels) if y == c) for f in range(30)] for c in (0, 1)]
    total = [sum(h) + quality_nbsvm.DIMENSIONS - 30 for h in held]
    want = [math.log(held[1][f] / total[1]) - math.log(held[0][f] / total[0]) for f in range(30)]
    assert np.allclose(model.ratios[:30], want, atol=1e-6)
    scores = [model.score(r) for r in rows]
    assert all(0 < s < 1 for s in scores) and np.mean([s for s, y in zip(scores, labels) if y]) > np.mean([s for s, y in zip(scores, labels) if not y])


def test_weights_are_mixed_with_their_mean_size():
    weights, seen = np.array([2.0, 0.0, -1.0, 0.0, 0.0]), np.array([True, True, True, True, False])
    mean = 3 / 4
    share = quality_nbsvm.NAIVE_SHARE
    assert np.allclose(quality_nbsvm.mixed_weights(weights, seen), [(1 - share) * 2 + share * mean, share * mean, -(1 - share) + share * mean, share * mean, 0])


def test_quality_learns_one_row_of_an_id(spark):
    texts = [(i, f"{'good clean text' if i % 2 else 'bad !!! ###'} {i}") for i in range(60)]
    docs = spark.createDataFrame([*texts, *[(1, f"other text {n}") for n in range(300)]], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id bigint, quality int")
    one, again = (quality_nbsvm.train(d, labels) for d in (docs, docs.repartition(5)))
    assert np.array_equal(one.weights, again.weights) and one.bias == again.bias
    kept = {i: t for i, t in texts} | {1: min([texts[1][1], *(f"other text {n}" for n in range(300))], key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])}
    alone = quality_nbsvm.train(spark.createDataFrame(sorted(kept.items()), "doc_id bigint, text string"), labels)
    assert np.allclose(one.weights, alone.weights)


def slow_landmarks(samples):
    """Frame by frame, bin by bin, with a sum for each bin of the transform."""
    size, half = wav_landmarks.UNIT, wav_landmarks.UNIT // 2
    found = []
    for at in range(0, len(samples) - size + 1, half):
        frame = (np.frombuffer(samples[at : at + size], np.uint8).astype(np.float32) - 128) * np.hanning(size).astype(np.float32)
        frame = frame - frame.mean()
        width = half // wav_landmarks.BANDS
        power = [abs(np.sum(frame * np.exp(-2j * np.pi * k * np.arange(size) / size))) for k in range(1, 1 + width * wav_landmarks.BANDS)]
        peaks = []
        for band in range(wav_landmarks.BANDS):
            own = power[band * width : (band + 1) * width]
            best = int(np.argmax(own))
            if own[best] > max(2 * np.mean(own), 1e-3):
                peaks.append(best + 1 + band * width)
        found.append(peaks)
    return sorted(i << 32 | a << 18 | b << 4 | gap for i, first in enumerate(found) for gap in range(wav_landmarks.REACH + 1) if i + gap < len(found) for a in first for b in found[i + gap] if gap or a < b)


def test_landmarks_equal_loops(spark):
    rnd = random.Random(6)
    tone = "".join(chr(40 + int(30 * (1 + math.sin(i / 5)) + 10 * (1 + math.sin(i / 1.7)))) for i in range(3000))
    texts = ["", "short", "".join(rnd.choice("ab cdé") for _ in range(2500)), tone, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in wav_landmarks.media_table(rows).collect()}
    for i, text in enumerate(texts):
        data = wav_landmarks.payload(text)[1]
        assert got[i].landmarks == slow_landmarks(data) and wav_landmarks.from_wav(bytes(got[i].media)) == data
    assert len(got[3].landmarks) > 50
    digests = {r.doc_id: r for r in wav_landmarks.media_digests(rows).collect()}
    assert {i: int(d.feature.split(":")[0]) for i, d in digests.items()} == {i: len(g.landmarks) for i, g in got.items()}


def test_long_words_are_summed_as_short_ones_and_fast(monkeypatch):
    path = str(language_id.vocabulary_path(language_id.PIECES_FILE))
    rng, rnd = np.random.default_rng(0), random.Random(1)
    chances = rng.random((len(language_id.pieces(path)) + 1, 4)) * 1e-4
    words = ["".join(rnd.choice("абвгдheloandthing字") for _ in range(n)) for n in (1, 7, 300, 4500, 5000)]
    model = language_id.Model(path, list("abcd"), np.zeros(4), chances)
    weights, langs = np.arange(1.0, 6), np.arange(5) % 4
    uses = lambda: language_id.expected_uses(words, weights, langs, language_id.filled(chances), language_id.piece_table(path))
    few, few_uses = model.word_scores(words), uses()
    monkeypatch.setattr(language_id, "FEW", 0)
    assert np.allclose(few, model.word_scores(words), rtol=1e-12) and np.allclose(few_uses, uses(), rtol=1e-9)
    monkeypatch.undo()
    begin = time.perf_counter()
    model.word_scores(["字" * 10_000 + "ab" * 5000])
    assert time.perf_counter() - begin < 3


def test_repair_goes_on_beyond_16_bit_symbols():
    rng = np.random.default_rng(8)
    vocabulary = 65_536 - 600  # leaves 600 rules of 16 bits
    phrases = [rng.integers(0, vocabulary, 6) for _ in range(3000)]
    ids = np.concatenate([phrases[i] for i in rng.integers(0, 3000, 60_000)]).astype(np.uint32)
    symbols, offsets, rules = repair_shards.compress(ids, np.array([len(ids)]), vocabulary)
    assert len(rules) > 2000 and symbols.max() >= 1 << 16 and len(symbols) < len(ids) / 4
    shard = repair_shards.Shard(repair_shards.write_shard([1], [ids], vocabulary))
    assert np.array_equal(shard.decode_document(0), ids) and np.array_equal(shard.decode_span(1000, 77), ids[1000:1077])


def test_repair_splits_an_id_that_many_rows_bear(spark, tmp_path):
    docs = spark.createDataFrame([(None if i % 3 else i, f"text {i % 50}") for i in range(6000)], "doc_id bigint, text string").repartition(4)
    path = f"file://{tmp_path}/shards"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would become one partition
    repair_shards.write_shards(docs, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = {r.part: r.n for r in spark.read.parquet(path).groupBy("part").agg(F.sum("documents").alias("n")).collect()}
    assert sum(sizes.values()) == 6000 and max(sizes.values()) < 3000
    rows = repair_shards.read_documents(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows if r.doc_id is not None] == sorted(i for i in range(6000) if not i % 3)


def test_url_rules_nest_by_path(spark):
    rnd = random.Random(5)
    hosts = ["net", "a.net", "b.a.net", "c.b.a.net", "org", "x.org", "y.org", "anet"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/c", "/ab", "/b/", "/é/", "/a/B"]
    rules = [(rnd.choice(hosts[:6]), rnd.choice(paths), rnd.choice(["allow", "block"])) for _ in range(60)] + [("net", None, "block"), (None, "/", "block"), ("NET", "/a", "block")]
    pages = [(i, f"https://{rnd.choice(hosts + ['z.' + h for h in hosts])}{rnd.choice(paths)}{rnd.choice(['', 'tail', '?q=/a', '/b/c/d'])}") for i in range(400)]

    def want(url):
        rest = url.split("://", 1)[1]
        host, _, _ = rest.partition("/")
        host = host.split("?")[0]
        path = rest[len(host) :].split("?")[0]
        fitting = [(len((h + (p or ""))), len(h), h + (p or ""), v) for h, p, v in ((h and h.lower(), p, v) for h, p, v in rules) if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = max(fitting, default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    for salt in (2000, 2):
        url_rules_salt, url_rules.HOSTS_PER_SALT = url_rules.HOSTS_PER_SALT, salt
        rows = url_rules.judge_urls(spark.createDataFrame(pages, "page_id int, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
        url_rules.HOSTS_PER_SALT = url_rules_salt
        assert {r.page_id: tuple(r[1:]) for r in rows} == {i: want(u) for i, u in pages}


def test_near_dedup_takes_columns_of_any_name(spark):
    rows = [(1, "one two three four five six seven", "a", 1, [1]), (2, "one two three four five six seven", "b", 2, [2]), (3, "quite another text that stands alone here", "c", 3, [3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __key string, __row bigint, __bands array<bigint>").selectExpr("*", "1 AS __fp", "2 AS c0", "3 AS __size", "4 AS __sketch")
    kept = simhash_ball.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id <> 2").collect()))


def test_paraphrases_are_found_in_a_truncated_space(spark):
    """More passages than latent dimensions: what the cosine leaves out against checks of every passage in every window."""
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(6000)]
    share = 1 / np.arange(1, 6001) ** 0.8
    share /= share.sum()
    draw = lambda n: [vocabulary[i] for i in rng.choice(6000, n, p=share)]
    passages = {i: draw(int(rng.integers(20, 60))) for i in range(300)}
    docs, planted = {}, set()
    for d in range(60):
        words = draw(int(rng.integers(40, 120)))
        if d < 50:  # a paraphrase: rare words stay, most of the others are replaced
            p = int(rng.integers(0, 300))
            changed = [w if int(w[1:]) > 900 or rng.random() < 0.4 else vocabulary[int(rng.integers(0, 6000))] for w in passages[p]]
            words[20:20] = changed
        docs[d] = words
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in passages.items()], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in lsa_decontaminate.find_leaks(frame, items).collect()}
    block = next(lsa_decontaminate.blocks(frame, items))
    assert block.points.shape[1] == lsa_decontaminate.RANK < len(block.keys)
    for d, words in docs.items():
        for p in range(len(block.keys)):
            size = len(block.words[p])
            for start in range(0, max(1, len(words) - size + 1), max(4, size // 4)):
                common, answers = block.check(p, words, start, min(start + size, len(words)))
                if common >= lsa_decontaminate.COPY or common >= lsa_decontaminate.PARAPHRASE and answers >= lsa_decontaminate.ANSWER:
                    planted.add((d, block.keys[p]))
                    break
    assert len(planted) > 15 and len(found & planted) >= 0.9 * len(planted), (len(found & planted), len(planted))
