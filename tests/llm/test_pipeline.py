import numpy as np

import corpus_pipeline
from quillmesh.llm import language_id, lsa_decontaminate, quality_nbsvm, simhash_ball, tiktoken_codec
from quillmesh.llm.common import table

SMALL = "/root/testdata/sf0.001"


def linked(pairs, nodes):
    """Smallest member of each node's component, by brute force."""
    name = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(name[a], name[b])
            changed |= name[a] != least or name[b] != least
            name[a] = name[b] = least
    return name


def test_stages_keep_columns_and_take_effect(spark):
    """Each stage against the operator's decisions taken row by row."""
    docs = table(spark, SMALL, "documents")
    kept = docs
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, SMALL)
        names.append(name)
        assert kept.columns == docs.columns
        after = {r.doc_id for r in kept.collect()}
        frame = docs.where(docs.doc_id.isin(list(before)))
        if name == "quality":
            model = quality_nbsvm.train(frame, table(spark, SMALL, "labels"))
            features = quality_nbsvm.Features()
            want = {i for i, t in before.items() if model.score(features(t)) >= 0.5}
        elif name == "language":
            model = language_id.train(frame)
            want = {i for (i, lang, score) in language_id.predict_rows(model, iter(before.items())) if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE}
        elif name == "near_dedup":
            prints = {i: simhash_ball.fingerprint(t) for i, t in before.items()}
            sets = {i: set(simhash_ball.shingle_set(t)[1].tolist()) for i, t in before.items()}
            alike = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2 or sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            name_of = linked([(i, j) for i in before for j in before if i < j and alike(i, j)], before)
            want = {i for i, n in name_of.items() if n == i}
            assert any((prints[i] ^ prints[j]).bit_count() > 2 for i, j in name_of.items())
        else:
            block = next(lsa_decontaminate.blocks(frame, table(spark, SMALL, "benchmark")))
            want = {i for i, t in before.items() if not block.matches(t)}
        assert after == want
        kept = docs.where(docs.doc_id.isin(list(after)))
    assert names == ["quality", "language", "near_dedup", "decontaminate"]


def test_odd_rows_pass_every_stage(spark, odd, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (8, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such passage anywhere in here at all")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for source in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, source, str(tmp_path))
            rows = out.collect()
            assert len(rows) <= source.count()
            if name == "near_dedup" and rows:
                assert [r.doc_id for r in rows].count(1) == 1 and any(r.doc_id is None for r in rows)
            if name == "encode":
                assert len(rows) == source.count() and "ids" in out.columns
            else:
                assert out.columns == source.columns


def test_run_gives_ids_of_what_was_kept(spark):
    out = corpus_pipeline.run(spark, SMALL)
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    codec = tiktoken_codec.Codec(tiktoken_codec.vocabulary_path(tiktoken_codec.RANKS_FILE))
    rows = out.collect()
    assert 0 < len(rows) < len(texts)
    assert all(list(r.ids) == codec.encode(texts[r.doc_id]) and codec.decode(list(r.ids)) == texts[r.doc_id].encode() for r in rows)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    """Different texts without an id, or under one id, all stay; a copy without an id goes."""
    texts = [" ".join(f"{name}{i}" for i in range(60)) for name in "abcdef"]
    rows = [(1, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (2, texts[3]), (2, texts[4]), (3, texts[4]), (4, texts[5])]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SMALL)
    wanted = [(1, texts[0]), (None, texts[1]), (None, texts[2]), (2, texts[3]), (2, texts[4]), (4, texts[5])]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, wanted))


def test_near_dedup_finds_copies_with_small_edits(spark):
    """Three of 200 words changed leave a five-word similarity of 0.86; twelve leave 0.54."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(30):
        words = [f"w{j}" for j in rng.integers(0, 5000, 200)]
        few, many = list(words), list(words)
        for n, at in enumerate((30, 90, 150)):
            few[at] = f"few{n}"
        for n in range(12):
            many[10 + 15 * n] = f"many{n}"
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(few)), (3 * i + 2, " ".join(many))]
    texts = dict(rows)
    assert any((simhash_ball.fingerprint(texts[3 * i]) ^ simhash_ball.fingerprint(texts[3 * i + 1])).bit_count() > 2 for i in range(30))
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SMALL)
    assert {r.doc_id for r in out.collect()} == {i for i in texts if i % 3 != 1}
    assert simhash_ball.similarity(texts[0], texts[1]) >= 0.8 > simhash_ball.similarity(texts[0], texts[2])


def test_near_dedup_finds_pairs_in_bands_that_many_texts_share(spark, monkeypatch):
    """Texts of one common passage and words of their own share bands but no group; among them are three similar pairs."""
    monkeypatch.setattr(simhash_ball, "LAGS", 1)
    monkeypatch.setattr(simhash_ball, "TEXTS_PER_SALT", 7)
    rng = np.random.default_rng(12)
    common = " ".join(f"common{j}" for j in range(150))
    rows = [(i, f"{common} " + " ".join(f"own{j}" for j in rng.integers(0, 100_000, 60))) for i in range(80)]
    rows += [(100 + i, rows[20 * i][1].replace("common75 ", "changed ") + " more") for i in range(3)]
    texts = dict(rows)
    pairs = {(i, j) for i in texts for j in texts if i < j and simhash_ball.similarity(texts[i], texts[j]) >= 0.8}
    assert pairs == {(20 * i, 100 + i) for i in range(3)}
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SMALL)
    close = {(i, j) for i in texts for j in texts if i < j and (simhash_ball.fingerprint(texts[i]) ^ simhash_ball.fingerprint(texts[j])).bit_count() <= 2}
    name = linked([*pairs, *close], texts)
    assert {r.doc_id for r in out.collect()} == {i for i, n in name.items() if i == n}


def test_sketches_tell_how_many_least_hashes_differ(spark):
    """About three quarters of the share of shingles not common: two bits of different hashes are equal in a quarter."""
    words = [f"word{i}" for i in range(400)]
    changed = [" ".join([*words[:n], *(f"other{i}" for i in range(400 - n))]) for n in (400, 380, 300, 0)]
    sketches = [simhash_ball.min_hashes(text)[2] for text in changed]
    assert all(len(s) == 2 * simhash_ball.SKETCH for s in sketches) and simhash_ball.min_hashes(None)[2] == []
    rows = spark.createDataFrame([(sketches[0], s) for s in sketches], "one array<bigint>, other array<bigint>")
    got = [r.unlike for r in rows.select(simhash_ball._unlike("one", "other").alias("unlike")).collect()]
    bits = [[f"{v & (1 << 64) - 1:064b}" for v in s] for s in sketches]
    low, high = ["".join(b[: simhash_ball.SKETCH]) for b in bits], ["".join(b[simhash_ball.SKETCH :]) for b in bits]
    assert got == [sum(a != b for a, b in zip(zip(low[0], high[0]), zip(low[i], high[i]), strict=True)) for i in range(4)]
    n = simhash_ball.BANDS * simhash_ball.BAND_ROWS
    for text, found in zip(changed, got, strict=True):
        assert abs(found - 0.75 * n * (1 - simhash_ball.similarity(changed[0], text))) < 25
