import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmesh.llm import prefix_counts, repair_shards, tiktoken_codec, units

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "the", " ", "  ", "\n", "'re", "'", "'ll", "l", "é", "ß", "　", "\x1c", "!!", "12", "<|endoftext|>", "<|", "\U0001f600", "\xa0", "\t", "x" * 30, "字", "²"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_units_give_the_library_s_ids(library):
    encoder = units.UnitEncoder(JSON)
    for text in texts(300, 1):
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_units_of_many_texts_are_told_apart(library):
    """Units that agree in their first bytes, long ones, zero bytes, and a table that is full and starts anew."""
    encoder = units.UnitEncoder(JSON)
    rng = random.Random(4)
    odd_ones = ["a\0", "a", "a\0\0", " \0", "", None, "x" * 17, "x" * 16, "x" * 15, "字" * 6, "\u3000 a", "a \u3000", "  a", "end  ", " a b", "\n", "\n\n a"]
    many = odd_ones + ["".join(rng.choice("ab \n") for _ in range(40)) for _ in range(300)] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    want = [library.encode(text or "", add_special_tokens=False).ids for text in many]
    for limit in (1 << 24, 1):
        units.MOST_VALUES, kept = limit, units.MOST_VALUES
        assert [ids.tolist() for ids in encoder.encode_many(many)] == want == [ids.tolist() for ids in encoder.encode_many(many)]
        units.MOST_VALUES = kept


def test_every_prefix_is_counted_exactly(library):
    counter = prefix_counts.PrefixCounter(JSON)
    for text in texts(150, 2):
        changes = counter.changes(text)
        counts = [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        assert [prefix_counts.count_at(changes, p) for p in range(len(text) + 1)] == counts
        for budget in (0, 1, 3):
            assert prefix_counts.longest_within(changes, budget) == max(p for p, c in enumerate(counts) if c <= budget)


def test_safe_parts_leave_the_ids_as_they_are():
    codec = tiktoken_codec.Codec(RANKS)
    for text in texts(300, 3):
        parts = tiktoken_codec.safe_parts(text, 5)
        assert "".join(parts) == text
        ids = [i for part in parts for i in codec.inner.encode_ordinary(part)]
        assert ids == codec.inner.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_op5_on_odd_rows(odd, empty):
    inner = tiktoken_codec.Codec(RANKS).inner
    rows = tiktoken_codec.round_trip(odd).collect()
    want = {(r.doc_id, r.text) for r in odd.collect()}
    assert len(rows) == odd.count()
    digests = {(i, hashlib.sha256((t or "").encode()).hexdigest(), len(inner.encode_ordinary(t or ""))) for i, t in want}
    assert {(r.doc_id, r.decoded_sha256, r.n_tokens) for r in rows} == digests
    assert tiktoken_codec.round_trip(empty).count() == 0 and tiktoken_codec.encode_documents(empty).count() == 0


def test_op7_on_odd_rows(odd, empty, library):
    rows = prefix_counts.prefix_table(odd).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert prefix_counts.prefix_table(empty).count() == 0


def test_op7_counts_with_other_kinds_of_tokenizer(odd):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    small = odd.where("doc_id IN (1, 8)")
    assert {r.n_tokens for r in prefix_counts.prefix_table(small, model).collect()} == {len(pieces.encode(r.text)) for r in small.collect()}


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    documents = [np.append(rng.integers(1, 40, rng.integers(0, 400)), 0).astype(np.uint32) for _ in range(60)]
    shard = repair_shards.Shard(repair_shards.write_shard(list(range(59)) + [None], documents, 50_257))
    assert shard.keys[-1] is None and len(shard.sizes) > 0
    assert all((a == b).all() for a, b in zip(shard.documents(), documents, strict=True))
    whole = np.concatenate(documents)
    for start, count in ((0, 1), (17, 300), (len(whole) - 3, 3)):
        assert (shard.decode_span(start, count) == whole[start : start + count]).all()
    assert (shard.decode_document(7) == documents[7]).all()


def brute_repair(documents, least):
    """Re-Pair one rule at a time: the size of symbols and rules in numbers."""
    documents = [list(map(int, d)) for d in documents]
    rules = 0
    while True:
        counts = {}
        for d in documents:
            i = 0
            while i + 1 < len(d):
                counts[d[i], d[i + 1]] = counts.get((d[i], d[i + 1]), 0) + 1
                i += 2 if i + 2 < len(d) and d[i] == d[i + 1] == d[i + 2] else 1
        pair = max(counts, key=lambda p: (counts[p], p), default=None)
        if pair is None or counts[pair] < least:
            return sum(map(len, documents)) + 2 * rules
        rules += 1
        for k, d in enumerate(documents):
            out, i = [], 0
            while i < len(d):
                if i + 1 < len(d) and (d[i], d[i + 1]) == pair:
                    out.append(("rule", rules))
                    i += 2
                else:
                    out.append(d[i])
                    i += 1
            documents[k] = [hash(x) if isinstance(x, tuple) else x for x in out]


def test_repair_compresses_about_as_well_as_one_rule_at_a_time():
    rng = np.random.default_rng(2)
    phrases = [rng.integers(1, 200, rng.integers(2, 9)) for _ in range(60)]
    documents = [np.append(np.concatenate([phrases[min(int(k), 59)] for k in rng.geometric(0.08, 40)]), 0).astype(np.uint32) for _ in range(30)]
    symbols, _, rules = repair_shards.compress(np.concatenate(documents), np.cumsum(list(map(len, documents))), 50_257)
    assert len(symbols) + 2 * len(rules) <= 1.15 * brute_repair(documents, repair_shards.LEAST_COUNT)


def test_repair_shortens_runs_of_one_id():
    """Runs shrink by half a round; one that ends a document does not reach into the next."""
    symbols, _, rules = repair_shards.compress(np.full(1000, 7, np.uint32), np.array([1000]), 50_257)
    assert len(symbols) + 2 * len(rules) <= 3 * 10
    documents = [np.full(n, 7, np.uint32) for n in (1, 2, 3, 501, 64, 1)] + [np.array([7, 7, 8, 7, 7, 7, 8], np.uint32)] * 9
    shard = repair_shards.Shard(repair_shards.write_shard(list(range(len(documents))), documents, 50_257))
    assert all((a == b).all() for a, b in zip(shard.documents(), documents, strict=True)) and len(shard.symbols) < 120


def test_repair_with_symbols_of_four_bytes():
    documents = [np.tile(np.array([5, 6, 70_000], np.uint32), 30)] * 3
    shard = repair_shards.Shard(repair_shards.write_shard([1, 2, 3], documents, 80_000))
    assert shard.symbols.dtype.itemsize == 4 and len(shard.rules[0]) and all((a == b).all() for a, b in zip(shard.documents(), documents, strict=True))


def test_op7_takes_long_runs_without_white_space(library):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    counter = prefix_counts.PrefixCounter(JSON)
    changes = counter.changes(text)
    for end in (1, 1000, 200_000):
        assert prefix_counts.count_at(changes, end) == len(library.encode(text[:end], add_special_tokens=False).ids)


def test_op3_on_odd_rows(odd, empty, library):
    rows = sorted(repair_shards.encode_and_read(odd).collect(), key=lambda r: r.start)
    source = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start = 0
    for row, want in zip(rows, source, strict=True):
        ids = [*library.encode(want.text or "", add_special_tokens=False).ids, 0]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (want.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert repair_shards.encode_and_read(empty).count() == 0
