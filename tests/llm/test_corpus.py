import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillmesh.llm import components, lsa_decontaminate, simhash_ball, url_rules, wav_landmarks
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
            if name[a] != least or name[b] != least:
                name[a] = name[b] = least
                changed = True
    return name


def test_components_of_paths_stars_and_pairs(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (5, 5)]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    name = linked(pairs, {n for p in pairs for n in p})
    groups = {}
    for node, root in roots.items():
        groups.setdefault(root, set()).add(name[node])
    assert set(roots) == set(name) and all(len(g) == 1 for g in groups.values()) and len(groups) == 3
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_further_links(spark):
    first, further = [(1, 2), (3, 4), (5, 6), (20, 21)], [(2, 3), (7, 8), (8, 6), (9, 10), (4, 1)]
    frame = lambda pairs: spark.createDataFrame(pairs, "a bigint, b bigint")
    for some, others in ((first, further), (first, []), ([], further)):
        rows = components.merged(components.components(frame(some)), frame(others)).collect()
        name = linked(some + others, {n for p in some + others for n in p})
        assert sorted(r.node for r in rows) == sorted(name)
        assert len({(r.root, name[r.node]) for r in rows}) == len(set(name.values())) == len({r.root for r in rows})


def test_components_take_few_tasks(spark):
    """The driver remembers every task, so rounds of few edges must not take one for each shuffle partition."""
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    tracker = spark.sparkContext.statusTracker()
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("components", "components")
        assert len({r.root for r in components.components(edges).collect()}) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
    assert 0 < tasks < 1200, tasks  # 1752 with a task for each partition


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    n = min(3, len(words))
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_op8_equals_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    near = docs.select("doc_id", "text").unionByName(docs.selectExpr("doc_id + 1000 AS doc_id", "concat(text, ' one more')").toDF("doc_id", "text"))
    rows = {r.doc_id: r for r in simhash_ball.near_duplicates(near).select("doc_id", simhash_ball.hex_digits("fp").alias("h"), "component_id").collect()}
    prints = {r.doc_id: brute_fingerprint(r.text) for r in near.collect()}
    ids = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = linked(pairs, ids)
    assert {i: (r.h, r.component_id) for i, r in rows.items()} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}
    assert any(a != b and prints[a] != prints[b] for a, b in pairs)


def test_ball_links_find_distances_of_one_and_two(spark):
    values = [0, 1, 3, 1 << 63, (1 << 63) | 1, 0b11110000]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash_ball.ball_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"))
    name = linked([(r.a, r.b) for r in links.collect()], signed)
    assert len({name[v] for v in signed[:5]}) == 1 and name[signed[5]] == signed[5]


def test_op8_on_odd_rows(odd, empty):
    rows = simhash_ball.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.fp for r in rows if r.doc_id in (2, 3)} == {0} and {r.component_id for r in rows if r.doc_id in (2, 3)} == {2}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash_ball.near_duplicates(empty).count() == 0


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    best = max(fits) if fits else (0, 0, None, default)
    return host, path, best[2], best[3]


URLS = ["http://a.example.net/en/x?q#f", "https://EXAMPLE.net", "http://example.net/en/", "http://notexample.net/en/", "http://x.org/fr/", "http://org/fr/1", "http://b.a.example.com/de/1", "nothing", None, "http://", "ftp://h?x=://y/", "http://example.net:80/en/", "http://net./", "http://deep.a.b.c.example.org/fr/#z", "http://net/"]


def test_op9_equals_brute_force(spark):
    pages = spark.createDataFrame([(i % 13, u) for i, u in enumerate(URLS * 3)], "page_id bigint, url string").withColumn("host", F.lit("clash"))
    rules = [*url_rules.RULES, ("c.example.org", "/fr/", "allow"), ("a.b.c.example.org", "", "block"), ("", "/", "block"), ("example.org", "/", "block"), ("org", "/fr/", "allow")]
    rows = sorted(map(str, (tuple(r) for r in url_rules.judge_urls(pages, url_rules.rules_frame(spark, rules)).collect())))
    assert rows == sorted(map(str, ((i % 13, *judged(u, rules)) for i, u in enumerate(URLS * 3))))


def test_op9_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert [r.verdict for r in url_rules.judge_urls(pages, url_rules.rules_frame(spark, [])).collect()] == ["allow"]
    assert url_rules.judge_urls(pages.where("false"), url_rules.rules_frame(spark, url_rules.RULES)).count() == 0


def test_op9_with_many_hosts_in_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "HOSTS_PER_SALT", 3)
    pages = spark.range(60).selectExpr("id AS page_id", "concat('http://h', id, IF(id % 2 = 0, '.example.net', '.b.example.com'), IF(id % 3 = 0, '/en/', '/de/')) AS url")
    rows = {tuple(r) for r in url_rules.judge_urls(pages, url_rules.rules_frame(spark, url_rules.RULES)).collect()}
    assert rows == {(r.page_id, *judged(r.url, url_rules.RULES)) for r in pages.collect()}


def test_op10_round_trip_and_ties(odd, empty):
    rows = wav_landmarks.media_digests(odd).collect()
    source = {(r.doc_id, r.text) for r in odd.collect()}
    assert len(rows) == odd.count()
    want = set()
    for key, text in source:
        data = (text or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        want.add((key, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
    assert {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == want
    assert len({tuple(r)[1:] for r in rows if r.doc_id == 1}) == 1
    assert wav_landmarks.media_digests(empty).count() == 0
    media = wav_landmarks.media_table(odd.where("doc_id = 8")).first()
    assert wav_landmarks.from_wav(media.media).startswith("naïve".encode()) and media.landmarks == sorted(media.landmarks)


def test_landmarks_find_a_tone():
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * np.arange(576 * 8) / 576)).astype(np.uint8).tobytes()
    codes = wav_landmarks.landmarks(tone)
    assert 40 in {int(c) >> 18 & 0x3FFF for c in codes} and len(codes) < 4 * 4 * 4 * 16


def test_common_subsequence_by_dynamic_programming():
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = [list(rng.choice(list("abcd"), rng.integers(1, 40))) for _ in range(2)]
        assert lsa_decontaminate.common_subsequence(a, b) == brute(a, b)


def test_op4_recall_against_brute_force(spark):
    docs, items = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    found = {(r.doc_id, r.item_id) for r in lsa_decontaminate.find_leaks(docs, items).collect()}
    want = set()
    for item in items.collect():
        wanted = lsa_decontaminate.words_of(item.text)
        for doc in docs.collect():
            words = lsa_decontaminate.words_of(doc.text)
            step = max(1, len(wanted) // 2)
            if any(lsa_decontaminate.common_subsequence(wanted, words[i : i + 2 * len(wanted)]) >= 0.8 * len(wanted) for i in range(0, len(words), step)):
                want.add((doc.doc_id, item.item_id))
    assert want and len(found & want) >= 0.9 * len(want) and not found - want


def test_op4_finds_paraphrases_and_leaves_others(spark, odd, empty):
    passage = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew potent elixirs beneath ancient crumbling towers"
    words = passage.split()
    changed = " ".join(w if i % 4 else "thing" for i, w in enumerate(words))
    filler = " ".join(f"filler{i}" for i in range(300))
    rows = [(1, f"{filler} {passage} {filler}"), (2, f"{filler} {changed} {filler}"), (3, filler), (4, "over the while the beneath"), (5, None), (6, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(9, passage), (10, None), (11, ""), (12, "a b c"), (13, passage)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r.kind for r in lsa_decontaminate.find_leaks(docs, items).collect()}
    assert found[1, 9] == found[1, 13] == "copy" and found[6, 12] == "copy" and not {k for k in found if k[0] in (3, 4, 5)}
    assert lsa_decontaminate.find_leaks(odd, items).count() == 0 and lsa_decontaminate.find_leaks(empty, items).count() == 0
    assert lsa_decontaminate.find_leaks(docs, items.where("false")).count() == 0


def test_op4_finds_copies_of_passages_that_stand_in_many_documents(spark):
    rng = np.random.default_rng(5)
    third, most = [" ".join(f"{name}{i}" for i in rng.permutation(33)) for name in ("third", "most")]
    docs = []
    for i in range(60):
        parts = [" ".join(f"filler{j}" for j in rng.integers(0, 100_000, 150)) for _ in range(3)]
        docs.append((i, " ".join([parts[0], third if i % 3 == 0 else "", parts[1], most if i % 3 else "", parts[2]])))
    docs.append((60, " ".join(f"filler{j}" for j in range(237)) + " " + third))  # its last stretch has no window of its own
    rare = [(10 + k, " ".join(f"rare{k}x{i}" for i in range(33))) for k in range(10)]
    items = spark.createDataFrame([(1, third), (2, most), *rare], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id, r.kind) for r in lsa_decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    assert found == {(i, 2 if i % 3 else 1, "copy") for i in range(61)}
