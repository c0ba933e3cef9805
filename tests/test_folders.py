"""Folder and configuration sources, layered settings, the cached graph and draft answers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import drafts as D
from quillmesh.sources import folders as FO
from quillmesh.sources import graph_cache as GC


@pytest.fixture()
def folder(tmp_path):
    files = {
        "Mehnat kodeksi__x.org__2024-05-01.txt": "1-modda. Umumiy\nBu moddaning matni yetarlicha uzun.\n2-modda\nIkkinchi moddaning matni ham uzun.",
        "deep/er/Oila kodeksi.md": "Birinchi xatboshi yetarlicha uzun.\n\nIkkinchi xat-\nboshi ham shunday uzun.",
        "page.HTML": "<p>Sahifa matni yetarlicha uzun <b>boʻldi</b></p><script>x</script>",
        "empty.txt": "\n", "nothing.txt": "", "scan.pdf": "%PDF", "noending": "x", ".hidden.txt": "yashirin matn, koʻrinmaydi", ".git/config.txt": "yashirin papka, koʻrinmaydi",
    }
    for name, text in files.items():
        path = tmp_path / "corpus" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return f"file://{tmp_path}/corpus"


def test_folder_is_walked_and_summed_up(spark, folder):
    files = {r.name: (r.kind, r.readable) for r in FO.folder_files(spark, folder).collect()}
    assert files == {"Mehnat kodeksi__x.org__2024-05-01.txt": ("txt", True), "Oila kodeksi.md": ("md", True), "page.HTML": ("html", True), "empty.txt": ("txt", True), "scan.pdf": ("pdf", False), "noending": ("", False)}
    chunks, summary = FO.ingest_folder(spark, folder)
    rows = sorted((r.document, r.pos, r.article, r.text) for r in chunks.collect())
    assert rows == [
        ("Mehnat kodeksi", 0, "1", "1-modda. Umumiy Bu moddaning matni yetarlicha uzun."), ("Mehnat kodeksi", 1, "2", "2-modda. Ikkinchi moddaning matni ham uzun."),
        ("Oila kodeksi", 0, None, "Birinchi xatboshi yetarlicha uzun.\n\nIkkinchi xatboshi ham shunday uzun."), ("page", 0, None, "Sahifa matni yetarlicha uzun boʻldi"),
    ]
    assert {r.version for r in chunks.collect()} == {"2024-05-01", None}
    told = summary.first()
    assert (told.files, told.chunks, told.skipped) == (4, 4, ["noending", "scan.pdf"])
    assert told.documents == ["Mehnat kodeksi", "Oila kodeksi", "empty", "page"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        FO.folder_files(spark, folder + "-absent")


def test_decisions_are_read_and_empty_ones_told(spark, tmp_path):
    for name, text in {"b.txt": "HUKM", "a.txt": "  \n", "c.md": "QAROR", "sub/d.txt": "ichki"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r.name: (r.text, r.notice) for r in FO.read_decisions(spark, f"file://{tmp_path}").collect()}
    assert rows == {"a.txt": (None, "empty"), "b.txt": ("HUKM", None)}
    with pytest.raises(ValueError, match="no decision"):
        FO.read_decisions(spark, f"file://{tmp_path}", "a.*")


def test_settings_have_defaults_where_a_file_is_absent(spark, tmp_path):
    assert [t.count() for t in FO.read_routing(spark, f"file://{tmp_path}/none.jsonl")] == [0, 0]
    lines = [{"domain": "mehnat", "weight": 2.0, "triggers": ["Ish haqi", "Ta'til"], "documents": ["Mehnat kodeksi"]}, {"domain": "half", "triggers": ["x"], "documents": []}, {"domain": "oila", "triggers": ["Nikoh"], "documents": ["Oila kodeksi", "Fuqarolik kodeksi"]}]
    (tmp_path / "routing.jsonl").write_text("\n".join(map(json.dumps, lines)))
    triggers, documents = FO.read_routing(spark, f"file://{tmp_path}/routing.jsonl")
    assert sorted(map(tuple, triggers.collect())) == [("mehnat", "ish haqi", 2.0), ("mehnat", "ta'til", 2.0), ("oila", "nikoh", 1.0)]
    assert sorted(map(tuple, documents.collect())) == [("mehnat", 0, "mehnat kodeksi"), ("oila", 0, "oila kodeksi"), ("oila", 1, "fuqarolik kodeksi")]
    (tmp_path / "broken.jsonl").write_text("{broken")
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILED_READ_FILE"):
        FO.read_setting(spark, f"file://{tmp_path}/broken.jsonl", "domain string").collect()


def merge(base, over):
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def leaves(value, path=()):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves(v, (*path, k))
    else:
        yield ".".join(path), value


def test_layers_merge_as_nested_dictionaries(spark):
    rnd = random.Random(11)

    def made(depth):
        return {rnd.choice("abc"): made(depth - 1) if depth and rnd.random() < 0.6 else rnd.choice([1, "x", [1, {"k": 2}], None, 2.5, True]) for _ in range(rnd.randrange(1, 4))}

    configs = {k: [made(3) for _ in range(rnd.randrange(1, 5))] for k in range(40)}
    rows = [(k, i, json.dumps(c)) for k, cs in configs.items() for i, c in enumerate(cs)]
    got = {}
    for r in FO.merged_settings(spark.createDataFrame(rows, "key int, layer int, config string")).collect():
        got.setdefault(r.key, {})[r.path] = r.value
    want = {}
    for k, cs in configs.items():
        whole = {}
        for c in cs:
            whole = merge(whole, c)
        want[k] = dict(leaves(whole))
    read = lambda v: json.loads(v) if v[:1] in '[{"0123456789tfn-' and v not in ("x",) else v
    assert {k: {p: read(v) for p, v in ps.items()} for k, ps in got.items()} == want
    settings = spark.createDataFrame([(1, "api.port", "8080"), (1, "api.host", "h")], "key int, path string, value string")
    over = FO.environment_over(settings, spark.createDataFrame([("X_API_PORT", "9")], "name string, setting string"), F.concat(F.lit("X_"), F.upper(F.replace("path", F.lit("."), F.lit("_")))))
    assert {r.path: r.value for r in over.collect()} == {"api.port": "9", "api.host": "h"}


def test_graph_is_reused_only_while_it_is_good(spark, tmp_path):
    path, built = f"file://{tmp_path}/graph", []
    indexed = spark.createDataFrame([("a", "1"), ("b", "2")], "doc_id string, content_sha256 string")
    other = spark.createDataFrame([("a", "1"), ("b", "3")], "doc_id string, content_sha256 string")

    def build(docs):
        built.append(1)
        return docs.select(F.col("doc_id").alias("src"), F.lit("n").alias("dst"), F.lit("text").alias("kind"), F.lit(True).alias("resolved"))

    asked = lambda docs, **o: (lambda edges, found: (found, edges.count()))(*GC.cached_graph(docs, path, build, **o))
    assert asked(indexed) == ("absent", 2) and asked(indexed) == ("good", 2) and len(built) == 1
    assert asked(other) == ("stale", 2) and asked(indexed.repartition(3)) == ("stale", 2) and len(built) == 3
    part = next((tmp_path / "graph/edges").glob("part-*"))
    part.write_text(part.read_text() + "{half a li")
    (part.parent / f".{part.name}.crc").unlink()
    assert asked(indexed) == ("corrupt", 2) and asked(indexed) == ("good", 2)
    part = next(p for p in (tmp_path / "graph/edges").glob("part-*") if p.stat().st_size)
    part.write_text("")
    (part.parent / f".{part.name}.crc").unlink()
    assert asked(indexed)[0] == "corrupt" and asked(indexed, rebuild=True) == ("asked", 2)


def test_drafts_go_by_level(spark):
    position = "role string, stance string, arguments array<struct<strength:string,claim:string,citations:array<string>>>, weaknesses array<string>, confidence double"
    said = [(2, 0, 1, ("advocate", "old", None, [], 0.5)), (2, 1, 1, ("prosecutor", "p", [("kuchli", "c", ["C1", "C2"])], ["w"], 0.25)), (2, 0, 2, ("advocate", "new", None, None, 0.75)), (1, 0, 1, ("advocate", "x", None, None, 0.1))]
    positions = spark.createDataFrame(said, f"request_id int, place int, round int, position struct<{position.replace(' string', ':string').replace(' array', ':array').replace(' double', ':double')}>")
    requests = spark.createDataFrame([(1, ("xulosa", ["r"], []), None), (2, None, ("a", [], [])), (3, None, ("a", [("C1", "Kodeks", "5"), ("C2", "Qonun", None)], ["u"])), (4, None, ("", [], ["only unknown"])), (5, None, None), (6, ("", [], []), None)], "request_id int, verdict struct<conclusion:string,reasoning:array<string>,caveats:array<string>>, frame struct<answer:string,norms:array<struct<tag:string,title:string,article:string>>,unknowns:array<string>>")
    rows = {r.request_id: (r.level, r.draft) for r in D.draft_answers(requests, positions).collect()}
    assert rows == {
        1: ("verdict", "XULOSA\nxulosa\n\nASOSLAR\n- r"),
        2: ("positions", f"{D.NO_SYNTHESIS}\n\nADVOCATE POZITSIYASI\nnew\n\nISHONCH: 0.75\n\nPROSECUTOR POZITSIYASI\np\n\nDALILLAR\n- [kuchli] c [C1] [C2]\n\nZAIF TOMONLAR\n- w\n\nISHONCH: 0.25"),
        3: ("frame", "XULOSA\na\n\nTEGISHLI NORMALAR\n- [C1] Kodeks, 5-modda\n- [C2] Qonun\n\nYETISHMAYOTGAN MA'LUMOT\n- u"),
        4: ("none", ""), 5: ("none", ""), 6: ("verdict", ""),
    }
