"""A small tree from files to answers, and what changes in it."""

import json

import pytest

from corpusloom.plans.evaluate import evaluate, write_report
from corpusloom.plans.facade import Engine, ranked_names
from corpusloom.plans.index import Indexer
from corpusloom.sources.files import evaluation_queries
from corpusloom.sources.store import ConflictError, SnapshotStore
from corpusloom.streaming.reindex import reindex_stream

FILES = {
    "math/math.hpp": "#pragma once\nnamespace math {\nint twice(int x);\n}\n",
    "math/math.cpp": '#include "math.hpp"\n#include <string>\nnamespace math {\nint twice(int x) { return x * 2; }\nstd::string text_of(int x) { return std::to_string(twice(x)); }\n}\n',
    "app/widget.cpp": '#include "math.hpp"\nnamespace app {\nclass Widget {\npublic:\n  std::string name() { return math::text_of(3); }\n};\n}\n',
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    indexer = Indexer(SnapshotStore(spark, str(tmp_path_factory.mktemp("store"))), str(root))
    stats = indexer.index()
    assert (stats.files_scanned, stats.files_indexed, stats.symbols_indexed, stats.parse_errors) == (3, 3, 8, 0)
    return Engine(indexer, complete=lambda messages, model: f"{model}: {messages[0]['role']}").load()


def post(engine, path, **body):
    answer = engine.handle("POST", path, json.dumps(body))
    assert answer["status"] == 200, answer
    return answer["body"]


def test_requests(engine):
    callers = post(engine, "/callers", name="math::text_of")
    assert [s["qualified_name"] for s in callers["callers"]] == ["app::Widget::name"] == ranked_names("callers", callers)
    deps = post(engine, "/deps", name="app::Widget::name")
    assert [(m["module_name"], m["depth"]) for m in deps["modules"]] == [("math", 1), ("string", 2)]
    assert ranked_names("deps", deps) == ["math::text_of", "math", "string"]
    found = post(engine, "/search", query="twice text_of")
    assert found["symbols"] and all(s["token_count"] <= 256 for s in found["symbols"]) and any("Callers:" in s["context"] for s in found["symbols"])
    explained = post(engine, "/explain", symbol_name="twice", model="deep")
    assert explained["completion"] == "deep: system" and "math::twice" in explained["prompt"]["user_text"]
    module = post(engine, "/module", module_name="math")
    assert module["module"]["header_count"] == 1 and [d["module_name"] for d in module["dependencies"]] == ["string"]


def test_evaluation(engine, spark, tmp_path):
    queries = [
        {"id": "a", "tool": "callers", "query": "Who calls math::text_of?", "expected_symbols": ["app::Widget::name"]},
        {"id": "b", "tool": "deps", "query": "Dependencies of app::Widget::name", "depth": 2, "expected_symbols": ["string"]},
        {"id": "c", "tool": "semantic_search", "query": "twice", "expected_symbols": ["nobody"]},
        {"id": "d", "tool": "explain", "query": "Explain zz", "expected_symbols": ["zz"]},
    ]
    (tmp_path / "q.json").write_text(json.dumps(queries))
    ranks, scores = evaluate(engine, evaluation_queries(spark, str(tmp_path / "q.json")))
    write_report(ranks, scores, str(tmp_path / "report"))
    assert {r["query_id"]: r["first_rank"] for r in spark.read.json(str(tmp_path / "report/ranks")).collect()} == {"a": 1, "b": 3, "c": None, "d": None}
    got = {r["tool_group"]: r for r in spark.read.json(str(tmp_path / "report/metrics")).collect()}
    assert got["structural"]["precision_at_5"] == 1.0 and got["semantic"]["mrr"] == 0.0 and got["overall"]["queries"] == 3


def test_failures(engine):
    status = lambda *a: engine.handle(*a)["status"]
    assert status("GET", "/status") == 200 and status("POST", "/status") == 405 and status("GET", "/deps") == 405
    assert status("POST", "/nothing") == 404 and status("POST", "/callers", "{}") == 400 and status("POST", "/callers", "{x") == 400
    assert status("POST", "/callers", '{"name": "zz"}') == 404 and status("POST", "/module", '{"name": "zz"}') == 404 and status("POST", "/search", '{"query": " "}') == 400
    assert Engine(engine.indexer).handle("POST", "/search", '{"query": "x"}')["status"] == 503


def test_update_keeps_edges_into_the_changed_file(engine, spark, tmp_path):
    root, indexer = engine.indexer.root, engine.indexer
    with open(f"{root}/math/math.cpp", "a") as f:
        f.write("namespace math { int thrice(int x) { return twice(x) + x; } }\n")
    done = post(engine, "/reindex", files=[f"{root}/math/math.cpp"])
    assert done["files"] == ["math/math.cpp"] and done["stats"]["symbols_indexed"] == 5
    assert [s["qualified_name"] for s in post(engine, "/callers", name="math::text_of")["callers"]] == ["app::Widget::name"]
    # A stream of paths; running it again changes nothing.
    paths = str(tmp_path / "paths")
    spark.createDataFrame([("app/widget.cpp",)], "path string").write.json(paths)
    before = indexer.store.read()["symbols"].count()
    reindex_stream(spark.readStream.schema("path string").json(paths), indexer, str(tmp_path / "c")).awaitTermination()
    t = indexer.store.read()
    assert t["symbols"].count() == before == t["vectors"].count() == t["symbols"].select("symbol_id").distinct().count()


def test_transactions(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.commit()
    modules = spark.createDataFrame([(1, "m", "m")], "module_id long, module_name string, module_path string")
    store.begin()
    with pytest.raises(RuntimeError):
        store.begin()
    store.publish({"modules": modules})
    assert store.version() == 0 and store.read()["modules"].count() == 1
    store.rollback()
    assert store.read()["modules"].count() == 0
    store.begin()
    store.publish({"modules": modules})
    assert store.commit() == 1 and store.read()["modules"].count() == 1


def named(tables):
    """Tables by names, as ids differ between a full index and an updated one."""
    name = {r["symbol_id"]: (r["file_path"], r["qualified_name"], r["kind"], r["start_line"]) for r in tables["symbols"].collect()}
    plain = {i: n[1] for i, n in name.items()}
    module = {r["module_id"]: r["module_name"] for r in tables["modules"].collect()}
    calls = sorted((plain[r["caller_symbol_id"]], plain[r["callee_symbol_id"]], module[r["caller_module_id"]], module[r["callee_module_id"]]) for r in tables["calls"].collect())
    bases = sorted((plain[r["derived_symbol_id"]], plain[r["base_symbol_id"]]) for r in tables["inheritance"].collect())
    includes = sorted((plain[r["source_symbol_id"]], r["include_path"], module.get(r["target_module_id"])) for r in tables["includes"].collect())
    return sorted(name.values()), calls, bases, includes, sorted((r["qualified_name"], r["start_line"], r["source_text"]) for r in tables["vectors"].collect())


# No unqualified name is left to choose among symbols of several scopes: the smallest id is chosen, and ids differ.
CHANGES = [
    {"a/one.cpp": "namespace a { int run() { return go(); } int fresh() { return b::run(); } }\n"},
    {"c/late.cpp": "namespace c { int go() { return a::fresh(); } struct Root {}; }\n", "b/two.cpp": None},
    {"b/two.cpp": "namespace b { struct Leaf : public c::Root { int run() { return stop(); } }; int stop() { return 1; } }\n", "x[1].cpp": "int odd() { return c::go(); }\n"},
]


def test_updates_equal_a_full_index(spark, tmp_path, monkeypatch):
    """Files added, changed and removed; an update lists nothing of the tree, and writes parts, not tables."""
    from corpusloom.plans import index as I

    root = tmp_path / "tree"
    files = {"a/one.cpp": "namespace a { int run() { return b::run(); } }\n", "b/two.cpp": "namespace b { int run() { return go(); } int go() { return 2; } }\n", "b/CMakeLists.txt": ""}
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    indexer = Indexer(store, str(root))
    indexer.index()
    scan = I.scan_files
    for k, change in enumerate(CHANGES, 1):
        for name, text in change.items():
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_text(text) if text is not None else (root / name).unlink()
        monkeypatch.setattr(I, "scan_files", lambda *a: pytest.fail("the tree was listed"))
        indexer.update(spark.createDataFrame([(n,) for n in change], "path string"))
        monkeypatch.setattr(I, "scan_files", scan)
        full = Indexer(SnapshotStore(spark, str(tmp_path / f"full{k}")), str(root))
        full.index()
        assert named(store.read()) == named(full.store.read())
        assert len(store.parts()) == k + 1
    monkeypatch.setattr(I, "LISTED", 0)
    assert indexer.update(spark.createDataFrame([("a/one.cpp",)], "path string")).files_indexed == 1
    assert named(store.read()) == named(full.store.read())


def test_parts_are_written_whole_again_in_time(spark, tmp_path, monkeypatch):
    from corpusloom.sources import store as S

    monkeypatch.setattr(S, "MAX_PARTS", 3)
    (tmp_path / "tree").mkdir()
    indexer = Indexer(SnapshotStore(spark, str(tmp_path / "store")), str(tmp_path / "tree"))
    (tmp_path / "tree/f.cpp").write_text("int f() { return 0; }\n")
    indexer.index()
    for k in range(3):
        (tmp_path / "tree/f.cpp").write_text(f"int f() {{ return {k}; }}\nint g{k}() {{ return f(); }}\n")
        indexer.update(spark.createDataFrame([("f.cpp",)], "path string"))
        assert len(indexer.store.parts()) <= 2
    indexer.store.vacuum()
    _, calls, _, _, texts = named(indexer.store.read())
    assert [c[:2] for c in calls] == [("g2", "f")] and len(texts) == 2 and len(list((tmp_path / "store").glob("part-*"))) <= 3


def test_of_two_writers_one_fails(spark, tmp_path):
    one, other = (SnapshotStore(spark, str(tmp_path / "s")) for _ in range(2))
    module = lambda i: spark.createDataFrame([(i, f"m{i}", "m")], "module_id long, module_name string, module_path string")
    one.begin()
    other.begin()
    one.publish({"modules": module(1)})
    other.publish({"modules": module(2)})
    assert one.commit() == 1
    with pytest.raises(ConflictError):
        other.commit()
    assert [r["module_id"] for r in other.read()["modules"].collect()] == [1]
    none = spark.createDataFrame([], "symbol_id long")
    with pytest.raises(ConflictError):
        other.change({"modules": module(3)}, none, none, base=0)
    assert other.change({"modules": module(3)}, none, none) == 2 and one.read()["modules"].count() == 2


def test_vectors_of_another_dimension_fail_the_index(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/f.cpp").write_text("int f() { return 0; }\n")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    with pytest.raises(Exception, match="expected 64 dimensions"):
        Indexer(store, str(tmp_path / "tree"), dimension=64).index()
    assert store.version() == 0
    Indexer(store, str(tmp_path / "tree"), dimension=128).index()
    assert store.version() == 1
