"""Module views kept through changes equal views computed anew, and cost what changed."""

import pytest

from corpusloom.plans import views as V
from corpusloom.plans.facade import Engine
from corpusloom.plans.index import Indexer
from corpusloom.plans.views import ModuleViews
from corpusloom.sources.embedding import hash_embed
from corpusloom.sources.store import ConflictError, SnapshotStore

START = {
    "a/one.cpp": "namespace a { int run() { return b::run(); } int own() { return run(); } }\n",
    "a/one.hpp": "namespace a { int run(); }\n",
    "b/two.cpp": '#include "a/one.hpp"\nnamespace b { int run() { return go(); } int go() { return 2; } }\n',
    "c/three.cpp": "namespace c { int solo() { return 3; } }\n",
}
CHANGES = [
    {"a/one.cpp": "namespace a { int run() { return c::solo(); } }\n"},
    {"b/two.cpp": None, "c/three.cpp": "namespace c { int solo() { return a::run() + a::run(); } }\n"},
    {"b/two.cpp": "namespace b { struct Leaf : public c::Root {}; int run() { return a::run(); } }\n", "c/root.hpp": "namespace c { struct Root {}; }\n"},
    {"a/one.cpp": None, "a/one.hpp": None},
]


def plant(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text) if text is not None else (root / name).unlink()


def shown(views, tables):
    """By names of modules, as their ids may differ."""
    name = {r["module_id"]: r["module_name"] for r in tables["modules"].collect()}
    edges = sorted((name[r["src"]], name[r["dst"]], r["n"]) for r in views.edges().collect())
    counts = sorted((name[r["module_id"]], r["symbol_count"], r["file_count"], r["header_count"]) for r in views.counts().collect())
    centroids = sorted((r["module_name"], r["vectors"], tuple(r["centroid"])) for r in views.centroids().collect())
    profiles = sorted((r["module_name"], r["header_count"], r["public_symbol_count"], r["summary"], tuple(r["embedding"])) for r in views.profiles().collect())
    return edges, counts, centroids, profiles


@pytest.mark.parametrize("most", [3])
def test_updates_equal_views_computed_anew(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(V, "MAX_PARTS", most)
    root = tmp_path / "tree"
    plant(root, START)
    views = ModuleViews(spark, str(tmp_path / "views"))
    indexer = Indexer(SnapshotStore(spark, str(tmp_path / "store")), str(root), views=views)
    indexer.index()
    for k, change in enumerate(CHANGES):
        plant(root, change)
        indexer.update(spark.createDataFrame([(n,) for n in change], "path string"))
        tables = indexer.store.read()
        fresh = ModuleViews(spark, str(tmp_path / f"fresh{k}"))
        fresh.rebuild(tables, 1)
        assert shown(views, tables) == shown(fresh, tables)
        assert views.brought_to() == indexer.store.version() and len(views.parts()) <= most
    edges, counts, _, profiles = shown(views, tables)
    assert {c[0] for c in counts} == {"b", "c"} == {p[0] for p in profiles} and edges and all(e[2] > 0 for e in edges)


def test_only_what_changed_is_embedded(spark, tmp_path):
    log = tmp_path / "texts"
    log.write_text("")

    def embed(texts):
        with open(log, "a") as f:
            f.writelines(t.splitlines()[0] + "\n" for t in texts)
        return hash_embed(texts)

    plant(tmp_path / "tree", START)
    views = ModuleViews(spark, str(tmp_path / "views"), embed)
    indexer = Indexer(SnapshotStore(spark, str(tmp_path / "store")), str(tmp_path / "tree"), views=views)
    indexer.index()
    assert sorted(set(log.read_text().split("\n")) - {""}) == ["module a", "module b", "module c"]
    log.write_text("")
    # A body changes, what the module shows doesn't.
    plant(tmp_path / "tree", {"c/three.cpp": "namespace c { int solo() { return 4; } }\n"})
    indexer.update(spark.createDataFrame([("c/three.cpp",)], "path string"))
    assert log.read_text() == ""
    plant(tmp_path / "tree", {"c/three.cpp": "namespace c { int duo() { return 4; } }\n"})
    indexer.update(spark.createDataFrame([("c/three.cpp",)], "path string"))
    assert set(log.read_text().split("\n")) - {""} == {"module c"}
    # An engine takes the profiles as they are.
    log.write_text("")
    engine = Engine(indexer).load()
    assert log.read_text() == "" and engine.handle("POST", "/module", '{"module_name": "c"}')["body"]["module"]["public_symbol_count"] == 2


def test_views_that_fell_behind_are_built_anew(spark, tmp_path):
    plant(tmp_path / "tree", START)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    Indexer(store, str(tmp_path / "tree")).index()
    views = ModuleViews(spark, str(tmp_path / "views"))
    assert views.brought_to() == 0 and views.edges().collect() == [] == views.profiles().collect()
    plant(tmp_path / "tree", CHANGES[0])
    Indexer(store, str(tmp_path / "tree"), views=views).update(spark.createDataFrame([("a/one.cpp",)], "path string"))
    assert views.brought_to() == 2 and len(views.parts()) == 1 and views.profiles().count() == 3
    other = ModuleViews(spark, str(tmp_path / "views"))
    base = other.version()
    views.rebuild(store.read(), 3)
    with pytest.raises(ConflictError):
        other._add({"edges": V.edge_rows(store.read(), 1)}, 3, base, [])
