"""Chains of modules: lookups, closure, deletes."""

import pytest
from pyspark.sql import functions as F

from corpusloom.model import CALLS, INCLUDES, INHERITANCE, MODULES, SYMBOLS
from corpusloom.operators import dml, graph, resolve

N = 12


@pytest.fixture(scope="module")
def chain(spark):
    modules = [(i + 1, f"unit_{i}", f"units/unit_{i}") for i in range(N)]
    symbols = [s for i in range(N) for s in ((2 * i + 1, i + 1, f"units/unit_{i}.cpp", 1, f"Step{i}", "", 2, 2), (2 * i + 2, i + 1, f"units/unit_{i}.cpp", 2, f"run{i}", f"void run{i}()", 3, 3))]
    calls = [(i + 1, 2 * i + 2, 2 * i + 4, i + 1, i + 2) for i in range(N - 1)]
    includes = [(i + 1, 2 * i + 2, f"unit_{i + 1}.hpp", i + 1, i + 2) for i in range(N - 1)] + [(99, 2, "none.hpp", 1, None)]
    bases = [(i + 1, 2 * i + 1, 2 * i + 3, i + 1, i + 2) for i in range(N - 1)]
    rows = {"modules": (modules, MODULES), "symbols": (symbols, SYMBOLS), "calls": (calls, CALLS), "includes": (includes, INCLUDES), "inheritance": (bases, INHERITANCE)}
    return {k: spark.createDataFrame(*v) for k, v in rows.items()}


def closure(t, name, depth):
    edges = graph.module_edges(t["calls"], t["includes"], t["inheritance"])
    return [(r["module_name"], r["depth"]) for r in graph.module_closure(name, depth, t["modules"], edges).collect()]


def test_one_hop(chain):
    names = lambda df: [r["qualified_name"] for r in df.collect()]
    t = chain
    assert names(graph.callers_of(12, t["calls"], t["symbols"], t["modules"])) == ["run4"]
    assert names(graph.callees_from(12, t["calls"], t["symbols"], t["modules"])) == ["run6"]
    assert names(graph.symbols_for_file("units/../units/unit_3.cpp", t["symbols"], t["modules"])) == ["Step3", "run3"]


def test_closure(chain):
    assert closure(chain, "unit_0", N) == [(f"unit_{i}", i) for i in range(1, N)]
    assert closure(chain, "unit_8", 2) == [("unit_9", 1), ("unit_10", 2)]
    assert closure(chain, "unit_0", 0) == closure(chain, "nowhere", 3) == []


def test_closure_of_a_cycle(spark):
    modules = spark.createDataFrame([(i, f"m{i}", "") for i in range(1, 5)], MODULES)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 4)], "src long, dst long")
    assert [(r["module_id"], r["depth"]) for r in graph.module_closure("m1", 8, modules, edges).collect()] == [(2, 1), (3, 1), (4, 2)]


def test_delete_cascades_but_modules_stay(spark, chain):
    left = chain | dml.delete_files(spark.createDataFrame([("units/unit_5.cpp",)], "file_path string"), chain)
    assert graph.callers_of(14, left["calls"], left["symbols"], left["modules"]).count() == 0
    assert left["symbols"].count() == 2 * (N - 1) and left["modules"].count() == N
    # The includes of unit_4 still name unit_5's module.
    assert closure(left, "unit_0", N) == [(f"unit_{i}", i) for i in range(1, 6)]


def test_lookup(spark, chain):
    t = chain
    extra = spark.createDataFrame([(100, 1, "x.cpp", 2, "deep::ns::go", "", 1, 1), (101, 1, "x.cpp", 2, "ns::go", "", 2, 2), (102, 1, "x.cpp", 2, "b::go", "", 2, 2), (103, 1, "x.cpp", 2, "xgo", "", 2, 2)], SYMBOLS)
    symbols = t["symbols"].unionByName(extra)
    find = lambda name: [r["symbol_id"] for r in graph.lookup(name, symbols, t["modules"]).collect()]
    assert find("run3") == [8] and find("go") == [102] and find("ns::go") == [101] and find("q::go") == [] and find("zz") == []
    assert graph.lookup_any_suffix("go", symbols, t["modules"]).first()["symbol_id"] == 100


def test_resolution_prefers_the_inner_scope(spark):
    symbols = spark.createDataFrame([(1, "a::b::f"), (2, "a::f"), (3, "f"), (4, "z::g"), (5, "y::g"), (6, "a::b::f")], "symbol_id long, qualified_name string")
    cases = [(1, "a::b::c", "f", 1), (2, "a::c", "f", 2), (3, "q::c", "f", 3), (4, "q", "g", 4), (5, "q", "x::g", None), (6, "q", "y::g", 5), (7, "q", "none", None)]
    refs = spark.createDataFrame([c[:3] for c in cases], "ref_id long, source_name string, target string")
    got = {r["ref_id"]: r["resolved_id"] for r in resolve.resolve_names(refs, symbols).collect()}
    assert got == {c[0]: c[3] for c in cases}


def test_modules_are_identified_by_name(spark):
    have = spark.createDataFrame([(4, "old", "p/old")], MODULES)
    wanted = spark.createDataFrame([("new", "second", 2), (" new ", "first", 1), ("old", "other", 3), ("", "only/path", 4), ("", "", 5)], "module_name string, module_path string, ord int")
    got = sorted(tuple(r) for r in dml.ensure_modules(wanted, have).collect())
    assert got == [(4, "old", "p/old"), (5, "new", "first"), (6, "only/path", "only/path"), (7, "root", "root")]


def test_ids_follow_the_order(spark):
    rows = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "k int")
    got = [(r["id"], r["k"]) for r in dml.assign_ids(rows, "id", 10, "k").orderBy("id").collect()]
    assert got == [(10 + i, i) for i in range(101)]
    assert dml.assign_ids(rows.limit(0), "id", 1, "k").count() == 0 and dml.next_id(rows.limit(0), "k") == 1


def test_edges_need_both_ends(spark, chain):
    pairs = spark.createDataFrame([(2, 4, 1), (2, 4, 2), (2, 999, 3)], "caller_symbol_id long, callee_symbol_id long, ord int")
    assert [tuple(r) for r in dml.call_edges(pairs, chain["symbols"], 7).orderBy("call_id").collect()] == [(7, 2, 4, 1, 2), (8, 2, 4, 1, 2)]
    assert [r[0] for r in dml.missing_symbols(pairs, ["caller_symbol_id", "callee_symbol_id"], chain["symbols"]).collect()] == [999]


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, dml.upsert(t, spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), "k").collect())) == [(1, "a"), (2, "B"), (3, "c")]


def test_closure_plan_has_no_cross_join(chain):
    plan = graph.module_edges(chain["calls"], chain["includes"], chain["inheritance"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert F is not None
