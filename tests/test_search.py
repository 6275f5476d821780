import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.vectors import centroids, cosine, normalize
from corpusloom.operators import evaluation, profile, search
from corpusloom.session import dealt


@pytest.fixture(scope="module")
def corpus(spark):
    """Symbols whose own vectors mislead and whose modules' vectors don't."""
    rows = [(1, "drawing", [0.7, 0.3, 0.0]), *((i, "drawing", [0.7, 0.3, 0.0]) for i in range(2, 400)), *((i, "wires", [0.99, 0.01, 0.0]) for i in range(400, 800)), *((i, "disks", [0.98, 0.02, 0.0]) for i in range(800, 1200))]
    symbols = spark.createDataFrame([(i, m, f"p/{m}", f"{m}/f.hpp", f"{m}::s{i:04d}", 1, v) for i, m, v in rows], "symbol_id long, module_name string, module_path string, file_path string, qualified_name string, start_line long, embedding array<float>")
    modules = spark.createDataFrame([("drawing", "p/drawing", [1.0, 0.0, 0.0]), ("wires", "p/wires", [0.0, 1.0, 0.0]), ("disks", "p/disks", [0.0, 0.0, 1.0])], "module_name string, module_path string, embedding array<float>")
    return symbols, modules


def test_two_levels_beat_flat_search(corpus):
    symbols, modules = corpus
    found = search.hierarchical_search(symbols, modules, [1.0, 0.0, 0.0], 1, 5).collect()
    assert [r["symbol_id"] for r in found] == [1, 2, 3, 4, 5]
    assert all(r["module_name"] == "wires" for r in search.top_symbols(symbols, [1.0, 0.0, 0.0], 5).collect())


def test_search_reads_the_corpus_once_without_a_shuffle(corpus):
    symbols, modules = corpus
    plan = search.hierarchical_search(symbols, modules, [1.0, 0.0, 0.0])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_cosine(spark):
    rows = [([1.0, 2.0], [2.0, 1.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<float>, b array<float>").select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(0.8), 0.0, 0.0, 0.0, 0.0]


def test_vector_helpers(spark):
    df = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("b", [0.0, 0.0])], "k string, v array<double>")
    assert {r["k"]: r["centroid"] for r in centroids(df, "k", "v").collect()} == {"a": [2.0, 4.0], "b": [0.0, 0.0]}
    assert [r[0] for r in df.select(normalize(F.col("v"))).collect()][2] == [0.0, 0.0]


def test_context_is_a_prefix_within_the_budget(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a b", "", "c", "d e f", "g"])] + [(2, 0, "x y z w v u")], "k int, pos int, line string")
    got = {r["k"]: (r["context"], r["token_count"]) for r in search.budgeted(lines, "k", "pos", "line", 5).collect()}
    assert got == {1: ("a b\nc", 3)}
    assert search.budgeted(lines, "k", "pos", "line", None).where("k = 2").first()["token_count"] == 6


def test_module_profile(spark):
    rows = [(1, "m", "p", "m/a.hpp", 2, "m::f", "void f()", 5), (2, "m", "p", "m/a.hpp", 1, "m::C", "", 1), (3, "m", "p", "m/b.cpp", 0, "m", "", 1), (4, "m", "p", "m/c.hh", 3, "m::C::g", "", 9)]
    symbols = spark.createDataFrame(rows, "symbol_id long, module_name string, module_path string, file_path string, kind int, qualified_name string, signature string, start_line long")
    r = profile.module_profiles(symbols, 3).first()
    assert (r["header_count"], r["public_symbol_count"]) == (2, 3)
    assert r["summary"] == "module m\npath p\nheaders 2\npublic symbols 3\nselected symbols:\n- class m::C (m/a.hpp)\n- function m::f :: void f() (m/a.hpp)\n- method m::C::g (m/c.hh)\n"
    f = profile.fallback_module("m", symbols).first()
    assert (f["public_symbol_count"], f["header_count"], f["summary"]) == (4, 3, "m::f\nm::C\nm\nm::C::g")


def test_parts_of_a_module_are_its_record(spark):
    rows = [(i, "m" if i % 3 else "n", "p", f"m/a.{'hpp' if i % 2 else 'cpp'}", 2, f"m::f{i}", None) for i in range(7, 300)]
    symbols = spark.createDataFrame(rows, "symbol_id long, module_name string, module_path string, file_path string, kind int, qualified_name string, extra string").repartition(5)
    parts = profile.fallback_parts(symbols, 16).orderBy("first_id").collect()
    assert max(p["public_symbol_count"] for p in parts) <= 16 and {p["first_id"] % 16 for p in parts} == {0}
    for name in ("m", "n"):
        whole, own = profile.fallback_module(name, symbols).first(), [p for p in parts if p["module_name"] == name]
        assert "\n".join(p["summary"] for p in own) == whole["summary"]
        assert (sum(p["public_symbol_count"] for p in own), sum(p["header_count"] for p in own)) == (whole["public_symbol_count"], whole["header_count"])
    assert profile.fallback_parts(symbols.limit(0)).count() == 0
    # Nothing but the module's and the part's key decides where a row goes.
    assert "hashpartitioning(module_name" in profile.fallback_parts(symbols)._jdf.queryExecution().executedPlan().toString()


def test_percentiles_by_nearest_rank(spark):
    values = [float(v) for v in np.random.default_rng(1).permutation(24)] + [3.0, 3.0, None]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)], "k string, v double")
    got = {r["k"]: r for r in evaluation.nearest_rank_percentiles(df, "k", "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    s = sorted(v for v in values if v is not None)
    for name, q in (("p0", 0), ("p50", 0.5), ("p95", 0.95), ("p100", 1)):
        assert got["a"][name] == s[round((len(s) - 1) * q)] and got["b"][name] == 7.0


def test_metrics(spark):
    queries = spark.createDataFrame([(1, "semantic"), (2, "semantic"), (3, "structural"), (4, "auxiliary")], "query_id int, tool_group string")
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "hit"), (2, 7, "hit"), (3, 1, "no"), (4, 1, "hit")], "query_id int, rank int, name string")
    expected = spark.createDataFrame([(q, "hit") for q in (1, 2, 3, 4)], "query_id int, name string")
    got = {r["tool_group"]: r for r in evaluation.metrics(evaluation.first_ranks(ranked, expected, queries)).collect()}
    assert (got["semantic"]["precision_at_5"], got["semantic"]["recall_at_10"]) == (0.5, 1.0)
    assert got["structural"]["mrr"] == 0.0 and got["overall"]["queries"] == 3
    assert got["overall"]["mrr"] == pytest.approx((1 / 2 + 1 / 7) / 3)
    assert evaluation.precision_at(spark.createDataFrame([(1, 1, True), (1, 6, True), (1, 2, False)], "query_id int, rank int, relevant boolean")).first()["precision"] == 0.2


def largest_task(spark, action):
    """The most rows that a task read from a shuffle while ``action`` ran, from Spark's own status store."""
    store = spark.sparkContext._jsc.sc().statusStore()
    seen = {s.stageId() for s in _stages(store)}
    action()
    most = 0
    for s in _stages(store):
        if s.stageId() not in seen and s.numCompleteTasks():
            tasks = store.taskList(s.stageId(), s.attemptId(), 100_000)
            for k in range(tasks.size()):
                m = tasks.apply(k).taskMetrics()
                if m.isDefined():
                    most = max(most, m.get().shuffleReadMetrics().recordsRead())
    return most


def _stages(store):
    found = store.stageList(None, *(getattr(store, f"stageList$default${k}")() for k in (2, 3, 4, 5)))
    return [found.apply(k) for k in range(found.size())]


def test_a_hub_of_a_million_rows_is_in_no_task_whole(spark):
    """A key's million rows are merged as tables of a few."""
    rows = spark.range(0, 1_000_000, 1, 16).select(F.lit(7).alias("hit_id"), F.lit("callers").alias("direction"), F.concat(F.lit("n"), (F.col("id") * 7919 % 1_000_003).cast("string")).alias("qualified_name"), F.lit("f").alias("file_path"), F.col("id").alias("symbol_id"))
    few = spark.createDataFrame([(8, "callees", f"z{i}", "f", -i) for i in range(3)], "hit_id int, direction string, qualified_name string, file_path string, symbol_id long")
    got = []
    top = search.top_rows(rows.unionByName(few), ("hit_id", "direction"), ("qualified_name", "file_path", "symbol_id"), 4)
    most = largest_task(spark, lambda: got.extend(top.collect()))
    names = sorted(f"n{i * 7919 % 1_000_003}" for i in range(1_000_000))[:4]
    assert sorted((r["hit_id"], r["rank"], r["qualified_name"]) for r in got) == [(7, k, n) for k, n in enumerate(names, 1)] + [(8, k, f"z{k - 1}") for k in (1, 2, 3)]
    assert 0 < most < 5000


def test_relations_of_many_hits_are_many_tasks_work(spark):
    """Rows of few bytes are dealt by number, not by bytes: no task sorts much more than its share, and the rows are those of a plain ranking."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        symbols = spark.range(20_000).select(F.col("id").alias("symbol_id"), F.concat(F.lit("n"), F.col("id") * 7919 % 501).alias("qualified_name"), F.when(F.col("id") % 9 > 0, "f").alias("file_path"))
        calls = spark.range(300_000).select((F.col("id") % 19_997).alias("caller_symbol_id"), (F.col("id") * 31 % 20_011).alias("callee_symbol_id")).unionByName(spark.range(9).select(F.lit(5).alias("caller_symbol_id"), "id").toDF("caller_symbol_id", "callee_symbol_id"))
        calls = dealt(calls, "callee_symbol_id")  # as those of the registered queries come
        hits = symbols.where("symbol_id < 15000")
        got = []
        most = largest_task(spark, lambda: got.extend(search.related(hits, calls, symbols).select("hit_id", "direction", "rank", "symbol_id").collect()))
        assert 0 < most < 45_000
        names = {r[0]: (r[1], r[2] is not None, r[2] or "", r[0]) for r in symbols.collect()}
        near = {}
        for a, b in {tuple(r) for r in calls.collect()}:
            if a in names and b in names:
                near.setdefault((b, "callers"), []).append(a)
                near.setdefault((a, "callees"), []).append(b)
        wanted = [(h, d, k, i) for (h, d), ids in near.items() if h < 15_000 for k, i in enumerate(sorted(ids, key=names.get)[:4], 1)]
        assert sorted(map(tuple, got)) == sorted(wanted)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
