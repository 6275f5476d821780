"""Blocks of queries against tiles, and the index: exact where asked to be, near enough where not, and what it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import topk
from corpusloom.plans.facade import Engine
from corpusloom.sources.vector_index import Model, VectorIndex, closest, cuts_of, k_means
from corpusloom.sources.vector_store import PAYLOAD

QUERIES, CORPUS = "query_id long, vector array<double>", "id long, vector array<double>"


def by_hand(queries, corpus, k, others=False):
    def cosine(a, b):
        a, b = (None if v is None or any(x is None for x in v) else np.array(v, float) for v in (a, b))
        if a is None or b is None or len(a) != len(b) or not np.isfinite([*a, *b]).all() or not a.any() or not b.any():
            return 0.0
        return round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9) + 0.0

    out = []
    for q, v in queries:
        scored = sorted((-cosine(v, w), i) for i, w in corpus if i is not None and not (others and i == q))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def clustered(n, seed, dimension=12, clusters=15):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, dimension))
    return [(int(i), [float(np.float32(x)) for x in centres[i % clusters] + 0.35 * draw.normal(size=dimension)]) for i in range(n)]


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-9)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_blocks_give_what_pairs_give(spark, broadcast_bytes):
    corpus = clustered(300, 1) + [(900, None), (901, []), (902, [0.0] * 12), (903, [float("nan")] * 12), (904, [1.0, 2.0]), (905, [None] * 12), (None, [1.0] * 12)]
    corpus += [(1000 + i, corpus[i][1]) for i in range(20)] + corpus[:3]
    queries = [*{i: v for i, v in corpus if i is not None and i % 7 == 0 and i < 300}.items()] + [(904, [1.0, 2.0]), (-5, None), (-6, [0.0] * 12)]
    q, c = spark.createDataFrame(queries, QUERIES), spark.createDataFrame(corpus, CORPUS).repartition(5)
    for others in (False, True):
        same(rows(topk.nearest(q, c, 4, others, broadcast_bytes, query_rows=8, tile_rows=16)), by_hand(queries, corpus, 4, others))
    same(rows(topk.nearest(q.limit(2), c.where("id in (3, 4)"), 9, broadcast_bytes=broadcast_bytes)), by_hand(queries[:2], [x for x in corpus if x[0] in (3, 4)], 9))
    assert rows(topk.nearest(q.limit(0), c, 3, broadcast_bytes=broadcast_bytes)) == rows(topk.nearest(q, c.limit(0), 3, broadcast_bytes=broadcast_bytes)) == []


def test_no_pair_is_a_row(spark):
    q, c = spark.createDataFrame(clustered(40, 2), QUERIES), spark.createDataFrame(clustered(400, 2), CORPUS)
    for limit in (0, 1 << 20):
        plan = topk.nearest(q, c, 3, broadcast_bytes=limit)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan
    assert "Exchange" not in plan.split("MapInArrow")[-1]  # the corpus is read where it lies


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_groups_meet_their_own_vectors_only(spark, broadcast_bytes):
    corpus = clustered(120, 3)
    c = spark.createDataFrame([(i, v, i % 4) for i, v in corpus], CORPUS + ", grp int")
    q = spark.createDataFrame([(i, v, [i % 4, 3, 99]) for i, v in corpus[:20]], QUERIES + ", groups array<int>")
    want = sorted(r for i, v in corpus[:20] for r in by_hand([(i, v)], [x for x in corpus if x[0] % 4 in (i % 4, 3)], 5))
    same(rows(topk.nearest(q, c, 5, broadcast_bytes=broadcast_bytes, query_rows=3)), want)


def test_centres_and_codes():
    x = np.random.default_rng(4).normal(size=(500, 6))
    assert np.array_equal(k_means(x, 7), k_means(x, 7)) and len(k_means(x[:3], 7)) == 3
    assert np.allclose(np.linalg.norm(k_means(x, 7, unit=True), axis=1), 1)
    assert np.array_equal(closest(x, x[:9]), np.argmin(((x[:, None] - x[:9]) ** 2).sum(axis=2), axis=1))
    assert cuts_of(7, 3) == [(0, 2), (2, 4), (4, 7)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    model = Model(k_means(unit, 5, unit=True), [k_means(unit[:, a:b], 16) for a, b in cuts_of(6, 3)])
    codes, off = model.encode(unit)
    for q in unit[:20]:
        about = sum(t[codes[:, p]] for p, t in enumerate(model.tables(q)))
        assert (np.abs(unit @ q - about) <= off + 1e-9).all()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    corpus = clustered(3000, 5, dimension=16, clusters=60)
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [1.0, 2.0]), (None, corpus[0][1]), (5003, corpus[7][1])]
    index = VectorIndex(spark, str(tmp_path_factory.mktemp("index")), parts=8)
    df = spark.createDataFrame([(i, v, f"n{i}") for i, v in corpus + odd], CORPUS + ", name string")
    assert index.build(df) == 3001
    return index, corpus + [odd[-1]]


def test_exact_search_equals_a_full_scan(index):
    index, corpus = index
    for q in (7, 100, 2999):
        want = by_hand([(q, corpus[q][1])], corpus, 10)
        got = index.search_rows(corpus[q][1], 10, exact=True).collect()
        assert [r["id"] for r in got] == [w[2] for w in want] and [r["score"] for r in got] == pytest.approx([w[3] for w in want], abs=2e-9)
        assert got[0]["name"] == f"n{got[0]['id']}"
    away = [float(x) for x in np.random.default_rng(9).normal(size=16)]
    assert [r["id"] for r in index.search_rows(away, 25, probes=1, exact=True).collect()] == [w[2] for w in by_hand([(0, away)], corpus, 25)]


def test_many_exact_searches_equal_a_full_scan(spark, index):
    index, corpus = index
    queries = [c for c in corpus if c[0] % 100 == 0] + [(-1, [1.0, 2.0]), (-2, [0.0] * 16)]
    q = spark.createDataFrame(queries, QUERIES)
    same(rows(index.search_many(q, 6, probes=2, exact=True, others=True)), by_hand(queries[:-2], corpus, 6, True))


def test_recall_of_probed_cells(spark, index):
    index, corpus = index
    q = spark.createDataFrame([c for c in corpus if c[0] % 100 == 0], QUERIES)
    exact = topk.nearest(q, index.rows().select("id", "vector"), 10)
    assert topk.recall(exact, exact) == 1.0
    assert topk.recall(index.search_many(q, 10), exact) >= 0.9
    single = [len({r["id"] for r in index.search_rows(corpus[i][1], 10).collect()} & {r["id"] for r in exact.where(f"query_id = {i}").collect()}) for i in (100, 700, 1500, 2200)]
    assert sum(single) >= 0.9 * 40


def test_a_search_reads_the_probed_cells_and_no_vectors_of_others(index):
    index, corpus = index
    q = np.array(corpus[3][1])
    cells = index.cells_for(q / np.linalg.norm(q), 3)
    assert len(cells) == 3 < len(index._open()[2])
    scan = index.candidates(q, cells)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "vector" not in plan.split("ReadSchema")[1]
    read = index.rows().where(F.col("cell").isin(cells))
    folders = {f.split("/cell=")[1].split("/")[0] for f in read.inputFiles()}
    assert len(index.rows().inputFiles()) > 3 and {int(r[0]) for r in scan.select("cell").distinct().collect()} == set(cells) <= {int(f) for f in folders}


def test_a_new_build_replaces_the_old(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path), cells=3)
    assert not index.ready and index.search([1.0], 3) == [] and index.search_many(spark.createDataFrame([(1, [1.0])], QUERIES), 2).collect() == []
    assert index.build(spark.createDataFrame(clustered(50, 6), CORPUS)) == 50 and index.ready
    assert index.build(spark.createDataFrame([(1, [3.0, 4.0]), (2, [4.0, 3.0])], CORPUS)) == 2
    assert [(r["id"], r["score"]) for r in index.search_rows([3.0, 4.0], 5).collect()] == [(1, 1.0), (2, 0.96)]
    assert index.search_rows([0.0, 0.0], 5) is None and index.search_rows([1.0], 5) is None and len(list(tmp_path.glob("build-*"))) == 1
    assert index.build(spark.createDataFrame([(1, None)], CORPUS)) == 0 and not index.ready


def test_an_engine_asks_the_index(spark, tmp_path):
    """The index stands where a vector store may: its nearest symbols come first."""
    from corpusloom.plans.index import Indexer
    from corpusloom.sources.store import SnapshotStore

    (tmp_path / "tree/lib").mkdir(parents=True)
    (tmp_path / "tree/lib/a.cpp").write_text("namespace lib {\nint open_door(int x) { return x; }\nint close_window(int x) { return open_door(x); }\n}\n")
    indexer = Indexer(SnapshotStore(spark, str(tmp_path / "store")), str(tmp_path / "tree"))
    indexer.index()
    vectors = indexer.store.read()["vectors"]
    index = VectorIndex(spark, str(tmp_path / "index"))
    assert index.build(vectors.withColumn("id", F.col("symbol_id")), "id", "embedding") == vectors.count()
    answer = Engine(indexer, vector_store=index).load().handle("POST", "/search", '{"query": "close window"}')
    assert answer["status"] == 200 and answer["body"]["symbols"][0]["qualified_name"] in ("lib::close_window", "lib")
    found = index.search([float(x) for x in vectors.where("qualified_name = 'lib::open_door'").first()["embedding"]], 1)
    assert found[0][0]["qualified_name"] == "lib::open_door" and set(found[0][0]) == set(PAYLOAD)


@pytest.mark.parametrize("most", [16, 2])
def test_changes_equal_a_full_scan(spark, tmp_path, monkeypatch, most):
    from corpusloom.sources import vector_index

    monkeypatch.setattr(vector_index, "MAX_PARTS", most)
    index = VectorIndex(spark, str(tmp_path), parts=4)
    held = dict(clustered(200, 11))
    table = lambda rows: spark.createDataFrame([(i, v, f"n{i}") for i, v in rows], CORPUS + ", name string")
    assert index.update(table(held.items())) == 200
    changed = {i: v for i, v in clustered(260, 12) if i >= 180}  # twenty of them are there already
    gone = [3, 5, 185, 999]
    held = {i: v for i, v in (held | changed).items() if i not in gone or i == 185}
    assert index.update(table([*changed.items(), (777, None)]), spark.createDataFrame([(i,) for i in gone if i != 185], "id long")) == len(held)
    held = {i: v for i, v in held.items() if i != 190}
    assert index.update(table([]), spark.createDataFrame([(190,)], "id long")) == len(held)
    corpus = list(held.items())
    queries = [c for c in corpus if c[0] % 20 == 0]
    same(rows(index.search_many(spark.createDataFrame(queries, QUERIES), 5, probes=2, exact=True)), by_hand(queries, corpus, 5))
    got = index.search_rows(held[200], 6, probes=1, exact=True).collect()
    assert [r["id"] for r in got] == [w[2] for w in by_hand([(0, held[200])], corpus, 6)] and got[0]["name"] == "n200"
    assert len(index._current()["parts"]) < most and len(list(tmp_path.glob("part-*"))) == len(index._current()["parts"])
    if most == 16:
        plan = index.candidates(np.array(held[200]), [1, 2])._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("cell") and "vector" not in index.candidates(np.array(held[200]), [1, 2])._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
