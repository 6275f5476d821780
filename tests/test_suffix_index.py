"""Suffix lookups equal a scan, and read a suffix's range only."""

import random

import numpy as np
import pytest

from corpusloom.sources import suffix_index
from corpusloom.sources.suffix_index import Least, SuffixIndex, past

SYMBOLS = "symbol_id long, qualified_name string, kind string"


def made(n, seed):
    draw = random.Random(seed)
    words = ["run", "go", "überzug", "Ünter", "a😀", "x", "operator()", "~Gate", "run_all", "", "zebra", "mango"]
    return [(i, "::".join(draw.choice(words) for _ in range(draw.randint(1, 4))), "f") for i in range(n)]


def find_by_hand(name, symbols):
    exact = [i for i, q, _ in symbols if q == name]
    scoped = sorted((len(q), q.encode(), i) for i, q, _ in symbols if q.endswith("::" + name))
    ends = [i for i, q, _ in symbols if q.endswith(name)]
    if exact:
        return min(exact)
    if "::" not in name and scoped:
        return scoped[0][2]
    return min(ends, default=None)


def test_least_of_ranges():
    draw = np.random.default_rng(1)
    values = draw.permutation(257)
    start = draw.integers(0, 257, 500)
    end = start + 1 + draw.integers(0, 257 - start)
    assert np.array_equal(Least(values).of(start, end), [a + values[a:b].argmin() for a, b in zip(start, end)])
    assert Least(np.array([5])).of(np.array([0]), np.array([1])).tolist() == [0]


def test_past():
    assert past(b"ab") == b"ac" and past(b"a\xff") == b"b" and past(b"\xff") is None and past(b"") is None


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    symbols = made(600, 2) + [(10_000 + i, "hot::name", "f") for i in range(300)]
    index = SuffixIndex(spark, str(tmp_path_factory.mktemp("names")), file_rows=60)
    assert index.build(spark.createDataFrame([*symbols, (None, "no::id", "f"), (77_777, None, "f")], SYMBOLS)) >= 12
    return index, symbols


NAMES = ["run", "go", "n", "name", "hot::name", "nobody", "überzug", "zug", "😀", "(", "::run", "all", "x::x", "", "Gate", "~Gate", "mango::zebra", "ebra"]


def test_many_lookups_equal_a_scan(spark, index, monkeypatch):
    index, symbols = index
    want = {n: find_by_hand(n, symbols) for n in NAMES}
    wanted = [(k, n) for k, n in enumerate([*NAMES, *NAMES[:4], None])]
    for rows in (50_000, 2):
        monkeypatch.setattr(suffix_index, "BLOCK_ROWS", rows)
        got = index.find_many(spark.createDataFrame(wanted, "ref long, name string")).collect()
        assert sorted((r["ref"], r["name"], r["found_id"]) for r in got if r["name"] is not None) == [(k, n, want[n]) for k, n in wanted if n is not None]
        assert [r["found_id"] for r in got if r["name"] is None] == [None]


def test_one_lookup_equals_many(index):
    index, symbols = index
    for n in NAMES:
        assert [r["symbol_id"] for r in index.find(n).collect()] == [x for x in [find_by_hand(n, symbols)] if x is not None], n
    ends = index.ending("go").collect()
    assert sorted((r["symbol_id"], r["qualified_name"], r["kind"]) for r in ends) == sorted(s for s in symbols if s[1].endswith("go"))


def test_a_lookup_reads_its_range_only(spark, index):
    index, symbols = index
    files = len(index._open()[1])
    for suffix, most in (("zebra", 4), ("::zebra", 4), ("mango::zebra", 2), ("nobody at all", 1)):
        assert len(index.files_for(suffix)) <= most < files
        assert {r[0] for r in index.rows().where(f"endswith(qualified_name, '{suffix}')").select("file").distinct().collect()} <= set(index.files_for(suffix))
    assert len(index.files_for("")) == files
    # A name that many symbols have is several files'.
    assert len(index.files_for("hot::name")) >= 4
    plan = index.ending("zebra")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(rev" in plan and "PartitionFilters: [file" in plan
    for suffix in ("zebra", "nobody at all"):
        ends = index.ending(suffix)
        ends.collect()
        scan = ends._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        assert scan.metrics().apply("numFiles").value() == len(index.files_for(suffix))


def test_empty_and_replaced(spark, tmp_path):
    index = SuffixIndex(spark, str(tmp_path))
    with pytest.raises(RuntimeError):
        index.find("x")
    none = spark.createDataFrame([], SYMBOLS)
    index.build(none)
    assert index.find("x").collect() == [] and index.ending("").collect() == []
    assert [r["found_id"] for r in index.find_many(spark.createDataFrame([(1, "x")], "ref long, name string")).collect()] == [None]
    assert index.build(spark.createDataFrame([(1, "a::x", "f")], SYMBOLS)) == 1
    assert index.find("x").first()["symbol_id"] == 1 and len(list(tmp_path.glob("build-*"))) == 1
    assert index.find_many(spark.createDataFrame([], "ref long, name string")).collect() == []


def test_an_engine_finds_names_by_the_index(spark, tmp_path):
    from corpusloom.plans.facade import Engine
    from corpusloom.plans.index import Indexer
    from corpusloom.sources.store import SnapshotStore

    (tmp_path / "tree/lib").mkdir(parents=True)
    (tmp_path / "tree/lib/a.cpp").write_text("namespace lib {\nint open(int x) { return x; }\nint shut(int x) { return open(x); }\n}\n")
    indexer = Indexer(SnapshotStore(spark, str(tmp_path / "store")), str(tmp_path / "tree"))
    indexer.index()
    index = SuffixIndex(spark, str(tmp_path / "names"))
    index.build(indexer.store.read()["symbols"])
    plain, indexed = Engine(indexer).load(), Engine(indexer, names=index).load()
    for name in ("open", "lib::open", "pen", "nobody", "lib"):
        assert plain.handle("POST", "/callers", f'{{"name": "{name}"}}') == indexed.handle("POST", "/callers", f'{{"name": "{name}"}}')
