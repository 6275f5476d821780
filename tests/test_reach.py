"""All pairs that a path joins, against a search from each node."""

import random

import pytest

from corpusloom.operators import reach

EDGES = "src long, dst long"


def by_hand(edges, max_depth=None, loops=False):
    out = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            out.setdefault(a, set()).add(b)
    pairs = set()
    for start in out:
        depth, seen, front = 0, set(), {start}
        while front and (max_depth is None or depth < max_depth):
            depth += 1
            front = {y for x in front for y in out.get(x, ())} - seen
            seen |= front
            pairs |= {(start, y, depth) for y in front if loops or y != start}
    return sorted(pairs)


def rows(df):
    assert df.columns == ["source", "target", "depth"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("chunk", "fan", "loops"), [(1 << 15, 10_000, False), (16, 3, True)])
def test_random_graphs(spark, chunk, fan, loops):
    draw = random.Random(chunk)
    edges = [(draw.randrange(70) * 10**12, draw.randrange(70) * 10**12) for _ in range(90)]
    edges += [(1, 2), (2, 1), (3, 3), (4, None), (None, 5), *edges[:9], *((7, k * 10**12) for k in range(40))]
    got = rows(reach.closure(spark.createDataFrame(edges, EDGES), loops=loops, chunk=chunk, fan=fan))
    assert got == by_hand(edges, loops=loops) and max(d for *_, d in got) > 4


def test_long_paths_and_a_limit(spark, monkeypatch):
    monkeypatch.setattr(reach, "MOST_FRAMES", 4)
    chain = [(i, i + 1) for i in range(14)] + [(20, 21), (21, 22), (22, 20)]
    df = spark.createDataFrame(chain, EDGES)
    got = rows(reach.closure(df, loops=True))
    assert got == by_hand(chain, loops=True) and (0, 14, 14) in got and (20, 20, 3) in got
    assert rows(reach.closure(df, max_depth=3)) == by_hand(chain, 3)


def test_nothing(spark):
    assert rows(reach.closure(spark.createDataFrame([(1, 1), (None, 2)], EDGES))) == []
    assert rows(reach.closure(spark.createDataFrame([(1, 2)], EDGES), max_depth=0)) == []
