import random

import pytest

from corpusloom.llm.components import connected_components
from tests.llm.brute import components


@pytest.mark.parametrize("one_task", [10**6, 0])
@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components(spark, one_task, shape):
    rng = random.Random(3)
    n = 60
    edges = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(35)], "chain": [(i + 1, i) for i in range(30)], "star": [(0, i) for i in range(1, 30)] + [(40, 41)], "empty": []}[shape]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = {r["node"]: r["label"] for r in connected_components(df, one_task).collect()}
    wanted = components(n, edges)
    assert got == {x: wanted[x] for e in edges for x in e}
