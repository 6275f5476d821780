import hashlib
import math
import re

import pytest

from corpusloom.queries import QUERIES, SQL
from tests.compare import connection, same_rows


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    same_rows(QUERIES[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["symbol_id", "module_name", "qualified_name", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_hash_embed_search_by_hand(spark, sf):
    """The embedder and the ranking stated plainly, one text at a time."""

    def embed(text):
        v = [0.0] * 128
        for token in re.findall(r"[A-Za-z0-9_]+", text):
            for weight, salt in ((1.0, ""), (0.5, "secondary:"), (0.25, "tertiary:")):
                d = hashlib.blake2b((salt + token.lower()).encode(), digest_size=16).digest()
                v[int.from_bytes(d[:4], "big") % 128] += weight * (1 - 2 * (d[4] & 1))
        return v

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0

    query = embed("the and of in que de la")
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    best = sorted(((cosine(embed(r["text"] or ""), query), r["item_id"]) for r in rows), key=lambda x: (-x[0], str(x[1])))[:20]
    got = [(r["score"], r["symbol_id"]) for r in QUERIES["hash_embed_search"](spark, sf).collect()]
    assert [s for s, _ in got] == pytest.approx([s for s, _ in best], abs=1e-5)
    assert {i for s, i in got if s > best[-1][0] + 1e-5} == {i for s, i in best if s > best[-1][0] + 1e-5}


def test_checkpoints_need_a_shared_folder_outside_local_mode():
    from types import SimpleNamespace as N

    from corpusloom.session import checkpoint_folder

    class Unset:
        def isEmpty(self):
            return True

    jsc = N(sc=lambda: N(getCheckpointDir=Unset))
    cluster = N(sparkContext=N(master="spark://host:7077", getConf=lambda: {}, _jsc=jsc))
    with pytest.raises(RuntimeError, match="share"):
        checkpoint_folder(cluster)
