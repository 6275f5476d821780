"""Names resolved by a filter and salts equal names resolved one by one; what moves, and where hot names go."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import resolve
from tests.test_search import largest_task

REFS, SYMBOLS = "ref_id long, source_name string, target string", "symbol_id long, qualified_name string"


def by_hand(refs, symbols):
    exact, short = {}, {}
    for i, q in symbols:
        if q is not None:
            exact[q] = min(exact.get(q, i), i)
            short[q.rpartition("::")[2]] = min(short.get(q.rpartition("::")[2], i), i)
    out = []
    for ref, source, target in refs:
        if "::" in target:
            found = exact.get(target)
        else:
            parts = source.split("::")
            names = ["::".join(parts[:k]) + "::" + target for k in range(len(parts) - 1, 0, -1)] + [target]
            found = next((exact[n] for n in names if n in exact), short.get(target))
        out.append((ref, found))
    return sorted(out)


def made(n, seed):
    draw = random.Random(seed)
    word = lambda k=12: draw.choice("abcdefghijkl"[:k])
    symbols = [(i, "::".join(word() for _ in range(draw.randint(1, 4)))) for i in range(200)] + [(900, "hot::push"), (901, None)]
    refs = [(i, "::".join(word() for _ in range(draw.randint(1, 4))), draw.choice(["push", word(), f"{word()}::{word()}", "nothing"])) for i in range(n)]
    return refs, symbols


@pytest.mark.parametrize("hot_rows", [resolve.HOT_ROWS, 10])
def test_each_reference_resolves_as_by_hand(spark, hot_rows):
    refs, symbols = made(400, hot_rows)
    got = resolve.resolve_names(spark.createDataFrame(refs, REFS), spark.createDataFrame(symbols, SYMBOLS), hot_rows)
    assert got.columns == ["ref_id", "source_name", "target", "resolved_id"]
    assert sorted((r["ref_id"], r["resolved_id"]) for r in got.collect()) == by_hand(refs, symbols)


def test_without_a_filter_nothing_changes(spark, monkeypatch):
    refs, symbols = made(100, 3)
    monkeypatch.setattr(resolve, "MOST_BITS", 1)
    df = spark.createDataFrame(symbols, SYMBOLS)
    assert resolve.name_filter(df) is None
    assert sorted((r["ref_id"], r["resolved_id"]) for r in resolve.resolve_names(spark.createDataFrame(refs, REFS), df).collect()) == by_hand(refs, symbols)


def test_the_filter_keeps_known_names_and_few_others(spark):
    known = spark.range(3000).select(F.concat(F.lit("k::"), "id").alias("qualified_name"))
    bits, packed = resolve.name_filter(known)
    assert 3000 * 2.5 < np.unpackbits(packed).sum() <= 9000 and len(packed) == 1 << (bits - 3)
    both = known.unionByName(spark.range(20_000).select(F.concat(F.lit("u::"), "id").alias("qualified_name"))).withColumn("ref", F.lit(1))
    kept = resolve.maybe_known(both, (bits, packed))
    assert kept.columns == both.columns and kept.where("qualified_name like 'k::%'").count() == 3000
    assert kept.where("qualified_name like 'u::%'").count() < 600
    assert resolve.maybe_known(both.limit(0), (bits, packed)).collect() == []
    assert np.unpackbits(resolve.name_filter(known.limit(0))[1]).sum() == 0


def test_few_candidates_are_shuffled(spark):
    """Deep scopes make many candidates; those that no symbol has don't reach the exchange."""
    refs = spark.range(5000).select(F.col("id").alias("ref_id"), F.concat(F.lit("a::b::c::d::e::f::g::h"), (F.col("id") % 50).cast("string")).alias("source_name"), F.concat(F.lit("t"), (F.col("id") % 40).cast("string")).alias("target"))
    symbols = spark.range(40).select(F.col("id").alias("symbol_id"), F.concat(F.lit("a::b::t"), "id").alias("qualified_name"))
    candidates = refs.select("ref_id", F.posexplode(X.candidate_names(F.col("source_name"), F.col("target"))).alias("pos", "qualified_name"))
    likely = resolve.maybe_known(candidates, resolve.name_filter(symbols))
    assert candidates.count() == 5000 * 8 and 5000 <= likely.count() < 1.2 * 5000
    assert {r["resolved_id"] == r["ref_id"] % 40 for r in resolve.resolve_names(refs, symbols).collect()} == {True}


def test_a_hot_name_is_many_tasks_work(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        refs = spark.range(0, 200_000, 1, 8).select(F.col("id").alias("ref_id"), F.lit("x::y").alias("source_name"), F.when(F.col("id") % 3 > 0, "push").otherwise(F.concat(F.lit("r"), "id")).alias("target"))
        symbols = spark.createDataFrame([(1, "hot::push"), (2, "x::pull")], SYMBOLS)
        found = []
        job = lambda hot: largest_task(spark, lambda: found.append(resolve.resolve_names(refs, symbols, hot).groupBy("resolved_id").count().collect()))
        whole, split = job(10**9), job(5000)
        assert whole > 130_000 > 45_000 > split
        assert {r[0]: r[1] for r in found[0]} == {r[0]: r[1] for r in found[1]} == {1: 133_333, None: 66_667}
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_references_of_few_bytes_are_many_tasks_work_and_made_once(spark):
    """All references lie in one partition; their candidates are made by many tasks, and each reference is read twice: for its candidates and for the result."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    refs = spark.range(0, 8000, 1, 1).select(F.col("id").alias("ref_id"), F.concat(F.lit("a::b::c"), "id").alias("source_name"), F.concat(F.lit("t"), F.col("id") % 40).alias("target"))
    symbols = spark.range(40).select(F.col("id").alias("symbol_id"), F.concat(F.lit("z::t"), "id").alias("qualified_name"))
    got = resolve.resolve_names(refs.mapInArrow(seen, refs.schema), symbols).collect()
    assert {r["resolved_id"] == r["ref_id"] % 40 for r in got} == {True} and len(got) == 8000
    assert reads.value <= 16_000


def test_references_that_share_an_id_or_have_none(spark):
    refs = [(1, "a::f", "x"), (1, "a::f", "y"), (None, "a::f", "x"), (2, None, "y"), (3, "a::f", None), (4, "a::f", "=x"), (1, "a::f", "x")]
    symbols = [(10, "q::x"), (11, "q::y"), (12, "~x"), (13, "b::=x"), (14, "")]
    got = resolve.resolve_names(spark.createDataFrame(refs, REFS), spark.createDataFrame(symbols, SYMBOLS)).collect()
    assert sorted((str(r["ref_id"]), str(r["target"]), r["resolved_id"]) for r in got) == [("1", "x", 10), ("1", "x", 10), ("1", "y", 11), ("2", "y", 11), ("3", "None", None), ("4", "=x", 13), ("None", "x", 10)]


def test_more_names_than_the_filter_likes_still_pass_one(spark, monkeypatch):
    monkeypatch.setattr(resolve, "MOST_BITS", 15)
    known = spark.range(6000).select(F.concat(F.lit("k::"), "id").alias("qualified_name"))
    bits, packed = resolve.name_filter(known)
    assert bits == 15 and resolve.maybe_known(known, (bits, packed)).count() == 6000
