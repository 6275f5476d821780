"""Quality of ranked answers, and percentiles of latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import durable

# The group that each tool's queries count for.
TOOL_GROUPS = {"semantic_search": "semantic", "search": "semantic", "explain": "auxiliary", "module": "auxiliary", "callers": "structural", "deps": "structural"}


def first_ranks(ranked: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """(query columns, first_rank): the least rank (from 1) of an expected name; null without one.

    ``ranked``: query_id, rank, name. ``expected``: query_id, name.
    """
    hits = ranked.join(expected, ["query_id", "name"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return queries.join(hits, "query_id", "left")


def metrics(ranks: DataFrame) -> DataFrame:
    """Hit rates and mean reciprocal rank by group (``tool_group``), and ``overall`` of all but the auxiliary one."""
    rank = F.col("first_rank")
    measured = ranks.select(
        F.col("tool_group"),
        F.coalesce((rank <= 5).cast("double"), F.lit(0.0)).alias("p5"),
        F.coalesce((rank <= 10).cast("double"), F.lit(0.0)).alias("r10"),
        F.coalesce(1.0 / rank, F.lit(0.0)).alias("rr"),
    )
    both = measured.unionByName(measured.where("tool_group <> 'auxiliary'").withColumn("tool_group", F.lit("overall")))
    return both.groupBy("tool_group").agg(F.count("*").alias("queries"), F.avg("p5").alias("precision_at_5"), F.avg("r10").alias("recall_at_10"), F.avg("rr").alias("mrr"))


def precision_at(ranked: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, precision): of ranked rows (query_id, rank, relevant), those relevant among the first k, over k."""
    return ranked.groupBy("query_id").agg((F.sum(F.when((F.col("rank") <= k) & F.col("relevant"), 1).otherwise(0)) / F.lit(float(k))).alias("precision"))


def nearest_rank_percentiles(rows: DataFrame, key: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank: place (n - 1) * q, halves to even, of the sorted values; nulls don't count.

    Values are first counted by (key, value) and sorted by range over all tasks; running sums within a part start from what the
    parts before it hold. A key of many values is many parts: no group is gathered in one row or task.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    # Kept, as parts and sums have to come from one sorting.
    ranged = durable(counted.repartitionByRange(key, value).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.sum("_n").alias("_sum"))
    by = Window.partitionBy("_key")
    parts = parts.select("_key", "_of", (F.sum("_sum").over(by.orderBy("_of").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"), F.sum("_sum").over(by).alias("_all"))
    placed = ranged.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    own = Window.partitionBy(key, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_upto", F.col("_before") + F.sum("_n").over(own))
    picks = []
    for name, q in quantiles.items():
        at = F.greatest(F.lit(0), F.least(F.bround((F.col("_all") - 1) * F.lit(q)).cast("long"), F.col("_all") - 1))
        picks.append(F.min(F.when(F.col("_upto") > at, F.col(value))).alias(name))
    return placed.groupBy(key).agg(F.max("_all").alias("n"), *picks)
