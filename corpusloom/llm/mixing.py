"""Mixing sources to target weights by Poisson replication; DataFrame operations only.

A source of n documents with target weight w is to give w * total documents, so each of its documents repeats at
the mean rate w * total / n. The number of copies of a document is drawn from the Poisson distribution of that
mean by inverting its cumulative distribution at a uniform number hashed from the seed and doc_id: it is the number of
cumulative probabilities that do not exceed it. Copies are exploded and shuffled by another hash, so order
and place of the output are random yet the same at every run.

Rates above ``SPLIT`` are drawn as sums of independent parts of at most that mean (a sum of Poisson numbers is one),
since exp(-rate) would underflow. A row carries its source's rate, one number, until its count is drawn; nothing else is
joined to the text.

Defined cases: a null source is a source of its own; a null doc_id hashes as the empty string. Rows that share a doc_id
get equal counts. Sources without a target weight are dropped if weights are given. Columns named mix_copy or
mix_order are replaced; all others are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import shuffle_partitions

#: Default targets: a source's weight grows as this power of its size.
ALPHA = 0.5
SEED = "mix-1"
SPLIT = 200.0
#: Names and rates of the sources are broadcast up to so many bytes; beyond, they are joined by source and salt.
BROADCAST_BYTES = 4 << 20
SALTS = 64
#: Stored bytes of documents that one partition of the shuffle should take at most.
PARTITION_BYTES = 64 << 20


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash of the parts."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(rate: Column, u: Column) -> Column:
    """How many of the Poisson distribution's cumulative probabilities do not exceed ``u``; summed up to where they round to 1."""
    first = F.exp(-rate)
    step = F.struct(first.alias("p"), first.alias("c"), (first <= u).cast("int").alias("n"))

    def following(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        c = a["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), (a["n"] + (c <= u).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")), step, following, lambda a: a["n"])


def source_rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", alpha: float = ALPHA, size: float = 1.0) -> DataFrame:
    """Each source's documents, target weight and mean rate of repetition; ``size``: of the output, relative to the input."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        wanted = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        wanted = counts.join(weights.select(F.col("source").alias("of"), F.col("weight").cast("double").alias("w")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    all_w, all_n = wanted.agg(F.coalesce(F.sum("w"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = F.col("w") / F.lit(float(all_w))
    return wanted.select("source", "n", weight.alias("weight"), (weight * F.lit(float(all_n)) * F.lit(size) / F.col("n")).alias("rate"))


class PoissonMix:
    """``mix(docs)``: documents repeated to target weights and shuffled; see the module."""

    def __init__(self, alpha: float = ALPHA, size: float = 1.0, seed: str = SEED, broadcast_bytes: int = BROADCAST_BYTES) -> None:
        self.alpha, self.size, self.seed, self.broadcast_bytes = alpha, size, seed, broadcast_bytes

    def mix(self, docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
        """The columns of ``docs``, mix_copy (from 1) and mix_order (the shuffle's key)."""
        docs = docs.drop("mix_copy", "mix_order")
        names = docs.columns
        rates = source_rates(docs, weights, source_col, self.alpha, self.size).select("source", "rate")
        held = docs.select(F.struct("*").alias("doc"))
        source, doc_id = F.col("doc")[source_col], F.col("doc")[id_col]
        of = source.eqNullSafe(F.col("source"))
        if rates.agg(F.coalesce(F.sum(F.coalesce(F.length(F.col("source").cast("string")), F.lit(0)) + 32), F.lit(0))).first()[0] <= self.broadcast_bytes:
            joined = held.join(F.broadcast(rates), of)
        else:
            # A source's rows are dealt over SALTS keys, so that no task gets a source whole.
            salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = held.withColumn("own", F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")).join(salted, of & (F.col("own") == F.col("salt")))
        parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / SPLIT)).cast("int")

        def drawn(k: Column) -> Column:
            return poisson(F.col("rate") / parts, uniform(F.lit(self.seed), k, doc_id))

        copies = F.aggregate(F.transform(F.sequence(F.lit(1), parts), drawn), F.lit(0), lambda a, b: a + b)
        copied = joined.select("doc", copies.alias("copies")).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("mix_copy"))
        order = F.md5(F.concat_ws("|", F.lit(self.seed), F.lit("order"), F.coalesce(doc_id.cast("string"), F.lit("")), F.col("mix_copy").cast("string")))
        # Rows are dealt and sorted by a number, 60 bits of their key.
        key = F.conv(F.substring("mix_order", 1, 15), 16, 10).cast("long")
        keyed = copied.select("doc", "mix_copy", order.alias("mix_order")).withColumn("key", key)
        n = partitions_for(docs, self.size)
        dealt = keyed.repartition(n, "key") if n else keyed.repartition("key")
        return dealt.sortWithinPartitions("key").select(*(F.col("doc")[c].alias(c) for c in names), "mix_copy", "mix_order")


def partitions_for(docs: DataFrame, times: float = 1.0) -> int | None:
    """Partitions for ``times`` the stored size of ``docs`` at ``PARTITION_BYTES`` each, if the session's number is too small for it."""
    stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # A plan without figures reports a size beyond all measure.
    n = -(-int(stored * times) // PARTITION_BYTES) if stored < 1 << 60 else 0
    return n if n > shuffle_partitions(docs.sparkSession) else None
