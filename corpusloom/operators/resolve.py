"""Names to symbols: the innermost scope that has the name wins, then any symbol of that short name.

A reference may mean as many names as its scope is deep, and most of those exist nowhere. A Bloom filter of the known names, built by partial aggregates
and of bounded size, passes over the candidates before they are shuffled, so that little more moves than what resolves. A name that very many
references share would be one task's work in a join: such names are counted first, and their rows dealt over salts, those of the other side copied to each.

A short name is one candidate more, behind all others, so one join finds both kinds. Candidates are made once, by many tasks however few bytes the
references have, and kept for the count and the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.session import dealt, durable, prepare

#: Rows of one name that a task may get.
HOT_ROWS = 1_000_000
#: log2 of the filter's bits at most (16 MB), and bits to a name, fewer where there are more names; with less than ``LEAST_BITS`` nothing is filtered.
MOST_BITS, NAME_BITS, LEAST_BITS = 27, 12, 4
#: What keys begin with: whole names, and short ones.
_WHOLE, _SHORT = "=", "~"
_HALF = (1 << 32) - 1


def _places(digest: Column, bits: int) -> list[Column]:
    """Three places of a name in a filter of 2 ** bits bits, from its 64-bit hash."""
    low, high = digest.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(digest, 32)
    return [(low + high * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(3)]


def name_filter(names: DataFrame, column: str = "qualified_name") -> tuple[int, np.ndarray] | None:
    """(log2 of its bits, bits packed in bytes) of a Bloom filter of distinct names; None if there are too many."""
    n = names.count()
    if n * LEAST_BITS > 1 << MOST_BITS:
        return None
    bits = min(MOST_BITS, max(15, (max(1, n) * NAME_BITS - 1).bit_length()))
    places = names.select(F.explode(F.array(*_places(F.xxhash64(column), bits))).alias("at"))
    # Pages of 2 ** 15 bits, made map-side first: 2 ** (bits - 3) bytes in all.
    page = F.bitmap_bucket_number("at")
    pages = places.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in pages.collect():
        # Pages count from 1; page 0 holds place 0 alone.
        held = np.frombuffer(r["bits"], np.uint8)
        at = np.flatnonzero(np.unpackbits(held, bitorder="little")) + (max(0, r["page"] - 1) << 15) + (r["page"] > 0)
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits, out


def maybe_known(candidates: DataFrame, known: tuple[int, np.ndarray], column: str = "qualified_name") -> DataFrame:
    """``candidates`` without those whose name the filter has not."""
    spark = candidates.sparkSession
    prepare(spark)
    bits, packed = known
    held = spark.sparkContext.broadcast(packed)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            digest = batch.columns[-1].to_numpy(zero_copy_only=False).view(np.uint64)
            low, high = digest & np.uint64(_HALF), digest >> np.uint64(32)
            for k in range(3):
                at = (low + high * np.uint64(k)) & np.uint64((1 << bits) - 1)
                good &= (held.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(good))

    return candidates.select("*", F.xxhash64(column).alias("_digest")).mapInArrow(keep, candidates.schema)


def join_hot(left: DataFrame, right: DataFrame, column: str, by: str, how: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` joined with ``right``, where ``column`` is unique; names of ``hot_rows`` rows of ``left`` or more are dealt over salts of ``by``."""
    counts = left.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") >= hot_rows)
    # At most one row for each ``hot_rows`` rows of ``left``.
    hot = durable(counts.select(column, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")))
    if hot.isEmpty():
        return left.join(right, column, how)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(F.broadcast(hot), column, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_salts")
    copied = right.join(F.broadcast(hot), column, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copied, [column, "_salt"], how).drop("_salt")


def resolve_names(references: DataFrame, symbols: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each reference (ref_id, source_name, target) with ``resolved_id``, null if nothing has the name.

    ``symbols``: (symbol_id, qualified_name); of several with one name the smallest id counts. Unqualified
    targets that no scope has fall back to the first symbol of that short name.
    """
    named = symbols.where("qualified_name is not null")
    keys = (F.concat(F.lit(_WHOLE), "qualified_name"), F.concat(F.lit(_SHORT), X.short_name(F.col("qualified_name"))))
    known = named.select(F.explode(F.array(*keys)).alias("key"), "symbol_id").groupBy("key").agg(F.min("symbol_id").alias("found_id"))
    known = durable(known)
    whole = F.transform(X.candidate_names(F.col("source_name"), F.col("target")), lambda c: F.concat(F.lit(_WHOLE), c))
    short = F.when(~F.contains("target", F.lit("::")), F.array(F.concat(F.lit(_SHORT), "target"))).otherwise(F.array().cast("array<string>"))
    candidates = dealt(references.select("ref_id", "source_name", "target"), "ref_id").select("ref_id", "target", F.posexplode(F.concat(whole, short)).alias("pos", "key"))
    sieve = name_filter(known, "key")
    likely = durable(candidates if sieve is None else maybe_known(candidates, sieve, "key"))
    first = join_hot(likely, known, "key", "ref_id", "inner", hot_rows).groupBy("ref_id", "target").agg(F.min_by("found_id", "pos").alias("resolved_id"))
    first = first.select(F.col("ref_id").alias("_ref"), F.col("target").alias("_target"), "resolved_id")
    same = F.col("ref_id").eqNullSafe(F.col("_ref")) & F.col("target").eqNullSafe(F.col("_target"))
    return references.join(first, same, "left").select(*references.columns, "resolved_id")


def touched(references: DataFrame, names: DataFrame) -> DataFrame:
    """Symbols with a reference that may resolve otherwise once symbols of ``names`` (qualified_name) come or go.

    All candidates of a reference end in its target's short name, so only symbols of that one matter. One column of the references is read.
    """
    short = names.select(X.short_name(F.col("qualified_name")).alias("short")).distinct()
    return references.where("relation <> 'include'").join(short, X.short_name(F.col("target")) == F.col("short"), "left_semi").select("symbol_id").distinct()
