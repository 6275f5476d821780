"""Everything that reaches everything: the closure of a graph from all of its nodes in one run.

For each node a set of the sources that reach it is kept as bitmaps: sources are numbered, ``CHUNK`` of them share a bitmap, and a bitmap is a row. A step lets
every bitmap that grew in the step before flow along the edges, joins those that meet (a map-side ``or`` before the shuffle), and keeps what is new. So a step
moves a bit for each source and edge, packed, instead of a row; and all sources advance together, in as many steps as the longest of the shortest
paths has edges.

A node's frontier is the bits that were new in the last step; a bitmap of which nothing is new is not sent. A node of many in-edges gets one bitmap a task and
chunk, one of many out-edges is split by a salt. Every step is kept in the shared folder, so neither plans nor recomputation grow with depth.

Defined cases: loops and repeated edges count for nothing; edges with a null end don't either. A node on a cycle reaches itself, with the cycle's length as depth, unless ``loops`` is off. Without
edges the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.dml import assign_ids
from corpusloom.session import durable, prepare, release_shuffles

#: Sources that share a bitmap.
CHUNK = 1 << 15
#: Out-edges of a node that one row of the frontier meets.
FAN = 10_000
#: Steps whose results are kept apart.
MOST_FRAMES = 32


def _packed(bits: np.ndarray) -> bytes:
    """A bitmap without the zeros at its end."""
    used = np.flatnonzero(bits)
    return bits[: used[-1] + 1].tobytes() if len(used) else b""


def _or(blobs: list[bytes]) -> np.ndarray:
    out = np.zeros(max((len(b) for b in blobs), default=0), np.uint8)
    for b in blobs:
        out[: len(b)] |= np.frombuffer(b, np.uint8)
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bitmap a node and chunk of what passes; at most as many as a task's rows."""
    held: dict[tuple[int, int], np.ndarray] = {}
    size = 0

    def out() -> pa.RecordBatch:
        rows = [(*k, _packed(v)) for k, v in held.items()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["node", "chunk", "bits"])

    for batch in batches:
        for node, chunk, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            have = held.get((node, chunk))
            if have is None:
                held[node, chunk] = np.frombuffer(bits, np.uint8).copy()
                size += len(bits) + 200
            else:
                held[node, chunk] = _or([have.tobytes(), bits]) if len(bits) > len(have) else have
                if len(bits) <= len(have):
                    have[: len(bits)] |= np.frombuffer(bits, np.uint8)
        if size > 64 << 20:
            yield out()
            held, size = {}, 0
    if held:
        yield out()


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and chunk, what was seen (kind 0) and what comes: for each node and chunk the sum, and what of it is new."""
    at, seen, came, out, size = None, [], [], [], 0

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["node", "chunk", "seen", "new"])

    def row() -> tuple:
        before, every = _or(seen), _or(seen + came)
        new = every.copy()
        new[: len(before)] &= ~before
        return (*at, _packed(every), _packed(new))

    for b in batches:
        for node, chunk, kind, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (node, chunk) != at:
                if at is not None:
                    out.append(row())
                    size += len(out[-1][2]) + len(out[-1][3]) + 64
                at, seen, came = (node, chunk), [], []
                if size > 4 << 20:
                    yield batch(out)
                    out, size = [], 0
            (came if kind else seen).append(bits)
            if len(came) > 64:
                came = [_packed(_or(came))]
    if at is not None:
        yield batch([*out, row()])


def _told(depth: int, size: int):
    """(source, node, depth) of the bits of new bitmaps, numbers for ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, chunk, new in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(new, np.uint8), bitorder="little")) + chunk * size
                if len(at):
                    yield pa.record_batch([pa.array(at, pa.int64()), pa.array(np.full(len(at), node)), pa.array(np.full(len(at), depth, np.int32))], ["source", "node", "depth"])

    return run


def _first(size: int):
    """A bitmap of one bit: the node itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            bits = []
            for n in nodes % size:
                b = np.zeros(n // 8 + 1, np.uint8)
                b[-1] = 1 << (n % 8)
                bits.append(b.tobytes())
            yield pa.record_batch([pa.array(nodes), pa.array(nodes // size), pa.array(bits, pa.binary())], ["node", "chunk", "bits"])

    return run


def closure(edges: DataFrame, max_depth: int | None = None, loops: bool = False, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(source, target, depth): all pairs that a path of ``edges`` (src, dst: whole numbers) joins, with the length of the shortest; up to ``max_depth`` edges if given.

    ``loops``: with the pairs of a node and itself. ``chunk``: sources to a bitmap; ``fan``: out-edges of a node that a row of its frontier meets.
    """
    spark = edges.sparkSession
    prepare(spark)
    e = durable(edges.where("src is not null and dst is not null and src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct())
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    numbers = durable(assign_ids(nodes, "number", 0, "id"))
    e = e.join(numbers.select(F.col("id").alias("src"), F.col("number").alias("s")), "src").join(numbers.select(F.col("id").alias("dst"), F.col("number").alias("d")), "dst").select("s", "d")
    # A node's out-edges are dealt over as many salts as they need; its frontier is copied to each.
    fans = e.groupBy("s").agg(F.ceil(F.count("*") / fan).cast("int").alias("fans"))
    e = durable(e.join(fans, "s").select("s", F.pmod(F.xxhash64("d"), "fans").cast("int").alias("fan"), "d"))
    fans = durable(fans)
    schema = "node long, chunk long, bits binary"
    sources = fans.select(F.col("s").alias("node"))
    frontier = durable(sources.mapInArrow(_first(chunk), schema))
    seen, told, depth = None, [], 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        sent = frontier.join(fans.withColumnRenamed("s", "node"), "node").withColumn("fan", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)))
        came = sent.withColumnRenamed("node", "s").join(e, ["s", "fan"]).select(F.col("d").alias("node"), "chunk", "bits").mapInArrow(_merged, schema).withColumn("kind", F.lit(1))
        both = came if seen is None else came.unionByName(seen.withColumn("kind", F.lit(0)))
        met = both.select("node", "chunk", "kind", "bits").repartition("node", "chunk").sortWithinPartitions("node", "chunk")
        grown = durable(met.mapInArrow(_grown, "node long, chunk long, seen binary, new binary"))
        seen = grown.select("node", "chunk", F.col("seen").alias("bits"))
        frontier = grown.where(F.length("new") > 0).select("node", "chunk", F.col("new").alias("bits"))
        told.append(frontier.mapInArrow(_told(depth, chunk), "source long, node long, depth int"))
        if len(told) == MOST_FRAMES:
            told = [durable(reduce(DataFrame.unionByName, told))]
        release_shuffles(spark)
    if not told:
        return spark.createDataFrame([], "source long, target long, depth int")
    out = reduce(DataFrame.unionByName, told)
    out = out if loops else out.where("source <> node")
    return out.join(numbers.select(F.col("id").alias("src"), F.col("number").alias("source")), "source").join(numbers.select(F.col("id").alias("target"), F.col("number").alias("node")), "node").select(F.col("src").alias("source"), "target", "depth")
