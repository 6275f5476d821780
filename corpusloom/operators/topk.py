"""The nearest vectors of many queries at once: blocks of queries against tiles of the corpus, by matrix products.

A task holds one block of queries (``QUERY_ROWS``) with a table of their best so far, and lets tiles of the corpus (``TILE_ROWS``) pass by; what it
emits is that table, ``k`` rows a query. Partial tables of a query are merged by a window whose limit Spark applies before its shuffle too.
So no pair of a query and a vector ever is a row, and memory is bounded by a block and a tile whatever the sizes.

Queries of up to ``broadcast_bytes`` are sent to every task, and the corpus is read where it lies, unshuffled. Of more, blocks and tiles are
dealt by (group, block, part): a tile moves once for each block of queries, in return for ``QUERY_ROWS`` products a vector.

With groups, a query meets only the vectors of the groups it names (cells of an index); without, all of them.

Scores are cosines in double precision, rounded to ``DIGITS`` places; equal scores are ordered by id, so results don't depend on blocks. A null, empty, zero or
non-finite vector scores 0, as does one of another dimension than the query. Rows without an id are no candidates; of queries with one id the one of the
greatest vector counts. With fewer than ``k`` vectors all are returned. Of rows that share an id each is a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.session import durable, prepare, shuffle_partitions

QUERY_ROWS, TILE_ROWS, DIGITS = 4096, 1024, 9
#: Queries of at most so many bytes go to every task.
BROADCAST_BYTES = 32 << 20
BLOCKS = "grp long, block int, part int, kind int, n int, dim int, ids binary, vectors binary"
FOUND = "query_id long, id long, score double"


def unit_rows(vectors: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, unit vectors) of each dimension in a batch; a vector that has no direction is all zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.array(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        m = values[starts[rows][:, None] + np.arange(dim)]
        m[~np.isfinite(m).all(axis=1)] = 0
        norm = np.sqrt((m * m).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        m[~good] = 0
        m[good] /= norm[good, None]
        out.append((int(dim), rows, m))
    return out


class Best:
    """The ``k`` best of each query of a block so far: by score, then by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, others: bool) -> None:
        """``others``: a vector of the query's own id is no answer."""
        self.ids, self.vectors, self.k, self.others = ids, vectors, k, others
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -np.inf)  # a query's k-th score, once it has k

    def add(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Let a tile pass; ``rows``: of the queries that it concerns."""
        rows = np.arange(len(self.ids)) if rows is None else rows
        if not len(rows) or not len(ids):
            return
        if vectors.shape[1] == self.vectors.shape[1]:
            scores = np.round(self.vectors[rows] @ vectors.T, DIGITS) + 0.0
        else:
            scores = np.zeros((len(rows), len(ids)))
        if self.others:
            own = self.ids[rows][:, None] == ids
            scores[own] = -np.inf
        bar = self.least[rows]
        if len(ids) > self.k and np.isneginf(bar).any():
            bar = np.maximum(bar, np.partition(scores, len(ids) - self.k, axis=1)[:, -self.k])
        q, v = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
        row = np.concatenate([self.row, rows[q]])
        key = np.concatenate([self.id, ids[v]])
        score = np.concatenate([self.score, scores[q, v]])
        order = np.lexsort((key, -score, row))
        row, key, score = row[order], key[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.id, self.score = row[kept], key[kept], score[kept]
        full = place[kept] == self.k - 1
        self.least[self.row[full]] = self.score[full]

    def found(self) -> Iterator[pa.RecordBatch]:
        if len(self.row):
            yield pa.record_batch([pa.array(self.ids[self.row]), pa.array(self.id), pa.array(self.score)], ["query_id", "id", "score"])


def _tiles(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, ids, unit vectors) of batches of (group, id, vector), at most ``rows`` of one group and dimension at a time."""
    for batch in batches:
        groups, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        for _, at, m in unit_rows(batch.column(2)):
            order = np.argsort(groups[at], kind="stable")
            at, m = at[order], m[order]
            cut = np.flatnonzero(np.diff(groups[at], prepend=np.nan))
            for a, b in zip(cut, [*cut[1:], len(at)], strict=True):
                for lo in range(a, b, rows):
                    hi = min(b, lo + rows)
                    yield int(groups[at[lo]]), ids[at[lo:hi]].astype(np.int64), m[lo:hi]


def _read(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dim"])


def _block(group: int, block: int, part: int, kind: int, ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    ints = [pa.array([x], pa.int32()) for x in (block, part, kind, *m.shape)]
    return pa.record_batch([pa.array([group], pa.int64()), *ints, pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())], ["grp", "block", "part", "kind", "n", "dim", "ids", "vectors"])


def nearest(queries: DataFrame, corpus: DataFrame, k: int, others: bool = False, broadcast_bytes: int = BROADCAST_BYTES, query_rows: int = QUERY_ROWS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` vectors of ``corpus`` (id, vector) nearest to each of ``queries`` (query_id, vector), ranks from 1.

    ``others``: a query's own id doesn't count. With a column ``groups`` of arrays in ``queries`` and ``grp`` in ``corpus``, only vectors of a named group do.
    """
    spark = queries.sparkSession
    prepare(spark)
    grouped = "groups" in queries.columns
    groups = F.array_distinct(F.transform("groups", lambda g: g.cast("long"))) if grouped else F.array(F.lit(0).cast("long"))
    asked = queries.where("query_id is not null").groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.max(F.struct(F.col("vector").cast("array<double>").alias("vector"), groups.alias("groups"))).alias("q"))
    asked = durable(asked.select("query_id", "q.vector", "q.groups"))
    rows = corpus.where("id is not null").select((F.col("grp") if grouped else F.lit(0)).cast("long").alias("grp"), F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    size = asked.agg(F.coalesce(F.sum(8 * F.greatest(F.size("vector"), F.lit(0)) + 8 * F.greatest(F.size("groups"), F.lit(0)) + 32), F.lit(0))).first()[0]
    part = _sent(spark, asked, rows, k, others, tile_rows) if size <= broadcast_bytes else _dealt(spark, asked, rows, k, others, query_rows, tile_rows)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _sent(spark: SparkSession, asked: DataFrame, rows: DataFrame, k: int, others: bool, tile_rows: int) -> DataFrame:
    """Every task has all queries, and reads its part of the corpus."""
    table = asked.toArrow()  # at most ``broadcast_bytes``
    blocks = [(table["query_id"].to_numpy()[at], m, table["groups"].take(pa.array(at)).to_pylist()) for _, at, m in unit_rows(table["vector"])] if table.num_rows else []
    held = spark.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(ids, m, k, others) for ids, m, _ in held.value]
        of: list[dict[int, np.ndarray]] = []
        for _, _, named in held.value:
            pairs = [(g, i) for i, groups in enumerate(named) for g in groups or ()]
            by = {}
            for g, i in pairs:
                by.setdefault(g, []).append(i)
            of.append({g: np.array(i) for g, i in by.items()})
        for group, ids, m in _tiles(batches, tile_rows):
            for b, by in zip(best, of, strict=True):
                if group in by:
                    b.add(ids, m, by[group])
        for b in best:
            yield from b.found()

    return rows.mapInArrow(run, FOUND)


def _dealt(spark: SparkSession, asked: DataFrame, rows: DataFrame, k: int, others: bool, query_rows: int, tile_rows: int) -> DataFrame:
    """Blocks of queries and tiles of the corpus meet by (group, block, part)."""
    each = asked.select("query_id", "vector", F.explode("groups").alias("grp"))
    blocks = durable(each.groupBy("grp").agg(F.count("*").alias("n"))).select("grp", F.ceil(F.col("n") / query_rows).cast("int").alias("blocks"))
    # Parts of the corpus: as many as give each core a few tasks.
    n = blocks.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    parts = max(1, -(-4 * shuffle_partitions(spark) // max(1, n)))

    def pack(table: pa.Table) -> pa.Table:
        grp, block = table["grp"][0].as_py(), table["block"][0].as_py()
        ids = table["query_id"].to_numpy()
        return pa.Table.from_batches([_block(grp, block, -1, 0, ids[at], m) for _, at, m in unit_rows(table["vector"])])

    dealt = each.join(blocks, "grp").select("grp", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), "query_id", "vector")
    packed = dealt.groupBy("grp", "block").applyInArrow(pack, BLOCKS)
    everywhere = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, ids, m in _tiles(batches, tile_rows):
            yield _block(group, -1, int(np.abs(ids[0] ^ (ids[-1] * 31)) % parts), 1, ids, m)

    tiles = rows.mapInArrow(tile, BLOCKS).join(blocks, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    met = everywhere.unionByName(tiles.select(*everywhere.columns)).repartition("grp", "block", "part").sortWithinPartitions("grp", "block", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (key := (row["grp"], row["block"], row["part"])) != at:
                    for b in best:
                        yield from b.found()
                    at, best = key, []
                ids, m = _read(row)
                if row["kind"] == 0:
                    best.append(Best(ids, m, k, others))
                else:
                    for b in best:
                        b.add(ids, m)
        for b in best:
            yield from b.found()

    return met.mapInArrow(run, FOUND)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of ``exact`` (query_id, rank, id, score) that ``found`` has, one of equal score standing for another; 1 if there is nothing to find."""
    bar = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    hits = found.join(bar, "query_id").where(F.col("score") >= F.col("least")).groupBy("query_id").agg(F.count("*").alias("hits"))
    row = bar.join(hits, "query_id", "left").agg(F.sum(F.least(F.coalesce("hits", F.lit(0)), F.col("n"))).alias("h"), F.sum("n").alias("n")).first()
    return row["h"] / row["n"] if row["n"] else 1.0
