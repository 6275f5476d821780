"""Lookups by the end of a name, one or many at once, without a scan: names are kept reversed and sorted, so that a suffix is a prefix.

``build`` deals names by ranges of their reversed text (then id, so a name that many symbols have spreads over files) into files of about ``file_rows``, each
sorted. The bounds of the files tell which of them a suffix needs, Parquet's statistics which row groups. Many suffixes are looked up
together: each distinct one is sent to the files of its range, where binary search gives its first and last row and a sparse table the best of
the rows between, in constant time however many match. Suffixes of a file are dealt into blocks of ``BLOCK_ROWS``, so neither a popular file nor a popular suffix is one task's work alone.

Which of several matches is best: of names that end in ``::`` and the suffix the shortest (in characters), then the first by text and id; of names that merely end
in it the one of the smallest id. Defined cases: null names and ids aren't indexed, null suffixes find nothing; an empty suffix matches all names. An empty index finds nothing.
"""

from __future__ import annotations

import bisect
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import delete_folder, durable, prepare

FILE_ROWS, BLOCK_ROWS = 200_000, 50_000
FOUND = "suffix string, scoped boolean, length int, qualified_name string, symbol_id long"


class Least:
    """The position of the least of any range of some distinct numbers, in constant time a range."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32)]
        width = 1
        while 2 * width <= len(values):
            a, b = self.levels[-1][:-width], self.levels[-1][width:]
            self.levels.append(np.where(values[a] <= values[b], a, b))
            width *= 2

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For ranges that aren't empty."""
        out = np.empty(len(start), np.int64)
        level = np.floor(np.log2(end - start)).astype(np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            a, b = self.levels[k][start[at]], self.levels[k][end[at] - (1 << int(k))]
            out[at] = np.where(self.values[a] <= self.values[b], a, b)
        return out


def past(prefix: bytes) -> bytes | None:
    """The least text after all that begin with ``prefix``; None if there is none."""
    bare = prefix.rstrip(b"\xff")
    return bare[:-1] + bytes([bare[-1] + 1]) if bare else None


class SuffixIndex:
    """An index below ``root``, any path that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, file_rows: int = FILE_ROWS) -> None:
        self.spark, self.root, self.file_rows = spark, root.rstrip("/"), file_rows
        self._state: tuple[dict, list[tuple[int, bytes, bytes]]] | None = None

    def build(self, symbols: DataFrame) -> int:
        """Index the names of ``symbols`` (symbol_id, qualified_name, ...); other columns are kept. Returns the number of files."""
        rows = symbols.where("symbol_id is not null and qualified_name is not null").withColumn("rev", F.reverse("qualified_name"))
        files = max(1, -(-rows.count() // self.file_rows))
        folder = f"build-{uuid.uuid4().hex}"
        dealt = rows.repartitionByRange(files, "rev", "symbol_id").withColumn("file", F.spark_partition_id())
        dealt.sortWithinPartitions("file", "rev", "symbol_id").write.option("parquet.block.size", 4 << 20).partitionBy("file").parquet(f"{self.root}/{folder}/rows")
        schema = dealt.schema.json()
        bounds = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{self.root}/{folder}/rows").groupBy("file").agg(F.min("rev").alias("lo"), F.max("rev").alias("hi"))
        bounds.coalesce(1).write.parquet(f"{self.root}/{folder}/bounds")
        self._publish(folder, schema)
        return len(self._open()[1])

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _publish(self, folder: str, schema: str) -> None:
        at, new = self._path("current.json"), self._path(f"{folder}.json")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        before = self._current()
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"folder": folder, "schema": schema}).encode()))
        out.close()
        fs.delete(at, False)
        if not fs.rename(new, at):
            raise RuntimeError(f"{self.root} could not be published")
        if before:
            delete_folder(self.spark, f"{self.root}/{before['folder']}")
        self._state = None

    def _current(self) -> dict | None:
        at = self._path("current.json")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _open(self) -> tuple[dict, list[tuple[int, bytes, bytes]]]:
        """The current build's manifest and its files with their first and last reversed names, in order. One row a file."""
        current = self._current()
        if current is None:
            raise RuntimeError(f"{self.root} holds no index")
        if self._state is None or self._state[0] != current:
            bounds = self.spark.read.parquet(f"{self.root}/{current['folder']}/bounds").collect()
            self._state = (current, sorted((r["file"], r["lo"].encode(), r["hi"].encode()) for r in bounds))
        return self._state

    def rows(self) -> DataFrame:
        """The indexed symbols, their reversed names as ``rev`` and their file's number as ``file``."""
        current = self._open()[0]
        return self.spark.read.schema(T.StructType.fromJson(json.loads(current["schema"]))).parquet(f"{self.root}/{current['folder']}/rows")

    def files_for(self, suffix: str) -> list[int]:
        """The files that may hold a name of this end."""
        p = suffix[::-1].encode()
        end = past(p)
        return [f for f, lo, hi in self._open()[1] if hi >= p and (end is None or lo < end)]

    def ending(self, suffix: str) -> DataFrame:
        """All symbols whose names end in ``suffix``, read from the files of that range only."""
        rows = self.rows().where(F.col("file").isin(self.files_for(suffix)))
        return rows.where(F.col("rev").startswith(suffix[::-1])).drop("rev", "file")

    def find(self, name: str) -> DataFrame:
        """At most one symbol: that of the name (smallest id), else, for a name without ``::``, the best that ends in ``::`` and it, else the best that ends in it."""
        ends = self.ending(name)
        scoped = F.col("qualified_name").endswith(f"::{name}") & F.lit("::" not in name)
        rank = F.when(F.col("qualified_name") == name, 0).when(scoped, 1).otherwise(2)
        by = F.struct(rank.alias("rank"), *(F.when(rank == 1, c).alias(n) for n, c in (("length", F.length("qualified_name")), ("name", F.col("qualified_name")))), "symbol_id")
        return ends.orderBy(by).limit(1)

    # --- many at once --------------------------------------------------------------------------

    def best(self, wanted: DataFrame) -> DataFrame:
        """(suffix, scoped, length, qualified_name, symbol_id): the best match of each distinct row of ``wanted`` (suffix, scoped).

        ``scoped``: names that end in ``::`` and the suffix. Suffixes without a match have no row.
        """
        prepare(self.spark)
        bounds = self._open()[1]
        distinct = wanted.where("suffix is not null and scoped is not null").select("suffix", "scoped").distinct()
        held = self.spark.sparkContext.broadcast(([f for f, _, _ in bounds], [lo for _, lo, _ in bounds], [hi for _, _, hi in bounds]))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, los, his = held.value
            for batch in batches:
                out = []
                for suffix, scoped in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    p = (suffix[::-1] + ("::" if scoped else "")).encode()
                    end = past(p)
                    a, b = bisect.bisect_left(his, p), len(los) if end is None else bisect.bisect_left(los, end)
                    out += [(f, p, scoped) for f in files[a:b]]
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.bool_()), strict=True)], ["file", "rev", "scoped"])

        asked = durable(distinct.mapInArrow(route, "file int, rev binary, scoped boolean"))
        blocks = durable(asked.groupBy("file").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")))
        needed = [r["file"] for r in blocks.select("file").collect()]  # at most a row a file
        dealt = asked.join(F.broadcast(blocks), "file").select("file", F.pmod(F.xxhash64("rev"), "blocks").cast("int").alias("block"), F.lit(1).alias("kind"), "rev", "scoped", F.lit(None).cast("int").alias("length"), F.lit(None).cast("long").alias("symbol_id"))
        names = self.rows().where(F.col("file").isin(needed)).join(F.broadcast(blocks), "file")
        names = names.select("file", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), F.col("rev").cast("binary").alias("rev"), F.lit(None).cast("boolean").alias("scoped"), F.length("rev").alias("length"), "symbol_id")
        met = names.unionByName(dealt).groupBy("file", "block").applyInArrow(_looked_up, FOUND)
        order = F.struct(F.when(F.col("scoped"), F.col("length")).alias("a"), F.when(F.col("scoped"), F.col("qualified_name")).alias("b"), F.col("symbol_id").alias("c"), "length", "qualified_name", "symbol_id")
        least = met.groupBy("suffix", "scoped").agg(F.min(order).alias("m"))
        return least.select("suffix", "scoped", "m.length", "m.qualified_name", "m.symbol_id")

    def find_many(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (ref, name) with ``found_id``: what ``find`` gives for each, null for nothing."""
        names = wanted.select("name").where("name is not null").distinct()
        exact = self.rows().join(names, F.col("qualified_name") == F.col("name"), "left_semi").groupBy(F.col("qualified_name").alias("name")).agg(F.min("symbol_id").alias("exact_id"))
        open_names = durable(names.join(exact, "name", "left_anti"))
        plain = ~F.contains("name", F.lit("::"))
        ask = open_names.where(plain).select(F.col("name").alias("suffix"), F.lit(True).alias("scoped")).unionByName(open_names.select(F.col("name").alias("suffix"), F.lit(False).alias("scoped")))
        best = self.best(ask)
        ends = best.groupBy(F.col("suffix").alias("name")).agg(F.max(F.when(F.col("scoped"), F.col("symbol_id"))).alias("scoped_id"), F.max(F.when(~F.col("scoped"), F.col("symbol_id"))).alias("end_id"))
        joined = wanted.join(exact, "name", "left").join(ends, "name", "left")
        return joined.select(*wanted.columns, F.coalesce("exact_id", "scoped_id", "end_id").alias("found_id"))


def _looked_up(table: pa.Table) -> pa.Table:
    """A file's names and a block of suffixes: the best match of each suffix in this file."""
    kind = table["kind"].to_numpy()
    names, asked = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1))
    ids, lengths = names["symbol_id"].to_numpy(), names["length"].to_numpy()
    revs = names["rev"].to_pylist()
    order = sorted(range(len(revs)), key=lambda k: (revs[k], ids[k]))
    revs, ids, lengths = [revs[k] for k in order], ids[order], lengths[order]
    texts = [r.decode()[::-1] for r in revs]
    out = []
    prefixes, scoped = asked["rev"].to_pylist(), asked["scoped"].to_numpy(zero_copy_only=False).astype(bool)
    ends = [past(p) for p in prefixes]
    start = np.array([bisect.bisect_left(revs, p) for p in prefixes], np.int64)
    stop = np.array([len(revs) if e is None else bisect.bisect_left(revs, e) for e in ends], np.int64)
    some = start < stop
    for of_scope in (True, False):
        at = np.flatnonzero(some & (scoped == of_scope))
        if not len(at):
            continue
        # Each row's place in the order that decides among matches.
        by = sorted(range(len(revs)), key=(lambda k: (lengths[k], texts[k].encode(), ids[k])) if of_scope else (lambda k: ids[k]))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        for q, hit in zip(at, Least(rank).of(start[at], stop[at]), strict=True):
            suffix = prefixes[q].decode()
            out.append((suffix[: len(suffix) - 2 * of_scope][::-1], of_scope, int(lengths[hit]), texts[hit], int(ids[hit])))
    columns = zip(*out, strict=True) if out else [[]] * 5
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["suffix", "scoped", "length", "qualified_name", "symbol_id"])
