"""Snapshots of the tables: each change adds a part, and a manifest that is written last makes it current.

A table is the union of its parts. A part may void rows of earlier ones: ``gone`` lists symbols that are no more, with
all that belongs to them; ``resolved`` lists symbols whose outgoing edges the part states anew. So what a change
writes follows from the change, not from the corpus. After ``MAX_PARTS`` changes the tables are written whole again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.model import TABLES
from corpusloom.session import at_once

MAX_PARTS = 16
#: The columns that name a table's symbols: a row goes with any of them, and with the first one's edges.
ENDS = {"symbols": ("symbol_id",), "vectors": ("symbol_id",), "references": ("symbol_id",), "calls": ("caller_symbol_id", "callee_symbol_id"), "inheritance": ("derived_symbol_id", "base_symbol_id"), "includes": ("source_symbol_id",)}
EDGES = ("calls", "inheritance")


class ConflictError(RuntimeError):
    """Another writer has published the version that this one was to become."""


class SnapshotStore:
    """Tables under ``root`` (any path that Spark reads). Readers see a snapshot whole or not at all; of two writers one fails."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._open: dict[str, DataFrame] | None = None
        self._base = 0

    # --- the folder ---------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current snapshot's number, 0 before the first."""
        fs = self._fs()
        if not fs.exists(self._path("")):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(self._path(""))]
        return max((int(n[9:-5]) for n in names if n.startswith("snapshot-") and n.endswith(".json") and n[9:-5].isdigit()), default=0)

    def parts(self, version: int | None = None) -> list[dict]:
        """The parts of a snapshot, oldest first: their folder and the tables they hold."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs().open(self._path(f"snapshot-{version}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)["parts"]

    def _publish(self, version: int, parts: list[dict]) -> int:
        """Make ``version`` current: its manifest is renamed into place, which fails if another writer's is there."""
        fs, name = self._fs(), f"snapshot-{version}.json"
        writing = self._path(f"writing-{uuid.uuid4().hex}")
        out = fs.create(writing, False)
        out.write(bytearray(json.dumps({"parts": parts}).encode()))
        out.close()
        claim = self._path(f"claim-{version}")
        try:
            # A folder's creation tells whether it was there: the first to make it may publish.
            mine = not fs.exists(claim) and fs.createNewFile(claim)
        except Exception as e:  # noqa: BLE001
            raise ConflictError(f"snapshot {version} could not be claimed") from e
        if not mine or not fs.rename(writing, self._path(name)):
            fs.delete(writing, False)
            raise ConflictError(f"snapshot {version} is another writer's")
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Delete parts that none of the last ``keep`` snapshots has, and older manifests."""
        fs, last = self._fs(), self.version()
        kept = range(max(1, last - keep + 1), last + 1)
        live = {p["folder"] for v in kept for p in self.parts(v)}
        names = {f"snapshot-{v}.json" for v in kept} | {f"claim-{v}" for v in range(1, last + 1)}
        for s in fs.listStatus(self._path("")):
            name = s.getPath().getName()
            if (name.startswith("part-") and name not in live) or (name.startswith(("snapshot-", "claim-")) and name not in names):
                fs.delete(s.getPath(), True)

    # --- reading and writing ------------------------------------------------------------------

    def read(self) -> dict[str, DataFrame]:
        """The current tables, empty ones before the first snapshot; inside a transaction, its own."""
        if self._open is not None:
            return dict(self._open)
        return self._tables(self.parts())

    def _tables(self, parts: list[dict]) -> dict[str, DataFrame]:
        return {name: self._table(name, parts) for name in TABLES}

    def _union(self, name: str, schema, parts: list[dict]) -> DataFrame | None:
        out = None
        for k, part in enumerate(parts):
            if name in part["tables"]:
                rows = self.spark.read.schema(schema).parquet(f"{self.root}/{part['folder']}/{name}").withColumn("_part", F.lit(k))
                out = rows if out is None else out.unionByName(rows)
        return out

    def _table(self, name: str, parts: list[dict]) -> DataFrame:
        schema = TABLES[name]
        rows = self._union(name, schema, parts)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        for kind, ends in (("gone", ENDS.get(name, ())), ("resolved", ENDS[name][:1] if name in EDGES else ())):
            void = self._union(kind, "symbol_id long", parts)
            for end in ends if void is not None else ():
                void_of = void.groupBy(F.col("symbol_id").alias("_id")).agg(F.max("_part").alias("_since"))
                rows = rows.join(void_of, (F.col(end) == F.col("_id")) & (F.col("_part") < F.col("_since")), "left_anti")
        return rows.select(*schema.names)

    def _write(self, tables: Mapping[str, DataFrame]) -> dict:
        folder = f"part-{uuid.uuid4().hex}"

        def write(name: str, rows: DataFrame) -> None:
            columns = TABLES[name].names if name in TABLES else ["symbol_id"]
            rows.select(*columns).write.parquet(f"{self.root}/{folder}/{name}")

        at_once(self.spark, *(partial(write, name, rows) for name, rows in tables.items()))
        return {"folder": folder, "tables": sorted(tables)}

    def publish(self, tables: Mapping[str, DataFrame]) -> int:
        """Write ``tables`` as the next snapshot; what isn't given stays as it is."""
        if self._open is not None:
            self._open |= dict(tables)
            return self.version()
        base = self.version()
        return self._publish(base + 1, [self._write(self._tables(self.parts(base)) | dict(tables))])

    def change(self, new: Mapping[str, DataFrame], gone: DataFrame, resolved: DataFrame, base: int | None = None) -> int:
        """The next snapshot: without the symbols ``gone`` and the outgoing edges of the symbols ``resolved``, with the rows ``new``.

        ``base``: the version that the change was made from; if it is current no more, the change fails.
        """
        base = self.version() if base is None else base
        parts = self.parts(base)
        part = self._write({**new, "gone": gone, "resolved": resolved})
        if len(parts) + 1 >= MAX_PARTS:
            part = self._write(self._tables([*parts, part]))
            return self._publish(base + 1, [part])
        return self._publish(base + 1, [*parts, part])

    def begin(self) -> None:
        if self._open is not None:
            raise RuntimeError("a transaction is open already")
        self._base = self.version()
        self._open = self._tables(self.parts(self._base))

    def commit(self) -> int:
        """Publish what the transaction holds; without one nothing happens. Fails if another writer came first."""
        if self._open is None:
            return self.version()
        tables, self._open = self._open, None
        return self._publish(self._base + 1, [self._write(tables)])

    def rollback(self) -> None:
        self._open = None
