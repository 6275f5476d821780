"""What modules are to each other and show to others, kept up with changes instead of computed anew.

Four views: edges between modules with the number of symbol edges that support each, symbols per file of each module, sums of each module's vectors, and
profiles with their embeddings. The first three are counts and sums, so a change is rows to add and rows to take away: it is written as a part of signed
numbers, and a view is the sum over its parts, without what has come to nothing. Components of vectors are summed as whole numbers (``SCALE`` to one), so what
was added can be taken away exactly, in any order. A profile can't be subtracted from; those of the modules that a change touches are stated anew, and only
texts that differ are embedded. So a change reads the rows it takes away and the symbols of the modules it touches, and writes rows of its own size.

A part names the snapshot that it brings the views to. After ``MAX_PARTS`` changes the views are written whole again. Of two writers one fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import graph, profile
from corpusloom.session import at_once, durable
from corpusloom.sources.embedding import Embed, hash_embed, with_embeddings
from corpusloom.sources.store import MAX_PARTS, SnapshotStore

#: Whole numbers to one unit of a vector's component.
SCALE = 1 << 30
MODULE = ("module_name", "module_path")
VIEWS = {
    "edges": "src long, dst long, n long",
    "files": "module_id long, file_path string, n long",
    "sums": "module_name string, module_path string, dim int, total decimal(38,0)",
    "profiles": "module_name string, module_path string, header_count long, public_symbol_count long, summary string, embedding array<float>, live boolean",
}
#: The ends of a kind of edges by module, and by symbol.
ENDS = {
    "calls": ("caller_module_id", "callee_module_id", ("caller_symbol_id", "callee_symbol_id")),
    "inheritance": ("derived_module_id", "base_module_id", ("derived_symbol_id", "base_symbol_id")),
    "includes": ("source_module_id", "target_module_id", ("source_symbol_id",)),
}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def edge_rows(tables: Mapping[str, DataFrame], sign: int) -> DataFrame:
    """(src, dst, n) of some edges; loops and edges without a target don't count."""
    rows = [tables[t].select(F.col(a).alias("src"), F.col(b).alias("dst")) for t, (a, b, _) in ENDS.items() if t in tables]
    return _union(rows).where("src <> dst").groupBy("src", "dst").agg((F.count("*") * sign).alias("n"))


def file_rows(symbols: DataFrame, sign: int) -> DataFrame:
    return symbols.groupBy("module_id", "file_path").agg((F.count("*") * sign).alias("n"))


def sum_rows(vectors: DataFrame, sign: int) -> DataFrame:
    """(module_name, module_path, dim, total); dimension -1 counts the vectors."""
    whole = F.round(F.col("x").cast("double") * SCALE).cast("decimal(38,0)")
    long = vectors.where("embedding is not null").select(*MODULE, F.posexplode(F.concat(F.array(F.lit(1.0 / SCALE)), F.col("embedding").cast("array<double>"))).alias("dim", "x"))
    return long.groupBy(*MODULE, (F.col("dim") - 1).alias("dim")).agg((F.sum(whole) * sign).cast("decimal(38,0)").alias("total"))


class ModuleViews(SnapshotStore):
    """The views of one store's snapshots, below ``root``."""

    def __init__(self, spark: SparkSession, root: str, embed: Embed = hash_embed) -> None:
        super().__init__(spark, root)
        self.embed = embed

    # --- reading -------------------------------------------------------------------------------

    def brought_to(self) -> int:
        """The version of the snapshot that the views are of; 0 before the first."""
        parts = self.parts()
        return parts[-1]["snapshot"] if parts else 0

    def _log(self, name: str) -> DataFrame:
        parts = [p for p in self.parts() if name in p["tables"]]
        if not parts:
            return self.spark.createDataFrame([], f"{VIEWS[name]}, _part int")
        return _union([self.spark.read.schema(VIEWS[name]).parquet(f"{self.root}/{p['folder']}/{name}").withColumn("_part", F.lit(k)) for k, p in enumerate(parts)])

    def _summed(self, name: str, *key: str) -> DataFrame:
        return self._log(name).groupBy(*key).agg(F.sum("n").alias("n")).where("n <> 0")

    def _sums(self) -> DataFrame:
        """(module_name, module_path, dim, total) of the modules that have vectors; a component's sum may be 0."""
        sums = self._log("sums").groupBy(*MODULE, "dim").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
        return sums.join(sums.where("dim = -1 and total > 0").select(*MODULE), list(MODULE), "left_semi")

    def edges(self) -> DataFrame:
        """(src, dst, n): pairs of modules and how many edges of symbols support each."""
        return self._summed("edges", "src", "dst")

    def files(self) -> DataFrame:
        """(module_id, file_path, n): symbols of each file."""
        return self._summed("files", "module_id", "file_path")

    def counts(self) -> DataFrame:
        """(module_id, symbol_count, file_count, header_count)."""
        header = X.is_header(F.col("file_path")).cast("long")
        return self.files().groupBy("module_id").agg(F.sum("n").alias("symbol_count"), F.count("*").alias("file_count"), F.sum(header).alias("header_count"))

    def centroids(self, digits: int = 9) -> DataFrame:
        """(module_name, module_path, vectors, centroid): the mean of each module's vectors."""
        each = self._sums().groupBy(*MODULE).agg(F.max(F.when(F.col("dim") < 0, F.col("total").cast("long"))).alias("vectors"), F.array_sort(F.collect_list(F.when(F.col("dim") >= 0, F.struct("dim", "total")))).alias("parts"))
        mean = lambda p: F.round(p["total"].cast("double") / SCALE / F.col("vectors"), digits)
        return each.select(*MODULE, "vectors", F.transform("parts", mean).alias("centroid"))

    def _profiles(self) -> DataFrame:
        last = Window.partitionBy(*MODULE).orderBy(F.desc("_part"))
        return self._log("profiles").withColumn("_at", F.row_number().over(last)).where("_at = 1").drop("_at", "_part")

    def profiles(self) -> DataFrame:
        """Every module's profile (``profile.module_profiles``) with its embedding."""
        return self._profiles().where("live").drop("live")

    # --- writing -------------------------------------------------------------------------------

    def _add(self, views: Mapping[str, DataFrame], snapshot: int, base: int, over: list[dict]) -> None:
        folder = f"part-{uuid.uuid4().hex}"
        columns = {name: [c.split()[0] for c in kind.split(", ")] for name, kind in VIEWS.items()}
        at_once(self.spark, *(lambda n=n, v=v: v.select(*columns[n]).write.parquet(f"{self.root}/{folder}/{n}") for n, v in views.items()))
        self._publish(base + 1, [*over, {"folder": folder, "tables": sorted(views), "snapshot": snapshot}])

    def _embedded(self, records: DataFrame) -> DataFrame:
        return with_embeddings(records, "summary", self.embed).withColumn("embedding", F.col("embedding").cast("array<float>")).withColumn("live", F.lit(True))

    def rebuild(self, tables: Mapping[str, DataFrame], snapshot: int) -> None:
        """All views anew from the tables of a snapshot."""
        named = graph.with_modules(tables["symbols"], tables["modules"])
        views = {"edges": edge_rows(tables, 1), "files": file_rows(tables["symbols"], 1), "sums": sum_rows(tables["vectors"], 1), "profiles": self._embedded(profile.module_profiles(named))}
        self._add(views, snapshot, self.version(), [])

    def change(self, before: Mapping[str, DataFrame], new: Mapping[str, DataFrame], gone: DataFrame, resolved: DataFrame, after: Mapping[str, DataFrame], snapshot: int) -> None:  # type: ignore[override]
        """Bring the views from ``before`` to ``after``: without the symbols ``gone`` and the outgoing edges of the symbols ``resolved``, with the rows ``new``."""
        base = self.version()
        lost = {t: _voided(before[t], ends, gone, resolved if t != "includes" else None) for t, (_, _, ends) in ENDS.items()}
        taken = durable(_of(before["symbols"], "symbol_id", gone).select("module_id", "file_path"))
        added = new["symbols"].select("module_id", "file_path")
        touched = durable(taken.select("module_id").unionByName(added.select("module_id")).distinct())
        named = graph.with_modules(after["symbols"].join(touched, "module_id", "left_semi"), after["modules"])
        records = durable(profile.module_profiles(named))
        known = self._profiles().where("live").select(*(F.col(c).alias(f"_{c}") for c in MODULE), F.col("summary").alias("_summary"))
        same = F.col("_summary").eqNullSafe(F.col("summary"))
        for c in MODULE:
            same = same & F.col(f"_{c}").eqNullSafe(F.col(c))
        differ = records.join(known, same, "left_anti")
        names = after["modules"].join(touched, "module_id", "left_semi").select(*MODULE)
        empty = names.join(records.select(*MODULE), list(MODULE), "left_anti")
        dead = empty.select(*MODULE, *(F.lit(None).cast(k).alias(c) for c, k in (("header_count", "long"), ("public_symbol_count", "long"), ("summary", "string"), ("embedding", "array<float>"))), F.lit(False).alias("live"))
        views = {
            "edges": _union([edge_rows(lost, -1), edge_rows({t: new[t] for t in ENDS if t in new}, 1)]),
            "files": _union([file_rows(taken, -1), file_rows(added, 1)]),
            "sums": _union([sum_rows(_of(before["vectors"], "symbol_id", gone), -1), sum_rows(new["vectors"], 1)]),
            "profiles": self._embedded(differ).unionByName(dead),
        }
        over = self.parts(base)
        self._add(views, snapshot, base, over)
        if len(over) + 1 >= MAX_PARTS:
            whole = {"edges": self.edges(), "files": self.files(), "sums": self._sums(), "profiles": self._profiles().where("live")}
            self._add(whole, snapshot, base + 1, [])


def _of(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select(F.col("symbol_id").alias("_id")), F.col(column) == F.col("_id"), "left_semi")


def _voided(edges: DataFrame, ends: tuple[str, ...], gone: DataFrame, resolved: DataFrame | None) -> DataFrame:
    """The edges with an end in ``gone``, or that go out from ``resolved``; each once, also where several of these hold."""
    ids = gone.select("symbol_id") if resolved is None else gone.select("symbol_id").unionByName(resolved.select("symbol_id")).distinct()
    out = _of(edges, ends[0], ids)
    if len(ends) == 1:
        return out
    others = edges.join(ids.select(F.col("symbol_id").alias("_id")), F.col(ends[0]) == F.col("_id"), "left_anti")
    return out.unionByName(_of(others, ends[1], gone))
