"""From a source tree to tables and vectors, in full or for changed files only."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.model import KINDS, SOURCE_EXTENSIONS
from corpusloom.operators import dml
from corpusloom.operators.resolve import resolve_names, touched
from corpusloom.plans.views import ModuleViews
from corpusloom.session import at_once, durable
from corpusloom.sources.cpp import parse_files
from corpusloom.sources.embedding import Embed, hash_embed, with_embeddings
from corpusloom.sources.files import existing, module_identities, path_order, read_files, scan_files
from corpusloom.sources.store import SnapshotStore
from corpusloom.sources.vector_store import checked


_BUILD_FILE = "CMakeLists.txt"
#: Up to so many changed paths are looked up one by one; of more, the tree is listed.
LISTED = 10_000
EMBED_BATCH = 64


@dataclass(frozen=True)
class IndexStats:
    files_scanned: int
    files_indexed: int
    symbols_indexed: int
    parse_errors: int
    elapsed_ms: int
    batches: int = 0


def _kind_code(name: Column) -> Column:
    out = F.lit(None).cast("byte")
    for kind, code in KINDS.items():
        out = F.when(name == kind, F.lit(code).cast("byte")).otherwise(out)
    return out


def symbol_text(source: Column, start: Column, end: Column, signature: Column, name: Column) -> Column:
    """What stands for a symbol when it is embedded: its lines, else its signature, else its name."""
    return F.coalesce(F.nullif(X.snippet(source, start, end), F.lit("")), F.nullif(signature, F.lit("")), name)


class Indexer:
    """Keeps the snapshot of a store in step with a source tree.

    Names that a symbol mentions are kept as references. After a change, the references that a name which came or went could
    answer are resolved anew: edges into a changed file survive it, and edges to new symbols appear. Files gone from the tree
    leave the tables. An update reads the changed files, one column of the references, and the names of symbols; it writes
    the new rows only.
    """

    def __init__(self, store: SnapshotStore, root: str, embed: Embed = hash_embed, extensions: Sequence[str] = SOURCE_EXTENSIONS, dimension: int | None = None, views: ModuleViews | None = None) -> None:
        """``dimension``: vectors of another one fail the index, if given. ``views``: kept in step with the snapshots, if given."""
        self.store, self.root, self.embed, self.extensions, self.dimension, self.views = store, root.rstrip("/"), embed, tuple(extensions), dimension, views
        self.spark = store.spark

    def index(self) -> IndexStats:
        """All files of the tree; nothing of the last snapshot but module ids is kept."""
        began = time.time()
        files = durable(scan_files(self.spark, self.root, self.extensions).select(F.col("relative_path").alias("path"), "text"))
        modules = self.store.read()["modules"]
        new, stats = self._process(files, self._markers(), modules, 1, files.count(), began)
        new["modules"] = modules.unionByName(new["modules"])
        version = self.store.publish(new | edges_of(new["references"], new["symbols"], new["symbols"], new["modules"]))
        if self.views is not None:
            self.views.rebuild(self.store.read(), version)
        return stats

    def update(self, paths: DataFrame) -> IndexStats:
        """The files of ``paths`` (path, relative to the root): their rows are replaced; files that are gone are removed."""
        began = time.time()
        base = self.store.version()
        have = self.store.read()
        changed = durable(paths.select(X.normal_path(F.col("path")).alias("path")).where(X.extension(F.col("path")).isin(*self.extensions)).distinct())
        n = changed.count()
        files, markers = self._changed(changed, n)
        gone = durable(have["symbols"].join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("symbol_id", "qualified_name"))
        first = dml.next_id(have["symbols"], "symbol_id")
        new, stats = self._process(files, markers, have["modules"], first, n, began)
        # What is left of the old, and what references have to be asked again.
        symbols = have["symbols"].join(gone, "symbol_id", "left_anti").unionByName(new["symbols"])
        names = gone.select("qualified_name").unionByName(new["symbols"].select("qualified_name"))
        old = have["references"].join(gone, "symbol_id", "left_anti")
        resolved = durable(touched(old, names))
        again = durable(old.where("relation <> 'include'").join(resolved, "symbol_id", "left_semi").unionByName(new["references"]))
        ids = {"calls": "call_id", "inheritance": "inheritance_id", "includes": "include_id"}
        starts = dict(zip(ids, at_once(self.spark, *(partial(dml.next_id, have[t], c) for t, c in ids.items())), strict=True))
        modules = have["modules"].unionByName(new["modules"])
        new |= edges_of(again, symbols, symbols, modules, starts)
        version = self.store.change(new, gone.select("symbol_id"), resolved, base)
        if self.views is not None:
            after = self.store.read()
            if self.views.brought_to() == base:
                self.views.change(have, new, gone.select("symbol_id"), resolved, after, version)
            else:  # a change broke off between snapshot and views
                self.views.rebuild(after, version)
        return stats

    def _changed(self, changed: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """The changed files' texts, and the folders about them that hold a build file."""
        if n > LISTED:
            every = scan_files(self.spark, self.root, self.extensions).select(F.col("relative_path").alias("path"), "text")
            return durable(every.join(changed, "path", "left_semi")), self._markers()
        relative = sorted(r["path"] for r in changed.collect())
        files = read_files(self.spark, self.root, relative, self.extensions).select(F.col("relative_path").alias("path"), "text")
        folders = sorted({str(f) for p in relative for f in PurePosixPath(p).parents})
        marked = [m.rpartition("/")[0] for m in existing(self.spark, [f"{self.root}/{f}/{_BUILD_FILE}".replace("/./", "/") for f in folders])]
        return durable(files), self.spark.createDataFrame([(m,) for m in marked], "folder string")

    def _markers(self) -> DataFrame:
        found = scan_files(self.spark, self.root, (".txt",), read=False).where(F.substring_index("path", "/", -1) == _BUILD_FILE)
        return found.select(F.concat(F.lit(self.root), F.lit("/"), F.col("relative_path")).alias("at")).select(F.regexp_replace("at", "/[^/]*$", "").alias("folder"))

    def _process(self, files: DataFrame, markers: DataFrame, have: DataFrame, first: int, scanned: int, began: float) -> tuple[dict[str, DataFrame], IndexStats]:
        """The rows of some files, ids from ``first``; of the modules those that ``have`` lacks."""
        parsed = durable(parse_files(files))
        errors = parsed.where("error is not null").count()
        rows = parsed.where("error is null")
        absolute = files.select(F.concat(F.lit(self.root + "/"), F.col("path")).alias("path"))
        of_file = module_identities(absolute, markers, self.root).select(F.substring("path", F.lit(len(self.root) + 2), F.lit(1 << 30)).alias("path"), F.col("module_name").alias("module"))
        rows = rows.join(of_file, "path").withColumn("order", path_order())
        numbered = dml.assign_ids(rows, "symbol_id", first, "order", "ordinal")
        numbered = durable(numbered.join(files, "path"))

        mentioned = numbered.select("symbol_id", F.explode(F.coalesce("includes", F.array().cast("array<string>"))).alias("include"))
        wanted = numbered.select(F.col("module").alias("module_name"), F.col("module").alias("module_path"), F.struct(F.lit(0).alias("a"), F.col("symbol_id").alias("b")).alias("ord"))
        targets = mentioned.select(X.include_target(X.include_path(F.col("include"))).alias("module_name"), F.struct(F.lit(1).alias("a"), F.col("symbol_id").alias("b")).alias("ord")).where("module_name <> ''")
        modules = durable(dml.ensure_modules(wanted.unionByName(targets.withColumn("module_path", F.col("module_name"))), have))

        named = modules.select("module_id", F.col("module_name").alias("module"))
        full = numbered.join(named, "module")
        symbols = durable(full.select("symbol_id", "module_id", F.col("path").alias("file_path"), _kind_code(F.col("kind")).alias("kind"), "qualified_name", "signature", "start_line", "end_line"))
        references = durable(self._references(numbered))
        text = symbol_text(F.col("text"), F.col("start_line"), F.col("end_line"), F.col("signature"), F.col("qualified_name"))
        new_vectors = full.select("symbol_id", F.col("module").alias("module_name"), F.col("module").alias("module_path"), F.col("path").alias("file_path"), "qualified_name", "signature", text.alias("source_text"), _kind_code(F.col("kind")).alias("kind"), "start_line", "end_line")
        vectors = with_embeddings(new_vectors, "source_text", self.embed, batch=EMBED_BATCH)
        vectors = vectors if self.dimension is None else checked(vectors, self.dimension)
        n = numbered.count()
        # Texts go to the embedder ``EMBED_BATCH`` at a time; tasks' last batches may be smaller, so this is the least number.
        stats = IndexStats(scanned, files.count() - errors, n, errors, int((time.time() - began) * 1000), -(-n // EMBED_BATCH))
        return {"modules": modules.join(have, "module_id", "left_anti"), "symbols": symbols, "references": references, "vectors": vectors}, stats

    @staticmethod
    def _references(numbered: DataFrame) -> DataFrame:
        def relation(name: str, column: str) -> DataFrame:
            return numbered.select("symbol_id", F.lit(name).alias("relation"), F.posexplode(column).alias("ordinal", "target"))

        return relation("call", "outgoing_calls").unionByName(relation("base", "base_classes")).unionByName(relation("include", "includes"))


def edges_of(references: DataFrame, known: DataFrame, symbols: DataFrame, modules: DataFrame, first: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The edges of some references, resolved against the symbols ``known``; unresolved calls and bases give none, includes always one."""
    names = known.select("symbol_id", "qualified_name")
    ask = references.where("relation <> 'include'").join(names, "symbol_id").select(F.struct("symbol_id", "relation", "ordinal").alias("ref_id"), F.col("qualified_name").alias("source_name"), "target")
    found = resolve_names(ask, names).where("resolved_id is not null").select("ref_id.*", "resolved_id")
    order = F.struct("symbol_id", "ordinal").alias("ord")
    calls = found.where("relation = 'call'").select(F.col("symbol_id").alias("caller_symbol_id"), F.col("resolved_id").alias("callee_symbol_id"), order)
    bases = found.where("relation = 'base'").select(F.col("symbol_id").alias("derived_symbol_id"), F.col("resolved_id").alias("base_symbol_id"), order)
    included = references.where("relation = 'include'").select(F.col("symbol_id").alias("source_symbol_id"), F.col("target").alias("include_path"), X.include_target(X.include_path(F.col("target"))).alias("target_module"), order)
    first = first or {}
    edges = at_once(
        references.sparkSession,
        lambda: dml.call_edges(calls, symbols, first.get("calls", 1)),
        lambda: dml.inheritance_edges(bases, symbols, first.get("inheritance", 1)),
        lambda: dml.include_edges(included, symbols, modules, first.get("includes", 1)),
    )
    return dict(zip(("calls", "inheritance", "includes"), edges, strict=True))
