"""Changes to the tables, each as a new DataFrame: ids, modules, edges, deletes, upserts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.graph import edge_modules
from corpusloom.session import durable


def next_id(table: DataFrame, column: str) -> int:
    """The first id that a table hasn't given out: one past the largest, 1 for an empty table."""
    return table.agg(F.coalesce(F.max(column), F.lit(0)) + 1).first()[0]


def assign_ids(rows: DataFrame, column: str, first: int | Column, *order: str) -> DataFrame:
    """``rows`` with consecutive ids from ``first`` in the given order.

    Rows are sorted by range over all tasks, counted per partition, and numbered from their partition's offset:
    unlike a global window, no task sees more than its share. Rows that tie get ids in any order.
    """
    names = rows.columns
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ordered = durable(ordered)
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_base"))
    # One row per partition.
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(counts.select("_part", "_base", F.coalesce(before, F.lit(0)).alias("_before")))
    start = F.lit(first) if isinstance(first, int) else first
    return ordered.join(offsets, "_part").select((start + F.col("_before") + F.col("_at") - F.col("_base")).cast("long").alias(column), *names)


def ensure_modules(wanted: DataFrame, modules: DataFrame) -> DataFrame:
    """All modules, those of ``wanted`` (module_name, module_path, ord) added that are not there yet.

    Names alone identify a module; of several paths the first by ``ord`` counts. New ids follow the old in order of first mention.
    """
    name = X.module_text(F.col("module_name"), F.col("module_path"))
    new = wanted.select(name.alias("module_name"), X.module_text(F.col("module_path"), name).alias("module_path"), "ord")
    new = new.groupBy("module_name").agg(F.min_by("module_path", "ord").alias("module_path"), F.min("ord").alias("ord"))
    new = new.join(modules, "module_name", "left_anti")
    numbered = assign_ids(new, "module_id", next_id(modules, "module_id"), "ord", "module_name")
    return modules.select("module_id", "module_name", "module_path").unionByName(numbered.select("module_id", "module_name", "module_path"))


def delete_files(paths: DataFrame, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the symbols of files (``paths``: file_path) and without edges at either end of one.

    Modules stay, even if nothing of them is left.
    """
    files = paths.select(X.normal_path(F.col("file_path")).alias("file_path")).distinct()
    gone = tables["symbols"].join(files, "file_path", "left_semi").select("symbol_id")

    def without(name: str, *ends: str) -> DataFrame:
        t = tables[name]
        for end in ends:
            t = t.join(gone.withColumnRenamed("symbol_id", end), end, "left_anti")
        return t.select(*tables[name].columns)

    out = dict(tables)
    out["symbols"] = tables["symbols"].join(files, "file_path", "left_anti").select(*tables["symbols"].columns)
    out["calls"] = without("calls", "caller_symbol_id", "callee_symbol_id")
    out["includes"] = without("includes", "source_symbol_id")
    out["inheritance"] = without("inheritance", "derived_symbol_id", "base_symbol_id")
    for name in ("vectors", "references"):
        if name in tables:
            out[name] = without(name, "symbol_id")
    return out


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` rows in place of those of the same key; the last is kept where ``new`` repeats a key only if it is unique."""
    return table.join(new.select(key), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def missing_symbols(edges: DataFrame, ends: list[str], symbols: DataFrame) -> DataFrame:
    """Ids at an edge's ends that no symbol has."""
    ids = None
    for end in ends:
        part = edges.select(F.col(end).alias("symbol_id"))
        ids = part if ids is None else ids.unionByName(part)
    return ids.distinct().join(symbols, "symbol_id", "left_anti")


def require_symbols(edges: DataFrame, ends: list[str], symbols: DataFrame) -> DataFrame:
    """``edges``, if all their ends are symbols; an error that names some ids if not."""
    unknown = [r["symbol_id"] for r in missing_symbols(edges, ends, symbols).orderBy("symbol_id").limit(5).collect()]
    if unknown:
        raise ValueError(f"edges to unknown symbols: {', '.join(map(str, unknown))}")
    return edges


def call_edges(pairs: DataFrame, symbols: DataFrame, first: int, strict: bool = False) -> DataFrame:
    """Call edges of (caller_symbol_id, callee_symbol_id, ord), with modules and ids; repeated calls stay. ``strict``: an end that is no symbol is an error."""
    if strict:
        require_symbols(pairs, ["caller_symbol_id", "callee_symbol_id"], symbols)
    return assign_ids(edge_modules(pairs, "caller", "callee", symbols), "call_id", first, "ord", "caller_symbol_id", "callee_symbol_id").select("call_id", "caller_symbol_id", "callee_symbol_id", "caller_module_id", "callee_module_id")


def inheritance_edges(pairs: DataFrame, symbols: DataFrame, first: int, strict: bool = False) -> DataFrame:
    """Inheritance edges of (derived_symbol_id, base_symbol_id, ord), with modules and ids; ``strict`` as in ``call_edges``."""
    if strict:
        require_symbols(pairs, ["derived_symbol_id", "base_symbol_id"], symbols)
    return assign_ids(edge_modules(pairs, "derived", "base", symbols), "inheritance_id", first, "ord", "derived_symbol_id", "base_symbol_id").select("inheritance_id", "derived_symbol_id", "base_symbol_id", "derived_module_id", "base_module_id")


def include_edges(rows: DataFrame, symbols: DataFrame, modules: DataFrame, first: int, strict: bool = False) -> DataFrame:
    """Include edges of (source_symbol_id, include_path, target_module, ord); the target is null where no module has that name."""
    if strict:
        require_symbols(rows, ["source_symbol_id"], symbols)
    named = modules.select(F.col("module_name").alias("target_module"), F.col("module_id").alias("target_module_id"))
    source = symbols.select(F.col("symbol_id").alias("source_symbol_id"), F.col("module_id").alias("source_module_id"))
    full = rows.withColumn("include_path", X.include_path(F.col("include_path"))).join(source, "source_symbol_id").join(named, "target_module", "left")
    return assign_ids(full, "include_id", first, "ord", "source_symbol_id", "include_path").select("include_id", "source_symbol_id", "include_path", "source_module_id", "target_module_id")
