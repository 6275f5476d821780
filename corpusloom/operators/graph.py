"""Operators over the symbol graph: lookups, one-hop joins, bounded closure over modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.model import SYMBOL_COLUMNS, SYMBOL_ORDER
from corpusloom.session import dealt, durable


def with_modules(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """Symbols with their module's name and path, in the column order of the graph operators."""
    return symbols.join(modules, "module_id").select(*SYMBOL_COLUMNS)


def _one_hop(edges: DataFrame, key: str, other: str, symbol_id: int, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    ids = edges.where(F.col(key) == symbol_id).select(F.col(other).alias("symbol_id"))
    found = with_modules(symbols.join(ids.distinct(), "symbol_id", "left_semi"), modules)
    # Symbols that agree in all that is shown are one, whatever their ids.
    shown = [c for c in SYMBOL_COLUMNS if c != "symbol_id"]
    return found.groupBy(*shown).agg(F.min("symbol_id").alias("symbol_id")).select(*SYMBOL_COLUMNS).orderBy(*SYMBOL_ORDER)


def callers_of(symbol_id: int, calls: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """The symbols that call a symbol, by file, name and lines."""
    return _one_hop(calls, "callee_symbol_id", "caller_symbol_id", symbol_id, symbols, modules)


def callees_from(symbol_id: int, calls: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """The symbols that a symbol calls, by file, name and lines."""
    return _one_hop(calls, "caller_symbol_id", "callee_symbol_id", symbol_id, symbols, modules)


def symbols_for_file(path: str, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """A file's symbols; the path is normalised first."""
    wanted = X.normal_path(F.lit(path))
    return with_modules(symbols.where(F.col("file_path") == wanted), modules).orderBy(*SYMBOL_ORDER)


def lookup_exact(name: str, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """At most one symbol of exactly this name, the one of the smallest id."""
    return with_modules(symbols.where(F.col("qualified_name") == name), modules).orderBy("symbol_id").limit(1)


def lookup_suffix(name: str, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """At most one symbol whose name ends in ``::name``: the shortest, then the first by name and id."""
    ends = F.col("qualified_name").endswith(f"::{name}")
    return with_modules(symbols.where(ends), modules).orderBy(F.length("qualified_name"), "qualified_name", "symbol_id").limit(1)


def lookup(name: str, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """The exact match, else, for a name without ``::``, the suffix match."""
    exact = lookup_exact(name, symbols, modules)
    if "::" in name or not exact.isEmpty():
        return exact
    return lookup_suffix(name, symbols, modules)


def lookup_any_suffix(name: str, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """At most one symbol whose name is or just ends with ``name``, the first by id."""
    match = (F.col("qualified_name") == name) | F.col("qualified_name").endswith(name)
    return with_modules(symbols.where(match), modules).orderBy("symbol_id").limit(1)


def edge_modules(edges: DataFrame, left: str, right: str, symbols: DataFrame) -> DataFrame:
    """Edges with the modules of both ends, as ``<end>_module_id``; edges to unknown symbols go.

    Edges are dealt before each join: they are few bytes and many rows, which adaptive execution would join to a few tasks that sort too many.
    """
    ids = symbols.select("symbol_id", "module_id")
    for end in (left, right):
        edges = dealt(edges, f"{end}_symbol_id").join(ids.withColumnsRenamed({"symbol_id": f"{end}_symbol_id", "module_id": f"{end}_module_id"}), f"{end}_symbol_id")
    return edges


def module_edges(calls: DataFrame, includes: DataFrame, inheritance: DataFrame) -> DataFrame:
    """Distinct (src, dst) over all three kinds of edges; includes without a target and loops don't count."""
    pairs = (
        calls.select(F.col("caller_module_id").alias("src"), F.col("callee_module_id").alias("dst"))
        .unionByName(inheritance.select(F.col("derived_module_id").alias("src"), F.col("base_module_id").alias("dst")))
        .unionByName(includes.where(F.col("target_module_id").isNotNull()).select(F.col("source_module_id").alias("src"), F.col("target_module_id").alias("dst")))
    )
    return pairs.where("src <> dst").distinct()


def module_closure(name: str, max_depth: int, modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules reachable from a module in at most ``max_depth`` steps, each with its least depth, by depth and id.

    Level by level: a level's new modules are what its edges reach and no level before did. Every level is kept
    in the shared folder, so neither plans nor recomputation grow with depth.
    """
    seen = modules.where(X.module_text(F.lit(name), F.lit("")) == F.col("module_name")).select(F.col("module_id").alias("id"), F.lit(0).alias("depth"))
    frontier = seen = durable(seen)
    edges = durable(edges) if max_depth > 1 else edges
    for depth in range(1, max_depth + 1):
        reached = edges.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = durable(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    found = seen.where("depth > 0").join(modules, F.col("id") == F.col("module_id"))
    return found.select("module_id", "module_name", "module_path", "depth").orderBy("depth", "module_id")


def by_id_or_name(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """``wanted`` (ref, symbol_id, qualified_name) with the symbol of that id, else the first by id of that name, as ``found_id``; null if there is neither."""
    ids = symbols.select(F.col("symbol_id").alias("_id"))
    names = symbols.groupBy("qualified_name").agg(F.min("symbol_id").alias("_by_name"))
    joined = wanted.join(ids, F.col("symbol_id") == F.col("_id"), "left").join(names, "qualified_name", "left")
    return joined.select(*wanted.columns, F.coalesce("_id", "_by_name").alias("found_id"))


def decoded(rows: DataFrame) -> DataFrame:
    """``rows`` as results show them: null texts are empty."""
    return rows.select(*(F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in rows.schema.fields))


def symbol_json() -> Column:
    """A row of ``SYMBOL_COLUMNS`` as a JSON object, its kind by name."""
    plain = [c for c in SYMBOL_COLUMNS if c != "kind"]
    return F.to_json(F.struct(*plain, X.kind_name(F.col("kind")).alias("kind")))


def first_seen(rows: DataFrame, column: str, order: str) -> DataFrame:
    """The distinct values of a column, those that were seen first before the others: (column, first)."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("first")).orderBy("first", column)
