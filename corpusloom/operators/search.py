"""Two-level search: score modules, then only the symbols of the best; relations and context of what was found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.vectors import cosine, vector_literal
from corpusloom.operators.dml import assign_ids
from corpusloom.session import dealt

MODULE_TOP_K, SYMBOL_TOP_K, RELATED_LIMIT, CONTEXT_TOKENS = 3, 5, 4, 256
#: Shares of a hub's neighbours.
SALTS = 16
MODULE_KEYS = ("module_name", "module_path")
SYMBOL_TIES = ("module_name", "qualified_name", "file_path", "start_line", "symbol_id")


def scored(rows: DataFrame, query: list[float] | Column, vector: str = "embedding") -> DataFrame:
    """``rows`` with the cosine of their vector and the query as ``score``."""
    query = vector_literal(query) if isinstance(query, list) else query
    return rows.withColumn("score", cosine(F.col(vector), query))


def top_modules(modules: DataFrame, query: list[float] | Column, k: int = MODULE_TOP_K) -> DataFrame:
    """The ``k`` modules (module_name, module_path, embedding, ...) nearest to the query."""
    return scored(modules, query).orderBy(F.desc("score"), *MODULE_KEYS).limit(k)


def top_symbols(symbols: DataFrame, query: list[float] | Column, k: int = SYMBOL_TOP_K) -> DataFrame:
    """The ``k`` symbols nearest to the query, over all given."""
    return scored(symbols, query).orderBy(F.desc("score"), *SYMBOL_TIES).limit(k)


def hierarchical_search(symbols: DataFrame, modules: DataFrame, query: list[float] | Column, module_k: int = MODULE_TOP_K, symbol_k: int = SYMBOL_TOP_K) -> DataFrame:
    """The nearest symbols of the nearest modules.

    The chosen modules are ``module_k`` rows, so they are broadcast: the corpus is read once, unsorted and
    unshuffled, and where it is partitioned by module only the files of those modules are read.
    """
    best = top_modules(modules, query, module_k).select(*MODULE_KEYS)
    return top_symbols(symbols.join(F.broadcast(best), list(MODULE_KEYS), "left_semi"), query, symbol_k)


def related(hits: DataFrame, calls: DataFrame, symbols: DataFrame, limit: int | None = RELATED_LIMIT) -> DataFrame:
    """(hit_id, direction, rank, symbol columns): each hit's callers and callees by name and file, ``limit`` of each.

    ``symbols`` come with their modules (``graph.with_modules``). They are numbered once in the order of the ranks, so what is joined, sorted and cut
    are numbers, two rows a call; the symbols' columns are joined to what is left.
    """
    order = ("qualified_name", "file_path", "symbol_id")
    numbered = assign_ids(symbols, "_at", 0, *order)
    ends = calls.select("caller_symbol_id", "callee_symbol_id").distinct()
    both = (F.struct(F.lit(up).alias("_up"), F.col(hit).alias("hit_id"), F.col(other).alias("symbol_id")) for up, hit, other in ((True, "callee_symbol_id", "caller_symbol_id"), (False, "caller_symbol_id", "callee_symbol_id")))
    pairs = ends.select(F.inline(F.array(*both)))
    pairs = dealt(pairs, "hit_id").join(hits.select(F.col("symbol_id").alias("hit_id")).distinct(), "hit_id")
    rows = dealt(pairs, "symbol_id").join(numbered.select("symbol_id", "_at"), "symbol_id").select("hit_id", "_up", "_at")
    if limit is not None:
        top = top_rows(rows, ("hit_id", "_up"), ("_at",), limit, salt="_at", deal=True)
    else:
        top = rows.withColumn("rank", F.row_number().over(Window.partitionBy("hit_id", "_up").orderBy("_at")))
    direction = F.when(F.col("_up"), "callers").otherwise("callees").alias("direction")
    return dealt(top, "_at").join(numbered, "_at").select("hit_id", *symbols.columns, direction, "rank")


def top_rows(rows: DataFrame, key: Sequence[str], order: Sequence[str], limit: int, salts: int = SALTS, salt: str = "symbol_id", deal: bool = False) -> DataFrame:
    """The first ``limit`` rows of each key in an order, with their ``rank`` from 1, however many rows a key has.

    What a key's rows leave is a table of ``limit`` rows: each task makes one before the shuffle, tasks of ``salts`` shares of the key merge those, and one
    merges the shares' tables. So a key of any size hands no task more than ``limit`` rows a share and task. ``order`` has to tell rows apart.

    ``deal``: for very many keys of few rows each, of which such tables leave nothing out: rows are dealt whole, a share of a key to a task, over a number of
    tasks that adaptive execution doesn't lower, so that none sorts more than its part.
    """
    share = F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int")
    by = Window.partitionBy(*key, "_share").orderBy(*order)
    rows = rows.withColumn("_share", share)
    rows = dealt(rows, *key, "_share") if deal else rows
    shares = rows.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= limit).drop("_rank", "_share")
    shares = dealt(shares, *key) if deal else shares
    return shares.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= limit)


def context_lines(hits: DataFrame, relations: DataFrame, gap: str = "- ") -> DataFrame:
    """(symbol_id, pos, line): the lines of each hit's context before any budget, in order.

    ``hits``: symbol_id, qualified_name, module_name, signature, source_text.
    """

    def fixed(pos: int, label: str, column: str, always: bool = False) -> DataFrame:
        rows = hits if always else hits.where(F.coalesce(F.col(column), F.lit("")) != "")
        return rows.select("symbol_id", F.struct(F.lit(pos).alias("part"), F.lit(0).alias("rank")).alias("pos"), F.concat(F.lit(f"{label}: "), F.coalesce(F.col(column), F.lit(""))).alias("line"))

    def relation(part: int, label: str, direction: str) -> DataFrame:
        own = relations.where(F.col("direction") == direction)
        head = own.select("hit_id").distinct().select(F.col("hit_id").alias("symbol_id"), F.struct(F.lit(part).alias("part"), F.lit(0).alias("rank")).alias("pos"), F.lit(label).alias("line"))
        rows = own.select(F.col("hit_id").alias("symbol_id"), F.struct(F.lit(part).alias("part"), F.col("rank").alias("rank")).alias("pos"), X.relation_line(F.col("qualified_name"), F.coalesce("signature", F.lit("")), F.coalesce("module_name", F.lit("")), gap).alias("line"))
        return head.unionByName(rows)

    parts = [fixed(0, "Symbol", "qualified_name", True), fixed(1, "Module", "module_name"), fixed(2, "Signature", "signature"), fixed(3, "Source", "source_text"), relation(4, "Callers:", "callers"), relation(5, "Callees:", "callees")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def budgeted(lines: DataFrame, key: str, pos: str, line: str, limit: int | None) -> DataFrame:
    """(key, context, token_count): each key's lines in order up to the first that would overflow ``limit`` tokens.

    Lines without a token are left out. A running sum within the limit is a prefix, so this is one window.
    """
    counted = lines.withColumn("_tokens", X.token_count(F.col(line)).cast("long")).where("_tokens > 0")
    running = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("_used", F.sum("_tokens").over(running))
    if limit is not None:
        counted = counted.where(F.col("_used") <= limit)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(line).alias("l")))), lambda s: s["l"]), "\n")
    return counted.groupBy(key).agg(joined.alias("context"), F.sum("_tokens").alias("token_count"))


def retrieve(hits: DataFrame, calls: DataFrame, symbols: DataFrame, related_limit: int | None = RELATED_LIMIT, token_limit: int | None = CONTEXT_TOKENS, gap: str = "- ") -> DataFrame:
    """``hits`` with the context text and its token count; a hit whose first line overflows has an empty one."""
    relations = related(hits, calls, symbols, related_limit)
    contexts = budgeted(context_lines(hits, relations, gap), "symbol_id", "pos", "line", token_limit)
    return hits.join(contexts, "symbol_id", "left").withColumn("context", F.coalesce("context", F.lit(""))).withColumn("token_count", F.coalesce("token_count", F.lit(0)))
