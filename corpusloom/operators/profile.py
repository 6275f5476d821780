"""Profiles of modules: what a module shows to others, as counts and a text to embed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X

PUBLIC_SYMBOLS = 8
#: Ids that one part of a module's record spans.
PART_IDS = 1024


def module_groups(symbols: DataFrame) -> DataFrame:
    """Symbols of each module, by name and path."""
    return symbols.groupBy("module_name", "module_path").agg(F.count("*").alias("symbol_count"), F.countDistinct("file_path").alias("file_count"))


def symbol_line():
    """A symbol on one line: kind, name, signature if any, file."""
    signature = F.coalesce(F.col("signature"), F.lit(""))
    return F.concat(X.kind_name(F.col("kind")), F.lit(" "), F.col("qualified_name"), F.when(signature != "", F.concat(F.lit(" :: "), signature)).otherwise(""), F.lit(" ("), F.col("file_path"), F.lit(")"))


def module_profiles(symbols: DataFrame, limit: int = PUBLIC_SYMBOLS) -> DataFrame:
    """(module_name, module_path, header_count, public_symbol_count, summary) of ``symbols`` with their modules.

    The public symbols are the first ``limit``: those in headers before others, then by rank of kind, file, line and
    name. Their number is of those selected, headers' or not. Each row is ranked within its module by a window whose limit
    Spark applies before the shuffle as well.
    """
    key = ["module_name", "module_path"]
    header = X.is_header(F.col("file_path"))
    headers = symbols.groupBy(*key).agg(F.countDistinct(F.when(header, F.col("file_path"))).alias("header_count"))
    order = Window.partitionBy(*key).orderBy(F.when(header, 0).otherwise(1), X.kind_rank(F.col("kind")), "file_path", "start_line", "qualified_name", "symbol_id")
    chosen = symbols.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", symbol_line().alias("line")))), lambda s: F.concat(F.lit("- "), s["line"], F.lit("\n")))
    public = chosen.groupBy(*key).agg(F.count("*").alias("public_symbol_count"), F.array_join(lines, "").alias("listed"))
    both = headers.join(public, key)
    summary = F.concat(F.lit("module "), "module_name", F.lit("\npath "), "module_path", F.lit("\nheaders "), F.col("header_count").cast("string"), F.lit("\npublic symbols "), F.col("public_symbol_count").cast("string"), F.lit("\nselected symbols:\n"), "listed")
    return both.select(*key, "header_count", "public_symbol_count", summary.alias("summary"))


def fallback_module(name: str, symbols: DataFrame) -> DataFrame:
    """A record for a module without a profile, of all symbols whose module has this name or path, in order of id.

    Here headers are counted once per symbol in one, and every symbol is public. The list grows with the module: it is
    meant for lookups of one; ``fallback_parts`` gives the same in rows of bounded size.
    """
    own = symbols.where((F.col("module_name") == name) | (F.col("module_path") == name))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol_id", "qualified_name"))), lambda s: s["qualified_name"]), "\n")
    return own.agg(names.alias("summary"), F.count("*").alias("public_symbol_count"), F.coalesce(F.sum(X.is_header(F.col("file_path")).cast("long")), F.lit(0)).alias("header_count")).select(F.lit(name).alias("module_name"), F.lit(name).alias("module_path"), "summary", "public_symbol_count", "header_count")


def fallback_parts(symbols: DataFrame, part_ids: int = PART_IDS) -> DataFrame:
    """The records of ``fallback_module`` for all modules, in parts: (module_name, module_path, first_id, summary, public_symbol_count, header_count).

    A part spans ``part_ids`` ids from ``first_id`` on, so no row holds more symbols than that, however many a module has, and they are
    gathered by module and part: a module of very many symbols is spread over the tasks. A module's parts in order of ``first_id``, joined by
    new lines, are its record, and their counts add up. Ids are unique and not null, as the index assigns them; a null name or path is a module of its own.
    """
    if part_ids < 1:
        raise ValueError("a part spans an id at least")
    key = ["module_name", "module_path", "first_id"]
    named = symbols.withColumn("first_id", F.col("symbol_id") - F.pmod("symbol_id", F.lit(part_ids).cast("long")))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol_id", "qualified_name"))), lambda s: s["qualified_name"]), "\n")
    return named.groupBy(*key).agg(names.alias("summary"), F.count("*").alias("public_symbol_count"), F.sum(F.coalesce(X.is_header(F.col("file_path")), F.lit(False)).cast("long")).alias("header_count"))
