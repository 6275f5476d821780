"""The star-schema tables seen as the relational model of a code corpus.

Nations are modules; customers and suppliers are symbols; all lineitems give edges: returned ones calls, accepted ones
inheritance, the others includes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.graph import edge_modules, with_modules
from corpusloom.session import dealt, read_table

#: Suppliers' symbol ids start here.
SUPPLIERS = 1_000_000_000_000


@dataclass
class StarCorpus:
    """``sparse``: edges from one quantity and line number of each kind only, for closures: from all lineitems every module is reached in one step."""

    spark: SparkSession
    sf_dir: str
    sparse: bool = False

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def modules(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("module_id"), F.col("n_name").alias("module_name"), F.col("r_name").alias("module_path"))

    @cached_property
    def symbols(self) -> DataFrame:
        c, s, n = self.table("customer"), self.table("supplier"), self.table("nation").select("n_nationkey", "n_name")
        key = F.col("c_custkey")
        customers = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
            key.alias("symbol_id"),
            F.col("c_nationkey").cast("long").alias("module_id"),
            F.concat(F.lit("src/"), F.lower("c_mktsegment"), F.when(key % 3 == 0, ".hpp").otherwise(".cpp")).alias("file_path"),
            (key % 6).cast("byte").alias("kind"),
            F.concat("n_name", F.lit("::"), "c_name").alias("qualified_name"),
            F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("void "), "c_name", F.lit("()"))).alias("signature"),
            (key % 500 + 1).alias("start_line"),
            (key % 500 + 1 + key % 7).alias("end_line"),
        )
        suppliers = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
            (F.col("s_suppkey") + SUPPLIERS).alias("symbol_id"),
            F.col("s_nationkey").cast("long").alias("module_id"),
            F.lit("supply/core.hpp").alias("file_path"),
            F.lit(1).cast("byte").alias("kind"),
            F.concat("n_name", F.lit("::"), "s_name").alias("qualified_name"),
            F.lit("").alias("signature"),
            F.col("s_suppkey").alias("start_line"),
            F.col("s_suppkey").alias("end_line"),
        )
        return customers.unionByName(suppliers)

    @cached_property
    def named_symbols(self) -> DataFrame:
        return with_modules(self.symbols, F.broadcast(self.modules))

    def _orders(self, flag: str, quantity: int, line: int) -> DataFrame:
        picked = self.table("lineitem").where(F.col("l_returnflag") == flag)
        if self.sparse:
            picked = picked.where((F.col("l_quantity") == quantity) & (F.col("l_linenumber") == line))
        o = self.table("orders").select("o_orderkey", "o_custkey")
        picked = dealt(picked, "l_orderkey")
        return picked.join(o, picked.l_orderkey == o.o_orderkey)

    def _modules_of(self, edges: DataFrame, left: str, right: str) -> DataFrame:
        return edge_modules(edges, left, right, self.symbols)

    @cached_property
    def calls(self) -> DataFrame:
        pairs = self._orders("R", 50, 1).select(F.col("o_custkey").alias("caller_symbol_id"), (F.col("l_suppkey") + SUPPLIERS).alias("callee_symbol_id"))
        pairs = dealt(pairs, "caller_symbol_id").distinct()
        return self._modules_of(pairs, "caller", "callee").withColumn("call_id", F.xxhash64("caller_symbol_id", "callee_symbol_id"))

    @cached_property
    def inheritance(self) -> DataFrame:
        pairs = self._orders("A", 49, 2).select((F.col("l_suppkey") + SUPPLIERS).alias("derived_symbol_id"), F.col("o_custkey").alias("base_symbol_id"))
        pairs = dealt(pairs, "derived_symbol_id").distinct()
        return self._modules_of(pairs, "derived", "base").withColumn("inheritance_id", F.xxhash64("derived_symbol_id", "base_symbol_id"))

    @cached_property
    def includes(self) -> DataFrame:
        """Half of the paths name a nation, and so a module; the others name a brand, and none."""
        rows = self._orders("N", 48, 3)
        p, n = self.table("part").select("p_partkey", "p_brand"), self.table("nation").select("n_nationkey", "n_name")
        named = rows.join(p, rows.l_partkey == p.p_partkey).join(F.broadcast(n), F.col("l_partkey") % 25 == F.col("n_nationkey"))
        path = F.concat(F.lit("<inc/"), F.when(F.col("l_partkey") % 2 == 0, F.col("n_name")).otherwise(F.col("p_brand")), F.lit(".hpp>"))
        found = named.select(F.col("o_custkey").alias("source_symbol_id"), path.alias("raw_path")).distinct()
        found = found.select("source_symbol_id", X.include_path(F.col("raw_path")).alias("include_path"))
        source = self.symbols.select(F.col("symbol_id").alias("source_symbol_id"), F.col("module_id").alias("source_module_id"))
        target = F.broadcast(self.modules.select(F.col("module_name").alias("stem"), F.col("module_id").alias("target_module_id")))
        return found.join(source, "source_symbol_id").join(target, X.include_target(F.col("include_path")) == F.col("stem"), "left").drop("stem")

    @cached_property
    def vectors(self) -> DataFrame:
        """Embeddings as symbols: the label is the module."""
        e = self.table("embeddings")
        label = F.col("label").cast("string")
        return e.select(F.col("vec_id").alias("symbol_id"), F.concat(F.lit("m"), label).alias("module_name"), F.concat(F.lit("path/"), label).alias("module_path"), F.concat(F.lit("f"), (F.col("vec_id") % 7).cast("string"), F.lit(".cpp")).alias("file_path"), F.concat(F.lit("m"), label, F.lit("::v"), F.col("vec_id").cast("string")).alias("qualified_name"), F.col("vec_id").alias("start_line"), "embedding")
