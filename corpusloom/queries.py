"""The registered queries of the code-corpus operators over the star-schema tables, and their SQL.

Each query applies one operator to whole tables through ``sources.adapters``; the SQL states the same result for DuckDB,
written apart from the operator. ``round`` in either is on sums of floating-point numbers, whose order differs.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.vectors import centroids
from corpusloom.operators import dml, evaluation, graph, profile, prompts, reach, resolve, search, topk
from corpusloom.plans.index import Indexer
from corpusloom.plans.requests import parsed_requests
from corpusloom.plans.views import ModuleViews
from corpusloom.session import at_once, checkpoint_folder, dealt, delete_folder, durable
from corpusloom.sources.adapters import SUPPLIERS, StarCorpus
from corpusloom.sources.cpp import parse_files
from corpusloom.sources.embedding import hash_vector, with_embeddings
from corpusloom.sources.files import changed_files, module_identities, write_file
from corpusloom.sources.store import SnapshotStore
from corpusloom.sources.suffix_index import SuffixIndex
from corpusloom.sources.vector_index import VectorIndex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_MODULES = "modules AS (SELECT n_nationkey::BIGINT AS module_id, n_name AS module_name, r_name AS module_path FROM nation JOIN region ON n_regionkey = r_regionkey)"
_SYMBOLS = f"""symbols AS (
  SELECT c_custkey AS symbol_id, c_nationkey::BIGINT AS module_id, 'src/' || lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN '.hpp' ELSE '.cpp' END AS file_path,
    (c_custkey % 6)::TINYINT AS kind, n_name || '::' || c_name AS qualified_name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'void ' || c_name || '()' END AS signature,
    c_custkey % 500 + 1 AS start_line, c_custkey % 500 + 1 + c_custkey % 7 AS end_line
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT s_suppkey + {SUPPLIERS}, s_nationkey::BIGINT, 'supply/core.hpp', 1::TINYINT, n_name || '::' || s_name, '', s_suppkey, s_suppkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_NAMED = "named AS (SELECT symbol_id, file_path, module_name, module_path, kind, qualified_name, signature, start_line, end_line FROM symbols JOIN modules USING (module_id))"


def _edge_tables(sparse: bool) -> tuple[str, str, str]:
    """Calls, bases and includes; ``sparse``: of the lineitems of one quantity and line number each."""

    def where(flag: str, quantity: int, line: int) -> str:
        return f"l_returnflag = '{flag}'" + (f" AND l_quantity = {quantity} AND l_linenumber = {line}" if sparse else "")

    calls = f"calls AS (SELECT DISTINCT o_custkey AS caller, l_suppkey + {SUPPLIERS} AS callee FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {where('R', 50, 1)})"
    bases = f"bases AS (SELECT DISTINCT l_suppkey + {SUPPLIERS} AS derived, o_custkey AS base FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {where('A', 49, 2)})"
    includes = f"""raw_includes AS (SELECT DISTINCT o_custkey AS source_symbol_id, 'inc/' || CASE WHEN l_partkey % 2 = 0 THEN n_name ELSE p_brand END || '.hpp' AS include_path
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN nation ON l_partkey % 25 = n_nationkey WHERE {where('N', 48, 3)}),
includes AS (SELECT source_symbol_id, include_path, s.module_id AS source_module_id, m.module_id AS target_module_id
  FROM raw_includes JOIN symbols s ON source_symbol_id = symbol_id LEFT JOIN modules m ON module_name = regexp_replace(regexp_replace(include_path, '^.*/', ''), '\\.[^.]*$', ''))"""
    return calls, bases, includes


_CALLS, _BASES, _INCLUDES = _edge_tables(sparse=False)
_EDGES = """edges AS (SELECT a.module_id AS src, b.module_id AS dst FROM calls JOIN symbols a ON caller = a.symbol_id JOIN symbols b ON callee = b.symbol_id
  UNION SELECT a.module_id, b.module_id FROM bases JOIN symbols a ON derived = a.symbol_id JOIN symbols b ON base = b.symbol_id
  UNION SELECT source_module_id, target_module_id FROM includes WHERE target_module_id IS NOT NULL)"""
_GRAPH = ",\n".join((_MODULES, _SYMBOLS, _NAMED, _CALLS))
_VECTORS = """vectors AS (SELECT vec_id AS symbol_id, 'm' || label AS module_name, 'path/' || label AS module_path, 'f' || vec_id % 7 || '.cpp' AS file_path,
  'm' || label || '::v' || vec_id AS qualified_name, vec_id AS start_line, embedding::DOUBLE[] AS x FROM embeddings)"""
_QUERY_VECTOR = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_COSINE = "list_dot_product(x, q) / sqrt(list_dot_product(x, x) * list_dot_product(q, q))"
_CENTROIDS = """centroids AS (SELECT module_name, module_path, list(m ORDER BY i) AS x FROM (SELECT module_name, module_path, i, round(avg(v), 9) AS m
  FROM (SELECT module_name, module_path, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM vectors) GROUP BY ALL) GROUP BY ALL)"""
_TOKENS = "len(list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> ''))::BIGINT"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _callee(c: StarCorpus) -> int:
    """A symbol that many call: the callee of most calls, the least id among equals."""
    top = c.calls.groupBy("callee_symbol_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "callee_symbol_id").first()
    return top[0] if top else -1


@query(f"WITH {_GRAPH}, top AS (SELECT callee FROM calls GROUP BY callee ORDER BY count(*) DESC, callee LIMIT 1) SELECT min(symbol_id) AS symbol_id, * EXCLUDE (symbol_id) FROM named WHERE symbol_id IN (SELECT caller FROM calls WHERE callee = (FROM top)) GROUP BY ALL")
def callers_of(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    return graph.callers_of(_callee(c), c.calls, c.symbols, c.modules)


@query(f"WITH {_GRAPH}, top AS (SELECT caller FROM calls GROUP BY caller ORDER BY count(*) DESC, caller LIMIT 1) SELECT min(symbol_id) AS symbol_id, * EXCLUDE (symbol_id) FROM named WHERE symbol_id IN (SELECT callee FROM calls WHERE caller = (FROM top)) GROUP BY ALL")
def callees_from(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    top = c.calls.groupBy("caller_symbol_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "caller_symbol_id").first()
    return graph.callees_from(top[0] if top else -1, c.calls, c.symbols, c.modules)


@query(f"WITH {_GRAPH} SELECT * FROM named WHERE file_path = 'src/building.hpp'")
def symbols_for_file(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    return graph.symbols_for_file("src/./machinery/../building.hpp", c.symbols, c.modules)


@query(f"WITH {_GRAPH} SELECT * FROM named WHERE qualified_name IN (SELECT n_name || '::Customer#000000007' FROM nation) ORDER BY symbol_id LIMIT 1")
def symbol_lookup_exact(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    owner = c.named_symbols.where(F.col("symbol_id") == 7).first()
    return graph.lookup_exact(owner["qualified_name"] if owner else "", c.symbols, c.modules)


@query(f"WITH {_GRAPH} SELECT * FROM named WHERE ends_with(qualified_name, '::Supplier#000000003') ORDER BY length(qualified_name), qualified_name, symbol_id LIMIT 1")
def symbol_lookup_suffix(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    return graph.lookup("Supplier#000000003", c.symbols, c.modules)


@query(f"WITH {_GRAPH} SELECT * FROM named WHERE ends_with(qualified_name, '0005') ORDER BY symbol_id LIMIT 1")
def symbol_lookup_any_suffix(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    return graph.lookup_any_suffix("0005", c.symbols, c.modules)


_WANTED = """wanted AS (SELECT 's' || s_suppkey AS ref, s_name AS name FROM supplier UNION ALL SELECT 'c' || c_custkey, right(c_name, 4) FROM customer
  UNION ALL SELECT 'q' || symbol_id, qualified_name FROM named UNION ALL SELECT 'p' || p_partkey, p_brand FROM part UNION ALL SELECT 'n' || n_nationkey, n_name || '::Supplier' FROM nation)"""


@query(f"""WITH {_GRAPH}, {_WANTED}, names AS (SELECT DISTINCT name FROM wanted),
exact AS (SELECT qualified_name AS name, min(symbol_id) AS id FROM named GROUP BY 1),
scoped AS (SELECT name, arg_min(symbol_id, (length(qualified_name), qualified_name, symbol_id)) AS id FROM names JOIN named ON ends_with(qualified_name, '::' || name) WHERE NOT contains(name, '::') GROUP BY name),
ends AS (SELECT name, min(symbol_id) AS id FROM names JOIN named ON ends_with(qualified_name, name) WHERE name NOT IN (SELECT name FROM exact) GROUP BY name)
SELECT ref, name, coalesce(e.id, s.id, n.id) AS found_id FROM wanted LEFT JOIN exact e USING (name) LEFT JOIN scoped s USING (name) LEFT JOIN ends n USING (name)""")
def suffix_index_lookups(spark, sf_dir):
    """Names, short names, ends of names and names that nothing has, looked up together in an index of all symbols' names."""
    c = StarCorpus(spark, sf_dir)
    key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string")).alias("ref")
    wanted = c.table("supplier").select(key("s", "s_suppkey"), F.col("s_name").alias("name"))
    wanted = wanted.unionByName(c.table("customer").select(key("c", "c_custkey"), F.right("c_name", F.lit(4)).alias("name")))
    wanted = wanted.unionByName(c.named_symbols.select(key("q", "symbol_id"), F.col("qualified_name").alias("name")))
    wanted = wanted.unionByName(c.table("part").select(key("p", "p_partkey"), F.col("p_brand").alias("name")))
    wanted = wanted.unionByName(c.table("nation").select(key("n", "n_nationkey"), F.concat("n_name", F.lit("::Supplier")).alias("name")))
    folder = f"{checkpoint_folder(spark)}/suffix-index-{uuid.uuid4().hex}"
    index = SuffixIndex(spark, folder)
    index.build(c.symbols.select("symbol_id", "qualified_name"))
    out = durable(index.find_many(wanted))
    delete_folder(spark, folder)
    return out.select("ref", "name", "found_id")


@query(f"WITH {_GRAPH} SELECT symbol_id, qualified_name FROM named WHERE qualified_name LIKE '%::Customer#00000001_' OR qualified_name LIKE '%::Cust\\_mer#%' ESCAPE '\\'")
def symbol_like_suffix(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    escaped = X.like_suffix("Cust_mer#")
    return c.named_symbols.where(F.col("qualified_name").like("%::Customer#00000001_") | F.expr(f"qualified_name LIKE r'{escaped}%' ESCAPE '\\\\'")).select("symbol_id", "qualified_name")


@query(f"WITH {_GRAPH} SELECT caller AS caller_symbol_id, callee AS callee_symbol_id, a.module_id AS caller_module_id, b.module_id AS callee_module_id FROM calls JOIN symbols a ON caller = a.symbol_id JOIN symbols b ON callee = b.symbol_id")
def edge_module_map(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    return c.calls.select("caller_symbol_id", "callee_symbol_id", "caller_module_id", "callee_module_id")


@query(f"WITH {_GRAPH}, {_INCLUDES} SELECT * FROM includes")
def include_edges(spark, sf_dir):
    return StarCorpus(spark, sf_dir).includes.select("source_symbol_id", "include_path", "source_module_id", "target_module_id")


@query(f"WITH {_GRAPH}, {_BASES} SELECT derived AS derived_symbol_id, base AS base_symbol_id, a.module_id AS derived_module_id, b.module_id AS base_module_id FROM bases JOIN symbols a ON derived = a.symbol_id JOIN symbols b ON base = b.symbol_id")
def inheritance_edges(spark, sf_dir):
    return StarCorpus(spark, sf_dir).inheritance.select("derived_symbol_id", "base_symbol_id", "derived_module_id", "base_module_id")


_REFERENCES = f"""refs AS (SELECT o_orderkey AS ref_id, s.qualified_name || '::body::part' AS source_name,
    CASE o_orderkey % 4 WHEN 0 THEN c.c_name WHEN 1 THEN n_name || '::' || c.c_name WHEN 2 THEN 'nobody' ELSE split_part(t.qualified_name, '::', 2) END AS target
  FROM orders JOIN symbols s ON o_custkey = s.symbol_id JOIN customer c ON (o_orderkey * 7) % (SELECT count(*) FROM customer) = c.c_custkey JOIN nation ON c.c_nationkey = n_nationkey
    JOIN symbols t ON t.symbol_id = o_orderkey % (SELECT count(*) FROM supplier) + {SUPPLIERS})"""


@query(f"""WITH {_GRAPH}, {_REFERENCES},
parts AS (SELECT *, string_split(source_name, '::') AS p, contains(target, '::') AS whole FROM refs),
candidates AS (SELECT ref_id, target, 0 AS pos, target AS name FROM parts WHERE whole
  UNION ALL SELECT ref_id, target, len(p) - i, array_to_string(p[1:i], '::') || '::' || target FROM parts, generate_series(1, 10) g(i) WHERE NOT whole AND i < len(p)
  UNION ALL SELECT ref_id, target, 100, target FROM parts WHERE NOT whole),
first_exact AS (SELECT ref_id, arg_min(id, pos) AS id FROM candidates JOIN (SELECT qualified_name, min(symbol_id) AS id FROM symbols GROUP BY 1) ON name = qualified_name GROUP BY 1),
short AS (SELECT regexp_replace(qualified_name, '^.*::', '') AS s, min(symbol_id) AS id FROM symbols GROUP BY 1)
SELECT r.ref_id, source_name, target, coalesce(e.id, CASE WHEN NOT contains(target, '::') THEN short.id END) AS resolved_id
FROM refs r LEFT JOIN first_exact e USING (ref_id) LEFT JOIN short ON target = s""")
def name_resolution(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    customers, suppliers = c.table("customer").count(), c.table("supplier").count()
    o = c.table("orders").select("o_orderkey", "o_custkey")
    source = c.symbols.select(F.col("symbol_id").alias("o_custkey"), F.concat("qualified_name", F.lit("::body::part")).alias("source_name"))
    other = c.named_symbols.select(F.col("symbol_id").alias("customer_id"), F.col("qualified_name").alias("customer"))
    third = c.named_symbols.select(F.col("symbol_id").alias("supplier_id"), F.col("qualified_name").alias("supplier"))
    full = o.join(source, "o_custkey").join(other, (F.col("o_orderkey") * 7) % customers == F.col("customer_id")).join(third, F.col("o_orderkey") % suppliers + SUPPLIERS == F.col("supplier_id"))
    kind = F.col("o_orderkey") % 4
    target = F.when(kind == 0, X.short_name(F.col("customer"))).when(kind == 1, F.col("customer")).when(kind == 2, "nobody").otherwise(X.short_name(F.col("supplier")))
    return resolve.resolve_names(full.select(F.col("o_orderkey").alias("ref_id"), "source_name", target.alias("target")), c.symbols.select("symbol_id", "qualified_name"))


@query(f"""WITH {_MODULES}, wanted AS (SELECT CASE WHEN trim(p_brand) = '' THEN p_type ELSE trim(p_brand) END AS module_name, arg_min(p_type, p_partkey) AS module_path, min(p_partkey) AS ord FROM part GROUP BY 1)
SELECT * FROM modules UNION ALL SELECT (SELECT max(module_id) FROM modules) + row_number() OVER (ORDER BY ord), module_name, module_path FROM wanted WHERE module_name NOT IN (SELECT module_name FROM modules)""")
def ensure_modules(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    wanted = c.table("part").select(F.col("p_brand").alias("module_name"), F.col("p_type").alias("module_path"), F.col("p_partkey").alias("ord"))
    return dml.ensure_modules(wanted, c.modules)


@query("SELECT (SELECT max(c_custkey) + 1 FROM customer) + row_number() OVER (ORDER BY s_name, s_suppkey) - 1 AS symbol_id, s_suppkey, s_name FROM supplier")
def id_assign(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    return dml.assign_ids(c.table("supplier").select("s_suppkey", "s_name"), "symbol_id", dml.next_id(c.table("customer"), "c_custkey"), "s_name", "s_suppkey")


@query(f"""WITH {_GRAPH}, {_BASES}, {_INCLUDES}, gone AS (SELECT symbol_id FROM symbols WHERE file_path IN ('src/building.hpp', 'src/machinery.cpp'))
SELECT 'symbols' AS table_name, symbol_id AS a, module_id AS b FROM symbols WHERE symbol_id NOT IN (FROM gone)
UNION ALL SELECT 'calls', caller, callee FROM calls WHERE caller NOT IN (FROM gone) AND callee NOT IN (FROM gone)
UNION ALL SELECT 'inheritance', derived, base FROM bases WHERE derived NOT IN (FROM gone) AND base NOT IN (FROM gone)
UNION ALL SELECT 'includes', source_symbol_id, target_module_id FROM includes WHERE source_symbol_id NOT IN (FROM gone)""")
def cascade_delete(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    paths = spark.createDataFrame([("src/building.hpp",), ("./src/machinery.cpp",)], "file_path string")
    left = dml.delete_files(paths, {"modules": c.modules, "symbols": c.symbols, "calls": c.calls, "includes": c.includes, "inheritance": c.inheritance})
    shown = {"symbols": ("symbol_id", "module_id"), "calls": ("caller_symbol_id", "callee_symbol_id"), "inheritance": ("derived_symbol_id", "base_symbol_id"), "includes": ("source_symbol_id", "target_module_id")}
    out = None
    for name, (a, b) in shown.items():
        part = left[name].select(F.lit(name).alias("table_name"), F.col(a).alias("a"), F.col(b).alias("b"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END::BIGINT AS label FROM embeddings")
def vector_upsert(spark, sf_dir):
    e = StarCorpus(spark, sf_dir).table("embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    new = e.where("vec_id % 5 = 0").withColumn("label", F.col("label") + 100)
    return dml.upsert(e, new, "vec_id")


def _closure_sql(depth: int) -> str:
    return f"""WITH RECURSIVE {_MODULES}, {_SYMBOLS}, {", ".join(_edge_tables(sparse=True))}, {_EDGES},
r(id, d) AS (SELECT module_id, 0 FROM modules WHERE module_name = 'NATION_0' UNION SELECT dst, d + 1 FROM r JOIN edges ON src = id WHERE d < {depth})
SELECT module_id, module_name, module_path, d AS depth FROM (SELECT id, min(d)::INT AS d FROM r GROUP BY id) JOIN modules ON id = module_id WHERE d > 0"""


def _closure(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    c = StarCorpus(spark, sf_dir, sparse=True)
    return graph.module_closure("NATION_0", depth, c.modules, graph.module_edges(c.calls, c.includes, c.inheritance))


@query(_closure_sql(2))
def module_closure_depth2(spark, sf_dir):
    return _closure(spark, sf_dir, 2)


@query(_closure_sql(5))
def module_closure_depth5(spark, sf_dir):
    return _closure(spark, sf_dir, 5)


def _closure_all_sql(sparse: bool) -> str:
    return f"""WITH RECURSIVE {_MODULES}, {_SYMBOLS}, {", ".join(_edge_tables(sparse))}, {_EDGES},
pairs AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
r(source, id, d) AS (SELECT src, dst, 1 FROM pairs UNION SELECT source, dst, d + 1 FROM r JOIN pairs ON src = id WHERE d < 24)
SELECT source, id AS target, min(d)::INT AS depth FROM r GROUP BY ALL"""


def _closure_all(spark: SparkSession, sf_dir: str, sparse: bool) -> DataFrame:
    c = StarCorpus(spark, sf_dir, sparse=sparse)
    return reach.closure(graph.module_edges(c.calls, c.includes, c.inheritance), loops=True)


@query(_closure_all_sql(False))
def module_closure_all(spark, sf_dir):
    """What each module reaches, over all edges, in one run for all modules."""
    return _closure_all(spark, sf_dir, False)


@query(_closure_all_sql(True))
def module_closure_all_sparse(spark, sf_dir):
    """The same over the sparse edges of the other closures, where paths are longer."""
    return _closure_all(spark, sf_dir, True)


@query(f"WITH {_GRAPH} SELECT count(*) AS symbol_count, max(symbol_id) + 1 AS next_id FROM symbols")
def symbol_count(spark, sf_dir):
    s = StarCorpus(spark, sf_dir).symbols
    return s.agg(F.count("*").alias("symbol_count"), (F.coalesce(F.max("symbol_id"), F.lit(0)) + 1).alias("next_id"))


@query(f"WITH {_GRAPH} SELECT module_name, module_path, count(*) AS symbol_count, count(DISTINCT file_path) AS file_count FROM named GROUP BY ALL")
def module_group(spark, sf_dir):
    return profile.module_groups(StarCorpus(spark, sf_dir).named_symbols)


_KIND = "CASE kind WHEN 0 THEN 'namespace' WHEN 1 THEN 'class' WHEN 2 THEN 'function' WHEN 3 THEN 'method' WHEN 4 THEN 'template' WHEN 5 THEN 'enum' END"
_RANK = "CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 5 THEN 2 WHEN 4 THEN 3 WHEN 2 THEN 4 ELSE 5 END"
_HEADER = "regexp_matches(file_path, '\\.(h|hh|hpp|hxx)$')"


@query(f"""WITH {_GRAPH}, ranked AS (SELECT *, row_number() OVER (PARTITION BY module_name, module_path ORDER BY CASE WHEN {_HEADER} THEN 0 ELSE 1 END, {_RANK}, file_path, start_line, qualified_name, symbol_id) AS rn FROM named),
public AS (SELECT module_name, module_path, count(*) AS n, string_agg('- ' || {_KIND} || ' ' || qualified_name || CASE WHEN signature <> '' THEN ' :: ' || signature ELSE '' END || ' (' || file_path || ')' || chr(10), '' ORDER BY rn) AS listed FROM ranked WHERE rn <= 8 GROUP BY ALL),
headers AS (SELECT module_name, module_path, count(DISTINCT CASE WHEN {_HEADER} THEN file_path END) AS h FROM named GROUP BY ALL)
SELECT module_name, module_path, h AS header_count, n AS public_symbol_count,
  'module ' || module_name || chr(10) || 'path ' || module_path || chr(10) || 'headers ' || h || chr(10) || 'public symbols ' || n || chr(10) || 'selected symbols:' || chr(10) || listed AS summary
FROM public JOIN headers USING (module_name, module_path)""")
def module_profile(spark, sf_dir):
    return profile.module_profiles(StarCorpus(spark, sf_dir).named_symbols)


@query(f"WITH {_GRAPH} SELECT 'NATION_3' AS module_name, 'NATION_3' AS module_path, string_agg(qualified_name, chr(10) ORDER BY symbol_id) AS summary, count(*) AS public_symbol_count, coalesce(sum(({_HEADER})::INT), 0)::BIGINT AS header_count FROM named WHERE module_name = 'NATION_3' OR module_path = 'NATION_3'")
def fallback_module_record(spark, sf_dir):
    return profile.fallback_module("NATION_3", StarCorpus(spark, sf_dir).named_symbols)


@query(
    f"WITH {_GRAPH} SELECT module_name, module_path, (symbol_id - symbol_id % {profile.PART_IDS})::BIGINT AS first_id, string_agg(qualified_name, chr(10) ORDER BY symbol_id) AS summary, "
    f"count(*) AS public_symbol_count, sum(({_HEADER})::INT)::BIGINT AS header_count FROM named GROUP BY 1, 2, 3"
)
def fallback_module_parts(spark, sf_dir):
    return profile.fallback_parts(StarCorpus(spark, sf_dir).named_symbols)


@query(f"WITH {_GRAPH} SELECT symbol_id, {_KIND} AS kind_name, {_RANK}::INT AS kind_rank, {_HEADER} AS is_header FROM named")
def header_flag_rank(spark, sf_dir):
    s = StarCorpus(spark, sf_dir).named_symbols
    return s.select("symbol_id", X.kind_name(F.col("kind")).alias("kind_name"), X.kind_rank(F.col("kind")).alias("kind_rank"), X.is_header(F.col("file_path")).alias("is_header"))


def _query_vector(c: StarCorpus) -> list[float]:
    row = c.table("embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def _module_vectors(c: StarCorpus) -> DataFrame:
    means = centroids(c.vectors.withColumn("key", F.concat_ws("\n", "module_name", "module_path")), "key", "embedding")
    parts = F.split("key", "\n")
    return means.select(parts[0].alias("module_name"), parts[1].alias("module_path"), F.col("centroid").alias("embedding"))


@query(f"WITH {_VECTORS}, {_QUERY_VECTOR} SELECT symbol_id, round({_COSINE}, 6) AS score FROM vectors, q")
def cosine_scores(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    return search.scored(c.vectors, _query_vector(c)).select("symbol_id", F.round("score", 6).alias("score"))


@query(f"WITH {_VECTORS}, {_QUERY_VECTOR} SELECT symbol_id, qualified_name, round({_COSINE}, 6) AS score FROM vectors, q ORDER BY {_COSINE} DESC, module_name, qualified_name LIMIT 5")
def cosine_flat_topk(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    return search.top_symbols(c.vectors, _query_vector(c)).select("symbol_id", "qualified_name", F.round("score", 6).alias("score"))


@query(f"WITH {_VECTORS}, {_QUERY_VECTOR}, {_CENTROIDS} SELECT module_name, module_path, round({_COSINE}, 6) AS score FROM centroids, q ORDER BY {_COSINE} DESC, module_name, module_path LIMIT 3")
def module_topk(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    return search.top_modules(_module_vectors(c), _query_vector(c)).select("module_name", "module_path", F.round("score", 6).alias("score"))


@query(f"""WITH {_VECTORS}, {_QUERY_VECTOR}, {_CENTROIDS}, best AS (SELECT module_name, module_path FROM centroids, q ORDER BY {_COSINE} DESC, module_name, module_path LIMIT 3)
SELECT symbol_id, module_name, qualified_name, round({_COSINE}, 6) AS score FROM vectors SEMI JOIN best USING (module_name, module_path), q ORDER BY {_COSINE} DESC, module_name, qualified_name, file_path, start_line, symbol_id LIMIT 5""")
def hierarchical_search(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    found = search.hierarchical_search(c.vectors, _module_vectors(c), _query_vector(c))
    return found.select("symbol_id", "module_name", "qualified_name", F.round("score", 6).alias("score"))


_HITS = "hits AS (SELECT * FROM named)"
_RELATED = """related AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hit_id, direction ORDER BY qualified_name, file_path, symbol_id)::INT AS rank FROM (
  SELECT h.symbol_id AS hit_id, 'callers' AS direction, n.* FROM hits h JOIN calls ON callee = h.symbol_id JOIN named n ON n.symbol_id = caller
  UNION ALL SELECT h.symbol_id, 'callees', n.* FROM hits h JOIN calls ON caller = h.symbol_id JOIN named n ON n.symbol_id = callee)) WHERE rank <= 4)"""


@query(f"WITH {_GRAPH}, {_HITS}, {_RELATED} SELECT hit_id, direction, rank, symbol_id, qualified_name FROM related")
def related_topn(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    return search.related(c.named_symbols, c.calls, c.named_symbols).select("hit_id", "direction", "rank", "symbol_id", "qualified_name")


_CONTEXT_LIMIT = 24


@query(f"""WITH {_GRAPH}, {_HITS}, {_RELATED}, lines AS (
  SELECT symbol_id, 0 AS part, 0 AS rank, 'Symbol: ' || qualified_name AS line FROM hits
  UNION ALL SELECT symbol_id, 1, 0, 'Module: ' || module_name FROM hits WHERE module_name <> ''
  UNION ALL SELECT symbol_id, 2, 0, 'Signature: ' || signature FROM hits WHERE signature <> ''
  UNION ALL SELECT symbol_id, 3, 0, 'Source: ' || file_path || ' ' || start_line FROM hits
  UNION ALL SELECT DISTINCT hit_id, 4, 0, 'Callers:' FROM related WHERE direction = 'callers'
  UNION ALL SELECT hit_id, 4, rank, '-  ' || qualified_name || CASE WHEN signature <> '' THEN ' :: ' || signature ELSE '' END || ' [' || module_name || ']' FROM related WHERE direction = 'callers'
  UNION ALL SELECT DISTINCT hit_id, 5, 0, 'Callees:' FROM related WHERE direction = 'callees'
  UNION ALL SELECT hit_id, 5, rank, '-  ' || qualified_name || CASE WHEN signature <> '' THEN ' :: ' || signature ELSE '' END || ' [' || module_name || ']' FROM related WHERE direction = 'callees'),
sums AS (SELECT *, tokens, sum(tokens) OVER (PARTITION BY symbol_id ORDER BY part, rank ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT *, {_TOKENS.format('line')} AS tokens FROM lines))
SELECT symbol_id, string_agg(line, chr(10) ORDER BY part, rank) AS context, sum(tokens)::BIGINT AS token_count FROM sums WHERE used <= {_CONTEXT_LIMIT} GROUP BY symbol_id""")
def retrieve_context(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    hits = c.named_symbols.withColumn("source_text", F.concat_ws(" ", "file_path", F.col("start_line").cast("string")))
    return search.retrieve(hits, c.calls, c.named_symbols, token_limit=_CONTEXT_LIMIT).select("symbol_id", "context", "token_count")


@query(f"SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents")
def token_count(spark, sf_dir):
    return StarCorpus(spark, sf_dir).table("documents").select("doc_id", X.token_count(F.col("text")).cast("long").alias("tokens"))


@query("""WITH t AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) > 24 THEN array_to_string(w[1:24], ' ') || ' ...' ELSE text END AS line FROM t""")
def truncate_line(spark, sf_dir):
    return StarCorpus(spark, sf_dir).table("documents").select("doc_id", X.truncate_line(F.col("text"), 24).alias("line"))


@query(f"""WITH whole AS (SELECT doc_id, text, {_TOKENS.format('text')} AS n FROM documents),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM whole WHERE n > 64),
counted AS (SELECT *, {_TOKENS.format('line')} AS n FROM split),
kept AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM counted),
cut AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE n > 0) AS body, max(used)::BIGINT AS used, arg_max(n, pos) AS last FROM kept WHERE used <= 64 GROUP BY doc_id)
SELECT doc_id, CASE WHEN n <= 64 THEN text WHEN body IS NULL THEN '' WHEN used < 64 THEN body || chr(10) || '[truncated]' WHEN last = 0 THEN body || chr(10) ELSE body END AS trimmed FROM whole LEFT JOIN cut USING (doc_id)""")
def trim_to_token_limit(spark, sf_dir):
    return StarCorpus(spark, sf_dir).table("documents").select("doc_id", X.trim_to_token_limit(F.col("text"), 64).alias("trimmed"))


@query("""WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '\\r$', '')) AS l, doc_id % 3 + 1 AS a, doc_id % 3 + 2 AS b FROM documents),
u AS (SELECT doc_id, a, b, CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM t)
SELECT doc_id, CASE WHEN a <= len(l) THEN array_to_string(l[a:least(b, len(l))], chr(10)) ELSE '' END AS snippet FROM u""")
def snippet_extract(spark, sf_dir):
    d = StarCorpus(spark, sf_dir).table("documents")
    return d.select("doc_id", X.snippet(F.col("text"), F.col("doc_id") % 3 + 1, F.col("doc_id") % 3 + 2).alias("snippet"))


@query("SELECT p_partkey, p_name AS include_path FROM part")
def include_normalize(spark, sf_dir):
    p = StarCorpus(spark, sf_dir).table("part")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" <"), "p_name", F.lit(">\t"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('"'), "p_name", F.lit('"\n'))).otherwise(F.concat(F.lit("\x0b"), "p_name"))
    return p.select("p_partkey", X.include_path(raw).alias("include_path"))


@query("SELECT page_id, CASE WHEN s = '' THEN u ELSE s END AS target FROM (SELECT page_id, u, regexp_replace(regexp_replace(u, '^.*/', ''), '^(.+)\\.[^.]*$', '\\1') AS s FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages))")
def include_target_module(spark, sf_dir):
    p = StarCorpus(spark, sf_dir).table("pages")
    return p.select("page_id", X.include_target(F.regexp_replace("url", "[?#].*$", "")).alias("target"))


@query(f"WITH {_GRAPH} SELECT symbol_id, regexp_replace(qualified_name, '^.*::', '') AS short_name FROM named")
def short_name(spark, sf_dir):
    return StarCorpus(spark, sf_dir).named_symbols.select("symbol_id", X.short_name(F.col("qualified_name")).alias("short_name"))


@query(f"""WITH {_GRAPH} SELECT symbol_id, module_path || '::' || qualified_name || '::run' || chr(10) || module_path || '::' || module_name || '::run' || chr(10) || module_path || '::run' || chr(10) || 'run' AS candidates FROM named""")
def candidate_names(spark, sf_dir):
    s = StarCorpus(spark, sf_dir).named_symbols
    scope = F.concat("module_path", F.lit("::"), "qualified_name", F.lit("::body"))
    return s.select("symbol_id", F.array_join(X.candidate_names(scope, F.lit("run")), "\n").alias("candidates"))


@query("""WITH f AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
p AS (SELECT page_id, string_split(path, '/') AS p FROM f), marked AS (SELECT DISTINCT p[1] AS host FROM p WHERE page_id % 5 = 0)
SELECT page_id, CASE WHEN host IS NOT NULL THEN p[1] WHEN len(p) > 1 THEN p[1] ELSE 'web' END AS module_name FROM p LEFT JOIN marked ON p[1] = host""")
def module_identity(spark, sf_dir):
    p = StarCorpus(spark, sf_dir).table("pages")
    path = F.concat(F.lit("/web/"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""))
    files = p.select("page_id", path.alias("path"))
    markers = files.where("page_id % 5 = 0").select(F.concat(F.lit("/web/"), F.split("path", "/")[2]).alias("folder")).distinct()
    named = module_identities(files.select("path").distinct(), markers, "/web")
    return files.join(named, "path").select("page_id", "module_name")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE 'root' END AS module_name FROM customer")
def module_normalize(spark, sf_dir):
    c = StarCorpus(spark, sf_dir).table("customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" \t"), "c_name", F.lit("\r\n"))).otherwise(" \n")
    fallback = F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).otherwise("")
    return c.select("c_custkey", X.module_text(name, fallback).alias("module_name"))


# The evaluation's queries are a list of 20 vectors, whatever the table's size.
_PROBES = "probes AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS q, CASE vec_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'structural' ELSE 'auxiliary' END AS tool_group FROM embeddings WHERE vec_id % 100 = 0)"
_RANKED = f"""ranked AS (SELECT query_id, name, rank FROM (SELECT query_id, vec_id AS name, row_number() OVER (PARTITION BY query_id ORDER BY round({_COSINE}, 9) DESC, vec_id) AS rank FROM probes, (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) WHERE vec_id <> query_id) WHERE rank <= 10),
ranks AS (SELECT query_id, tool_group, min(rank) FILTER (WHERE e.label = p.label) AS first_rank FROM probes p LEFT JOIN ranked USING (query_id) LEFT JOIN embeddings e ON e.vec_id = name GROUP BY ALL)"""


def _ranked(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ten nearest vectors of each probe, and the probes: every vector whose id is divisible by 100."""
    group = F.when(F.col("vec_id") % 3 == 0, "semantic").when(F.col("vec_id") % 3 == 1, "structural").otherwise("auxiliary")
    probes = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", group.alias("tool_group"))
    return _nearest(e, 10).select("query_id", F.col("id").alias("name"), "rank", "score"), probes


def _nearest(e: DataFrame, k: int, others: bool = True) -> DataFrame:
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return topk.nearest(queries, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), k, others)


_MANY = f"""WITH probes AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
scored AS (SELECT query_id, vec_id AS id, round({_COSINE}, 9) AS score FROM probes, (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings))"""


@query(f"{_MANY} SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE id <> query_id) WHERE rank <= 10")
def blocked_topk(spark, sf_dir):
    """Ten neighbours of every vector whose id is divisible by 100, among all others."""
    return _nearest(StarCorpus(spark, sf_dir).table("embeddings"), 10).withColumn("score", F.round("score", 6))


def _vector_index(spark: SparkSession, e: DataFrame) -> tuple[VectorIndex, str]:
    folder = f"{checkpoint_folder(spark)}/vector-index-{uuid.uuid4().hex}"
    index = VectorIndex(spark, folder)
    index.build(e, "vec_id", "embedding")
    return index, folder


@query(f"WITH {_VECTORS}, {_QUERY_VECTOR} SELECT symbol_id, module_name, score FROM (SELECT symbol_id, module_name, round({_COSINE}, 9) AS score FROM vectors, q ORDER BY 3 DESC, 1 LIMIT 10)")
def vector_index_topk(spark, sf_dir):
    """All vectors are indexed; the ten nearest of one are found exactly, reading only cells and vectors that can hold them."""
    c = StarCorpus(spark, sf_dir)
    index, folder = _vector_index(spark, c.vectors.select(F.col("symbol_id").alias("vec_id"), "embedding", "module_name"))
    found = index.search_rows(_query_vector(c), 10, exact=True)
    out = durable(found.select(F.col("id").alias("symbol_id"), "module_name", "score")) if found is not None else spark.createDataFrame([], "symbol_id long, module_name string, score double")
    delete_folder(spark, folder)
    return out


@query(f"{_MANY} SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 5")
def vector_index_topk_many(spark, sf_dir):
    """Five neighbours of every vector whose id is divisible by 100, itself among them, exactly by the index."""
    e = StarCorpus(spark, sf_dir).table("embeddings")
    index, folder = _vector_index(spark, e)
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    out = durable(index.search_many(queries, 5, exact=True).withColumn("score", F.round("score", 6)))
    delete_folder(spark, folder)
    return out


def _first_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = StarCorpus(spark, sf_dir).table("embeddings")
    ranked, probes = _ranked(e)
    # What is expected of a probe is all of its label; only what was ranked needs to be looked up.
    labels = e.join(F.broadcast(ranked.select(F.col("name").alias("vec_id")).distinct()), "vec_id", "left_semi").select(F.col("vec_id").alias("name"), "label")
    expected = labels.join(probes.select("query_id", "label"), "label").select("query_id", "name")
    return evaluation.first_ranks(ranked, expected, probes.select("query_id", "tool_group"))


@query(f"WITH {_PROBES}, {_RANKED} SELECT query_id, tool_group, first_rank::INT AS first_rank FROM ranks")
def eval_first_rank(spark, sf_dir):
    return _first_ranks(spark, sf_dir)


@query(f"""WITH {_PROBES}, {_RANKED}, m AS (SELECT tool_group, coalesce((first_rank <= 5)::INT, 0) AS p5, coalesce((first_rank <= 10)::INT, 0) AS r10, coalesce(1.0::DOUBLE / first_rank, 0) AS rr FROM ranks)
SELECT tool_group, count(*) AS queries, round(avg(p5), 9) AS precision_at_5, round(avg(r10), 9) AS recall_at_10, round(avg(rr), 9) AS mrr
FROM (FROM m UNION ALL SELECT 'overall', p5, r10, rr FROM m WHERE tool_group <> 'auxiliary') GROUP BY tool_group""")
def eval_metrics_by_group(spark, sf_dir):
    m = evaluation.metrics(_first_ranks(spark, sf_dir))
    return m.select("tool_group", "queries", *(F.round(c, 9).alias(c) for c in ("precision_at_5", "recall_at_10", "mrr")))


@query("""SELECT event_type, len(a)::BIGINT AS n, a[round_even((len(a) - 1) * 0.5, 0)::INT + 1] AS p50, a[round_even((len(a) - 1) * 0.95, 0)::INT + 1] AS p95, a[round_even((len(a) - 1) * 0.99, 0)::INT + 1] AS p99
FROM (SELECT event_type, list(value ORDER BY value) AS a FROM events GROUP BY 1)""")
def nearest_rank_percentiles(spark, sf_dir):
    return evaluation.nearest_rank_percentiles(StarCorpus(spark, sf_dir).table("events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("SELECT DISTINCT '/repo/src/' || lower(c_mktsegment) || '/' || 'f' || c_custkey % 40 || '.cpp' AS path FROM customer WHERE c_custkey % 2 = 0")
def changed_files_normalize(spark, sf_dir):
    c = StarCorpus(spark, sf_dir).table("customer")
    name = F.concat(F.lower("c_mktsegment"), F.lit("/f"), (F.col("c_custkey") % 40).cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".cpp").otherwise(".txt"))
    path = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("/repo/./src//"), name)).otherwise(F.concat(F.lit("x/../src/"), name))
    return changed_files(c.select(path.alias("path")), "/repo")


@query(f"""WITH delta AS (SELECT o_orderkey + {SUPPLIERS} AS symbol_id, o_custkey AS module_id, o_orderpriority AS file_path FROM orders WHERE o_orderpriority < '3')
SELECT o_orderkey AS symbol_id, o_custkey AS module_id, o_orderpriority AS file_path, 'base' AS origin FROM orders WHERE o_orderpriority NOT IN (SELECT file_path FROM delta)
UNION ALL SELECT symbol_id, module_id, file_path, 'delta' FROM delta""")
def incremental_update(spark, sf_dir):
    """All orders as symbols; the files of the first two priorities are deleted with all that hangs on them, and come back with new ids."""
    c = StarCorpus(spark, sf_dir)
    rows = c.table("orders").select(F.col("o_orderkey").alias("symbol_id"), F.col("o_custkey").alias("module_id"), F.col("o_orderpriority").alias("file_path"))
    delta = rows.where("file_path < '3'").withColumn("symbol_id", F.col("symbol_id") + SUPPLIERS).withColumn("origin", F.lit("delta"))
    have = {"symbols": rows.withColumn("origin", F.lit("base")), "calls": c.calls, "includes": c.includes, "inheritance": c.inheritance}
    return dml.upsert(dml.delete_files(delta.select("file_path"), have)["symbols"], delta, "symbol_id")


_GONE = "gone AS (SELECT symbol_id FROM symbols WHERE file_path IN ('src/building.hpp', 'src/machinery.cpp')), resolved AS (SELECT s_suppkey + 1000000000000 AS symbol_id FROM supplier WHERE s_suppkey % 10 = 0)"
_MOVED = 5_000_000_000_000


@query(f"""WITH {_GRAPH}, {_BASES}, {_INCLUDES}, {_GONE},
final AS (SELECT symbol_id, module_id, file_path FROM symbols WHERE symbol_id NOT IN (FROM gone) UNION ALL SELECT symbol_id + {_MOVED}, (module_id + 1) % 25, file_path FROM symbols WHERE symbol_id IN (FROM gone)),
pairs AS (SELECT a.module_id AS src, b.module_id AS dst FROM calls JOIN symbols a ON caller = a.symbol_id JOIN symbols b ON callee = b.symbol_id WHERE caller NOT IN (FROM gone) AND callee NOT IN (FROM gone) AND caller NOT IN (FROM resolved)
  UNION ALL SELECT (a.module_id + 1) % 25, b.module_id FROM calls JOIN symbols a ON caller = a.symbol_id JOIN symbols b ON callee = b.symbol_id WHERE caller IN (FROM gone) AND callee NOT IN (FROM gone)
  UNION ALL SELECT a.module_id, b.module_id FROM bases JOIN symbols a ON derived = a.symbol_id JOIN symbols b ON base = b.symbol_id WHERE derived NOT IN (FROM gone) AND base NOT IN (FROM gone) AND derived NOT IN (FROM resolved)
  UNION ALL SELECT source_module_id, target_module_id FROM includes WHERE source_symbol_id NOT IN (FROM gone))
SELECT 'edge' AS view, src AS a, dst AS b, count(*) AS n FROM pairs WHERE src <> dst GROUP BY ALL
UNION ALL SELECT 'symbols', module_id, count(DISTINCT file_path), count(*) FROM final GROUP BY ALL
UNION ALL SELECT 'headers', module_id, count(DISTINCT file_path) FILTER (WHERE {_HEADER}), 0 FROM final GROUP BY ALL""")
def module_views_after_change(spark, sf_dir):
    """Edges between modules with their support, and counts of files and symbols, kept through a change: two files' symbols go and come back in other
    modules with the calls they made, some others' outgoing edges are resolved to nothing."""
    views, folder = _changed_views(spark, sf_dir)
    counts = views.counts()
    out = views.edges().select(F.lit("edge").alias("view"), F.col("src").alias("a"), F.col("dst").alias("b"), "n")
    out = out.unionByName(counts.select(F.lit("symbols").alias("view"), F.col("module_id").alias("a"), F.col("file_count").alias("b"), F.col("symbol_count").alias("n")))
    out = durable(out.unionByName(counts.select(F.lit("headers").alias("view"), F.col("module_id").alias("a"), F.col("header_count").alias("b"), F.lit(0).cast("long").alias("n"))))
    delete_folder(spark, folder)
    return out


def _changed_views(spark: SparkSession, sf_dir: str) -> tuple[ModuleViews, str]:
    c = StarCorpus(spark, sf_dir)
    files = ["src/building.hpp", "src/machinery.cpp"]
    vectors = c.vectors.select((F.col("symbol_id") - (1 << 40)).alias("symbol_id"), "module_name", "module_path", "embedding")
    tables = {"modules": c.modules, "symbols": c.symbols, "calls": c.calls, "inheritance": c.inheritance, "includes": c.includes, "vectors": vectors}
    own = c.symbols.where(F.col("file_path").isin(files))
    # One vector in five moves to the next module, as its symbol goes and comes back.
    moving = vectors.where((F.col("symbol_id") + (1 << 40)) % 5 == 0)
    gone = own.select("symbol_id").unionByName(moving.select("symbol_id"))
    resolved = c.symbols.where(f"symbol_id >= {SUPPLIERS} and (symbol_id - {SUPPLIERS}) % 10 = 0").select("symbol_id")
    moved = own.withColumn("symbol_id", F.col("symbol_id") + _MOVED).withColumn("module_id", (F.col("module_id") + 1) % 25)
    calls = c.calls.join(own.select(F.col("symbol_id").alias("caller_symbol_id")), "caller_symbol_id", "left_semi").join(own.select(F.col("symbol_id").alias("callee_symbol_id")), "callee_symbol_id", "left_anti")
    calls = calls.withColumn("caller_symbol_id", F.col("caller_symbol_id") + _MOVED).withColumn("caller_module_id", (F.col("caller_module_id") + 1) % 25)
    label = ((F.substring("module_name", F.lit(2), F.lit(9)).cast("long") + 1) % 10).cast("string")
    new = {"symbols": moved, "calls": calls, "vectors": moving.withColumn("symbol_id", F.col("symbol_id") + _MOVED).select("symbol_id", F.concat(F.lit("m"), label).alias("module_name"), F.concat(F.lit("path/"), label).alias("module_path"), "embedding")}
    after = {"modules": c.modules, "symbols": c.symbols.join(gone, "symbol_id", "left_anti").unionByName(moved.select(*c.symbols.columns))}
    folder = f"{checkpoint_folder(spark)}/module-views-{uuid.uuid4().hex}"
    views = ModuleViews(spark, folder)
    views.rebuild(tables, 1)
    views.change(tables, new, gone, resolved, after, 2)
    return views, folder


@query("""WITH v AS (SELECT CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings),
d AS (SELECT label, generate_subscripts(embedding, 1) AS dim, round(unnest(embedding)::DOUBLE * 1073741824)::BIGINT AS x FROM v)
SELECT 'm' || label AS module_name, (dim - 1)::INT AS dim, count(*) AS vectors, round(sum(x)::DOUBLE / 1073741824 / count(*), 9) AS mean FROM d GROUP BY label, dim""")
def module_centroids_after_change(spark, sf_dir):
    """Each module's mean vector, kept through a change that moves one vector in five to the next module."""
    views, folder = _changed_views(spark, sf_dir)
    out = durable(views.centroids().select("module_name", "vectors", F.posexplode("centroid").alias("dim", "mean")))
    delete_folder(spark, folder)
    return out


_CLEAN = "regexp_replace({}, '[^A-Za-z0-9_]', '_', 'g')"


@query(f"""WITH n AS (SELECT n_nationkey AS k, {_CLEAN.format('n_name')} AS name, {_CLEAN.format('r_name')} AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
live AS (SELECT n.*, p.k AS pk, p.name AS prev, CASE WHEN n.k % 5 = 0 THEN n.name || '::fresh' ELSE n.name || '::own' END AS second FROM n JOIN n p ON p.k = (n.k + 24) % 25 WHERE n.k <> 7)
SELECT *, true AS in_full FROM (SELECT 'call' AS relation, name || '::run' AS source, prev || '::run' AS target FROM live WHERE pk <> 7
  UNION ALL SELECT 'call', name || '::run', second FROM live UNION ALL SELECT 'call', second, prev || '::own' FROM live WHERE k % 5 = 0
  UNION ALL SELECT 'include', unnest([name, name || '::run', second]), region FROM live)""")
def index_update(spark, sf_dir):
    """A tree of a file for each nation is indexed; one in five changes, one goes; after the update the edges are those of a full index."""
    c = StarCorpus(spark, sf_dir)
    clean = lambda x: re.sub("[^A-Za-z0-9_]", "_", x)
    nations = {r["module_id"]: (clean(r["module_name"]), clean(r["module_path"])) for r in c.modules.collect()}
    folder = f"{checkpoint_folder(spark)}/index-update-{uuid.uuid4().hex}"
    root = f"{folder}/tree"

    def path(k: int) -> str:
        """Names of files and folders begin with _ or . too."""
        name, region = nations[k]
        return (f"{region}/_{name}.cpp", f".{region}/{name}.cpp", f"{region}/{name}.cpp")[k % 3]

    def write(k: int, second: str, body: str) -> str:
        name, region = nations[k]
        text = f'#include "{region}.hpp"\nnamespace {name} {{\nint run(int x) {{ return {nations[(k + 24) % 25][0]}::run(x) + {second}(x); }}\nint {second}(int x) {{ return {body}; }}\n}}\n'
        write_file(spark, f"{root}/{path(k)}", text)
        return path(k)

    for k in nations:
        write(k, "own", "x")
    indexer = Indexer(SnapshotStore(spark, f"{folder}/store"), root)
    indexer.index()
    changed = [write(k, "fresh", f"{nations[(k + 24) % 25][0]}::own(x)") for k in nations if k % 5 == 0]
    delete_folder(spark, f"{root}/{path(7)}")
    paths = spark.createDataFrame([(p,) for p in [*changed, path(7)]], "path string")
    full = Indexer(SnapshotStore(spark, f"{folder}/full"), root)
    at_once(spark, lambda: indexer.update(paths), full.index)
    edges = at_once(spark, *(lambda i=i: durable(_edges_by_name(i.store.read())) for i in (indexer, full)))
    delete_folder(spark, folder)
    same = edges[1].withColumn("in_full", F.lit(True))
    return edges[0].join(same, ["relation", "source", "target"], "full").select("relation", "source", "target", F.coalesce("in_full", F.lit(False)).alias("in_full"))


def _edges_by_name(t: dict[str, DataFrame]) -> DataFrame:
    name = t["symbols"].select("symbol_id", "qualified_name")
    source, target = name.select(F.col("symbol_id").alias("s"), F.col("qualified_name").alias("source")), name.select(F.col("symbol_id").alias("t"), F.col("qualified_name").alias("target"))
    calls = t["calls"].select(F.lit("call").alias("relation"), F.col("caller_symbol_id").alias("s"), F.col("callee_symbol_id").alias("t")).join(source, "s").join(target, "t")
    modules = t["modules"].select(F.col("module_id").alias("t"), F.col("module_name").alias("target"))
    includes = t["includes"].select(F.lit("include").alias("relation"), F.col("source_symbol_id").alias("s"), F.col("target_module_id").alias("t")).join(source, "s").join(modules, "t")
    return calls.unionByName(includes).select("relation", "source", "target")


@query("SELECT event_id, event_type || ' ' || (props->>'k') AS content FROM events")
def sse_delta_extract(spark, sf_dir):
    e = StarCorpus(spark, sf_dir).table("events")
    chunk = lambda x: F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), x, F.lit('"}}]}\n\n'))
    body = F.concat(chunk(F.concat("event_type", F.lit(" "))), chunk(F.get_json_object("props", "$.k")), F.lit("data: [DONE]\n\n"))
    text = F.array_join(F.transform(X.sse_events(body), X.completion_text), "")
    return e.select("event_id", text.alias("content"))


@query(f"WITH {_GRAPH}, {_BASES}, {_INCLUDES} SELECT (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM modules) AS modules, (SELECT count(*) FROM calls) AS calls, (SELECT count(*) FROM includes) AS includes, (SELECT count(*) FROM bases) AS inheritance")
def status_snapshot(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    out = None
    for name in ("symbols", "modules", "calls", "includes", "inheritance"):
        part = getattr(c, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out.groupBy().pivot("name", ["symbols", "modules", "calls", "includes", "inheritance"]).agg(F.first("n"))


_SYSTEM = "You know this code base. Say which of the symbols found answer the query, and why."
_PROMPT_LIMIT = 3072
_ROOM = _PROMPT_LIMIT - len(_SYSTEM.split())
_LINES = "string_split(CASE WHEN ends_with({0}, chr(10)) THEN left({0}, length({0}) - 1) ELSE {0} END, chr(10))"


# The symbols' section is a walk over its lines: one that overflows ends the section, or only its context if it is one of that.
@query(f"""WITH RECURSIVE turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS item FROM conversations),
convs AS (SELECT conv_id, count(*) AS n_turns, arg_min(text, item) AS q FROM turns GROUP BY conv_id),
raw AS (SELECT conv_id, item, 0 AS part, 0 AS k, '- ' || role || ' [chat] score=0.5' AS line FROM turns WHERE item <= 8
  UNION ALL SELECT conv_id, item, 1, 0, '  context:' FROM turns WHERE item <= 8 AND text <> ''
  UNION ALL SELECT conv_id, item, 2, k, '    ' || line FROM (SELECT conv_id, item, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM (SELECT conv_id, item, {_LINES.format('text')} AS l FROM turns WHERE item <= 8 AND text <> ''))),
listed AS (SELECT conv_id, item, part, line, {_TOKENS.format('line')} AS n, row_number() OVER (PARTITION BY conv_id ORDER BY item, part, k) AS pos FROM raw),
walk(conv_id, pos, used, body, ended, skipped) AS (SELECT conv_id, 0::BIGINT, 0::BIGINT, '', false, 0::BIGINT FROM convs
  UNION ALL SELECT conv_id, place, CASE WHEN fits THEN used + n ELSE used END,
    CASE WHEN fits OR blank THEN body || CASE WHEN body <> '' AND NOT ends_with(body, chr(10)) THEN chr(10) ELSE '' END || CASE WHEN fits THEN line ELSE '' END ELSE body END,
    ended OR (n > 0 AND NOT fits AND part < 2 AND NOT passed), CASE WHEN n > 0 AND NOT fits AND part = 2 AND NOT passed THEN item ELSE skipped END
  FROM (SELECT *, n = 0 AND NOT passed AS blank, n > 0 AND NOT passed AND used + n <= 2048 AS fits FROM (
    SELECT w.conv_id, l.pos AS place, used, body, ended, skipped, item, part, line, n, ended OR (part = 2 AND skipped = item) AS passed FROM walk w JOIN listed l ON l.conv_id = w.conv_id AND l.pos = w.pos + 1))),
symbols AS (SELECT conv_id, CASE WHEN arg_max(body, pos) = '' THEN '  none' ELSE arg_max(body, pos) END AS section FROM walk GROUP BY conv_id),
summaries AS (SELECT conv_id, n_turns, q, list_filter(regexp_split_to_array(q, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '') AS w FROM convs),
whole AS (SELECT conv_id, 'Request: search' || chr(10) || 'Query: ' || q || chr(10) || chr(10) || 'Modules:' || chr(10) || '- chat score=0.99 public=' || n_turns || ' headers=0'
    || CASE WHEN q = '' THEN '' WHEN len(w) > 24 THEN chr(10) || '  summary: ' || array_to_string(w[1:24], ' ') || ' ...' ELSE chr(10) || '  summary: ' || q END
    || chr(10) || chr(10) || 'Symbols:' || chr(10) || section || chr(10) || chr(10) || 'Files at hand:' || chr(10) || '  none' || chr(10) AS text FROM summaries JOIN symbols USING (conv_id)),
sized AS (SELECT *, {_TOKENS.format('text')} AS n FROM whole),
split AS (SELECT conv_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT conv_id, {_LINES.format('text')} AS l FROM sized WHERE n > {_ROOM})),
kept AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT *, {_TOKENS.format('line')} AS n FROM split)),
cut AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE n > 0) AS body, max(used)::BIGINT AS used, arg_max(n, pos) AS last FROM kept WHERE used <= {_ROOM} GROUP BY conv_id),
final AS (SELECT conv_id, CASE WHEN n <= {_ROOM} THEN text WHEN body IS NULL THEN '' WHEN used < {_ROOM} THEN body || chr(10) || '[truncated]' WHEN last = 0 THEN body || chr(10) ELSE body END AS user_text FROM sized LEFT JOIN cut USING (conv_id))
SELECT conv_id AS request_id, 'search' AS template_name, {_PROMPT_LIMIT}::BIGINT AS context_token_limit, ({len(_SYSTEM.split())} + {_TOKENS.format('user_text')})::BIGINT AS token_count, '{_SYSTEM}' AS system_text, user_text FROM final""")
def prompt_sections(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = c.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    first = F.element_at("turns", 1)
    symbols = F.transform("turns", lambda t: F.struct(t["role"].alias("qualified_name"), F.lit("chat").alias("module_name"), F.lit("").alias("signature"), t["text"].alias("context"), F.lit(0.5).alias("score")))
    modules = F.array(F.struct(F.lit("chat").alias("module_name"), F.lit("").alias("module_path"), first["text"].alias("summary"), F.lit(0.99).alias("score"), F.size("turns").alias("public_symbol_count"), F.lit(0).alias("header_count")))
    return prompts.prompts(rows.select(F.col("conv_id").alias("request_id"), F.lit("search").alias("request_type"), first["text"].alias("query"), modules.alias("modules"), symbols.alias("symbols")))


@query(f"""WITH {_GRAPH}, w AS (SELECT o_orderkey AS ref, o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 5000000000 END AS symbol_id, CASE WHEN o_orderkey % 3 = 2 THEN 'nobody' ELSE s.qualified_name END AS qualified_name FROM orders JOIN symbols s ON (o_orderkey * 7) % (SELECT count(*) FROM customer) = s.symbol_id)
SELECT w.*, coalesce(s.symbol_id, n.id) AS found_id FROM w LEFT JOIN symbols s ON s.symbol_id = w.symbol_id LEFT JOIN (SELECT qualified_name, min(symbol_id) AS id FROM symbols GROUP BY 1) n ON n.qualified_name = w.qualified_name""")
def symbol_by_id_or_name(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    key, customers = F.col("o_orderkey"), c.table("customer").count()
    named = c.symbols.select(F.col("symbol_id").alias("of"), F.col("qualified_name").alias("name"))
    rows = c.table("orders").join(named, (key * 7) % customers == F.col("of"))
    wanted = rows.select(key.alias("ref"), (F.col("o_custkey") + F.when(key % 3 == 0, 0).otherwise(F.lit(5_000_000_000))).alias("symbol_id"), F.when(key % 3 == 2, "nobody").otherwise(F.col("name")).alias("qualified_name"))
    return graph.by_id_or_name(wanted, c.symbols)


@query("SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, n_chars FROM documents")
def null_texts_decoded(spark, sf_dir):
    return graph.decoded(StarCorpus(spark, sf_dir).table("documents"))


@query(f"WITH {_GRAPH} SELECT symbol_id, to_json({{'symbol_id': symbol_id, 'file_path': file_path, 'module_name': module_name, 'module_path': module_path, 'qualified_name': qualified_name, 'signature': signature, 'start_line': start_line, 'end_line': end_line, 'kind': {_KIND}}})::VARCHAR AS body FROM named")
def symbols_as_json(spark, sf_dir):
    return StarCorpus(spark, sf_dir).named_symbols.select("symbol_id", graph.symbol_json().alias("body"))


@query(f"WITH {_GRAPH} SELECT file_path, min(symbol_id) AS first FROM symbols GROUP BY 1")
def changed_files_first_seen(spark, sf_dir):
    return graph.first_seen(StarCorpus(spark, sf_dir).symbols, "file_path", "symbol_id")


@query("SELECT c_custkey, c_name AS field FROM customer")
def field_trim(spark, sf_dir):
    c = StarCorpus(spark, sf_dir).table("customer")
    return c.select("c_custkey", X.trim_api(F.concat(F.lit(" \t"), "c_name", F.lit("\r\n "))).alias("field"))


@query("SELECT page_id, split_part(url, '?', 1) AS path FROM pages")
def request_path(spark, sf_dir):
    return StarCorpus(spark, sf_dir).table("pages").select("page_id", X.request_path(F.col("url")).alias("path"))


@query(f"WITH {_GRAPH} SELECT symbol_id, qualified_name AS name FROM named")
def query_prefix_strip(spark, sf_dir):
    s = StarCorpus(spark, sf_dir).named_symbols
    prefix = F.element_at(F.array(*map(F.lit, ("Explain ", "Dependencies of ", "Who calls ", "Overview of the "))), (F.col("symbol_id") % 4 + 1).cast("int"))
    return s.select("symbol_id", X.strip_question(F.concat(prefix, "qualified_name", F.lit("?"))).alias("name"))


@query("""WITH r AS (SELECT event_id, (['/search', '/explain', '/deps', '/callers', '/module', '/else'])[event_id % 6 + 1] AS path, event_type AS subject, event_id % 11 AS n, event_id % 7 AS form FROM events),
s AS (SELECT *, CASE WHEN form IN (2, 3) OR path = '/else' THEN NULL ELSE subject END AS kept FROM r)
SELECT event_id, path, kept AS subject, CASE WHEN path NOT IN ('/deps', '/module') THEN NULL WHEN form IN (1, 3) THEN CASE WHEN path = '/deps' THEN 2 ELSE 1 END ELSE n END::BIGINT AS depth,
  CASE WHEN path <> '/search' THEN NULL WHEN form IN (1, 3) THEN 5 ELSE n END::BIGINT AS "limit",
  CASE WHEN path = '/else' THEN 404 WHEN form IN (2, 3) THEN 400 WHEN form <> 1 AND path IN ('/deps', '/module') AND NOT n BETWEEN 1 AND 8 THEN 400 WHEN form <> 1 AND path = '/search' AND n = 0 THEN 400 ELSE 200 END AS status FROM s""")
def parse_requests(spark, sf_dir):
    """Bodies of seven forms: one without numbers, one with a blank subject, one that is no JSON."""
    e = StarCorpus(spark, sf_dir).table("events")
    path = F.element_at(F.array(*map(F.lit, ("/search", "/explain", "/deps", "/callers", "/module", "/else"))), (F.col("event_id") % 6 + 1).cast("int"))
    field = F.when(path == "/search", "query").when(path == "/module", "module_name").when(path == "/deps", "symbol_name").otherwise("name")
    form, n = F.col("event_id") % 7, (F.col("event_id") % 11).cast("string")
    named = F.concat(F.lit('{"'), field, F.lit('": " '), F.when(form == 2, "").otherwise(F.col("event_type")), F.lit('\\t"'))
    body = F.when(form == 3, F.lit('{"query": ')).when(form == 1, F.concat(named, F.lit("}"))).otherwise(F.concat(named, F.lit(', "depth": '), n, F.lit(', "limit": '), n, F.lit("}")))
    rows = e.select("event_id", F.concat(path, F.when(form == 4, "?x=1").otherwise("")).alias("target"), body.alias("body"))
    return parsed_requests(rows).select("event_id", "path", "subject", "depth", "limit", "status")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 > 0 THEN floor(o_orderkey::DOUBLE / (o_custkey % 7) * (o_custkey % 11))::BIGINT END AS eta FROM orders")
def eta_ms(spark, sf_dir):
    o = StarCorpus(spark, sf_dir).table("orders")
    return o.select("o_orderkey", X.eta_ms(F.col("o_orderkey").cast("double"), F.col("o_custkey") % 7, F.col("o_custkey") % 11).alias("eta"))


@query(f"WITH {_PROBES}, {_RANKED} SELECT query_id, count(*) FILTER (WHERE rank <= 5 AND e.label = p.label) / 5.0::DOUBLE AS precision FROM probes p JOIN ranked USING (query_id) JOIN embeddings e ON e.vec_id = name GROUP BY query_id")
def eval_precision_at_5(spark, sf_dir):
    e = StarCorpus(spark, sf_dir).table("embeddings")
    ranked, probes = _ranked(e)
    labels = e.join(F.broadcast(ranked.select(F.col("name").alias("vec_id")).distinct()), "vec_id", "left_semi").select(F.col("vec_id").alias("name"), F.col("label").alias("found"))
    judged = ranked.join(labels, "name").join(F.broadcast(probes.select("query_id", "label")), "query_id").withColumn("relevant", F.col("found") == F.col("label"))
    return evaluation.precision_at(judged)


@query("SELECT vec_id AS symbol_id, 'f' || vec_id % 7 || '.cpp' AS file_path FROM embeddings WHERE vec_id % 7 NOT IN (2, 5)")
def vector_delete_by_file(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    paths = spark.createDataFrame([("f2.cpp",), ("x/../f5.cpp",), ("f9.cpp",)], "file_path string")
    edges = {k: getattr(c, k).limit(0) for k in ("calls", "includes", "inheritance")}
    return dml.delete_files(paths, {"symbols": c.vectors.select("symbol_id", "file_path"), "vectors": c.vectors, **edges})["vectors"].select("symbol_id", "file_path")


@query(f"WITH {_GRAPH} SELECT DISTINCT c_custkey + 1 AS symbol_id FROM customer WHERE c_custkey + 1 NOT IN (SELECT symbol_id FROM symbols) UNION SELECT DISTINCT ps.l_partkey FROM lineitem ps WHERE ps.l_partkey NOT IN (SELECT symbol_id FROM symbols)")
def edges_to_unknown(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    ends = c.table("customer").select((F.col("c_custkey") + 1).alias("a"), (F.col("c_custkey") + 1).alias("b")).unionByName(c.table("lineitem").select(F.col("l_partkey").alias("a"), F.col("l_partkey").alias("b")))
    return dml.missing_symbols(ends, ["a", "b"], c.symbols.select("symbol_id"))


@query(f"""WITH {_GRAPH}, ends AS (SELECT callee AS hit_id, caller AS other, 'callers' AS direction FROM calls UNION ALL SELECT caller, callee, 'callees' FROM calls),
listed AS (SELECT hit_id, direction, string_agg('- ' || qualified_name || CASE WHEN signature <> '' THEN ' :: ' || signature ELSE '' END || ' [' || module_name || ']', chr(10) ORDER BY qualified_name, file_path, symbol_id) AS lines
  FROM ends JOIN named n ON n.symbol_id = other GROUP BY ALL)
SELECT symbol_id, 'Symbol: ' || qualified_name || chr(10) || 'Module: ' || module_name || CASE WHEN signature <> '' THEN chr(10) || 'Signature: ' || signature ELSE '' END || chr(10) || 'Source: ' || file_path || ' ' || start_line
  || coalesce(chr(10) || 'Callers:' || chr(10) || a.lines, '') || coalesce(chr(10) || 'Callees:' || chr(10) || b.lines, '') AS context
FROM named LEFT JOIN listed a ON a.hit_id = symbol_id AND a.direction = 'callers' LEFT JOIN listed b ON b.hit_id = symbol_id AND b.direction = 'callees'""")
def unbudgeted_context(spark, sf_dir):
    """Everything about every symbol: a line for each caller and callee, without a limit."""
    c = StarCorpus(spark, sf_dir)
    hits = c.named_symbols.withColumn("source_text", F.concat_ws(" ", "file_path", F.col("start_line").cast("string")))
    return search.retrieve(hits, c.calls, c.named_symbols, None, None, "-").select("symbol_id", "context")


@query()
def hash_embed_search(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    items = with_embeddings(c.table("benchmark").select(F.col("item_id").alias("symbol_id"), "text"), "text")
    rows = items.select("symbol_id", F.lit("benchmark").alias("module_name"), F.col("symbol_id").cast("string").alias("qualified_name"), F.lit("").alias("file_path"), F.lit(0).alias("start_line"), "embedding")
    return search.top_symbols(rows, hash_vector("the and of in que de la"), 20).select("symbol_id", F.round("score", 6).alias("score"))


# A file for each symbol: M its module, I its id, L its line.
_CPP = """#include "M.hpp"
#include <vector>
namespace M {
// class Hidden { };
enum class ModeI { Off, On = L };
template <typename T>
T pickI(T a, T b) { return a < b ? first(a) : std::max<T>(a, b); }
class CI : public Base, private other::Thing<int> {
public:
  explicit CI(int x) : x_(x) { init(x); }
  int run(int x) { return helper(x) + std::max(x, L); }
  bool operator==(const CI& o) const;
private:
  int x_;
};
bool CI::operator==(const CI& o) const { return same(o) && o.x_ == x_; }
}
int mainI() {
  return M::pickI(1, 2);
}
"""
_CPP_ROWS = (
    ("namespace", "M", "", 3, 17, "", ""),
    ("enum", "M::ModeI", "", 5, 5, "", ""),
    ("template", "M::pickI", "template <typename T>", 6, 7, "", ""),
    ("function", "M::pickI", "T pickI(T a, T b)", 7, 7, "first,std::max", ""),
    ("class", "M::CI", "", 8, 15, "", "M::Base,other::Thing<int>"),
    ("method", "M::CI::CI", "explicit CI(int x) : x_(x)", 10, 10, "init", ""),
    ("method", "M::CI::run", "int run(int x)", 11, 11, "helper,std::max", ""),
    ("method", "M::CI::operator==", "bool operator==(const CI& o) const", 12, 12, "", ""),
    ("method", "M::CI::operator==", "bool CI::operator==(const CI& o) const", 16, 16, "same", ""),
    ("function", "mainI", "int mainI()", 18, 20, "M::pickI", ""),
)


def _filled(text: str) -> str:
    """SQL of ``text`` with M and I replaced by a symbol's module and id."""
    text = re.sub(r"\b(Mode|pick|main|C)I\b", r"\1' || symbol_id || '", re.sub(r"\bM\b", "' || module_name || '", text))
    return f"'{text}'"


@query(f"""WITH {_GRAPH}, made AS (SELECT 'gen/' || symbol_id || '.cpp' AS path, module_name, symbol_id FROM named)
{" UNION ALL ".join(f"SELECT path, {i} AS ordinal, '{kind}' AS kind, {_filled(name)} AS qualified_name, {_filled(text)} AS signature, {a} AS start_line, {b} AS end_line, module_name || '.hpp,vector' AS includes, {_filled(calls)} AS calls, {_filled(bases)} AS bases FROM made" for i, (kind, name, text, a, b, calls, bases) in enumerate(_CPP_ROWS))}""")
def parse_cpp(spark, sf_dir):
    c = StarCorpus(spark, sf_dir)
    text = F.lit(_CPP)
    for mark, value in ((r"\bM\b", "module_name"), (r"(?<=\b(Mode|pick|main|C))I\b", "symbol_id"), (r"\bL\b", "start_line")):
        text = F.regexp_replace(text, F.lit(mark), F.col(value).cast("string"))
    # Dealt before the texts are made, which is cheaper than after.
    made = dealt(c.named_symbols, "symbol_id").select(F.concat(F.lit("gen/"), F.col("symbol_id").cast("string"), F.lit(".cpp")).alias("path"), text.alias("text"))
    return parse_files(made, deal=False).select("path", "ordinal", "kind", "qualified_name", "signature", "start_line", "end_line", F.array_join("includes", ",").alias("includes"), F.array_join("outgoing_calls", ",").alias("calls"), F.array_join("base_classes", ",").alias("bases"))
