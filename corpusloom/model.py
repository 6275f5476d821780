"""The relational model: modules, symbols and three kinds of edges, with the schemas of all tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The kinds of symbols and their codes.
KINDS = {"namespace": 0, "class": 1, "function": 2, "method": 3, "template": 4, "enum": 5}
KIND_NAMES = {v: k for k, v in KINDS.items()}
# The rank of a kind among a module's public symbols.
KIND_RANKS = {"namespace": 0, "class": 1, "enum": 2, "template": 3, "function": 4, "method": 5}
# File name extensions.
SOURCE_EXTENSIONS = (".cpp", ".cxx", ".cc", ".h", ".hpp", ".hxx")
HEADER_EXTENSIONS = (".h", ".hh", ".hpp", ".hxx")
SKIPPED_FOLDERS = (".git", "build", "cmake-build-debug", "cmake-build-release", ".cache", "node_modules")


def _table(*columns: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(c[0], c[1], c[2] if len(c) > 2 else False) for c in columns])


L, S, B = T.LongType(), T.StringType(), T.ByteType()

MODULES = _table(("module_id", L), ("module_name", S), ("module_path", S))
SYMBOLS = _table(("symbol_id", L), ("module_id", L), ("file_path", S), ("kind", B), ("qualified_name", S), ("signature", S), ("start_line", L), ("end_line", L))
CALLS = _table(("call_id", L), ("caller_symbol_id", L), ("callee_symbol_id", L), ("caller_module_id", L), ("callee_module_id", L))
INCLUDES = _table(("include_id", L), ("source_symbol_id", L), ("include_path", S), ("source_module_id", L), ("target_module_id", L, True))
INHERITANCE = _table(("inheritance_id", L), ("derived_symbol_id", L), ("base_symbol_id", L), ("derived_module_id", L), ("base_module_id", L))
VECTORS = _table(("symbol_id", L), ("module_name", S), ("module_path", S), ("file_path", S), ("qualified_name", S), ("signature", S), ("source_text", S), ("kind", B), ("start_line", L), ("end_line", L), ("embedding", T.ArrayType(T.FloatType(), False)))
#: What the parser found by name; kept so that edges can be resolved anew when other files change.
REFERENCES = _table(("symbol_id", L), ("relation", S), ("ordinal", T.IntegerType()), ("target", S))
TABLES = {"modules": MODULES, "symbols": SYMBOLS, "calls": CALLS, "includes": INCLUDES, "inheritance": INHERITANCE, "vectors": VECTORS, "references": REFERENCES}

PARSED = T.StructType(
    [
        T.StructField("path", S),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("kind", S),
        T.StructField("qualified_name", S),
        T.StructField("signature", S),
        T.StructField("start_line", L),
        T.StructField("end_line", L),
        T.StructField("includes", T.ArrayType(S)),
        T.StructField("outgoing_calls", T.ArrayType(S)),
        T.StructField("base_classes", T.ArrayType(S)),
        T.StructField("error", S),
    ]
)
#: The columns of a symbol as the graph operators return it.
SYMBOL_COLUMNS = ("symbol_id", "file_path", "module_name", "module_path", "kind", "qualified_name", "signature", "start_line", "end_line")
SYMBOL_ORDER = ("file_path", "qualified_name", "start_line", "end_line", "symbol_id")
