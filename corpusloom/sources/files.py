"""Source trees as tables, and small inputs read on the driver."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.model import SOURCE_EXTENSIONS
from corpusloom.sources.tree import NAME, register


def scan_files(spark: SparkSession, root: str, extensions: Sequence[str] = SOURCE_EXTENSIONS, recursive: bool = True, read: bool = True) -> DataFrame:
    """(path, relative_path, text) of the files of a tree, folders of builds and tools left out; see ``sources.tree``.

    The text of a file that can't be read is null; so is every text unless ``read``. Order by ``path_order`` for the order of path
    components.
    """
    return _tree(spark, extensions).options(recursive=recursive, read=read).load(root).drop("error")


def _tree(spark: SparkSession, extensions: Sequence[str]) -> DataFrameReader:
    register(spark)
    return spark.read.format(NAME).option("extensions", json.dumps(list(extensions)))


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of some paths that are there."""
    out = []
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            out.append(p)
    return out


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any store; one of that name is replaced."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_files(spark: SparkSession, root: str, relative: Sequence[str], extensions: Sequence[str] = SOURCE_EXTENSIONS) -> DataFrame:
    """As ``scan_files``, of the given files only; those that aren't there have no row. Nothing of the tree is listed."""
    return _tree(spark, extensions).option("only", json.dumps(list(relative))).load(root).drop("error")


def path_order(path: str = "path") -> Column:
    """A key that orders paths component by component."""
    return F.split(path, "/")


def changed_files(paths: DataFrame, root: str, extensions: Sequence[str] = SOURCE_EXTENSIONS) -> DataFrame:
    """Changed paths made absolute and normal, each once, of the extensions only, in order of path."""
    absolute = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col("path")))
    rows = paths.where("path is not null").select(X.normal_path(absolute).alias("path"))
    return rows.where(X.extension(F.col("path")).isin(*extensions)).distinct().orderBy(path_order())


def module_identities(files: DataFrame, markers: DataFrame, root: str) -> DataFrame:
    """(path, module_name): the nearest folder up to the root that holds a build file, else the first folder
    below the root, else the root's own name, else ``root``.

    ``files``: path. ``markers``: folder, absolute, of each build file. Names are relative to the root; the root itself goes by its name.
    """
    root = root.rstrip("/")
    own = F.lit(PurePosixPath(root).name or "root")
    below = F.substring(F.col("path"), F.lit(len(root) + 2), F.lit(1 << 30))
    parts = F.split(below, "/")
    rows = files.select("path", parts.alias("parts"))
    folders = rows.select("path", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("depth"), "parts")
    folders = folders.select("path", "depth", F.concat(F.lit(root), F.when(F.col("depth") > 0, F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/"))).otherwise("")).alias("folder"))
    nearest = folders.join(markers.select("folder").distinct(), "folder", "left_semi").groupBy("path").agg(F.max("depth").alias("depth"))
    joined = rows.join(nearest, "path", "left")
    marked = F.when(F.col("depth") == 0, own).otherwise(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/"))
    first = F.when(F.size("parts") > 1, F.element_at("parts", 1)).otherwise(own)
    return joined.select("path", F.coalesce(marked, first).alias("module_name"))


def parse_local_files(payload: str) -> list[dict[str, str]]:
    """The objects of a JSON list with a path or a content; anything else is passed over."""
    value = json.loads(payload)
    rows = [{"path": str(v.get("path") or ""), "content": str(v.get("content") or "")} for v in value if isinstance(v, dict)] if isinstance(value, list) else []
    return [r for r in rows if r["path"] or r["content"]]


def workspace_path(path: str, workspace: str) -> str:
    """A path relative to the workspace; blank stays empty, one that leaves it is an error."""
    if not path.strip():
        return ""
    full = os.path.normpath(os.path.join(workspace, path.strip()))
    relative = os.path.relpath(full, workspace)
    if relative == ".." or relative.startswith("../"):
        raise ValueError(f"{path!r} is outside the workspace")
    return "" if relative == "." else relative


def evaluation_queries(spark: SparkSession, path: str) -> DataFrame:
    """The queries of a JSON manifest, one row each."""
    schema = "id string, tool string, query string, model string, module_name string, depth int, expected_symbols array<string>"
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def tool_arguments(row: dict[str, Any]) -> dict[str, Any]:
    """A query row as the arguments of its tool."""
    tool, query = row["tool"], row["query"]
    name = query
    for prefix in ("Explain ", "Dependencies of ", "Who calls ", "Overview of the "):
        name = name.removeprefix(prefix)
    name = name.removesuffix("?").strip()
    if tool in ("search", "semantic_search"):
        return {"query": query}
    if tool == "module":
        return {"module_name": row.get("module_name") or name, **({"depth": row["depth"]} if row.get("depth") else {})}
    args: dict[str, Any] = {"name": name}
    if tool == "explain" and row.get("model"):
        args["model"] = row["model"]
    if tool == "deps" and row.get("depth"):
        args["depth"] = row["depth"]
    return args
