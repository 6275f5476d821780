"""Requests against an indexed tree, answered as plain dictionaries with a status."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corpusloom.model import KIND_NAMES
from corpusloom.operators import graph, profile, search
from corpusloom.operators.prompts import PromptBuilder
from corpusloom.plans.index import Indexer
from corpusloom.session import durable
from corpusloom.sources.embedding import with_embeddings
from corpusloom.sources.files import parse_local_files
from corpusloom.sources.git import changed_table
from corpusloom.sources.suffix_index import SuffixIndex
from corpusloom.sources.vector_index import VectorIndex
from corpusloom.sources.vector_store import VectorStore

#: Steps of a closure and symbols of a search that a request may ask for.
MAX_DEPTH, SEARCH_LIMIT = 8, 100
Complete = Callable[[list[dict[str, str]], str | None], str]


class RequestError(Exception):
    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


def _field(body: dict[str, Any], *names: str) -> str:
    for name in names:
        value = str(body.get(name) or "").strip(" \t\r\n")
        if value:
            return value
    raise RequestError(400, f"missing field: {names[0]}")


def _number(body: dict[str, Any], name: str, default: int, least: int, most: int) -> int:
    value = body.get(name, default)
    try:
        n = int(value)
    except (TypeError, ValueError) as e:
        raise RequestError(400, f"{name}: {value!r} is no number") from e
    if not least <= n <= most:
        raise RequestError(400, f"{name}: {n} is not between {least} and {most}")
    return n


def symbol_json(row: Row | dict[str, Any]) -> dict[str, Any]:
    r = row.asDict() if isinstance(row, Row) else dict(row)
    out = {k: r[k] for k in ("symbol_id", "file_path", "module_name", "module_path", "qualified_name", "signature", "start_line", "end_line")}
    return out | {"kind": KIND_NAMES.get(r["kind"], "unknown")}


class Engine:
    """``handle(method, target, body)``, or the request methods by name. ``load`` makes it ready."""

    def __init__(self, indexer: Indexer, complete: Complete | None = None, prompts: PromptBuilder | None = None, vector_store: VectorStore | VectorIndex | None = None, names: SuffixIndex | None = None) -> None:
        """``vector_store``: if it is ready, its nearest symbols come first; the search by modules is used where it finds none. ``names``: an index
        of the symbols' names, asked in place of a scan."""
        self.indexer, self.complete, self.prompts, self.vector_store, self.names = indexer, complete, prompts or PromptBuilder(), vector_store, names
        self.tables: dict[str, DataFrame] | None = None
        self.modules: DataFrame | None = None
        self.indexed_at: int | None = None

    def load(self) -> Engine:
        """Read the current snapshot and its modules' profiles: those of the indexer's views, if they are up to it."""
        self.tables = t = self.indexer.store.read()
        views = self.indexer.views
        if views is not None and views.brought_to() == self.indexer.store.version() > 0:
            self.modules = durable(views.profiles())
        else:
            records = profile.module_profiles(graph.with_modules(t["symbols"], t["modules"]))
            self.modules = durable(with_embeddings(records, "summary", self.indexer.embed))
        self.indexed_at = int(time.time() * 1000)
        return self

    def handle(self, method: str, target: str, body: str = "{}") -> dict[str, Any]:
        path = target.partition("?")[0]
        try:
            if path == "/status":
                if method != "GET":
                    raise RequestError(405, "use GET")
                return {"status": 200, "body": self.status()}
            call = {"/search": self.search, "/explain": self.explain, "/deps": self.deps, "/callers": self.callers, "/module": self.module, "/reindex": self.reindex}.get(path)
            if call is None:
                raise RequestError(404, f"unknown endpoint {path}")
            if method != "POST":
                raise RequestError(405, "use POST")
            try:
                fields = json.loads(body or "{}")
            except ValueError as e:
                raise RequestError(400, f"invalid JSON: {e}") from e
            return {"status": 200, "body": call(fields if isinstance(fields, dict) else {})}
        except RequestError as e:
            return {"status": e.status, "body": {"error": str(e)}}
        except Exception as e:  # noqa: BLE001  a request's failure is an answer
            return {"status": 500, "body": {"error": str(e)}}

    def _ready(self) -> dict[str, DataFrame]:
        if self.tables is None:
            raise RequestError(503, "the corpus is not ready")
        return self.tables

    def _find(self, name: str) -> Row:
        t = self._ready()
        if self.names is not None:
            ids = self.names.find(name).select("symbol_id")
            found = graph.with_modules(t["symbols"].join(F.broadcast(ids), "symbol_id", "left_semi"), t["modules"]).first()
        else:
            found = graph.lookup(name, t["symbols"], t["modules"]).first() or graph.lookup_any_suffix(name, t["symbols"], t["modules"]).first()
        if found is None:
            raise RequestError(404, f"unknown symbol {name}")
        return found

    def _hits(self, hits: DataFrame, related_limit: int | None, token_limit: int | None, gap: str = "- ") -> list[dict[str, Any]]:
        t = self._ready()
        symbols = graph.with_modules(t["symbols"], t["modules"])
        rows = search.retrieve(hits, t["calls"], symbols, related_limit, token_limit, gap)
        return [r.asDict() for r in rows.orderBy(F.desc("score"), *search.SYMBOL_TIES).collect()]

    def _module_record(self, name: str) -> dict[str, Any] | None:
        t = self._ready()
        row = self.modules.where((F.col("module_name") == name) | (F.col("module_path") == name)).drop("embedding").first()
        if row is None:
            row = profile.fallback_module(name, graph.with_modules(t["symbols"], t["modules"])).first()
            if not row["public_symbol_count"]:
                return None
        return row.asDict()

    def search(self, body: dict[str, Any]) -> dict[str, Any]:
        t = self._ready()
        query = _field(body, "query")
        vector = [float(x) for x in self.indexer.embed([query])[0]]
        modules = search.top_modules(self.modules, vector).drop("embedding").collect()
        limit = _number(body, "limit", search.SYMBOL_TOP_K, 1, SEARCH_LIMIT)
        found = self._flat(vector, limit) if self.vector_store is not None else None
        if found is None:
            found = durable(search.hierarchical_search(t["vectors"], self.modules, vector, symbol_k=limit))
        hits = self._hits(found, search.RELATED_LIMIT, search.CONTEXT_TOKENS)
        return {"query": query, "modules": [m.asDict() for m in modules], "symbols": [symbol_json(h) | {"score": h["score"], "context": h["context"], "token_count": h["token_count"]} for h in hits]}

    def _flat(self, vector: list[float], limit: int) -> DataFrame | None:
        """What the vector store finds, with the current rows of its symbols; None if it finds none."""
        scores = {p["symbol_id"]: score for p, score in self.vector_store.search(vector, limit)}
        if not scores:
            return None
        ranked = self.indexer.spark.createDataFrame(list(scores.items()), "symbol_id long, score double")
        found = durable(self._ready()["vectors"].join(F.broadcast(ranked), "symbol_id"))
        return None if found.isEmpty() else found

    def explain(self, body: dict[str, Any], header_model: str | None = None) -> dict[str, Any]:
        t = self._ready()
        found = self._find(_field(body, "name", "symbol_name"))
        hit = t["vectors"].where(F.col("symbol_id") == found["symbol_id"]).withColumn("score", F.lit(1.0))
        hits = self._hits(hit, None, None, "-")
        module = self._module_record(found["module_name"])
        prompt = self.prompts.build("explain", found["qualified_name"], [module | {"score": 1.0}] if module else [], hits, self._local_files(body))
        model = body.get("model") or header_model
        answer = self.complete(prompt["messages"], model) if self.complete else None
        return {"symbol": symbol_json(found), "prompt": prompt, "model": model, "completion": answer}

    @staticmethod
    def _local_files(body: dict[str, Any]) -> list[dict[str, str]]:
        given = body.get("local_files") or []
        return parse_local_files(given if isinstance(given, str) else json.dumps(given))

    def deps(self, body: dict[str, Any]) -> dict[str, Any]:
        t = self._ready()
        found = self._find(_field(body, "name", "symbol_name"))
        depth = _number(body, "depth", 2, 1, MAX_DEPTH)
        near = {k: [symbol_json(r) for r in f(found["symbol_id"], t["calls"], t["symbols"], t["modules"]).collect()] for k, f in (("callers", graph.callers_of), ("callees", graph.callees_from))}
        return {"symbol": symbol_json(found), **near, "modules": self._closure(found["module_name"], depth)}

    def _closure(self, module: str, depth: int) -> list[dict[str, Any]]:
        t = self._ready()
        edges = graph.module_edges(t["calls"], t["includes"], t["inheritance"])
        return [r.asDict() for r in graph.module_closure(module, depth, t["modules"], edges).select("module_name", "module_path", "depth").collect()]

    def callers(self, body: dict[str, Any]) -> dict[str, Any]:
        t = self._ready()
        found = self._find(_field(body, "name", "symbol_name"))
        rows = graph.callers_of(found["symbol_id"], t["calls"], t["symbols"], t["modules"]).collect()
        return {"symbol": symbol_json(found), "callers": [symbol_json(r) for r in rows]}

    def module(self, body: dict[str, Any]) -> dict[str, Any]:
        t = self._ready()
        name = _field(body, "module_name", "name")
        record = self._module_record(name)
        if record is None:
            raise RequestError(404, f"unknown module {name}")
        own = graph.with_modules(t["symbols"], t["modules"]).where((F.col("module_name") == name) | (F.col("module_path") == name))
        rows = own.orderBy("symbol_id").collect()
        return {"module": record, "symbols": [symbol_json(r) for r in rows], "dependencies": self._closure(record["module_name"], _number(body, "depth", 1, 1, MAX_DEPTH))}

    def reindex(self, body: dict[str, Any]) -> dict[str, Any]:
        spark = self.indexer.spark
        given = body.get("files") or body.get("changed_files")
        paths = spark.createDataFrame([(str(p),) for p in given], "path string") if given else changed_table(spark, self.indexer.root, body.get("base_ref") or "HEAD~1")
        root = self.indexer.root + "/"
        paths = paths.select(F.when(F.col("path").startswith(root), F.substring("path", F.lit(len(root) + 1), F.lit(1 << 30))).otherwise(F.col("path")).alias("path"))
        changed = [r["path"] for r in paths.collect()]
        stats = self.indexer.update(paths)
        warnings = []
        try:
            self.load()
        except Exception as e:  # noqa: BLE001  the new snapshot is published; the old one still answers
            warnings.append(str(e))
        return {"files": list(dict.fromkeys(changed)), "stats": vars(stats), "warnings": warnings}

    def status(self) -> dict[str, Any]:
        ready = self.tables is not None
        counts = {name: self.tables[name].count() for name in ("symbols", "modules", "calls", "includes", "inheritance")} if ready else {}
        return {"ready": ready, "root": self.indexer.root, "snapshot": self.indexer.store.version(), "indexed_at_unix_ms": self.indexed_at, **counts}


def ranked_names(tool: str, payload: dict[str, Any]) -> list[str]:
    """The names in a tool's answer, in order, each once: what an evaluation ranks."""
    names: list[str] = []
    if tool in ("search", "semantic_search", "module"):
        names += [s["qualified_name"] for s in payload.get("symbols", [])]
    elif tool == "callers":
        names += [s["qualified_name"] for s in payload.get("callers", [])]
    elif tool == "deps":
        names += [s["qualified_name"] for k in ("callers", "callees") for s in payload.get(k, [])]
        names += [m["module_name"] for m in payload.get("modules", [])]
    if payload.get("symbol") and tool == "explain":
        names.insert(0, payload["symbol"]["qualified_name"])
    return list(dict.fromkeys(names))


