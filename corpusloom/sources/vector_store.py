"""A vector store behind an HTTP interface of collections, points and searches; the transport is the caller's.

``Send`` takes method, path and body and gives status and answer, so that the client needs no network of its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.session import prepare

Send = Callable[[str, str, str | None], tuple[int, str]]
# The columns of a point's payload.
PAYLOAD = ("symbol_id", "file_path", "module_name", "module_path", "kind", "qualified_name", "signature", "start_line", "end_line", "source_text")


class VectorStoreError(RuntimeError):
    pass


class VectorStore:
    """Points of one collection. A store without a name is never ready: it takes and gives nothing."""

    def __init__(self, send: Send, collection: str, dimension: int, batch: int = 256) -> None:
        self.send, self.collection, self.dimension, self.batch = send, collection, dimension, batch

    @property
    def ready(self) -> bool:
        return bool(self.collection) and self.dimension > 0

    def _request(self, method: str, suffix: str, body: dict[str, Any] | None = None, missing: bool = False) -> dict[str, Any] | None:
        status, answer = self.send(method, f"/collections/{self.collection}{suffix}", None if body is None else json.dumps(body))
        if missing and status == 404:
            return None
        if not 200 <= status < 300:
            raise VectorStoreError(f"{method} {suffix or '/'}: status {status}: {answer}")
        return json.loads(answer) if answer else {}

    def ensure(self) -> None:
        """Make the collection, for cosines, unless it is there."""
        if self.ready and self._request("GET", "", missing=True) is None:
            self._request("PUT", "", {"vectors": {"size": self.dimension, "distance": "Cosine"}})

    def _fits(self, vector: Sequence[float], what: str) -> None:
        if len(vector) != self.dimension:
            raise VectorStoreError(f"{what} has {len(vector)} dimensions, the collection {self.dimension}")

    def upsert(self, points: Sequence[dict[str, Any]]) -> None:
        """Points with the columns of PAYLOAD and ``embedding``; one of the same id is replaced."""
        if not self.ready or not points:
            return
        self.ensure()
        for p in points:
            self._fits(p["embedding"], p["qualified_name"])
        rows = [{"id": p["symbol_id"], "vector": [float(x) for x in p["embedding"]], "payload": {k: p[k] for k in PAYLOAD}} for p in points]
        for at in range(0, len(rows), self.batch):
            self._request("PUT", "/points?wait=true", {"points": rows[at : at + self.batch]})

    def delete_files(self, paths: Sequence[str]) -> None:
        """All points of some files."""
        paths = [p for p in paths if p]
        if not self.ready or not paths:
            return
        self.ensure()
        for p in paths:
            self._request("POST", "/points/delete?wait=true", {"filter": {"must": [{"key": "file_path", "match": {"value": p}}]}})

    def search(self, query: Sequence[float], limit: int) -> list[tuple[dict[str, Any], float]]:
        """The payloads of the nearest points with their scores; none for a blank query or limit."""
        if not self.ready or not query or limit < 1:
            return []
        self._fits(query, "the query")
        self.ensure()
        answer = self._request("POST", "/points/search", {"vector": [float(x) for x in query], "limit": limit, "with_payload": True, "with_vector": False}) or {}
        rows = answer.get("result")
        return [(_payload(r), float(r.get("score", 0.0))) for r in rows] if isinstance(rows, list) else []


def _payload(row: dict[str, Any]) -> dict[str, Any]:
    given = row.get("payload") or {}
    blank = {"symbol_id": row.get("id", 0), "kind": 0, "start_line": 0, "end_line": 0}
    return {k: given.get(k) if given.get(k) is not None else blank.get(k, "") for k in PAYLOAD}


def write_points(vectors: DataFrame, connect: Callable[[], VectorStore]) -> int:
    """Upsert a table of vectors from its tasks, a store for each; the number of points written.

    A task that runs again writes the same points under the same ids.
    """
    prepare(vectors.sparkSession)
    columns = [*PAYLOAD, "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, n = connect(), 0
        for b in batches:
            store.upsert(b.to_pylist())
            n += b.num_rows
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    return vectors.select(*columns).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def checked(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """``vectors``; a row of another dimension fails the job that reads it."""
    n = F.size(column)
    message = F.concat(F.lit(f"expected {dimension} dimensions, got "), n.cast("string"))
    return vectors.where(F.when(n != dimension, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def files_of(paths: DataFrame) -> list[str]:
    """Normal paths of a change, for ``delete_files``: a list that a change names."""
    return sorted(r[0] for r in paths.select(X.normal_path(F.col("path")).alias("path")).distinct().collect())
