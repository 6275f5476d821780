"""An inverted file with product quantisation over stored vectors: nearest neighbours without a full scan.

Vectors are dealt to cells by their nearest centre and written partitioned by cell, so a search reads the files of the cells it probes only. Next to each
vector stand its code (a byte for each of ``parts`` pieces of its direction), how far the code is off, and its closeness to the centre. A search of one query
scores codes by table look-ups, reads the vectors of the best candidates, and ranks those exactly. Two bounds make a search exact on demand: a cell whose
nearest edge is further than the k-th found is not read, and a vector whose code plus its error can't reach the k-th found is not ranked. Many queries
go through ``operators.topk`` by cell, under the first bound.

Centres and code books are fitted on ``sample`` vectors at most, chosen by a hash of the id; every vector is indexed. There are as many cells as the
square root of the number of vectors, up to MAX_CELLS: their centres are held by every task while vectors are dealt out. A cell of any size is written in files of
limited size, sorted by id.

A change adds a part: its vectors are dealt to the cells there are, and ids that go or come again void the rows of earlier parts. After MAX_PARTS changes
the index is built anew, with centres for what it holds by then.

Scores are cosines, rounded and ordered as in ``operators.topk``. Vectors without direction (null, zero, non-finite, of another dimension than most) are in no
cell and never found; nor are rows without an id. Without vectors an index is empty and finds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions.vectors import cosine, vector_literal
from corpusloom.operators import topk
from corpusloom.session import delete_folder, durable, prepare
from corpusloom.sources.vector_store import PAYLOAD

SAMPLE, MAX_CELLS, PARTS, CODES, ROUNDS = 65_536, 4096, 16, 256, 12
PROBES, REFINE = 8, 20
MAX_PARTS = 16
_OWN = ("cell", "id", "code", "off", "near", "vector")
#: Bounds are loosened by this much, as sums are rounded.
_SLACK = 1e-6


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, unit: bool = False) -> np.ndarray:
    """At most ``k`` centres of the rows of ``x``; of length 1 if ``unit``. Equal input gives equal centres."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(7).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        at = closest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        count = np.bincount(at, minlength=k)[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
        if unit:
            norm = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.where(norm > 0, centres / np.maximum(norm, 1e-300), centres)
    return centres


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[k : k + 4096] @ centres.T - half, axis=1) for k in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class Model:
    """Centres of the cells, and for each piece of a direction the values that its codes stand for."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]) -> None:
        self.centres, self.books = centres, books
        self.dimension = centres.shape[1]
        self.cuts = cuts_of(self.dimension, len(books))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of unit vectors, and their distances from what the codes stand for."""
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        square = np.zeros(len(x))
        for p, (book, (a, b)) in enumerate(zip(self.books, self.cuts, strict=True)):
            codes[:, p] = at = closest(x[:, a:b], book)
            square += ((x[:, a:b] - book[at]) ** 2).sum(axis=1)
        return codes, np.sqrt(square)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """What each code adds to the product with ``q``."""
        return [book @ q[a:b] for book, (a, b) in zip(self.books, self.cuts, strict=True)]


def cuts_of(dimension: int, parts: int) -> list[tuple[int, int]]:
    at = [dimension * p // parts for p in range(parts + 1)]
    return list(zip(at, at[1:], strict=False))


def _rows(vectors: DataFrame, id_col: str, vector_col: str, carry: Sequence[str]) -> DataFrame:
    return vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"), *carry)


def _partitioned(dealt: DataFrame) -> StructType:
    """The schema of stored rows: the partition's column comes last."""
    return StructType([f for f in dealt.schema if f.name != "cell"] + [dealt.schema["cell"]])


class VectorIndex:
    """An index below ``root``, any path that Spark reads; ``build`` replaces it, readers see the old or the new one."""

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS, sample: int = SAMPLE, cells: int | None = None) -> None:
        """``cells``: their number, by the number of vectors if None."""
        self.spark, self.root, self.parts, self.sample, self.cells = spark, root.rstrip("/"), parts, sample, cells
        self._state: tuple[dict, Model, np.ndarray, np.ndarray] | None = None

    # --- building ------------------------------------------------------------------------------

    def build(self, vectors: DataFrame, id_col: str = "id", vector_col: str = "vector") -> int:
        """Index ``vectors``; other columns are kept beside them. Returns the number of vectors indexed."""
        prepare(self.spark)
        carry = [c for c in vectors.columns if c not in (id_col, vector_col) and c not in _OWN]
        rows = _rows(vectors, id_col, vector_col, carry)
        usual = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        folder = f"build-{uuid.uuid4().hex}"
        n = 0
        if usual is not None:
            rows = rows.where(F.size("vector") == usual["d"])
            model = self._fit(rows, usual["d"], usual["n"])
            if model is not None:
                n = self._write(rows, model, folder)
        self._publish({"folder": folder, "vectors": n, "parts": []})
        return n

    def update(self, vectors: DataFrame, gone: DataFrame | None = None, id_col: str = "id", vector_col: str = "vector") -> int:
        """Put ``vectors`` (with the columns of the build) in place of rows of the same ids, and take away the ids of ``gone``. Returns the number of vectors then indexed."""
        state = self._open()
        if state is None:
            return self.build(vectors, id_col, vector_col)
        prepare(self.spark)
        current, model = state[:2]
        carry = [c for c in self.rows().columns if c not in _OWN]
        rows = _rows(vectors, id_col, vector_col, carry)
        part = f"part-{uuid.uuid4().hex}"
        void = rows.select("id") if gone is None else rows.select("id").unionByName(gone.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")))
        void.distinct().write.parquet(f"{self.root}/{part}/gone")
        self._store(self._dealt(rows.where(F.size("vector") == model.dimension), model), part)
        self._publish(current | {"parts": [*current["parts"], part]})
        if len(current["parts"]) + 1 >= MAX_PARTS:
            return self.build(self.rows().select("id", "vector", *carry))
        n = self.rows().select("id").count()
        self._publish(self._current() | {"vectors": n})
        return n

    def _fit(self, rows: DataFrame, dimension: int, n: int) -> Model | None:
        parts = min(self.parts, dimension)
        cells = self.cells or min(MAX_CELLS, int(np.ceil(np.sqrt(n))))
        share = min(1 << 20, int(np.ceil(self.sample / n * (1 << 20))))
        chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).select("vector")
        cuts = cuts_of(dimension, parts)

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, m in topk.unit_rows(batch.column(0)):
                    m = m[(m != 0).any(axis=1)]
                    for p, (a, b) in enumerate([(0, dimension), *cuts], -1):
                        yield pa.record_batch([pa.array(np.full(len(m), p, np.int32)), pa.array([r.tobytes() for r in np.ascontiguousarray(m[:, a:b])], pa.binary())], ["part", "piece"])

        def fit(table: pa.Table) -> pa.Table:
            part = table["part"][0].as_py()
            x = np.frombuffer(b"".join(sorted(table["piece"].to_pylist())), np.float64).reshape(table.num_rows, -1)
            found = k_means(x, cells if part < 0 else CODES, unit=part < 0)
            return pa.table([pa.array(np.full(len(found), part, np.int32)), pa.array([r.tobytes() for r in found], pa.binary())], ["part", "centre"])

        # A group is the sample's pieces of one part: bounded by ``sample``.
        fitted = chosen.mapInArrow(pieces, "part int, piece binary").groupBy("part").applyInArrow(fit, "part int, centre binary").toArrow()
        by = {p: [] for p in range(-1, parts)}
        for p, c in zip(fitted["part"].to_pylist(), fitted["centre"].to_pylist(), strict=True):
            by[p].append(np.frombuffer(c, np.float64))
        return Model(np.array(by[-1]), [np.array(by[p]) for p in range(parts)]) if by[-1] else None

    def _write(self, rows: DataFrame, model: Model, folder: str) -> int:
        n = self._store(self._dealt(rows, model), folder)
        centres = [(-1, k, c.tolist()) for k, c in enumerate(model.centres)] + [(p, k, c.tolist()) for p, book in enumerate(model.books) for k, c in enumerate(book)]
        self.spark.createDataFrame(centres, "part int, number int, centre array<double>").coalesce(1).write.parquet(f"{self.root}/{folder}/model")
        return n

    def _dealt(self, rows: DataFrame, model: Model) -> DataFrame:
        """``rows`` with their cells and codes; those without direction go."""
        held = self.spark.sparkContext.broadcast(model)
        carry = [c for c in rows.columns if c not in ("id", "vector")]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = held.value
            for batch in batches:
                for _, at, m in topk.unit_rows(batch.column(1)):
                    good = (m != 0).any(axis=1)
                    at, m = at[good], m[good]
                    if not len(at):
                        continue
                    cell = closest(m, model.centres)
                    codes, off = model.encode(m)
                    taken = batch.take(pa.array(at))
                    own = [pa.array(cell.astype(np.int32)), taken.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.array((m * model.centres[cell]).sum(axis=1)), taken.column(1)]
                    yield pa.record_batch([*own, *taken.columns[2:]], [*_OWN, *carry])

        kinds = dict(rows.dtypes)
        schema = ", ".join(["cell int", "id long", "code binary", "off double", "near double", "vector array<float>", *(f"`{c}` {kinds[c]}" for c in carry)])
        return rows.mapInArrow(deal, schema)

    def _store(self, dealt: DataFrame, folder: str) -> int:
        # Cells of any size make files of limited size: large ones are split, small ones share a task.
        dealt.hint("rebalance", "cell").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{self.root}/{folder}/rows")
        stats = self.spark.read.schema(_partitioned(dealt)).parquet(f"{self.root}/{folder}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("near"))
        stats.coalesce(1).write.parquet(f"{self.root}/{folder}/cells")
        return self.spark.read.parquet(f"{self.root}/{folder}/cells").agg(F.sum("n")).first()[0] or 0

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _publish(self, manifest: dict) -> None:
        """Make a manifest current; folders that it doesn't name any more are deleted."""
        at, new = self._path("current.json"), self._path(f"writing-{uuid.uuid4().hex}.json")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        before = self._current()
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.delete(at, False)
        if not fs.rename(new, at):
            raise RuntimeError(f"{self.root} could not be published")
        for old in {before["folder"], *before["parts"]} - {manifest["folder"], *manifest["parts"]} if before else ():
            delete_folder(self.spark, f"{self.root}/{old}")
        self._state = None

    # --- reading -------------------------------------------------------------------------------

    def _current(self) -> dict | None:
        at = self._path("current.json")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _open(self) -> tuple[dict, Model, np.ndarray, np.ndarray] | None:
        """The current manifest, model, cells that have vectors and how close to its centre each reaches."""
        current = self._current()
        if current is None or not current["vectors"]:
            return None
        if self._state is None or self._state[0] != current:
            folder = f"{self.root}/{current['folder']}"
            rows = sorted(self.spark.read.parquet(f"{folder}/model").collect())  # centres of cells and code books: bounded
            of = lambda p: np.array([r["centre"] for r in rows if r["part"] == p])
            model = Model(of(-1), [of(p) for p in range(max(r["part"] for r in rows) + 1)])
            every = self.spark.read.schema("cell int, n long, near double").parquet(*(f"{self.root}/{f}/cells" for f in (current["folder"], *current["parts"])))
            stats = sorted(every.groupBy("cell").agg(F.min("near").alias("near")).collect())
            self._state = (current, model, np.array([r["cell"] for r in stats]), np.array([r["near"] for r in stats]))
        return self._state

    @property
    def ready(self) -> bool:
        return self._open() is not None

    def rows(self) -> DataFrame:
        """The indexed vectors with all columns; filters on ``cell`` prune files."""
        current = self._open()[0]
        base = self.spark.read.parquet(f"{self.root}/{current['folder']}/rows")
        if not current["parts"]:
            return base
        parts = [self.spark.read.schema(base.schema).parquet(f"{self.root}/{p}/rows").withColumn("_part", F.lit(k)) for k, p in enumerate(current["parts"], 1)]
        gone = [self.spark.read.schema("id long").parquet(f"{self.root}/{p}/gone").select(F.col("id").alias("_id"), F.lit(k).alias("_since")) for k, p in enumerate(current["parts"], 1)]
        void = reduce(DataFrame.unionByName, gone).groupBy("_id").agg(F.max("_since").alias("_since"))
        every = reduce(DataFrame.unionByName, parts, base.withColumn("_part", F.lit(0)))
        return every.join(void, (F.col("id") == F.col("_id")) & (F.col("_part") < F.col("_since")), "left_anti").drop("_part")

    @staticmethod
    def _reach(products: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The greatest cosine that a vector of each cell can have with a query of that product with the cell's centre."""
        angle = np.arccos(np.clip(products, -1, 1)) - np.arccos(np.clip(near, -1, 1))
        return np.cos(np.maximum(0, angle)) + _SLACK

    def cells_for(self, query: Sequence[float], probes: int = PROBES, least: float | None = None) -> list[int]:
        """The ``probes`` cells nearest to a query; or all that may hold a vector of a cosine of ``least`` or more."""
        _, model, cells, near = self._open()
        products = model.centres[cells] @ np.asarray(query)
        if least is not None:
            return sorted(int(c) for c in cells[self._reach(products, near) >= least])
        return sorted(int(c) for c in cells[np.argsort(-products, kind="stable")[:probes]])

    def candidates(self, query: np.ndarray, cells: list[int]) -> DataFrame:
        """(cell, id, about, off) of the cells' vectors: their cosines by code alone, and how far off those may be. Vectors aren't read."""
        tables = self._open()[1].tables(query)

        @F.pandas_udf("double")
        def about(codes: pd.Series) -> pd.Series:
            if not len(codes):
                return pd.Series([], dtype="float64")
            m = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
            return pd.Series(sum(t[m[:, p]] for p, t in enumerate(tables)))

        return self.rows().where(F.col("cell").isin(cells)).select("cell", "id", about("code").alias("about"), "off")

    def _ranked(self, query: Sequence[float], cells: list[int], ids: DataFrame, k: int) -> DataFrame:
        score = F.round(cosine(F.col("vector"), vector_literal(list(query))), topk.DIGITS)
        held = self.rows().where(F.col("cell").isin(cells)).join(F.broadcast(ids.select("cell", "id")), ["cell", "id"], "left_semi")
        return held.withColumn("score", score).drop("code", "off", "near").orderBy(F.desc("score"), "id").limit(k)

    def search_rows(self, query: Sequence[float], k: int, probes: int = PROBES, exact: bool = False) -> DataFrame | None:
        """The ``k`` nearest vectors with their columns and ``score``, best first; None if the index is empty or the query has no direction.

        Unless ``exact``, of the vectors of ``probes`` cells those ``REFINE`` times ``k`` whose codes are nearest are ranked.
        """
        state = self._open()
        q = np.asarray(query, np.float64)
        if state is None or k < 1 or len(q) != state[1].dimension or not np.isfinite(q).all() or not q.any():
            return None
        prepare(self.spark)
        q = q / np.linalg.norm(q)
        cells = self.cells_for(q, probes)
        best = self.candidates(q, cells).orderBy(F.desc("about"), "id").limit(REFINE * k)
        found = self._ranked(query, cells, best, k)
        if not exact:
            return found
        scores = [r["score"] for r in found.select("score").collect()]
        least = scores[-1] - _SLACK if len(scores) == k else -1.0
        cells = self.cells_for(q, least=least)
        able = durable(self.candidates(q, cells).where(F.col("about") + F.col("off") + _SLACK >= least).select("cell", "id"))
        if able.count() <= 1 << 16:
            return self._ranked(query, cells, able, k)
        score = F.round(cosine(F.col("vector"), vector_literal(list(query))), topk.DIGITS)
        held = self.rows().where(F.col("cell").isin(cells)).join(able, ["cell", "id"], "left_semi")
        return held.withColumn("score", score).drop("code", "off", "near").orderBy(F.desc("score"), "id").limit(k)

    def search(self, query: Sequence[float], limit: int) -> list[tuple[dict, float]]:
        """As a vector store answers: payloads of the nearest with their scores. The index has to hold the columns of a payload."""
        found = self.search_rows(query, limit)
        if found is None:
            return []
        rows = found.withColumn("symbol_id", F.col("id")).select(*PAYLOAD, "score").collect()
        return [({c: r[c] for c in PAYLOAD}, float(r["score"])) for r in rows]

    def search_many(self, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = False, others: bool = False) -> DataFrame:
        """(query_id, rank, id, score) for ``queries`` (query_id, vector); see ``topk.nearest``. Queries of another dimension find nothing.

        ``exact``: after the nearest cells, all those are asked that may hold a nearer vector than the k-th found.
        """
        state = self._open()
        if state is None:
            return self.spark.createDataFrame([], "query_id long, rank int, id long, score double")
        prepare(self.spark)
        corpus = self.rows().select(F.col("cell").alias("grp"), "id", "vector")
        asked = queries.where(F.size("vector") == state[1].dimension).select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
        found = topk.nearest(self._probing(asked.withColumn("least", F.lit(None).cast("double")), probes), corpus, k, others)
        if not exact:
            return found
        found = durable(found)
        bar = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score") - _SLACK).otherwise(F.lit(-1.0)).alias("least"))
        again = asked.join(bar, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))
        return topk.nearest(self._probing(again, probes), corpus, k, others)

    def _probing(self, asked: DataFrame, probes: int) -> DataFrame:
        """``asked`` (query_id, vector, least) with the cells to ask as ``groups``: of those that may reach ``least``, or the nearest where that is null."""
        _, model, cells, near = self._open()
        held = self.spark.sparkContext.broadcast((model.centres[cells], cells, near))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, cells, near = held.value
            for batch in batches:
                for _, at, m in topk.unit_rows(batch.column(1)):
                    products = m @ centres.T
                    taken, named = batch.take(pa.array(at)), []
                    for row, least in zip(products, taken.column(2).to_pylist(), strict=True):
                        own = cells[np.argsort(-row, kind="stable")[:probes]] if least is None else cells[VectorIndex._reach(row, near) >= least]
                        named.append(own.astype(np.int64).tolist())
                    # A query without direction finds nothing.
                    named = [g if v.any() else [] for g, v in zip(named, m, strict=True)]
                    yield pa.record_batch([taken.column(0), taken.column(1), pa.array(named, pa.list_(pa.int64()))], ["query_id", "vector", "groups"])

        return asked.select("query_id", "vector", "least").mapInArrow(probe, "query_id long, vector array<double>, groups array<long>")
