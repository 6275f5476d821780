"""Near-duplicate embeddings by NN-descent: a neighbour graph refined by neighbours-of-neighbours joins.

1. Equal vectors are one class; classes carry how many rows they stand for.
2. The graph starts from random-hyperplane trees: the classes of a leaf are compared with one another. A round has as many
   trees as it takes for two vectors that just link to share a leaf in one with a chance of ``MEET``, whatever the table's size.
3. Rounds refine it. Each class joins the group of one neighbour (of those in its closed neighbourhood the one whose
   hash, new in every round, is smallest); members of a group are neighbours of one neighbour, and are compared.
   New trees in every round bring together what no neighbour connects yet. A class keeps its ``k`` nearest; where the list
   is saturated (the k-th still links) it is enlarged, up to ``ENLARGED`` times ``k``. What a comparison links is besides
   kept as a spanning forest, so no component depends on a list's length. Rounds end when two of them connect nothing further.
4. Edges of ``threshold`` or more are the links; components follow from them. Linked pairs lie within a component, so the links
   of each class are counted there in full: the classes of a component are cut into cells of like direction, and two cells are
   compared unless the angle between them shows that no pair can link. Counts are what moves, not links: a cluster of m
   vectors has m x m of those.
5. The result is audited: all rows whose id is divisible by 100, in slices of ``AUDIT_BYTES``, are compared with all rows. Recall is
   links counted to links there are, averaged over queries, apart for each power of two of their links; the least of these
   averages counts, so no large cluster outweighs rare links. Where none of those rows links, one slice more is drawn from all rows by a hash. Below ``recall``
   rounds go on, up to ``MORE`` times ``rounds``, then the operator fails. The recall reached is kept in ``last_recall``; None: none of either has a link.

A group or leaf of more than ``TILE`` classes is cut into tiles and its pairs of tiles are compared, each in a task of its
own; over ``TILES`` tiles, a round compares only within tiles, dealt anew in each: the rest is left to other rounds and, within a
component, to the count, which is exact.

Cosines are computed in double precision from the vectors as they are. Defined cases: vectors that are null, empty, zero,
or hold null or non-finite components link with nothing. Vectors of different length don't link. A null vec_id takes
part and is the smallest of no component that has another. Rows that share a vec_id are vectors of their own.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.blocks import tidied
from corpusloom.llm.components import UnionFind, connected_components
from corpusloom.session import durable, prepare, release_shuffles

THRESHOLD = 0.9
K, ENLARGED, ROUNDS, RECALL = 8, 4, 12, 0.99
TILE, TILES, LEAF, CELL = 512, 8, 192, 256
#: Chance that two vectors at the threshold share a leaf in one of a round's trees.
MEET = 0.6
#: Vectors of one slice of an audit: they go to every task.
AUDIT_BYTES = 8 << 20
#: Rounds at most, in multiples of ``rounds``, while the audit falls short.
MORE = 4
#: An audit leaves out links this close to the threshold: another order of summation may not see them.
SLACK = 1e-9
#: Tasks that the cells of one component are dealt over where they meet one another.
SALTS = 16


def _unit(raw: list[bytes]) -> np.ndarray:
    """Rows of unit length from doubles; scaled first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _edges(u: np.ndarray, v: np.ndarray, sim: np.ndarray, tree: np.ndarray) -> pa.Table:
    return pa.table([pa.array(np.minimum(u, v), pa.int64()), pa.array(np.maximum(u, v), pa.int64()), pa.array(np.minimum(sim, 1.0), pa.float64()), pa.array(tree)], ["u", "v", "sim", "tree"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, a digest of the vector's bytes, its length and bytes; these are null for vectors that link with nothing."""
    for batch in batches:
        keys, dims, raw = [], [], []
        for v in batch.column(1):
            x = None if not v.is_valid or v.values is None or not len(v.values) or v.values.null_count else v.values.to_numpy(zero_copy_only=False) + 0.0
            good = x is not None and np.isfinite(x).all() and x.any()
            raw.append(x.tobytes() if good else None)
            dims.append(len(x) if good else None)
            keys.append(hashlib.blake2b(raw[-1], digest_size=16).digest() if good else None)
        yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "key", "dim", "x"])


def trees_for(bits: int, threshold: float) -> int:
    """Trees of so many planes in which two vectors at the threshold share a leaf with a chance of ``MEET``."""
    once = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if once >= MEET else math.ceil(math.log(1 - MEET) / math.log1p(-once))


def _codes(x: np.ndarray, bits: int, seed: list[int]) -> np.ndarray:
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], bits))
    return ((x @ planes) > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), np.int64)


class EmbeddingDedup:
    """``components(vectors)``: links and component of each row; see the module."""

    def __init__(self, threshold: float = THRESHOLD, k: int = K, rounds: int = ROUNDS, recall: float = RECALL) -> None:
        self.threshold, self.k, self.rounds, self.recall = threshold, k, rounds, recall
        self.last_recall: float | None = None

    def components(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """vec_id, n_links, component_id, kept; one row per row of ``vectors``."""
        prepare(vectors.sparkSession)
        raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
        rows = raw.mapInArrow(tidied(_vectors), "vec_id long, key binary, dim int, x binary")
        audited = F.max(F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))
        classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), audited.alias("query"), F.first("dim").alias("dim"), F.first("x").alias("x"))
        classes = durable(classes.select(F.monotonically_increasing_id().alias("node"), "*"))
        linked = self._linked(classes)
        named = durable(classes.select("node", "key", "least", "n").join(linked, "node", "left").select("key", "least", F.coalesce("label", "node").alias("label"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")))
        smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
        members = named.join(smallest, "label").select("key", "n_links", "component_id")
        found = rows.select("vec_id", "key").join(members, "key", "left")
        alone = F.col("key").isNull()
        found = found.select("vec_id", F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
        return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

    def _linked(self, classes: DataFrame) -> DataFrame:
        """(node, label, others) of the classes that link: the component, and how many rows of other classes each links with."""
        vectors = classes.select("node", "n", "dim", "x")
        n = classes.count()
        truth = self._audit(classes)
        if truth.isEmpty():
            truth = self._audit(self._drawn(classes))
        graph, forest, last = None, None, self.rounds
        before, still = -1, 0
        for r in range(MORE * self.rounds):
            graph, forest = self._round(graph, forest, vectors, n, r)
            links = forest.count()
            before, still = links, still + 1 if links == before else 0
            if (r and still >= 2) or r + 1 >= last:
                linked = self._count(forest, vectors)
                if self._met(truth, linked):
                    return linked
                last, still = r + 3, 0
        raise RuntimeError(f"recall {self.last_recall} of the audited links after {MORE * self.rounds} rounds, {self.recall} is asked for")

    def _round(self, graph: DataFrame | None, forest: DataFrame | None, vectors: DataFrame, n: int, r: int) -> tuple[DataFrame, DataFrame]:
        found = self._compare(self._leaves(vectors, n, r), r)
        if graph is not None:
            found = found.unionByName(self._compare(self._hubs(graph, vectors, r), r))
        found = durable(found)
        links = found.where("tree").select("u", "v")
        links = connected_components(links if forest is None else links.unionByName(forest.select(F.col("node").alias("u"), F.col("label").alias("v"))))
        # A component of c classes has c - 1 rows here: a star.
        forest = durable(links.where("node <> label"))
        near = found.select("u", "v", "sim")
        graph = durable(self._keep(near if graph is None else near.unionByName(graph)))
        release_shuffles(vectors.sparkSession)
        return graph, forest

    def _met(self, truth: DataFrame, linked: DataFrame) -> bool:
        """Whether no audited query speaks against ``recall``; keeps ``last_recall``."""
        queries = truth.join(linked.select(F.col("node").alias("q"), F.col("others").alias("found")), "q", "left").select("n", F.least(F.lit(1.0), F.coalesce("found", F.lit(0)) / F.col("n")).alias("part"))
        bands = queries.groupBy(F.floor(F.log2("n")).alias("band")).agg(F.avg("part").alias("recall"))
        self.last_recall = bands.agg(F.min("recall")).first()[0]
        return self.last_recall is None or self.last_recall >= self.recall

    def _leaves(self, vectors: DataFrame, n: int, r: int) -> DataFrame:
        """Each class in a leaf of each of this round's trees: the signs of its products with random vectors."""
        bits = max(0, math.ceil(math.log2(max(1.0, n / LEAF))))
        trees = trees_for(bits, self.threshold)

        def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = np.array(batch.column("dim").to_pylist())
                for d in np.unique(dims).tolist():
                    part = batch.filter(pa.array(dims == d))
                    x = _unit(part.column("x").to_pylist())
                    for t in range(trees):
                        yield pa.record_batch([pa.array([f"{t}/{d}/{c}" for c in _codes(x, bits, [r, t, d]).tolist()]), part.column("node"), part.column("x")], ["group", "node", "x"])

        return vectors.mapInArrow(leaf, "group string, node long, x binary")

    @staticmethod
    def _hubs(graph: DataFrame, vectors: DataFrame, r: int) -> DataFrame:
        """Each class in the group of one class of its closed neighbourhood."""
        both = graph.select("u", "v").union(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        key = lambda c: F.struct(F.xxhash64(c, F.lit(r)).alias("h"), F.col(c).alias("hub"))
        chosen = both.groupBy("u").agg(F.min(key("v")).alias("best")).select(F.col("u").alias("node"), F.least(F.col("best"), key("u"))["hub"].alias("hub"))
        return chosen.join(vectors, "node").select(F.concat_ws("/", F.lit("hub"), F.col("hub").cast("string"), F.col("dim").cast("string")).alias("group"), "node", "x")

    def _compare(self, grouped: DataFrame, r: int) -> DataFrame:
        """Edges (u, v, sim, tree) between the classes of a group: each one's nearest, more where they link, and (``tree``) a forest of what links."""
        threshold, k, most = self.threshold, self.k, self.k * ENLARGED
        sizes = grouped.groupBy("group").agg(F.count("*").alias("members")).where("members > 1")
        tiles = F.ceil(F.col("members") / TILE).cast("int")
        # The members of one group meet its size in several tasks.
        sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = grouped.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(sizes, ["group", "salt"]).withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("node", F.lit(r)), F.col("tiles")).cast("int"))
        others = F.when(F.col("tiles") <= TILES, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("own"))
        pairs = dealt.withColumn("other", F.explode(others)).select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "x")

        def compare(table: pa.Table) -> pa.Table:
            i, j = table["i"][0].as_py(), table["j"][0].as_py()
            own, node = np.array(table["own"].to_pylist()), np.array(table["node"].to_pylist(), np.int64)
            x = _unit(table["x"].to_pylist())
            out, sets = [], UnionFind()
            rows = np.flatnonzero(own == i)
            cols = rows if i == j else np.flatnonzero(own == j)
            for at in range(0, len(rows), TILE):
                part = rows[at : at + TILE]
                sim = x[part] @ x[cols].T
                if i == j:
                    sim[np.arange(len(part)), np.arange(at, at + len(part))] = -2.0
                if not sim.size:
                    continue
                tree = _forest(sim >= threshold, part, cols, sets)
                place = min(most, sim.shape[1]) - 1
                near = np.argpartition(-sim, place, axis=1)[:, : place + 1]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, axis=1), axis=1, kind="stable"), axis=1)
                # The first k, and those after them that link.
                wanted = np.take_along_axis(sim, near, axis=1) >= np.where(np.arange(near.shape[1]) < k, -1.5, threshold)
                keep = tree.copy()
                a, b = np.nonzero(wanted)
                keep[a, near[a, b]] = True
                a, b = np.nonzero(keep)
                out.append(_edges(node[part[a]], node[cols[b]], sim[a, b], tree[a, b]))
            return pa.concat_tables(out) if out else _edges(node[:0], node[:0], np.zeros(0), np.zeros(0, bool))

        return pairs.groupBy("group", "i", "j").applyInArrow(compare, "u long, v long, sim double, tree boolean")

    def _keep(self, edges: DataFrame) -> DataFrame:
        """Each pair once, and only what is among the nearest of either end: ``k``, or up to ``ENLARGED`` times as many that link."""
        once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
        ends = once.select(F.col("u").alias("end"), "*").union(once.select(F.col("v").alias("end"), "*"))
        near = Window.partitionBy("end").orderBy(F.desc("sim"), "u", "v")
        ranked = ends.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= self.k * ENLARGED)
        return ranked.where((F.col("rank") <= self.k) | (F.col("sim") >= self.threshold)).select("u", "v", "sim").distinct()

    # --- counting links within components -----------------------------------------------------

    def _count(self, forest: DataFrame, vectors: DataFrame) -> DataFrame:
        """(node, label, others) of the classes of components of two and more: each one's links, weighted by rows."""
        threshold = self.threshold
        labels = durable(forest.unionByName(forest.select(F.col("label").alias("node"), "label").distinct()))
        sizes = labels.groupBy("label").agg(F.count("*").alias("members")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
        sized = labels.withColumn("salt", salt).join(sizes, ["label", "salt"]).drop("salt").join(vectors, "node")

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Classes by direction: about ``CELL`` to a code; a part of a hash cuts codes that hold more."""
            for batch in batches:
                members, dims = (np.array(batch.column(c).to_pylist()) for c in ("members", "dim"))
                bits = np.maximum(0, np.ceil(np.log2(np.maximum(1.0, members / CELL)))).astype(np.int64)
                for d, m in {(int(d), int(b)) for d, b in zip(dims, bits, strict=True)}:
                    part = batch.filter(pa.array((dims == d) & (bits == m)))
                    code = _codes(_unit(part.column("x").to_pylist()), m, [7, d])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(code, pa.int64())], names=[*part.schema.names, "code"])

        coded = durable(sized.mapInArrow(deal, "node long, label long, members long, n long, dim int, x binary, code long"))
        held = coded.groupBy("label", "dim", "code").agg(F.count("*").alias("held")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        celled = coded.withColumn("salt", salt).join(held, ["label", "dim", "code", "salt"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("held") / (2 * CELL))))

        def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            x = _unit(table["x"].to_pylist())
            middle = x.sum(axis=0)
            middle = middle / max(np.linalg.norm(middle), 1e-300)
            around = float(np.arccos(np.clip(x @ middle, -1.0, 1.0)).max()) if middle.any() else math.pi
            node, n = np.array(table["node"].to_pylist(), np.int64), np.array(table["n"].to_pylist(), np.int64)
            return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), pa.array([int(node.min())], pa.int64()), pa.array([len(node)], pa.int32()), pa.array([middle.tobytes()], pa.binary()), pa.array([around]), pa.array([node.tobytes() + n.tobytes() + x.tobytes()], pa.binary())], ["label", "dim", "cell", "size", "middle", "around", "blob"])

        cells = durable(celled.select("label", "dim", "code", "part", "node", "n", "x").groupBy("label", "dim", "code", "part").applyInArrow(pack, "label long, dim int, cell long, size int, middle binary, around double, blob binary"))
        bounds = cells.drop("blob")
        a = bounds.withColumn("salt", F.pmod(F.xxhash64("cell"), F.lit(SALTS)).cast("int")).alias("a")
        b = bounds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("b")
        on = (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.cell") <= F.col("b.cell"))
        near = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The pairs of cells of which some vectors may link."""
            for batch in batches:
                x, y = ([np.frombuffer(m, np.float64) for m in batch.column(c).to_pylist()] for c in ("x", "y"))
                angle = np.arccos(np.clip([p @ q for p, q in zip(x, y, strict=True)], -1.0, 1.0))
                keep = pa.array(angle <= near + np.array(batch.column("around").to_pylist()))
                yield batch.select(["p", "q"]).filter(keep)

        pairs = a.join(b, on).select(F.col("a.cell").alias("p"), F.col("b.cell").alias("q"), F.col("a.middle").alias("x"), F.col("b.middle").alias("y"), (F.col("a.around") + F.col("b.around")).alias("around")).mapInArrow(reach, "p long, q long")
        blobs = cells.select("cell", "size", "blob")
        sides = pairs.join(blobs.withColumnsRenamed({"cell": "p", "size": "p_size", "blob": "p_blob"}), "p").join(blobs.withColumnsRenamed({"cell": "q", "size": "q_size", "blob": "q_blob"}), "q")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p, q, m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("p", "q", "p_size", "q_size", "p_blob", "q_blob")), strict=True):
                    (i, weight_i, x), (j, weight_j, y) = _unpacked(m, x), _unpacked(n, y)
                    link = x @ y.T >= threshold
                    if p == q:
                        np.fill_diagonal(link, False)
                        found = [(i, link @ weight_j)]
                    else:
                        found = [(i, link @ weight_j), (j, weight_i @ link)]
                    for nodes, others in found:
                        hit = others > 0
                        yield pa.record_batch([pa.array(nodes[hit]), pa.array(others[hit])], ["node", "others"])

        counts = sides.mapInArrow(tidied(count), "node long, others long").groupBy("node").agg(F.sum("others").alias("others"))
        return durable(labels.join(counts, "node", "left").select("node", "label", F.coalesce("others", F.lit(0)).alias("others")))

    @staticmethod
    def _drawn(classes: DataFrame) -> DataFrame:
        """``classes`` with about ``AUDIT_BYTES`` of them as queries, by a hash of their keys; all if there are no more."""
        total = classes.agg(F.coalesce(F.sum(F.length("x") + 16), F.lit(0))).first()[0]
        share = min(1 << 30, math.ceil(AUDIT_BYTES / max(1, total) * (1 << 30)))
        return classes.withColumn("query", F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share)

    def _audit(self, classes: DataFrame) -> DataFrame:
        """(q, n): for each audited class that links, the rows of other classes that do, by comparing it with all."""
        threshold = self.threshold + SLACK
        spark = classes.sparkSession
        queries = durable(classes.where("query").select("node", "dim", "x"))
        total = queries.agg(F.coalesce(F.sum(F.length("x") + 16), F.lit(0))).first()[0]
        slices = max(1, -(-total // AUDIT_BYTES))
        out = None
        for k in range(slices):
            part = queries.where(F.pmod(F.xxhash64("node"), F.lit(slices)) == k)
            shared = spark.sparkContext.broadcast([(r["node"], r["dim"], bytes(r["x"])) for r in part.collect()])

            def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                by_dim: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
                for d in {d for _, d, _ in shared.value}:
                    mine = [(i, x) for i, e, x in shared.value if e == d]
                    by_dim[d] = (np.array([i for i, _ in mine]), _unit([x for _, x in mine]), np.zeros(len(mine), np.int64))
                for batch in batches:
                    dims = np.array(batch.column("dim").to_pylist())
                    for d in set(dims.tolist()) & set(by_dim):
                        rows = batch.filter(pa.array(dims == d))
                        ids, q, found = by_dim[d]
                        nodes, weight, raw = (rows.column(c).to_pylist() for c in ("node", "n", "x"))
                        for at in range(0, len(nodes), 1000):
                            link = q @ _unit(raw[at : at + 1000]).T >= threshold
                            link &= ids[:, None] != np.array(nodes[at : at + 1000])[None, :]
                            found += link @ np.array(weight[at : at + 1000])
                for ids, _, found in by_dim.values():
                    yield pa.record_batch([pa.array(ids[found > 0]), pa.array(found[found > 0])], ["q", "n"])

            truth = classes.select("node", "n", "dim", "x").mapInArrow(compare, "q long, n long").groupBy("q").agg(F.sum("n").alias("n"))
            out = truth if out is None else out.unionByName(truth)
        return durable(out)


def _forest(link: np.ndarray, part: np.ndarray, cols: np.ndarray, sets: UnionFind) -> np.ndarray:
    """Of the linking pairs those that connect what ``sets`` has apart."""
    tree = np.zeros(link.shape, bool)
    for i in np.flatnonzero(link.any(axis=1)).tolist():
        for j in np.flatnonzero(link[i]).tolist():
            if sets.union(int(part[i]), int(cols[j])):
                tree[i, j] = True
    return tree


def _unpacked(size: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    node, n = np.frombuffer(blob, np.int64, size), np.frombuffer(blob, np.int64, size, 8 * size)
    return node, n, np.frombuffer(blob, np.float64, offset=16 * size).reshape(size, -1)
