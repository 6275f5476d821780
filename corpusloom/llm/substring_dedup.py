"""Substring dedup over a log-structured index of window fingerprints.

A window is 20 consecutive words of one document. A window whose words already started earlier is a repeat, and every
word that it covers is removed. Documents come in batches, each later than those before it:

1. Each block of a batch writes its distinct window hashes as a sorted run, cut into buckets by their leading bits.
2. A bucket's runs are merged with one another and with the immutable sorted runs that the index keeps of earlier batches.
   Each block gets back which of its windows are repeats; what is new becomes the batch's own run of the index.
3. A match is verified by a second hash, whose bases for the bytes of words and for words are drawn apart from the first's, once for
   the index: 88 bits agree, and none of them follows from another, whatever the words.
4. When ``FANOUT`` runs stand on a level, they are compacted into one of the next level.

The index is a folder: a table per run, bucketed by the buckets of the hashes, so that merging and compacting read the runs
where they lie, without a shuffle; and a manifest that names the live runs. A manifest is written after its runs, so a batch
that is broken off leaves the index as it was. A run holds only windows that no earlier one holds. When buckets would grow too
large, the index is written anew with more of them, and with more files: a file holds at most ``FILE_BUCKETS`` buckets, so the
tasks that scan and merge grow with the index, whatever it began with.

Defined cases: null text and text without words have n_words 0 and the hash of the empty string. Texts
of fewer than 20 words lose nothing. A null doc_id counts as smaller than every other. Rows that share
a doc_id are documents of their own; which of them is the earlier one follows their place in the input.
Other columns of the input are ignored. An empty table or batch gives an empty result. A document has to fit a worker.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import runs as R
from corpusloom.llm.blocks import Bases, Block, Words, blocks_of, covered, draw_bases, pack, spread
from corpusloom.session import checkpoint_folder, durable, prepare, release_shuffles, shuffle_partitions

U = np.uint64
WINDOW = 20
#: Bits kept of a window's hash; 32 of its second hash are kept beside them.
HASH_BITS = 56
#: Windows of a run that one row holds at most: rows of a megabyte would be hard on the collector.
CHUNK = 1 << 14
#: Buckets that one file of a run, and so one task of a merge, holds at most.
FILE_BUCKETS = 4
#: Runs of one level that are compacted into one of the next.
FANOUT = 3
#: Batches in which ``SubstringDedup`` feeds a table to its index.
BATCHES = 4
#: A run's table: kind 1 are its buckets, kind 0 the answers that its batch got.
RUN_SCHEMA = "kind int, bucket int, block_id long, n long, data binary"
RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class _Windows:
    """The windows of a block, its distinct ones in order of hash, second hash and place."""

    def __init__(self, block: Block, bases: Bases, window: int) -> None:
        self.words = words = Words(block, bases)
        self.at = np.flatnonzero(words.left() >= window)
        h = words.rolling.ranges(self.at, self.at + window) >> U(64 - HASH_BITS) << U(64 - HASH_BITS)
        check = (words.apart.ranges(self.at, self.at + window) >> U(32)).astype(np.uint32)
        self.order = np.lexsort((self.at, check, h))
        h, check = h[self.order], check[self.order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
        self.new, self.number = new, np.cumsum(new) - 1
        self.hash, self.check, self.doc = h[new], check[new], words.doc[self.at[self.order[new]]]


def _encode(h: np.ndarray, check: np.ndarray, doc: np.ndarray, keys: np.ndarray) -> bytes:
    """Hashes, second hashes, and the document that each first starts in as a number into sorted ``keys``."""
    own, number = np.unique(doc, return_inverse=True)
    ids = R.pack_sorted(keys[own].astype(np.int64).view(U) ^ U(1 << 63))
    rest = zstandard.ZstdCompressor(level=1).compress(number.astype(np.uint16 if len(own) < 1 << 16 else np.uint32).tobytes())
    run = _stored(h, check)
    return np.array([len(own), len(run), len(ids)], np.int64).tobytes() + run + ids + rest


def _decode(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, second hashes, order keys (as unsigned) of the documents they first start in."""
    docs, run, ids = map(int, np.frombuffer(data, np.int64, 3))
    keys = R.unpack_sorted(data[24 + run : 24 + run + ids], docs)
    rest = zstandard.ZstdDecompressor().decompress(data[24 + run + ids :])
    return *_unstored(n, data[24 : 24 + run]), keys[np.frombuffer(rest, np.uint16 if docs < 1 << 16 else np.uint32, n)]


def _stored(h: np.ndarray, check: np.ndarray) -> bytes:
    return check.tobytes() + R.pack_sorted(h >> U(64 - HASH_BITS))


def _unstored(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return R.unpack_sorted(data[4 * n :], n) << U(64 - HASH_BITS), np.frombuffer(data, np.uint32, n)


def _merge(batch: list[tuple[int, int, bytes]], past: list[tuple[int, bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """For each run of the batch a bit per window: it also starts earlier. And the new run: what no earlier one holds."""
    runs = [_decode(n, r) for _, n, r in batch] + [(*_unstored(n, r), np.zeros(n, U)) for n, r in past]
    size = [len(r[0]) for r in runs]
    h, check, key = (np.concatenate(x) for x in zip(*runs, strict=True))
    block = np.repeat([b for b, _, _ in batch] + [-1] * len(past), size)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    several = np.zeros(len(h), bool)
    several[1:] |= same
    several[:-1] |= same
    among = order[several]
    among = among[np.lexsort((block[among], key[among], block[among] >= 0, check[among], h[among]))]
    repeat = np.zeros(len(among), bool)
    repeat[1:] = (h[among][1:] == h[among][:-1]) & (check[among][1:] == check[among][:-1])
    earlier = np.zeros(len(h), bool)
    earlier[among] = repeat
    out, at = [], 0
    for n in size[: len(batch)]:
        out.append(np.packbits(earlier[at : at + n]).tobytes())
        at += n
    fresh = order[(~earlier & (block >= 0))[order]]
    return out, h[fresh], check[fresh]


def _chunks(bucket: int, h: np.ndarray, check: np.ndarray) -> pa.RecordBatch:
    """A bucket of a run as rows of at most ``CHUNK`` windows, in order of hash."""
    at = range(0, len(h), CHUNK)
    return _rows(1, [bucket] * len(at), [-1] * len(at), [len(h[i : i + CHUNK]) for i in at], [_stored(h[i : i + CHUNK], check[i : i + CHUNK]) for i in at])


def _rows(kind: int, bucket: list[int], block: list[int], n: list[int], data: list[bytes]) -> pa.RecordBatch:
    m = len(bucket)
    return pa.record_batch([pa.array([kind] * m, pa.int32()), pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["kind", "bucket", "block_id", "n", "data"])


class FingerprintIndex:
    """Window hashes of all batches so far, in ``folder``; ``add(batch)`` cleans the next one.

    A folder that holds an index is opened as it is, with its own window, bases and buckets. ``bucket_hashes``: how many a
    bucket should hold at most, over all runs. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, window: int = WINDOW, fanout: int = FANOUT, bucket_hashes: int = R.BUCKET_HASHES) -> None:
        if window < 1 or fanout < 2:
            raise ValueError("a window has a word at least, a level takes two runs at least")
        prepare(spark)
        self.spark, self.folder, self.fanout, self.bucket_hashes = spark, folder.rstrip("/"), fanout, bucket_hashes
        self.state = self._latest() or {"version": 0, "window": window, "bits": 0, "files": shuffle_partitions(spark), "bases": list(draw_bases()), "runs": []}
        self.window, self.bases = self.state["window"], Bases(*self.state["bases"])

    # --- the folder ---------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, start: str) -> list[str]:
        fs, root = self._fs(), self._path("x").getParent()
        return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(root)) if n.startswith(start)) if fs.exists(root) else []

    def _latest(self) -> dict | None:
        done = [n for n in self._names("manifest-") if self._fs().exists(self._path(f"{n}/_SUCCESS"))]
        return json.loads(self.spark.read.text(f"{self.folder}/{done[-1]}").first()[0]) if done else None

    def _publish(self, runs: list[dict]) -> None:
        """Make ``runs`` the live ones; others and older manifests go."""
        self.state = self.state | {"version": self.state["version"] + 1, "runs": runs}
        name = f"manifest-{self.state['version']:08d}"
        self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{name}")
        live = {r["name"] for r in runs}
        for old in [n for n in self._names("manifest-") if n != name] + [n for n in self._names("run-") if n not in live]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table_name(old)}")
            self._fs().delete(self._path(old), True)

    @staticmethod
    def _table_name(name: str) -> str:
        return "corpusloom_" + name.replace("-", "_")

    def _write(self, rows: DataFrame, level: int) -> dict:
        """A new run from ``rows`` (RUN_SCHEMA), dealt out by bucket."""
        name = f"run-{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.state["files"], "bucket").option("path", f"{self.folder}/{name}").saveAsTable(self._table_name(name))
        run = {"name": name, "level": level, "files": self.state["files"]}
        return run | {"n": self._read(run).where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]}

    def _read(self, run: dict) -> DataFrame:
        table = self._table_name(run["name"])
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE {table} (kind INT, bucket INT, block_id BIGINT, n BIGINT, data BINARY) USING parquet CLUSTERED BY (bucket) INTO {run['files']} BUCKETS LOCATION '{self.folder}/{run['name']}'")
        return self.spark.table(table)

    def drop(self) -> None:
        """Delete the index."""
        self._publish([])
        self._fs().delete(self._path("x").getParent(), True)

    # --- batches ------------------------------------------------------------------------------

    def _grow(self, hashes: float) -> None:
        """Buckets enough for so many hashes more; with more of them than now, all runs are written anew."""
        runs = self.state["runs"]
        bits = R.bucket_bits(hashes + sum(r["n"] for r in runs), self.state["files"], self.bucket_hashes)
        if bits <= self.state["bits"]:
            return
        # A broken-off growth leaves the state, and the runs that it names, as they were.
        state, files = self.state, max(self.state["files"], -(-(1 << bits) // FILE_BUCKETS))
        self.state = state | {"bits": bits, "files": files}
        if not runs:
            return

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    h, check = _unstored(n, data)
                    for b, i, j in R.cuts(h, bits):
                        yield _chunks(b, h[i:j], check[i:j])

        try:
            rows = self._past(runs).mapInArrow(cut, RUN_SCHEMA).repartition(files, "bucket")
            self._publish([self._write(self._combined(rows), max(r["level"] for r in runs) + 1)])
        except BaseException:
            self.state = state
            raise

    def _past(self, runs: list[dict]) -> DataFrame:
        """The buckets of some runs. Their tables are dealt out alike, and a union of them still is."""
        out = None
        for run in runs:
            part = self._read(run).where("kind = 1")
            out = part if out is None else out.unionByName(part)
        return out

    @staticmethod
    def _combined(rows: DataFrame) -> DataFrame:
        def combine(table: pa.Table) -> pa.Table:
            h, check = (np.concatenate(x) for x in zip(*map(_unstored, table["n"].to_pylist(), table["data"].to_pylist()), strict=True))
            order = np.argsort(h, kind="stable")
            return pa.Table.from_batches([_chunks(table["bucket"][0].as_py(), h[order], check[order])])

        return rows.groupBy("bucket").applyInArrow(combine, RUN_SCHEMA)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
        """The batch cleaned: doc_id, n_words, n_removed, kept_sha256, and the kept text if ``with_text``. Its windows join the index."""
        out = self._add(docs, id_col, text_col, with_text)
        # Nothing refers to the batch's shuffles any more: they go before runs are merged.
        release_shuffles(self.spark)
        self._compact()
        return out

    def _add(self, docs: DataFrame, id_col: str, text_col: str, with_text: bool) -> DataFrame:
        window, bases = self.window, self.bases
        blocks = durable(pack(docs, id_col, text_col))
        stored = blocks.select(F.coalesce(F.sum(F.length("payload")), F.lit(0))).first()[0]
        # A compressed byte stands for about three, a word for six.
        self._grow(stored / 2)
        bits, runs, files = (self.state[k] for k in ("bits", "runs", "files"))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, _ in blocks_of(batches):
                w = _Windows(block, bases, window)
                found = R.cuts(w.hash, bits)
                if found:
                    keys = block.order_key()
                    yield _rows(0, [b for b, _, _ in found], [block.block_id] * len(found), [j - i for _, i, j in found], [_encode(w.hash[i:j], w.check[i:j], w.doc[i:j], keys) for _, i, j in found])

        def merge(table: pa.Table) -> pa.Table:
            rows = list(zip(*(table[c].to_pylist() for c in ("kind", "block_id", "n", "data")), strict=True))
            batch, bucket = [r[1:] for r in rows if r[0] == 0], table["bucket"][0].as_py()
            if not batch:
                return _rows(0, [], [], [], []).schema.empty_table()
            replies, h, check = _merge(batch, [r[2:] for r in rows if r[0] == 1])
            return pa.Table.from_batches([_rows(0, [bucket] * len(batch), [b for b, _, _ in batch], [m for _, m, _ in batch], replies), _chunks(bucket, h, check)])

        sent = blocks.mapInArrow(send, RUN_SCHEMA).repartition(files, "bucket")
        both = sent.unionByName(self._past(runs)) if runs else sent
        new = self._write(both.groupBy("bucket").applyInArrow(merge, RUN_SCHEMA), 0)
        replies = self._read(new).where("kind = 0").groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", F.col("data").alias("reply")))).alias("replies"))

        def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, row in blocks_of(batches):
                w = _Windows(block, bases, window)
                gone = R.flags(row["found"])[w.number] if len(w.at) else np.zeros(0, bool)
                start = w.at[w.order][gone | ~w.new]
                words = w.words
                removed = covered(len(words.start), start, start + window)
                n_removed = np.bincount(words.doc[removed], minlength=len(block.doc_ids))
                texts = kept_texts(words, ~removed, len(block.doc_ids))
                cols = [pa.array(block.ids(), pa.int64()), pa.array(words.count, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols, names = [*cols, pa.array([t.decode("utf-8", "replace") for t in texts])], [*names, "kept_text"]
                yield pa.record_batch(cols, names)

        out = durable(R.with_replies(blocks, replies, "found").mapInArrow(render, RESULT_SCHEMA + (", kept_text string" if with_text else "")))
        self._publish([*runs, new])
        return out

    def _compact(self) -> None:
        """Merge the runs of every level that holds ``fanout``, the lowest first."""
        while full := [k for k in {r["level"] for r in self.state["runs"]} if sum(r["level"] == k for r in self.state["runs"]) >= self.fanout]:
            self._compact_level(min(full))

    def _compact_level(self, level: int) -> None:
        old = [r for r in self.state["runs"] if r["level"] == level]
        new = self._write(self._combined(self._past(old)), level + 1)
        self._publish([new, *(r for r in self.state["runs"] if r not in old)])


class SubstringDedup:
    """``dedup(docs)`` feeds a table to an index of its own in ``batches`` of rising doc_id, and deletes the index."""

    def __init__(self, window: int = WINDOW, batches: int = BATCHES) -> None:
        self.window, self.batches = window, batches

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256, and the kept text if ``with_text``; one row per row of ``docs``."""
        spark = docs.sparkSession
        index = FingerprintIndex(spark, f"{checkpoint_folder(spark)}/substring-index-{uuid.uuid4().hex}", self.window)
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        at = [k / self.batches for k in range(1, self.batches)]
        cuts = sorted(set((rows.agg(F.percentile_approx("doc_id", at, 1000)).first()[0] if at else None) or []))
        first = F.col("doc_id").isNull()
        bounds = zip([None, *cuts], [*cuts, None], strict=True)
        out = None
        try:
            for low, high in bounds:
                inside = (F.lit(True) if low is None else F.col("doc_id") > low) & (F.lit(True) if high is None else F.col("doc_id") <= high)
                part = index.add(rows.where(inside if low is not None else inside | first), with_text=with_text)
                out = part if out is None else out.unionByName(part)
        finally:
            index.drop()
        return out


def kept_texts(words: Words, keep: np.ndarray, n_docs: int) -> list[bytes]:
    """Each document's kept words joined by one space."""
    start, size = words.start[keep], words.end[keep] - words.start[keep] + 1
    index = spread(start, size)
    out = words.data[np.minimum(index, max(0, len(words.data) - 1))] if len(index) else np.zeros(0, np.uint8)
    ends = np.cumsum(size)
    out[ends - 1] = 0x20
    per_doc = np.bincount(words.doc[keep], weights=size, minlength=n_docs).astype(np.int64)
    stop = np.cumsum(per_doc)
    raw = out.tobytes()
    return [raw[e - n : max(e - n, e - 1)] for e, n in zip(stop.tolist(), per_doc.tolist(), strict=True)]
