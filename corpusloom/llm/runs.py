"""Sorted immutable runs of hashes: dealt out by hash, merged, answered per block.

A block writes its distinct hashes in sorted order, cut into buckets by their leading bits and stored as
differences. All runs of a bucket are merged in one task, which answers each run with a few bits per
hash. What moves is a run per block and bucket, never a row per hash, and a hash that stands in every
block costs one entry per block: no key is hot, whatever a third of the rows hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import Block, blocks_of, mix

U = np.uint64
RUN_SCHEMA = "bucket int, block_id long, n int, run binary"
REPLY_SCHEMA = "block_id long, bucket int, n int, reply binary"
#: A bucket's merge should hold about this many hashes.
BUCKET_HASHES = 1_500_000


def bucket_bits(n_hashes: float, least: int = 8, bucket_hashes: int = BUCKET_HASHES) -> int:
    """log2 of the number of buckets for about ``n_hashes`` hashes in all."""
    return max((max(1, least) - 1).bit_length(), int(np.ceil(np.log2(max(1.0, n_hashes / bucket_hashes)))))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, byte plane by byte plane: the high planes are nearly empty."""
    delta = np.diff(values, prepend=U(0))
    planes = np.ascontiguousarray(delta.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    planes = np.frombuffer(raw, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=U)


def cuts(hashes: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending 64-bit ``hashes`` by their leading ``bits``."""
    if not len(hashes):
        return []
    of = (hashes >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    at = np.flatnonzero(np.diff(of, prepend=-1))
    return [(int(of[a]), int(a), int(b)) for a, b in zip(at, [*at[1:], len(of)], strict=True)]


def exchange(blocks: DataFrame, emit: Callable[[Block, dict], Iterable[tuple[int, int, bytes]]], merge: Callable[[list[tuple[int, int, bytes]]], list[bytes]], past: DataFrame | None = None) -> DataFrame:
    """One round: ``emit`` gives a block's (bucket, n, run); ``merge`` gets all (block_id, n, run) of a bucket and answers each in order.

    ``past``: runs of an index that are merged too, with block_id -1 and no answer.
    Returns block_id, replies: array of (bucket, n, reply) in order of the buckets.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, row in blocks_of(batches):
            runs = list(emit(block, row))
            if runs:
                yield pa.record_batch([pa.array([b for b, _, _ in runs], pa.int32()), pa.array([block.block_id] * len(runs), pa.int64()), pa.array([n for _, n, _ in runs], pa.int32()), pa.array([r for _, _, r in runs], pa.binary())], ["bucket", "block_id", "n", "run"])

    def answer(table: pa.Table) -> pa.Table:
        ids, ns = table["block_id"].to_pylist(), table["n"].to_pylist()
        replies = merge(list(zip(ids, ns, table["run"].to_pylist(), strict=True)))
        return pa.table([table["block_id"], table["bucket"], table["n"], pa.array(replies, pa.binary())], ["block_id", "bucket", "n", "reply"])

    sent = blocks.mapInArrow(send, RUN_SCHEMA)
    if past is not None:
        sent = sent.unionByName(past)
    replies = sent.groupBy("bucket").applyInArrow(answer, REPLY_SCHEMA).where("block_id >= 0")
    return replies.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "reply"))).alias("replies"))


def with_replies(blocks: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """``blocks`` with the answers to their runs as column ``name``; null where a block sent none."""
    return blocks.join(replies.withColumnRenamed("replies", name), "block_id", "left")


# --- the plain round: which hashes stand in another block too ------------------------------------


def filter_runs(hashes: np.ndarray, bits: int, width: int) -> Iterator[tuple[int, int, bytes]]:
    """Runs of the distinct ``hashes`` cut to their leading ``width`` bits.

    Shorter hashes collide now and then, which a filter may: it then keeps a little more.
    """
    distinct = np.unique(hashes >> U(64 - width)) << U(64 - width)
    for bucket, a, b in cuts(distinct, bits):
        yield bucket, b - a, pack_sorted(distinct[a:b] >> U(64 - width))


def merge_repeated(hot: int = 0) -> Callable[[list[tuple[int, int, bytes]]], list[bytes]]:
    """Answers a bit per hash: it stands in two runs at least; then, if ``hot``, another: in ``hot`` runs or more."""

    def merge(runs: list[tuple[int, int, bytes]]) -> list[bytes]:
        values = np.concatenate([unpack_sorted(r, n) for _, n, r in runs])
        order = np.argsort(values)
        ordered = values[order]
        start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        size = np.diff(np.append(start, len(ordered)))
        many = np.empty(len(values), np.int64)
        many[order] = np.repeat(size, size)
        out, at = [], 0
        for _, n, _ in runs:
            m = many[at : at + n]
            out.append(np.packbits(m >= 2).tobytes() + (np.packbits(m >= hot).tobytes() if hot else b""))
            at += n
        return out

    return merge


def flags(replies: list[dict] | None, plane: int = 0) -> np.ndarray:
    """A block's answers to its distinct hashes in ascending order."""
    parts = []
    for r in replies or []:
        size = (r["n"] + 7) // 8
        parts.append(np.unpackbits(np.frombuffer(r["reply"], np.uint8, size, plane * size), count=r["n"]))
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def repeated(hashes: np.ndarray, width: int, replies: list[dict] | None, plane: int = 0, local: bool = True) -> np.ndarray:
    """For each of a block's ``hashes``: it stands in another block or, if ``local``, twice in this one."""
    if not len(hashes):
        return np.zeros(0, bool)
    _, inverse, count = np.unique(hashes >> U(64 - width), return_inverse=True, return_counts=True)
    known = flags(replies, plane)
    return (known | (count > 1) if local else known)[inverse]


class Segments:
    """Windows of ``k + w - 1`` values, each owned by its smallest k-gram (winnowing).

    Equal windows have equal owners at equal distance, so a window can only stand elsewhere if its
    owner's k-gram does. ``first``/``last``: the windows of a segment, all owned by the k-gram at ``owner``.
    ``hash``: of that k-gram, mixed once more, as the smallest of many hashes is a small number and would deal all to a few buckets.
    """

    def __init__(self, grams: np.ndarray, owner: np.ndarray, valid: np.ndarray) -> None:
        at = np.flatnonzero(valid)
        own = owner[at]
        new = np.ones(len(at), bool)
        new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        self.first, self.owner = at[begin], own[begin]
        self.last = at[np.append(begin[1:], len(at)) - 1] if len(at) else at
        self.hash = mix(grams[self.owner] * U(0x9FB21C651E98DF25))
