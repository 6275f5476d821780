"""Blocks of documents and vectorised kernels over their bytes and words.

A block packs about ``BLOCK_BYTES`` of neighbouring documents into one compressed row, so that a
Python worker sees numpy arrays over all of their bytes at once instead of one text at a time, and so
that moving texts costs a third of their size. A document is never split: a worker needs about 60 bytes
of memory for each byte of the longest document.
"""

from __future__ import annotations

import contextlib
import ctypes
import random
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 19
BLOCK_SCHEMA = "block_id long, n_docs int, payload binary"
U = np.uint64
#: Hashes are polynomials over the integers modulo this prime.
PRIME = (1 << 61) - 1
_P, _M30, _M31, _M32 = U(PRIME), U((1 << 30) - 1), U((1 << 31) - 1), U((1 << 32) - 1)


def tidy() -> None:
    """Give memory back to the system: a worker that has done its partition lives on for other stages' partitions."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` over a partition's batches, then ``tidy``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            tidy()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all 64 bits; a bijection."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Bases(NamedTuple):
    """Where the polynomials over bytes and over words are evaluated, each twice."""

    byte: int
    word: int
    word2: int
    byte2: int


def draw_bases() -> Bases:
    """Random bases. Whoever writes the texts can't know them, so no text is made to collide; all hashes that are compared need the same."""
    rng = random.SystemRandom()
    return Bases(*(rng.randrange(1 << 40, PRIME - 1) for _ in Bases._fields))


def reduced(x: np.ndarray) -> np.ndarray:
    """Modulo PRIME."""
    x = (x & _P) + (x >> U(61))
    return x - (x >= _P) * _P


def mulmod(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo PRIME, for numbers below it; 2**61 counts as 1."""
    a_high, a_low, b_high, b_low = a >> U(31), a & _M31, b >> U(31), b & _M31
    middle = a_low * b_high
    middle += a_high * b_low
    out = a_high * b_high
    out <<= U(1)
    out += middle >> U(30)
    middle &= _M30
    middle <<= U(31)
    out += middle
    out += a_low * b_low
    return reduced(out)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low + high * 2**32 modulo PRIME."""
    high = reduced(high)
    return reduced(reduced(low) + ((high << U(32)) & _P) + (high >> U(29)))


def _sums(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Running sums modulo PRIME of low + high * 2**32; neither's plain sum may exceed 64 bits."""
    return _joined(np.cumsum(low, dtype=U), np.cumsum(high, dtype=U))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo PRIME for j in 0..n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        have = tuple(_powers_of(b, size) for b in (base, pow(base, -1, PRIME)))
        if n <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have


def _powers_of(base: int, size: int) -> np.ndarray:
    out = np.ones(size, U)
    have = 1
    while have < size:
        m = min(have, size - have)
        out[have : have + m] = mulmod(out[:m], U(pow(base, have, PRIME)))
        have += m
    return out


class Rolling:
    """Prefix polynomial hashes of a sequence: the hash of any range in constant time.

    ``values``: below PRIME. Two different sequences of n values agree at a random base with a chance of n / PRIME, whatever they are.
    """

    def __init__(self, values: np.ndarray, base: int) -> None:
        n = len(values)
        self.power, self.inverse = powers(base, n)
        self.prefix = np.zeros(n + 1, U)
        term = mulmod(values, self.power[:n])
        self.prefix[1:] = _sums(term & _M32, term >> U(32))

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes below PRIME."""
        return mulmod(reduced(self.prefix[end] + (_P - self.prefix[start])), self.inverse[start])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes spread over 64 bits."""
        return mix(self.raw(start, end))

    def windows(self, k: int) -> np.ndarray:
        """The hash of every run of ``k`` values."""
        n = len(self.prefix) - k
        return mix(mulmod(reduced(self.prefix[k:] + (_P - self.prefix[:-k])), self.inverse[:n])) if n > 0 else np.zeros(0, U)

    def agree(self, p: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ranges of ``length`` at ``p`` and at ``q`` have one hash."""
        a, b = np.minimum(p, q), np.maximum(p, q)
        left = reduced(self.prefix[a + length] + (_P - self.prefix[a]))
        right = reduced(self.prefix[b + length] + (_P - self.prefix[b]))
        return mulmod(left, self.power[b - a]) == right


_GRAM_BASE = 0x9E3779B97F4A7C15


def filter_grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` bytes, modulo 2**64: cheap, but texts can be made that collide. Fit for a filter alone, which then keeps more."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    have = _powers.get(-1)
    if have is None or len(have[0]) < len(data):
        size = max(len(data), 1 << 16)
        a, b = np.full(size, _GRAM_BASE, U), np.full(size, pow(_GRAM_BASE, -1, 1 << 64), U)
        a[0] = b[0] = 1
        have = (np.multiply.accumulate(a), np.multiply.accumulate(b))
        if size <= 4 * BLOCK_BYTES:
            _powers[-1] = have
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * have[0][: len(data)], out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * have[1][:n])


class Block:
    """Documents in order of doc_id (null first), their bytes joined with nothing between."""

    __slots__ = ("block_id", "doc_ids", "has_id", "lengths", "data", "offsets", "rest")

    def __init__(self, block_id, doc_ids, has_id, lengths, data, rest=()) -> None:
        self.block_id, self.doc_ids, self.has_id, self.lengths, self.data, self.rest = block_id, doc_ids, has_id, lengths, data, rest
        self.offsets = np.zeros(len(doc_ids) + 1, np.int64)
        np.cumsum(np.maximum(lengths, 0), out=self.offsets[1:])

    @property
    def bytes(self) -> np.ndarray:
        return np.frombuffer(self.data, np.uint8)

    def ids(self) -> list[int | None]:
        return [int(i) if h else None for i, h in zip(self.doc_ids, self.has_id, strict=True)]

    def null_text(self) -> np.ndarray:
        return self.lengths < 0

    def order_key(self) -> np.ndarray:
        """doc_id as a sortable number, null before all."""
        return np.where(self.has_id, self.doc_ids, np.iinfo(np.int64).min)


def encode_block(docs: list[tuple[int | None, bytes | None, bytes]]) -> bytes:
    n = len(docs)
    ids = np.array([d or 0 for d, _, _ in docs], np.int64)
    has = np.array([d is not None for d, _, _ in docs], np.uint8)
    lengths = np.array([-1 if t is None else len(t) for _, t, _ in docs], np.int64)
    rest = np.array([len(r) for _, _, r in docs], np.int64)
    raw = b"".join([np.int64(n).tobytes(), ids.tobytes(), has.tobytes(), lengths.tobytes(), rest.tobytes(), *(r for _, _, r in docs), *(t for _, t, _ in docs if t)])
    return zstandard.ZstdCompressor(level=2).compress(raw)


def decode_block(block_id: int, payload: bytes) -> Block:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids = np.frombuffer(raw, np.int64, n, 8)
    has = np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(bool)
    lengths = np.frombuffer(raw, np.int64, n, 8 + 9 * n)
    sizes = np.frombuffer(raw, np.int64, n, 8 + 17 * n).tolist()
    at, rest = 8 + 25 * n, []
    for size in sizes:
        rest.append(raw[at : at + size])
        at += size
    return Block(block_id, ids, has, lengths, memoryview(raw)[at:], rest)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, docs, size = TaskContext.get().partitionId(), 0, [], 0

    def row():
        docs.sort(key=lambda d: (d[0] is not None, d[0] or 0))
        return pa.record_batch([pa.array([part << 24 | seq], pa.int64()), pa.array([len(docs)], pa.int32()), pa.array([encode_block(docs)], pa.binary())], ["block_id", "n_docs", "payload"])

    for batch in batches:
        for doc_id, text, rest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            text, rest = text.as_buffer(), rest.as_buffer()
            docs.append((doc_id, None if text is None else text.to_pybytes(), b"" if rest is None else rest.to_pybytes()))
            size += len(docs[-1][1] or b"") + len(docs[-1][2]) + 16
            if size >= BLOCK_BYTES:
                yield row()
                seq, docs, size = seq + 1, [], 0
    if docs:
        yield row()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Blocks of ``docs`` (see module); rows of one input partition stay together, nothing is shuffled.

    ``carry``: other columns that the blocks keep, as JSON; ``with_carried`` reads them again. A block's
    number holds for this plan alone: keep the blocks with ``session.durable`` before two plans refer to them.
    """
    rest = F.to_json(F.struct(*carry)).cast("binary") if carry else F.lit(None).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), rest.alias("rest")).mapInArrow(tidied(_pack), BLOCK_SCHEMA)


def with_carried(result: DataFrame, docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """``result`` with its JSON column ``rest`` read back as the columns ``carry`` of ``docs``."""
    kept = F.from_json("rest", docs.select(*carry).schema)
    if not carry:
        return result.drop("rest")
    return result.withColumn("rest", kept).select(*(c for c in result.columns if c != "rest"), *(F.col("rest")[c].alias(c) for c in carry))


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, dict]]:
    """Each row's block with the row's other columns."""
    try:
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ("block_id", "payload", "n_docs")]
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in names}
                yield decode_block(batch.column("block_id")[i].as_py(), batch.column("payload")[i].as_py()), row
    finally:
        tidy()


# --- words ---------------------------------------------------------------------------------------

SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """The words of a block: maximal runs of ``in_word`` bytes inside one document."""

    def __init__(self, block: Block, bases: Bases, in_word: np.ndarray = SPACES, lower: bool = False) -> None:
        self.bases = bases
        data = block.bytes
        if lower:
            data = LOWER[data]
        inside = in_word[data]
        # A word starts where the byte before is no word byte or belongs to another document.
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = block.offsets[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < len(data))])
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        self.data = data
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, block.offsets)  # of each document, and one more
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self._rolling: Rolling | None = None
        self._second: Rolling | None = None
        self._apart: Rolling | None = None

    def hashes(self, base: int | None = None) -> np.ndarray:
        """Of each word, below PRIME: its bytes' polynomial, at ``bases.byte`` if no base is given."""
        if not len(self.start):
            return np.zeros(0, U)
        size = self.end - self.start
        first = np.cumsum(size) - size
        at = spread(self.start, size)
        power = powers(base or self.bases.byte, int(size.max()))[0][np.arange(len(at)) - np.repeat(first, size)]
        values = self.data[at].astype(U) + U(1)
        if size.max() <= 1 << 22:
            return _joined(np.add.reduceat(values * (power & _M32), first), np.add.reduceat(values * (power >> U(32)), first))
        term = mulmod(values, power)
        return _joined(np.add.reduceat(term & _M32, first), np.add.reduceat(term >> U(32), first))

    @property
    def rolling(self) -> Rolling:
        """Hashes of runs of words."""
        if self._rolling is None:
            self._hashes = self.hashes()
            self._rolling = Rolling(self._hashes, self.bases.word)
        return self._rolling

    @property
    def second(self) -> Rolling:
        """The same at another base."""
        if self._second is None:
            _ = self.rolling
            self._second = Rolling(self._hashes, self.bases.word2)
        return self._second

    @property
    def apart(self) -> Rolling:
        """The same with other bases for bytes and words: nothing that makes two runs agree in ``rolling`` makes them agree here."""
        if self._apart is None:
            self._apart = Rolling(self.hashes(self.bases.byte2), self.bases.word2)
        return self._apart

    def left(self) -> np.ndarray:
        """Words from each word to its document's end, itself included."""
        return self.first[1:][self.doc] - np.arange(len(self.start))

    def text(self, a: int, b: int) -> bytes:
        """Words a..b joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def sliding_owner(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` values the position of its smallest, the leftmost among equals (winnowing).

    Values are compared by their top bits, positions fill the rest.
    """
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = max(1, len(hashes).bit_length())
    low = U((1 << bits) - 1)
    key = (hashes & ~low) | np.arange(len(hashes), dtype=U)
    pad = -len(key) % w
    rows = np.concatenate([key, np.full(pad, ~U(0))]).reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).reshape(-1)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & low).astype(np.int64)


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+length[0]-1, start[1] .. and so on."""
    if not len(start):
        return np.zeros(0, np.int64)
    total = np.cumsum(length)
    out = np.arange(total[-1], dtype=np.int64)
    return out + np.repeat(start - (total - length), length)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` positions lie in one of the ranges."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0
