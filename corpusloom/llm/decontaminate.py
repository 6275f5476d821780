"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and characters beyond ASCII. A
window is 10 consecutive words of a benchmark item; an item with fewer words is one window. Both sides keep
the smallest 5-gram hash of each 10-word window (winnowing): two texts that share a window share that
fingerprint at equal distance. Fingerprints are joined, each hit is extended to the windows it stands for, and
a window counts if two hashes at random bases agree, and then its words. Windows of shorter items are fingerprints whole.

A benchmark of at most ``broadcast_bytes`` of text goes to every task. A larger one is joined by
fingerprint: blocks and items send runs of fingerprints, each block gets back the numbers of the items that it may
hold, and then their texts. Both ways end in the same check.

Defined cases: null or wordless texts have no words, no hits and the hash of the empty string as
``items_sha256``. An item with a null item_id counts and is listed as the empty string; rows that share an
item_id are one item. An empty benchmark hits nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import runs as R
from corpusloom.llm.blocks import ALNUM, BLOCK_BYTES, Bases, Block, Words, blocks_of, covered, draw_bases, pack, sliding_owner, spread, with_carried
from corpusloom.session import durable, prepare, shuffle_partitions

U = np.uint64
WINDOW, GRAM = 10, 5
BROADCAST_BYTES = 8 << 20
#: Tasks that the blocks of one item are dealt over.
SALTS = 16
RESULT_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

Item = tuple[str, bytes | None]


def _item_words(items: list[Item], bases: Bases) -> Words:
    texts = [t or b"" for _, t in items]
    block = Block(0, np.zeros(len(items), np.int64), np.ones(len(items), bool), np.array([len(t) for t in texts], np.int64), b"".join(texts))
    return Words(block, bases, ALNUM, lower=True)


def _fingerprints(words: Words, length: int, gram: int, valid: np.ndarray) -> R.Segments:
    """Fingerprints of the windows of ``length`` words; short ones are their own fingerprints."""
    k = gram if length > gram else length
    grams = words.rolling.windows(k)
    owner = sliding_owner(grams, length - k + 1)
    return R.Segments(grams, owner, valid[: len(owner)])


class ItemIndex:
    """The windows of some items: by length their fingerprints, hashes and items."""

    def __init__(self, items: list[Item], bases: Bases, window: int = WINDOW, gram: int = GRAM) -> None:
        self.items, self.gram = items, gram
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        self.words = words = _item_words(items, bases)
        lengths = np.minimum(words.count, window)
        left = words.left()
        for length in sorted({int(x) for x in lengths if x > 0}):
            valid = (lengths[words.doc] == length) & (left >= length)
            prints = _fingerprints(words, length, gram, valid)
            at = np.flatnonzero(valid)
            h = words.rolling.ranges(at, at + length)
            check = words.second.ranges(at, at + length)
            order = np.lexsort((check, h))
            new = np.ones(len(at), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])
            begin = np.flatnonzero(new)
            # The place of each distinct window's first occurrence tells its wording.
            self.by_length[length] = (np.unique(prints.hash), h[order][begin], check[order][begin], np.append(begin, len(at)), words.doc[at][order], at[order][begin])

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows found in a block: first word, length, and for each (window, item) the pair of numbers."""
        starts, sizes, docs, found = [], [], [], []
        left = words.left()
        for length, (prints, h, check, begin, item, place) in self.by_length.items():
            s = _fingerprints(words, length, self.gram, left >= length)
            keep = _member(s.hash, prints)
            at = spread(s.first[keep], s.last[keep] - s.first[keep] + 1)
            if not len(at):
                continue
            mine = words.rolling.ranges(at, at + length)
            lo, hi = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
            at, lo, hi = (x[hi > lo] for x in (at, lo, hi))
            if not len(at):
                continue
            mine = words.second.ranges(at, at + length)
            entry = spread(lo, hi - lo)
            which = np.repeat(np.arange(len(at)), hi - lo)
            good = check[entry] == mine[which]
            entry, which = entry[good], which[good]
            # At last the words themselves.
            good = same_words(words, at[which], self.words, place[entry], length)
            entry, which = entry[good], which[good]
            starts.append(at[which])
            sizes.append(np.full(len(which), length))
            count = begin[entry + 1] - begin[entry]
            docs.append(np.repeat(words.doc[at[which]], count))
            found.append(item[spread(begin[entry], count)])
        none = np.zeros(0, np.int64)
        return (np.concatenate(starts), np.concatenate(sizes), np.unique(np.stack([np.concatenate(docs), np.concatenate(found)]), axis=1)) if starts else (none, none, np.zeros((2, 0), np.int64))


def same_words(a: Words, at: np.ndarray, b: Words, place: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` words from ``at`` in ``a`` are those from ``place`` in ``b``, byte by byte."""
    k = np.arange(length)
    i, j = (at[:, None] + k).reshape(-1), (place[:, None] + k).reshape(-1)
    size = a.end[i] - a.start[i]
    same = size == b.end[j] - b.start[j]
    at_a, at_b = spread(a.start[i][same], size[same]), spread(b.start[j][same], size[same])
    if len(at_a):
        begin = np.cumsum(size[same]) - size[same]
        same[same] = np.logical_and.reduceat(a.data[at_a] == b.data[at_b], begin)
    return same.reshape(-1, length).all(axis=1)


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


class Decontaminate:
    """``annotate_hits(docs, benchmark)`` finds benchmark windows in documents; see the module."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> None:
        if not 1 <= gram <= window:
            raise ValueError("gram must lie between 1 and window")
        self.window, self.gram, self.broadcast_bytes = window, gram, broadcast_bytes

    def annotate_hits(self, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_items: bool = False, with_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
        """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; ``with_items``: the item ids; ``with_text``: text and the columns ``carry``."""
        prepare(docs.sparkSession)
        window, gram, bases = self.window, self.gram, draw_bases()
        items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").cast("binary").alias("text")).where("text is not null")
        size = items.agg(F.coalesce(F.sum(F.length("text") + F.length("item") + 16), F.lit(0))).first()[0]
        if size <= self.broadcast_bytes:
            shared = docs.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["text"])) for r in items.collect()])
            blocks, index_of = pack(docs, id_col, text_col, carry), _shared_index(shared, bases, window, gram)
        else:
            blocks, index_of = self._with_items(docs, items, bases, id_col, text_col, carry), _own_index(bases, window, gram)

        def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, row in blocks_of(batches):
                words = Words(block, bases, ALNUM, lower=True)
                index = index_of(row)
                start, length, pairs = index.hits(words)
                hit = covered(len(words.start), start, start + length)
                n = len(block.doc_ids)
                per_doc: list[set[str]] = [set() for _ in range(n)]
                for doc, item in pairs.T.tolist():
                    per_doc[doc].add(index.items[item][0])
                n_hit = np.bincount(words.doc[hit], minlength=n)
                named = [sorted(x) for x in per_doc]
                cols = [pa.array(block.ids(), pa.int64()), pa.array(words.count, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in named], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named]), pa.array(n_hit > 0)]
                names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
                if with_items:
                    cols, names = [*cols, pa.array(named, pa.list_(pa.string()))], [*names, "items"]
                if with_text:
                    texts = [None if size < 0 else bytes(block.data[a : a + size]).decode() for a, size in zip(block.offsets.tolist(), block.lengths.tolist(), strict=False)]
                    cols, names = [*cols, pa.array(texts, pa.string()), pa.array([r.decode() for r in block.rest])], [*names, "text", "rest"]
                yield pa.record_batch(cols, names)

        result = blocks.mapInArrow(render, RESULT_SCHEMA + (", items array<string>" if with_items else "") + (", text string, rest string" if with_text else ""))
        return with_carried(result, docs, carry) if with_text else result

    def _with_items(self, docs: DataFrame, items: DataFrame, bases: Bases, id_col: str, text_col: str, carry: Sequence[str]) -> DataFrame:
        """Blocks with the items that share a fingerprint with them, by a join on fingerprints."""
        spark = docs.sparkSession
        window, gram = self.window, self.gram
        blocks = durable(pack(docs, id_col, text_col, carry))
        stored = blocks.select(F.coalesce(F.sum(F.length("payload")), F.lit(0))).first()[0]
        bits = R.bucket_bits(stored / 6, shuffle_partitions(spark))

        # An item goes by its number until it is known which blocks it may stand in.
        items = durable(items.select(F.monotonically_increasing_id().alias("number"), "item", "text"))

        def send_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def run(numbers: list[int], part: list[Item]) -> Iterator[pa.RecordBatch]:
                words = _item_words(part, bases)
                left, lengths = words.left(), np.minimum(words.count, window)
                for length in sorted({int(x) for x in lengths if x > 0}):
                    prints = _fingerprints(words, length, gram, (lengths[words.doc] == length) & (left >= length))
                    pairs = np.unique(np.stack([prints.hash, np.array(numbers, np.int64)[words.doc[prints.first]].view(U)]), axis=1)
                    rows = [(b, j - i, bytes([length]) + pairs[:, i:j].tobytes()) for b, i, j in R.cuts(pairs[0], bits)]
                    if rows:
                        yield pa.record_batch([pa.array([b for b, _, _ in rows], pa.int32()), pa.array([-1] * len(rows), pa.int64()), pa.array([n for _, n, _ in rows], pa.int32()), pa.array([x for _, _, x in rows], pa.binary())], ["bucket", "block_id", "n", "run"])

            numbers, part, size = [], [], 0
            for batch in batches:
                for number, item, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    numbers.append(number)
                    part.append((item, text))
                    size += len(text)
                    if size >= BLOCK_BYTES:
                        yield from run(numbers, part)
                        numbers, part, size = [], [], 0
            if part:
                yield from run(numbers, part)

        lengths = sorted(r[0] for r in items.select(F.least(F.lit(window), F.size(F.regexp_extract_all(F.regexp_replace(F.col("text").cast("string"), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", " "), F.lit("[^ ]+"), F.lit(0)))).alias("n")).distinct().collect() if r[0] > 0)

        def send(block: Block, row: dict):
            words = Words(block, bases, ALNUM, lower=True)
            left = words.left()
            for length in lengths:
                h = np.unique(_fingerprints(words, length, gram, left >= length).hash)
                for bucket, a, b in R.cuts(h, bits):
                    yield bucket, b - a, bytes([length]) + R.pack_sorted(h[a:b])

        def merge(parts: list[tuple[int, int, bytes]]) -> list[bytes]:
            """For each run of a block the numbers of the items that share a fingerprint with it."""
            known: dict[int, list[np.ndarray]] = {}
            for block, n, run in parts:
                if block < 0:
                    known.setdefault(run[0], []).append(np.frombuffer(run, U, 2 * n, 1).reshape(2, n))
            tables = {}
            for length, found in known.items():
                h, number = np.concatenate(found, axis=1)
                order = np.argsort(h, kind="stable")
                tables[length] = h[order], number[order]
            out = []
            for block, n, run in parts:
                numbers = np.zeros(0, U)
                if block >= 0 and run[0] in tables:
                    h, number = tables[run[0]]
                    mine = R.unpack_sorted(run[1:], n)
                    lo, hi = np.searchsorted(h, mine, "left"), np.searchsorted(h, mine, "right")
                    numbers = np.unique(number[spread(lo[hi > lo], (hi - lo)[hi > lo])])
                out.append(numbers.tobytes())
            return out

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, replies in zip(batch.column("block_id").to_pylist(), batch.column("replies").to_pylist(), strict=True):
                    numbers = np.unique(np.concatenate([np.frombuffer(r["reply"], np.int64) for r in replies]))
                    yield pa.record_batch([pa.array([block] * len(numbers), pa.int64()), pa.array(numbers, pa.int64())], ["block_id", "number"])

        replies = R.exchange(blocks, send, merge, items.mapInArrow(send_items, R.RUN_SCHEMA))
        wanted = replies.mapInArrow(pairs, "block_id long, number long").withColumn("salt", F.pmod("block_id", F.lit(SALTS)).cast("int"))
        # An item that stands in many blocks meets them in several tasks.
        salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        held = wanted.join(salted, ["number", "salt"]).groupBy("block_id").agg(F.collect_list(F.struct("item", "text")).alias("items"))
        return blocks.join(held, "block_id", "left")


def _shared_index(shared, bases: Bases, window: int, gram: int):
    held: list[ItemIndex] = []

    def index_of(row: dict) -> ItemIndex:
        if not held:
            held.append(ItemIndex(shared.value, bases, window, gram))
        return held[0]

    return index_of


def _own_index(bases: Bases, window: int, gram: int):
    def index_of(row: dict) -> ItemIndex:
        return ItemIndex([(r["item"], bytes(r["text"])) for r in row["items"] or []], bases, window, gram)

    return index_of
