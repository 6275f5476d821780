"""Phrase collocations by hierarchical pair naming.

Words, then pairs of words, then pairs of overlapping pairs get numbers. A block of texts of one language holds a code per word place; a round sends the
distinct keys of a block with their counts to the buckets they hash to, where they are joined with those of all blocks: a key that stands ``min_count`` times or more in
the language gets a number there, and every block learns the numbers of its keys. Places of rarer keys become empty, as no longer phrase about them can be
frequent. Two neighbouring numbers are the next round's key: a pair of words, then two pairs that share a word, and so on. A name's key is so its two
parents, the phrase without its last and without its first word, through which cuts and longer phrases are looked up by joins.

Counts are exact: words are compared as strings, phrases as pairs of numbers, never by hash alone, and sums are 64 bits wide (within a bucket exact to 2 ** 53). What moves is a
compressed run per block and bucket, so a word of every text costs an entry per block. Scores are whole numbers of 38 digits: exact
for counts below 3 * 10 ** 15.

Blocks, numbers and names are kept in the shared folder, so a lost executor costs one round's work of its own at most.

Defined cases: a null text has no words; a null language is ``und``, together with texts of that label. Repeated rows count as often as they stand. Letters but A-Z keep
their case. A text is worked on whole: a worker needs some 40 bytes of memory for each byte of the longest one. Of phrases with
equal scores and counts the first by UTF-8 bytes ranks first. Other columns, whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.blocks import mix, tidied
from corpusloom.llm.runs import bucket_bits, cuts
from corpusloom.session import durable, prepare, release_shuffles, shuffle_partitions

MIN_COUNT, MAX_WORDS, WITHIN, TOP = 10, 3, 50, 2000
BLOCK_BYTES = 2 << 20
#: Texts of so many bytes in all may wait for others of their language.
WAITING_BYTES = 16 << 20
BLOCKS = "block_id long, lang string, n long, keys binary, codes binary"
RUNS = "lang string, bucket int, block_id long, n int, run binary, counts binary"
MERGED = "lang string, bucket int, block_id long, n int, reply binary, id long, word string, l long, r long, f long"
U = np.uint64
#: A to Z become small, what ends a piece a full stop, tabulators spaces.
_PLAIN = bytes(ord(".") if chr(c) in ".,;:!?\n\x0b\x0c\r" else ord(" ") if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


# --- numbers as bytes ------------------------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers of 4 or 8 bytes, byte plane by byte plane."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def _unpacked(blob: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def _words_packed(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def _words_unpacked(blob: bytes) -> list[bytes]:
    """A word holds no line feed, and there is one at least."""
    return zstandard.ZstdDecompressor().decompress(blob).split(b"\n")


# --- keys of a block, in order of their hash ---------------------------------------------------------


def _word_block(texts: list[bytes]) -> tuple[int, list[bytes], np.ndarray]:
    """Number of words, distinct words by hash, and per place the word's number, -1 between pieces."""
    tokens = b" . ".join(texts).translate(_PLAIN).replace(b".", b" . ").split()
    if not tokens:
        return 0, [], np.zeros(0, np.int32)
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    order = sorted((k for k, w in enumerate(words) if w != b"."), key=lambda k: (zlib.crc32(words[k]), words[k]))
    place = np.full(len(words), -1, np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    codes = place[codes]
    return int((codes >= 0).sum()), [words[k] for k in order], codes


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in words), U, len(words)) << U(32)


class _Pairs:
    """Distinct pairs of neighbouring numbers, by hash: ``l`` and ``r``, how often each stands, and which stands at each place (-1: none)."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray) -> None:
        both = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
        key = codes[:-1][both].astype(np.int64) * max(1, len(ids)) + codes[1:][both]
        distinct, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        l, r = (ids[distinct // max(1, len(ids))], ids[distinct % max(1, len(ids))]) if len(distinct) else (distinct, distinct)
        hashes = mix(l.astype(U) * U(0x9E3779B97F4A7C15) + mix(r.astype(U)))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.l, self.r, self.count, self.hashes = l[order], r[order], count[order].astype(np.uint32), hashes[order]
        self.at = np.full(max(0, len(codes) - 1), -1, np.int32)
        self.at[both] = rank[inverse]


# --- rounds ------------------------------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: batch.column(n)[k].as_py() for n in batch.schema.names}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, waiting, size = TaskContext.get().partitionId() << 24, 0, {}, {}

    def block(lang: str) -> pa.RecordBatch:
        n, words, codes = _word_block(waiting.pop(lang))
        del size[lang]
        return pa.record_batch([pa.array([part | seq], pa.int64()), pa.array([lang]), pa.array([n], pa.int64()), pa.array([_words_packed(words)], pa.binary()), pa.array([_packed(codes)], pa.binary())], ["block_id", "lang", "n", "keys", "codes"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_buffer().to_pybytes()
            waiting.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text) + 64
            while size and (size[lang := max(size, key=size.get)] >= BLOCK_BYTES or sum(size.values()) >= WAITING_BYTES):
                yield block(lang)
                seq += 1
    for lang in list(waiting):
        yield block(lang)
        seq += 1


def _run(row: dict, bucket: int, run: bytes, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([row["lang"]]), pa.array([bucket], pa.int32()), pa.array([row["block_id"]], pa.int64()), pa.array([len(counts)], pa.int32()), pa.array([run], pa.binary()), pa.array([_packed(counts)], pa.binary())], ["lang", "bucket", "block_id", "n", "run", "counts"])


def _word_runs(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, codes = _words_unpacked(row["keys"]), _unpacked(row["codes"], np.int32)
            counts = np.bincount(codes[codes >= 0], minlength=len(words)).astype(np.uint32)
            for bucket, a, b in cuts(_word_hashes(words), bits):
                yield _run(row, bucket, _words_packed(words[a:b]), counts[a:b])

    return tidied(send)


def _pair_runs(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            pairs = _Pairs(_unpacked(row["keys"], np.int64), _unpacked(row["codes"], np.int32))
            for bucket, a, b in cuts(pairs.hashes, bits):
                yield _run(row, bucket, _packed(np.concatenate([pairs.l[a:b], pairs.r[a:b]])), pairs.count[a:b])

    return tidied(send)


def _answers(key: tuple, table: pa.Table, of: np.ndarray, sums: np.ndarray, least: int, words: pa.Array | None, l: np.ndarray | None, r: np.ndarray | None, reply: bool) -> pa.Table:
    """Names of the frequent keys; for each run the numbers of its keys plus one, 0 for rare ones."""
    lang, bucket = key[0].as_py(), key[1].as_py()
    often = sums >= least
    names, runs = int(often.sum()), table.num_rows if reply else 0
    ids = (np.int64(bucket) << np.int64(32)) + np.arange(names)
    none, kept = pa.nulls(runs, pa.int64()), pa.nulls(names, pa.int64())
    number = (np.cumsum(often) * often).astype(np.uint32)[of]
    replies, at = [], 0
    for n in table["n"].to_pylist() if reply else ():
        replies.append(_packed(number[at : at + n]))
        at += n
    columns = {
        "lang": pa.array([lang] * (names + runs), pa.string()),
        "bucket": pa.array([bucket] * (names + runs), pa.int32()),
        "block_id": pa.chunked_array([kept, *(table["block_id"].chunks if reply else [none])], pa.int64()),
        "n": pa.chunked_array([pa.nulls(names, pa.int32()), *(table["n"].chunks if reply else [pa.nulls(0, pa.int32())])], pa.int32()),
        "reply": pa.array([None] * names + replies, pa.binary()),
        "id": pa.chunked_array([pa.array(ids, pa.int64()), none]),
        "word": pa.chunked_array([pa.nulls(names, pa.string()) if words is None else words.filter(pa.array(often)).cast(pa.string()), pa.nulls(runs, pa.string())]),
        "l": pa.chunked_array([kept if l is None else pa.array(l[often], pa.int64()), none]),
        "r": pa.chunked_array([kept if r is None else pa.array(r[often], pa.int64()), none]),
        "f": pa.chunked_array([pa.array(sums[often], pa.int64()), none]),
    }
    return pa.table(columns)


def _merge_words(least: int, reply: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        runs = [pa.array(_words_unpacked(r.as_buffer()), pa.binary()) for r in table["run"]]
        counts = np.concatenate([_unpacked(c.as_buffer(), np.uint32) for c in table["counts"]])
        coded = pa.chunked_array(runs).combine_chunks().dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        of = rank[coded.indices.to_numpy()]
        sums = np.bincount(of, counts, len(order)).astype(np.int64)
        return _answers(key, table, of, sums, least, coded.dictionary.take(pa.array(order)), None, None, reply)

    return merge


def _merge_pairs(least: int, reply: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        keys = [_unpacked(r.as_buffer(), np.int64).reshape(2, -1) for r in table["run"]]
        counts = np.concatenate([_unpacked(c.as_buffer(), np.uint32) for c in table["counts"]])
        l, r = (np.concatenate([k[side] for k in keys]) for side in (0, 1))
        order = np.lexsort((r, l))
        l, r = l[order], r[order]
        new = np.concatenate([[True], (l[1:] != l[:-1]) | (r[1:] != r[:-1])])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        sums = np.bincount(of, counts, int(new.sum())).astype(np.int64)
        return _answers(key, table, of, sums, least, None, l[new], r[new], reply)

    return merge


def _named(words: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks with the numbers of their keys in place of the keys; those whose places are all empty go."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            codes = _unpacked(row["codes"], np.int32)
            at = codes if words else _Pairs(_unpacked(row["keys"], np.int64), codes).at
            number = [_unpacked(x["reply"], np.uint32).astype(np.int64) for x in row["replies"]]
            often = np.concatenate(number) > 0
            ids = np.concatenate([(x["bucket"] << 32) + k - 1 for x, k in zip(row["replies"], number, strict=True)])[often]
            place = np.append(np.where(often, np.cumsum(often) - 1, -1), -1).astype(np.int32)  # the last is for -1
            codes = place[at]
            n = int(((codes[:-1] >= 0) & (codes[1:] >= 0)).sum())
            if n:
                yield pa.record_batch([pa.array([row["block_id"]], pa.int64()), pa.array([row["lang"]]), pa.array([n], pa.int64()), pa.array([_packed(ids)], pa.binary()), pa.array([_packed(codes)], pa.binary())], ["block_id", "lang", "n", "keys", "codes"])

    return tidied(named)


class Collocations:
    """``mine(docs)``: the phrases of each language whose words stand together most tellingly; see the module."""

    def __init__(self, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, within: int = WITHIN, top: int | None = TOP, bits: int | None = None) -> None:
        """``within``: percent of its count from which on a longer phrase replaces one; ``top``: phrases a language, None for all; ``bits``: log2 of the buckets, by the data's size if None."""
        if max_words < 2:
            raise ValueError("a phrase has two words at least")
        self.min_count, self.max_words, self.within, self.top, self.bits = min_count, max_words, within, top, bits

    def _round(self, blocks: DataFrame, words: bool, keys: int, reply: bool) -> DataFrame:
        spark = blocks.sparkSession
        bits = bucket_bits(keys, least=shuffle_partitions(spark)) if self.bits is None else self.bits
        send, merge = (_word_runs, _merge_words) if words else (_pair_runs, _merge_pairs)
        merged = blocks.mapInArrow(send(bits), RUNS).groupBy("lang", "bucket").applyInArrow(merge(self.min_count, reply), MERGED)
        merged = durable(merged)
        release_shuffles(spark)
        return merged

    @staticmethod
    def _with_numbers(blocks: DataFrame, merged: DataFrame, words: bool) -> DataFrame:
        replies = merged.where("block_id is not null").groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "reply"))).alias("replies"))
        return blocks.join(replies, "block_id").select("block_id", "lang", "keys", "codes", "replies").mapInArrow(_named(words), BLOCKS)

    def names(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
        """(lang, n): words of each language; and by number of words the frequent phrases: (lang, id, word, f), then (lang, id, l, r, f) of l and r with one word less."""
        prepare(docs.sparkSession)
        rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
        blocks = durable(rows.mapInArrow(tidied(_blocks), BLOCKS))
        sizes = blocks.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")
        blocks = blocks.where("n > 0")
        levels = []
        for size in range(1, self.max_words + 1):
            # At most as many distinct keys as places; what a block repeats makes it fewer.
            keys = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if size <= 2 else keys
            merged = self._round(blocks, size == 1, keys, size < self.max_words)
            found = merged.where("id is not null")
            levels.append(found.select("lang", "id", "word", "f") if size == 1 else found.select("lang", "id", "l", "r", "f"))
            if size < self.max_words:
                blocks = self._with_numbers(blocks, merged, size == 1)
                if size + 1 < self.max_words:
                    blocks = durable(blocks)
                    release_shuffles(docs.sparkSession)
        return sizes, levels

    def mine(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
        """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, then count ``a``, then text; see ``scored``. ``n``: the language's words."""
        sizes, levels = self.names(docs, text_col, lang_col)
        known = levels[0].select("lang", "id", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", *(F.array().cast("array<bigint>").alias(c) for c in ("heads", "tails")))
        out = None
        for k, level in enumerate(levels[1:], 2):
            known = durable(_resolved(level, known))
            kept = known
            if k < self.max_words:
                # What holds a phrase holds it in one of one word more that stands at least as often: to ask the children is enough.
                child = levels[k].select("lang", F.explode(F.array("l", "r")).alias("id"), "f").groupBy("lang", "id").agg(F.max("f").alias("longer"))
                kept = known.join(child, ["lang", "id"], "left").where(f"longer is null or 100 * longer < {self.within} * f").drop("longer")
            part = scored(kept)
            out = part if out is None else out.unionByName(part)
        ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
        ranked = ranked if self.top is None else ranked.where(F.col("rank") <= self.top)
        return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _resolved(level: DataFrame, known: DataFrame) -> DataFrame:
    """A level's phrases with their texts and the counts of their heads and tails at every cut, from those of their two parents."""
    left = known.select("lang", F.col("id").alias("l"), F.col("phrase").alias("head"), F.col("f").alias("head_f"), F.col("heads").alias("head_heads"))
    right = known.select("lang", F.col("id").alias("r"), "last", F.col("f").alias("tail_f"), F.col("tails").alias("tail_tails"))
    both = level.join(left, ["lang", "l"]).join(right, ["lang", "r"])
    return both.select(
        "lang",
        "id",
        F.concat("head", F.lit(" "), "last").alias("phrase"),
        "last",
        "f",
        F.array_append("head_heads", F.col("head_f")).alias("heads"),
        F.concat(F.array("tail_f"), "tail_tails").alias("tails"),
    )


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): ``l`` and ``r`` at the cut whose floor(1000000 * a * a / (l * r)) is least, the first of such cuts."""
    whole = "cast({} as decimal(38,0))"
    score = f"({whole.format(1000000)} * {whole.format('f')} * {whole.format('f')}) div ({whole.format('c.l')} * {whole.format('c.r')})"
    least = F.expr(f"array_min(transform(zip_with(heads, tails, (l, r) -> struct(l as l, r as r)), (c, k) -> struct({score} as score, k as k, c.l as l, c.r as r)))")
    return phrases.select("lang", "phrase", F.col("f").alias("a"), least.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
