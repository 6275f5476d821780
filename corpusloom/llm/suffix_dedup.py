"""Suffix-array dedup: removes every byte covered by a 400-byte string that also stands anywhere else.

Suffixes are compared by prefix polynomial hashes: any range of bytes hashes in constant time, so a binary search
finds how far two suffixes agree, and one comparison in the mergesort costs a logarithm of the length instead of
the length (``SuffixOrder``). Neighbours in the sorted order that agree for ``length`` bytes are copies; their bytes
are compared against collisions before anything is removed.

A corpus has far more suffixes than have to be sorted. Two exchanges of hashes leave those that matter:

1. Anchors: the smallest 320-byte hash in each window of 81 (winnowing), one place in about 41. Every 400-byte
   string holds one, and equal strings hold it at equal distance, so strings with an anchor that stands nowhere
   else are unique. This is a filter: a collision only keeps more.
2. Extents: all bytes of the strings that share an anchor. An extent that stands elsewhere (128 bits of a cryptographic
   digest of its bytes agree) is repeated as a whole: the inside of long copies is settled without looking at single strings.
3. What is left are the ends of copies. Extents that share an anchor meet in one task, one copy of each, and the
   suffixes that begin at equal distance from the anchor are sorted there, as above.

An anchor that stands in ``HOT_RUNS`` blocks or more is never gathered: its strings are dealt out one by one by their
digest instead, 128 bits of it. All other hashes only choose what is compared.

Defined cases: null text counts as empty; texts under 400 bytes lose nothing. Rows that share a doc_id or
have none are documents of their own. Other columns are ignored, or kept with ``carry``. An empty table gives an
empty result. Cuts may fall inside a UTF-8 character; ``with_text`` then drops the incomplete bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import runs as R
from corpusloom.llm.blocks import Block, Rolling, blocks_of, covered, draw_bases, filter_grams, mix, pack, sliding_owner, spread, with_carried
from corpusloom.session import durable, prepare, shuffle_partitions

U = np.uint64
LENGTH, GRAM = 400, 320
ANCHOR_BITS = 44
#: An anchor that stands in so many blocks is dealt out by extent, not by anchor.
HOT_RUNS = 64
_SECOND = 0xE7037ED1A0B428DB
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class _Suffixes:
    def __init__(self, block: Block, length: int, gram: int) -> None:
        self.block, self.length = block, length
        data = block.bytes
        self.n = len(data)
        grams = filter_grams(data, gram)
        owner = sliding_owner(grams, length - gram + 1)
        valid = np.zeros(len(owner), bool)
        for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
            if b - a >= length:
                valid[a : b - length + 1] = True
        self.segments = R.Segments(grams, owner, valid)

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Two 64-bit halves of a cryptographic digest of each range of bytes."""
        data, blake = self.block.data, hashlib.blake2b
        raw = b"".join([blake(data[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        return np.frombuffer(raw, U).reshape(-1, 2)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before; the first row always."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


class _Extents:
    """The segments whose anchor stands elsewhere too, and the distinct (anchor, extent) among them in run order."""

    def __init__(self, s: _Suffixes, replies: list[dict] | None) -> None:
        g = s.segments
        keep = R.repeated(g.hash, ANCHOR_BITS, replies)
        self.hot = R.repeated(g.hash, ANCHOR_BITS, replies, 1, local=False)[keep]
        self.first, self.last, self.anchor = g.first[keep], g.last[keep], g.hash[keep]
        self.distance = g.owner[keep] - self.first
        end = self.last + s.length
        digest = s.digests(self.first, end)
        # The place of the strings about the anchor is part of the extent.
        self.extent, self.check = mix(digest[:, 0] + (self.last - self.first).astype(U)), digest[:, 1]
        deal = np.where(self.hot, mix(self.anchor ^ self.extent), self.anchor)
        order = np.lexsort((self.first, self.check, self.extent, deal))
        new = changes(deal[order], self.extent[order], self.check[order])
        self.begin = order[new]  # the first segment of each distinct extent
        self.deal = deal[self.begin]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.several = np.bincount(self.number, minlength=len(self.begin)) > 1

    def settled(self, replies: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
        """Of each segment: its extent stands elsewhere. Of each distinct extent: its strings are to be compared."""
        state = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(r["reply"]), np.uint8, r["n"]) for r in replies]) if replies else np.zeros(len(self.begin), np.uint8)
        return ((state & 1 > 0) | self.several)[self.number], state & 2 > 0


def _extent_run(deal: np.ndarray, extent: np.ndarray, check: np.ndarray, hot: np.ndarray) -> bytes:
    head = R.pack_sorted(deal)
    return np.int64(len(head)).tobytes() + head + extent.tobytes() + check.tobytes() + hot.astype(np.uint8).tobytes()


def _merge_extents(parts: list[tuple[int, int, bytes]]) -> list[bytes]:
    """Per extent of each run, 1: it stands in another run; 2: its anchor has other extents, and this is the run that stands for it."""
    deals, extents, checks, hots = [], [], [], []
    for _, n, r in parts:
        head = int(np.frombuffer(r, np.int64, 1)[0])
        deals.append(R.unpack_sorted(r[8 : 8 + head], n))
        extents.append(np.frombuffer(r, U, n, 8 + head))
        checks.append(np.frombuffer(r, U, n, 8 + head + 8 * n))
        hots.append(np.frombuffer(r, np.uint8, n, 8 + head + 16 * n))
    deal, extent, check, hot = map(np.concatenate, (deals, extents, checks, hots))
    run = np.repeat(np.arange(len(parts)), [n for _, n, _ in parts])
    order = np.lexsort((run, check, extent, deal))
    new_deal = changes(deal[order])
    new = changes(deal[order], extent[order], check[order])
    number = np.cumsum(new) - 1
    size = np.bincount(number)
    kinds = np.bincount(np.cumsum(new_deal) - 1, weights=new)[np.cumsum(new_deal) - 1]
    state = np.empty(len(order), np.uint8)
    state[order] = (size[number] > 1) + 2 * (new & ((kinds > 1) | (hot[order] > 0)))
    out, at = [], 0
    for _, n, _ in parts:
        out.append(zstandard.ZstdCompressor(level=1).compress(state[at : at + n].tobytes()))
        at += n
    return out


class _Ends:
    """The strings of the extents to be compared: those of cold anchors, in run order, and those of hot ones."""

    def __init__(self, s: _Suffixes, x: _Extents, replies: list[dict] | None) -> None:
        self.whole, compare = x.settled(replies)
        hot = x.hot[x.begin]
        self.cold = x.begin[compare & ~hot]
        self.windows = x.last[self.cold] - x.first[self.cold] + 1
        self.cold_at = spread(x.first[self.cold], self.windows)
        send = x.begin[compare & hot]
        self.at = spread(x.first[send], x.last[send] - x.first[send] + 1)
        digest = s.digests(self.at, self.at + s.length)
        self.hash, self.check = digest[:, 0], digest[:, 1]
        order = np.lexsort((self.check, self.hash))
        new = changes(self.hash[order], self.check[order])
        self.begin = order[new]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.several = np.bincount(self.number, minlength=len(self.begin)) > 1

    def repeated(self, replies: list[dict] | None) -> np.ndarray:
        """The first bytes of the strings that stand elsewhere too."""
        known = R.flags(replies)
        cold, hot = known[: len(self.cold_at)], known[len(self.cold_at) :]
        return np.concatenate([self.cold_at[cold], self.at[(hot | self.several)[self.number]]])


class SuffixOrder:
    """Suffixes of ``data``, cut to ``length`` bytes, in lexicographic order within groups."""

    def __init__(self, data: np.ndarray, length: int, base: int) -> None:
        self.data, self.length = data, length
        self.hashes = Rolling(data.astype(U) + U(1), base)

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at ``p`` and ``q`` share, by binary search over prefix hashes."""
        low, high = np.zeros(len(p), np.int64), np.full(len(p), self.length)
        for _ in range(self.length.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes.agree(p, q, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The suffix at ``p`` sorts before the one at ``q``."""
        at = self.common(p, q)
        differ = at < self.length
        at = np.minimum(at, self.length - 1)
        return differ & (self.data[p + at] < self.data[q + at])

    def sort(self, at: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mergesort of the suffixes ``at`` within groups, all groups at once; suffixes that agree keep their order.

        In each round every suffix finds its place in the run that its own is merged with, by binary search.
        """
        at, width = at.copy(), 1
        while len(size) and width < size.max():
            groups = np.flatnonzero(size > width)
            where = spread(begin[groups], size[groups])
            first = np.repeat(begin[groups], size[groups])
            end = first + np.repeat(size[groups], size[groups])
            run = (where - first) // width
            left = run % 2 == 0
            pair = first + (run // 2) * 2 * width
            middle = np.minimum(pair + width, end)
            low = np.where(left, middle, pair)
            high = np.where(left, np.minimum(pair + 2 * width, end), middle)
            start, own = low.copy(), at[where]
            for _ in range(width.bit_length()):
                active = np.flatnonzero(low < high)
                if not len(active):
                    break
                probe = (low[active] + high[active]) >> 1
                mine, other, is_left = own[active], at[probe], left[active]
                # Of the run merged with, a left suffix passes what sorts before it, a right one all it doesn't sort before.
                smaller = self.before(np.where(is_left, other, mine), np.where(is_left, mine, other))
                passes = smaller == is_left
                low[active] = np.where(passes, probe + 1, low[active])
                high[active] = np.where(passes, high[active], probe)
            place = np.where(left, where + (low - start), where - (middle - pair) + (low - start))
            at[place] = own
            width *= 2
        return at

    def copies(self, at: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which of the sorted suffixes agree with a neighbour of their group for the whole length, byte by byte."""
        out = np.zeros(len(at), bool)
        inner = np.ones(len(at), bool)
        inner[begin] = False
        right = np.flatnonzero(inner)
        right = right[self.common(at[right - 1], at[right]) == self.length]
        if len(right):
            rows = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
            for k in range(0, len(right), 4096):
                part = right[k : k + 4096]
                same = (rows[at[part - 1]] == rows[at[part]]).all(axis=1)
                out[part[same]] = out[part[same] - 1] = True
        return out


def _end_run(anchor: np.ndarray, distance: np.ndarray, windows: np.ndarray, texts: list[bytes]) -> bytes:
    head = R.pack_sorted(anchor)
    rest = zstandard.ZstdCompressor(level=2).compress(distance.astype(np.uint32).tobytes() + windows.astype(np.uint32).tobytes() + b"".join(texts))
    return np.array([len(anchor), len(head)], np.int64).tobytes() + head + rest


def _merge_ends(length: int, base: int):
    def merge(parts: list[tuple[int, int, bytes]]) -> list[bytes]:
        """A bit for each string of each run: it stands in another extent too."""
        anchors, distances, counts, texts = [], [], [], []
        for _, _, r in parts:
            n, head = map(int, np.frombuffer(r, np.int64, 2))
            anchors.append(R.unpack_sorted(r[16 : 16 + head], n))
            rest = zstandard.ZstdDecompressor().decompress(r[16 + head :])
            distances.append(np.frombuffer(rest, np.uint32, n))
            counts.append(np.frombuffer(rest, np.uint32, n, 4 * n))
            texts.append(rest[8 * n :])
        windows = np.concatenate(counts).astype(np.int64)
        size = windows + length - 1
        first = np.cumsum(size) - size
        order = SuffixOrder(np.frombuffer(b"".join(texts), np.uint8), length, base)
        at = spread(first, windows)
        of = np.repeat(np.arange(len(windows)), windows)
        distance = np.concatenate(distances)[of].astype(np.int64) - (at - first[of])
        anchor = np.concatenate(anchors)[of]
        grouped = np.lexsort((distance, anchor))
        new = np.ones(len(grouped), bool)
        new[1:] = (anchor[grouped][1:] != anchor[grouped][:-1]) | (distance[grouped][1:] != distance[grouped][:-1])
        begin = np.flatnonzero(new)
        members = np.diff(np.append(begin, len(grouped)))
        ordered = order.sort(at[grouped], begin, members)
        flag = np.zeros(len(order.data), bool)
        flag[ordered] = order.copies(ordered, begin, members)
        found, k, out = flag[at], 0, []
        for _, n, _ in parts:
            out.append(np.packbits(found[k : k + n]).tobytes())
            k += n
        return out

    return merge


def _string_run(h: np.ndarray, check: np.ndarray) -> bytes:
    head = R.pack_sorted(h)
    return np.int64(len(head)).tobytes() + head + check.tobytes()


def _merge_strings(parts: list[tuple[int, int, bytes]]) -> list[bytes]:
    hashes, checks = [], []
    for _, n, r in parts:
        head = int(np.frombuffer(r, np.int64, 1)[0])
        hashes.append(R.unpack_sorted(r[8 : 8 + head], n))
        checks.append(np.frombuffer(r, U, n, 8 + head))
    h, check = np.concatenate(hashes), np.concatenate(checks)
    order = np.lexsort((check, h))
    same = (h[order][1:] == h[order][:-1]) & (check[order][1:] == check[order][:-1])
    flag = np.zeros(len(h), bool)
    flag[order[1:]] |= same
    flag[order[:-1]] |= same
    out, at = [], 0
    for _, n, _ in parts:
        out.append(np.packbits(flag[at : at + n]).tobytes())
        at += n
    return out


class SuffixDedup:
    """``dedup(docs)`` finds and removes repeated ``length``-byte strings; see the module."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        if not 1 <= gram <= length:
            raise ValueError("gram must lie between 1 and length")
        self.length, self.gram = length, gram

    def annotate(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
        """Blocks with the answers of all three merges."""
        spark = docs.sparkSession
        prepare(spark)
        blocks = durable(pack(docs, id_col, text_col, carry))
        length, gram = self.length, self.gram
        stored = blocks.select(F.coalesce(F.sum(F.length("payload")), F.lit(0))).first()[0]
        bits = R.bucket_bits(3 * stored / 20, shuffle_partitions(spark))

        def anchors(block, row):
            return R.filter_runs(_Suffixes(block, length, gram).segments.hash, bits, ANCHOR_BITS)

        def extents(block, row):
            x = _Extents(_Suffixes(block, length, gram), row["a"])
            for bucket, a, b in R.cuts(x.deal, bits):
                first = x.begin[a:b]
                yield bucket, b - a, _extent_run(x.deal[a:b], x.extent[first], x.check[first], x.hot[first])

        def ends(block, row):
            s = _Suffixes(block, length, gram)
            x = _Extents(s, row["a"])
            t = _Ends(s, x, row["b"])
            for bucket, a, b in R.cuts(x.anchor[t.cold], bits):
                e = t.cold[a:b]
                texts = [bytes(block.data[i:j]) for i, j in zip(x.first[e].tolist(), (x.last[e] + length).tolist(), strict=True)]
                yield bucket, int(t.windows[a:b].sum()), _end_run(x.anchor[e], x.distance[e], t.windows[a:b], texts)
            h, check = t.hash[t.begin], t.check[t.begin]
            for bucket, a, b in R.cuts(h, bits):
                # Strings of hot anchors have buckets of their own, after the others.
                yield (1 << bits) + bucket, b - a, _string_run(h[a:b], check[a:b])

        by_text, by_hash = _merge_ends(length, draw_bases().byte), _merge_strings

        def merge_ends(parts):
            return (by_hash if parts[0][2][:1] == b"H" else by_text)([(i, n, r[1:]) for i, n, r in parts])

        def tagged(block, row):
            return ((b, n, (b"H" if b >> bits else b"T") + r) for b, n, r in ends(block, row))

        a = R.with_replies(blocks, R.exchange(blocks, anchors, R.merge_repeated(HOT_RUNS)), "a")
        b = R.with_replies(a, R.exchange(a, extents, _merge_extents), "b")
        return R.with_replies(b, R.exchange(b, tagged, merge_ends), "c")

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256; kept_text (null where the text is) and the columns ``carry`` if ``with_text``."""
        length, gram = self.length, self.gram

        def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, row in blocks_of(batches):
                s = _Suffixes(block, length, gram)
                x = _Extents(s, row["a"])
                t = _Ends(s, x, row["b"])
                again = t.repeated(row["c"])
                begin, stop = np.append(x.first[t.whole], again), np.append(x.last[t.whole], again) + length
                gone = covered(s.n, begin, stop) if s.n else np.zeros(0, bool)
                data = block.bytes
                n_removed, n_spans, digests, texts = [], [], [], []
                for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
                    g = gone[a:b]
                    kept = (data[a:b][~g] if g.any() else data[a:b]).tobytes()
                    n_removed.append(int(g.sum()))
                    n_spans.append(int(np.count_nonzero(g[1:] & ~g[:-1])) + int(b > a and g[0]))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept.decode("utf-8", "ignore") if block.lengths[len(texts)] >= 0 else None)
                cols = [pa.array(block.ids(), pa.int64()), pa.array(np.maximum(block.lengths, 0), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    cols, names = [*cols, pa.array(texts, pa.string()), pa.array([r.decode() for r in block.rest])], [*names, "kept_text", "rest"]
                yield pa.record_batch(cols, names)

        result = self.annotate(docs, id_col, text_col, carry).mapInArrow(render, RESULT_SCHEMA + (", kept_text string, rest string" if with_text else ""))
        return with_carried(result, docs, carry) if with_text else result
