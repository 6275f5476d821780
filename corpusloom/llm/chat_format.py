"""Chat formatting by token-level assembly.

Every segment of a turn (role, text) is encoded on its own as ordinary text; reserved ids are spliced
between them, so no text can ever produce one: ``<start> role <sep> text <end>`` per turn. The loss mask comes
from prefix sums over the segments' lengths: +1 where an assistant's text begins, -1 where it ends.

So that the decoded string is unambiguous as well, control strings inside texts are escaped: ``<`` and ``|``
with any backslashes between get one more. ``unescape`` takes it away; the two are inverse to one another.

Turns are encoded where they lie; then they are dealt out by conversation, sorted by turn, and assembled as a
stream, one conversation in memory at a time.

Defined cases: null role and null text are empty strings. A null turn comes first; turns of one number go by
role, then text. Rows with a null conv_id are one conversation. Empty texts give empty segments. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import prepare

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"
FORMAT_SCHEMA = "conv_id long, n_turns long, token_ids array<int>, loss_mask array<tinyint>"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


class Codec:
    """An ordinary encoding with three reserved ids after its own."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        top = max(ranks.values()) + 1
        self.start, self.sep, self.end = top, top + 1, top + 2
        self.reserved = {self.start: START, self.sep: SEP, self.end: END}

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8")

    def decode_all(self, ids: list[int]) -> str:
        """The formatted string, reserved ids as control strings."""
        out, run = [], []
        for i in ids:
            if i in self.reserved:
                out += [self.decode(run), self.reserved[i]]
                run = []
            else:
                run.append(i)
        return "".join([*out, self.decode(run)])

    def read_back(self, ids: list[int], mask: list[int]) -> tuple[list[tuple[str, str]], str]:
        """The turns (role, text) of a formatted conversation, and the text under its loss mask, all unescaped."""
        turns, loss = [], []
        at = 0
        while at < len(ids):
            if ids[at] != self.start:
                raise ValueError("a turn must begin with the start id")
            sep = ids.index(self.sep, at)
            end = ids.index(self.end, sep)
            turns.append((unescape(self.decode(ids[at + 1 : sep])), unescape(self.decode(ids[sep + 1 : end]))))
            under = [i for i, m in zip(ids[sep + 1 : end], mask[sep + 1 : end], strict=True) if m]
            loss.append(unescape(self.decode(under)))
            at = end + 1
        return turns, "".join(loss)


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def assemble(turns: list[tuple[list[int], list[int], bool]], codec: Codec) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and loss mask of encoded (role, text, counts for the loss) turns."""
    lengths = np.array([[1, len(r), 1, len(t), 1] for r, t, _ in turns], np.int64).reshape(-1)
    offset = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.empty(offset[-1], np.int32)
    step = np.zeros(offset[-1] + 1, np.int8)
    for k, (role, text, loss) in enumerate(turns):
        a, b, c, d, e = offset[5 * k : 5 * k + 5]
        ids[a], ids[c], ids[e] = codec.start, codec.sep, codec.end
        ids[b:c], ids[d:e] = role, text
        if loss and e > d:
            step[d] += 1
            step[e] -= 1
    return ids, np.cumsum(step[:-1], dtype=np.int8)


class ChatFormat:
    """``format`` conversations to token ids and loss masks; ``read_back`` them to digests."""

    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern = path, pattern

    def format(self, rows: DataFrame) -> DataFrame:
        """conv_id, n_turns, token_ids, loss_mask of rows (conv_id, turn, role, text)."""
        prepare(rows.sparkSession)
        path, pattern = self.path, self.pattern

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(path, pattern)
            for batch in batches:
                roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
                yield pa.record_batch([batch.column("conv_id"), batch.column("turn"), batch.column("role"), batch.column("text"), pa.array([codec.encode(escape(r)) for r in roles], pa.list_(pa.int32())), pa.array([codec.encode(escape(t)) for t in texts], pa.list_(pa.int32()))], ["conv_id", "turn", "role", "text", "role_ids", "text_ids"])

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(path, pattern)

            def row(conv, turns):
                ids, mask = assemble(turns, codec)
                return pa.record_batch([pa.array([conv], pa.int64()), pa.array([len(turns)], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.int8()))], ["conv_id", "n_turns", "token_ids", "loss_mask"])

            conv, turns = None, []
            done: list[pa.RecordBatch] = []
            for batch in batches:
                for c, role, r, t in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("role_ids").to_pylist(), batch.column("text_ids").to_pylist(), strict=True):
                    if turns and c != conv:
                        done.append(row(conv, turns))
                        turns = []
                        if len(done) >= 500:
                            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                            done = []
                    conv = c
                    turns.append((r, t, role == LOSS_ROLE))
            if turns:
                done.append(row(conv, turns))
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()

        clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        encoded = clean.mapInArrow(encode, "conv_id long, turn long, role string, text string, role_ids array<int>, text_ids array<int>")
        # The text itself only breaks ties between turns of one number; a hash of it does, and is short.
        keyed = encoded.select("conv_id", "turn", "role", F.sha2("text", 256).alias("tie"), "role_ids", "text_ids")
        return keyed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie").select("conv_id", "role", "role_ids", "text_ids").mapInArrow(join, FORMAT_SCHEMA)

    def read_back(self, formatted: DataFrame) -> DataFrame:
        """Digests of what the formatted conversations hold, decoded from their ids and masks."""
        path, pattern = self.path, self.pattern

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(path, pattern)
            for batch in batches:
                out = []
                for ids, mask in zip(batch.column("token_ids").to_pylist(), batch.column("loss_mask").to_pylist(), strict=True):
                    turns, loss = codec.read_back(ids, mask)
                    digest = hashlib.sha256()
                    for role, text in turns:
                        digest.update(f"{role}\n{text}\n".encode())
                    out.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(codec.decode_all(ids)), len(ids), sum(mask)))
                cols = list(zip(*out, strict=True)) if out else [[]] * 7
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"])

        return formatted.mapInArrow(read, DIGEST_SCHEMA)
