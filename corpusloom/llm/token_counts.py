"""Token counts with a whole-token shortcut.

A text's count is the sum over its pre-tokens of the tokens that byte-pair merges leave of each. Which strings of
the vocabulary encode alone as one token is proved once, on the driver, by encoding each: a pre-token among
them counts 1 without merging. Other pre-tokens are merged by the library once and remembered.

The shortcut reads the tokenizer's own normalisation and splitting for characters up to U+024F. A text
with another character, a control character, or a string of an added token is counted by the library as a
whole, so that all counts are the library's.

Defined cases: null text counts as empty: 0 bytes, 0 tokens. Rows that share an id are texts of their own.
Texts are counted whole, whatever their length. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import tidied
from corpusloom.session import prepare

LIMIT = 2048
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 500_000
RESULT_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_TOP = 0x250


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_TOP) if unicodedata.category(chr(c))[0] == kind)


_L, _N = _class("L"), _class("N")
_PRE_TOKEN = re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^\\s{_L}{_N}]+")
_ASCII_PRE_TOKEN = re.compile("[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\sa-z0-9]+")
#: What the shortcut leaves to the library.
_UNUSUAL = re.compile("[^\t\n\r -~\xa0-ɏ]")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def library_count(tokenizer, text: str) -> int:
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


def prove_whole_tokens(path: str) -> frozenset[str]:
    """The strings of the vocabulary that, as a pre-token of their own, encode as exactly one token."""
    tokenizer, letters = load(path), byte_letters()
    model = json.loads(tokenizer.to_str())["model"]
    suffix = model.get("end_of_word_suffix") or ""
    words = []
    for token in model["vocab"]:
        if not token.endswith(suffix):
            continue
        try:
            text = bytes(letters[c] for c in token[: len(token) - len(suffix)]).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if text and not _UNUSUAL.search(text) and _PRE_TOKEN.fullmatch(text):
            words.append(text)
    encoded = tokenizer.encode_batch(words, add_special_tokens=False)
    return frozenset(w for w, e in zip(words, encoded, strict=True) if len(e.ids) == 1)


class Counting:
    """Counts tokens of texts in one worker."""

    def __init__(self, path: str, whole: frozenset[str]) -> None:
        self.tokenizer, self.whole = load(path), whole
        self.known = dict.fromkeys(whole, 1)
        added = json.loads(self.tokenizer.to_str())["added_tokens"]
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; what isn't known yet is merged together, about a megabyte of text at a time."""
        out: list[int] = []
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (size < 1 << 20 or stop == at):
                size += len(texts[stop])
                stop += 1
            out += self._counts(texts[at:stop])
            at = stop
        return out

    def _counts(self, texts: list[str]) -> list[int]:
        parts = [self._pre_tokens(t) for t in texts]
        if len(self.known) > REMEMBERED + len(self.whole):
            self.known = dict.fromkeys(self.whole, 1)
        missing: set[str] = set()
        for p in parts:
            if isinstance(p, list):
                missing.update(set(p).difference(self.known))
        self._merge(sorted(missing))
        get = self.known.__getitem__
        return [sum(map(get, p)) if isinstance(p, list) else p for p in parts]

    def _pre_tokens(self, text: str) -> list[str] | int:
        """The text's pre-tokens, or the library's count where the shortcut doesn't hold."""
        if _UNUSUAL.search(text) or (self.added and self.added.search(text)):
            return library_count(self.tokenizer, text)
        if text.isascii():
            return _ASCII_PRE_TOKEN.findall(text.lower())
        usual = unicodedata.normalize("NFC", text).lower()
        # The lower case of U+0130 is a letter and a mark.
        return library_count(self.tokenizer, text) if _UNUSUAL.search(usual) else _PRE_TOKEN.findall(usual)

    def _merge(self, tokens: list[str]) -> None:
        """Count the merged tokens of pre-tokens, each a word of one text."""
        for at in range(0, len(tokens), 2000):
            part = tokens[at : at + 2000]
            found = Counter(self.tokenizer.encode(" ".join(part), add_special_tokens=False).word_ids)
            self.known.update((t, found[i]) for i, t in enumerate(part))


_counting: dict[str, Counting] = {}


class TokenCounts:
    """``count(docs)`` with the tokenizer at ``path``, one of the .json kind that lower-cases and ends words."""

    def __init__(self, path: str, limit: int = LIMIT) -> None:
        self.path, self.limit = path, limit

    def count(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_bytes, n_tokens, over_limit; one row per row of ``docs``."""
        prepare(docs.sparkSession)
        path, limit = self.path, self.limit
        whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if path not in _counting:
                _counting[path] = Counting(path, whole.value)
            counting = _counting[path]
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                tokens = counting.counts(texts)
                yield pa.record_batch([batch.column(0), pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), RESULT_SCHEMA)
