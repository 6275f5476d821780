"""Language identification by cross-parsing entropy.

Each language's labelled sample becomes a suffix automaton. A text is parsed greedily into the longest
phrases that occur in the sample: the fewer phrases, the closer the language. Phrases are normalised by
the bits that point into the sample (log2 of its length); the language that needs fewest wins.

The automaton is a table of state by character, in which a missing transition already leads to the state
of a new phrase and carries a mark; so a parse is one table lookup per character, made for thousands of
pieces of text at once. Pieces are parsed side by side as if each began a phrase; where the piece before ends within one,
the parse is repeated from the state it ends in until both parses stand in one state, as all that follows is then the same. So
the phrases are those of the whole text, wherever it is cut.

Every character of a sample has a code of its own, and each language columns for its own characters only. Where states by
columns would pass ``DENSE_CELLS``, as in scripts of thousands of characters, the rows of the table are laid over one another
in one array, each cell with the state that it belongs to; both forms give the same phrases.

Training reads a bounded sample: ``sample_docs`` labelled texts a language (those of the smallest hash), the first
``sample_chars`` characters of each. Prediction sees the text only.

Defined cases: null text and text without a letter (Unicode category L) give ``und`` and score 0; so does every text if nothing is
labelled. The score is 1 - best / second best, 1 if one language is known. Ties go to the first language
by name. Rows that repeat get the same answer. Other columns are ignored by ``predict`` and kept by ``annotate``. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from corpusloom.llm.blocks import tidied
from corpusloom.session import prepare

SAMPLE_DOCS, SAMPLE_CHARS = 64, 400
#: Cells (four bytes each) of a table that is kept with a place for every state and character.
DENSE_CELLS = 1 << 24
PIECE = 256
PIECES_AT_ONCE = 1 << 13
_LETTER = regex.compile(r"\p{L}")


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        current = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in following[p]:
            following[p][c] = current
            p = link[p]
        if p != -1:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[current] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[current] = clone
        last = current
    return following


class _Dense:
    """Transitions with a place for every state and column; a state is the place where its row begins.

    ``next`` gives the state that follows, negative (bit 31) where a new phrase begins; the last two columns are
    for characters that the sample lacks and for padding, which changes nothing.
    """

    def __init__(self, states: list[dict[int, int]], columns: int) -> None:
        width = columns + 2
        table = np.full((len(states), width), -1, np.int64)
        for s, following in enumerate(states):
            table[s, list(following)] = list(following.values())
        start = np.maximum(table[0], 0)  # a character that the sample lacks is a phrase of its own
        fresh = np.broadcast_to(start * width, table.shape)
        out = np.where(table >= 0, table * width, fresh | (1 << 31))
        out[:, -1] = np.arange(len(states)) * width
        self.flat = (out & 0xFFFFFFFF).astype(np.uint32).view(np.int32).reshape(-1)

    def next(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        return self.flat[state + column]


class _Sparse:
    """The same transitions with the rows laid over one another: a cell counts for the state that owns it."""

    TRIES = 64

    def __init__(self, states: list[dict[int, int]], columns: int) -> None:
        width = columns + 2
        self.pad = columns + 1
        cells = 4 * sum(map(len, states)) + 1
        owner, target = [-1] * (cells + width), [0] * (cells + width)
        base = [0] * len(states)
        for s in sorted(range(len(states)), key=lambda s: (-len(states[s]), s)):
            for attempt in range(self.TRIES):
                at = (s * 2654435761 + attempt * 40503) % cells
                if all(owner[at + c] < 0 for c in states[s]):
                    break
            else:
                at = len(owner)
                owner.extend([-1] * width)
                target.extend([0] * width)
            base[s] = at
            for c, t in states[s].items():
                owner[at + c], target[at + c] = s, t
        self.base, self.owner, self.target = (np.array(x, np.int32) for x in (base, owner, target))
        start = np.array([states[0].get(c, 0) for c in range(width)], np.uint32)
        self.start = (start | np.uint32(1 << 31)).view(np.int32)

    def next(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        cell = self.base[state] + column
        to = np.where(self.owner[cell] == state, self.target[cell], self.start[column])
        return np.where(column == self.pad, state, to)


class CrossParser:
    """A parser for each language of ``samples`` (language to text)."""

    def __init__(self, samples: dict[str, str], dense_cells: int = DENSE_CELLS) -> None:
        self.languages = sorted(samples)
        texts = {k: self.normal(samples[k]) for k in self.languages}
        found = sorted(set("".join(texts.values())))
        # Codes: the samples' characters, one for all that no sample holds, padding.
        self.other, self.pad = len(found), len(found) + 1
        self.code = np.full(0x110000, self.other, np.int32)
        for i, c in enumerate(found):
            self.code[ord(c)] = i
        self.columns, self.tables = zip(*(self._table(self.codes(texts[k]), dense_cells) for k in self.languages), strict=True) if samples else ((), ())
        self.bits = np.array([math.log2(max(len(texts[k]), 4096)) for k in self.languages])

    @staticmethod
    def normal(text: str) -> str:
        return _NOT_WORD.sub(" ", text.lower())

    def codes(self, normal: str) -> np.ndarray:
        return self.code[np.frombuffer(normal.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _table(self, codes: np.ndarray, dense_cells: int) -> tuple[np.ndarray, _Dense | _Sparse]:
        """The column of each code in this language's table, and the table."""
        own, columns = np.unique(codes, return_inverse=True)
        column = np.full(self.pad + 1, len(own), np.int32)
        column[own] = np.arange(len(own))
        column[self.pad] = len(own) + 1
        states = suffix_automaton(columns.tolist())
        kind = _Dense if len(states) * (len(own) + 2) <= dense_cells else _Sparse
        return column, kind(states, len(own))

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each text needs in each language."""
        arrays = [self.codes(self.normal(t)) for t in texts]
        pieces = np.array([-(-len(a) // PIECE) for a in arrays], np.int64)
        of = np.repeat(np.arange(len(texts)), pieces)
        flat = np.full(int(pieces.sum()) * PIECE, self.pad, np.int32)
        begin = (np.cumsum(pieces) - pieces) * PIECE
        for a, b in zip(arrays, begin.tolist(), strict=True):
            flat[b : b + len(a)] = a
        rows = flat.reshape(-1, PIECE)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        goes_on = np.ones(len(rows), bool)
        goes_on[(np.cumsum(pieces) - pieces)[pieces > 0]] = False
        for k, (column, table) in enumerate(zip(self.columns, self.tables, strict=True)):
            count, end = np.empty(len(rows), np.int64), np.empty(len(rows), np.int32)
            for at in range(0, len(rows), PIECES_AT_ONCE):
                part = column[rows[at : at + PIECES_AT_ONCE].T]
                count[at : at + part.shape[1]], end[at : at + part.shape[1]] = _parse(table, part)
            self._carry(column, table, rows, goes_on, count, end)
            np.add.at(out[:, k], of, count)
        return out

    @staticmethod
    def _carry(column: np.ndarray, table: _Dense | _Sparse, rows: np.ndarray, goes_on: np.ndarray, count: np.ndarray, end: np.ndarray) -> None:
        """Correct the pieces' phrases and end states: a piece goes on in the state that the one before ends in."""
        entered = np.zeros(len(rows), np.int32)
        count[goes_on] -= 1  # its first phrase began before, unless the parse says otherwise
        todo = np.flatnonzero(goes_on)
        while len(todo):
            now = end[todo - 1]
            moved = now != entered[todo]
            todo, now = todo[moved], now[moved]
            was, old, new = todo, entered[todo].copy(), now.copy()
            entered[todo] = now
            changed = []
            for step in range(rows.shape[1]):
                if not len(was):
                    break
                c = column[rows[was, step]]
                old, new = table.next(old, c), table.next(new, c)
                count[was] += (new < 0).astype(np.int64) - (old < 0)
                old &= 0x7FFFFFFF
                new &= 0x7FFFFFFF
                apart = old != new
                was, old, new = was[apart], old[apart], new[apart]
            end[was] = new
            changed = was + 1
            changed = changed[changed < len(rows)]
            todo = changed[goes_on[changed]]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        result: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        which = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not which or not self.languages:
            return result
        cost = self.phrases([texts[i] for i in which]) * self.bits
        best = cost.argmin(axis=1)
        least = np.partition(cost, min(1, cost.shape[1] - 1), axis=1)
        score = 1 - least[:, 0] / least[:, 1] if cost.shape[1] > 1 else np.ones(len(which))
        for i, b, s in zip(which, best.tolist(), score.tolist(), strict=True):
            result[i] = (self.languages[b], float(s))
        return result


def _parse(table: _Dense | _Sparse, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases and end states of the columns of ``part``, each from the start."""
    state = np.zeros(part.shape[1], np.int32)
    count = np.ones(part.shape[1], np.int64)
    for step in part:
        state = table.next(state, step)
        count += state < 0
        state &= 0x7FFFFFFF
    return count, state


_NOT_WORD = re.compile(r"[\W\d_]+")
_parsers: dict[int, CrossParser] = {}


def _parser(samples: dict[str, str]) -> CrossParser:
    """This worker's parser for the samples, built once."""
    key = hash(tuple(sorted(samples.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(samples)
    return _parsers[key]


class LanguageId:
    """``fit`` on labelled texts, then ``predict`` or ``annotate``."""

    def __init__(self, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> None:
        self.sample_docs, self.sample_chars = sample_docs, sample_chars
        self.samples: dict[str, str] = {}

    def fit(self, labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageId:
        """Takes a bounded sample of each language's texts; rows with a null in either column don't count."""
        rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.substring(F.col(text_col), 1, self.sample_chars).alias("part"), F.xxhash64(text_col).alias("h")).where("lang is not null and part is not null and part rlike '\\\\p{L}'")
        first = Window.partitionBy("lang").orderBy("h", "part")
        chosen = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= self.sample_docs).orderBy("lang", "n").collect()
        self.samples = {}
        for r in chosen:
            self.samples[r["lang"]] = self.samples.get(r["lang"], "") + " " + r["part"]
        return self

    def annotate(self, docs: DataFrame, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
        """``docs`` with the language and its score; columns of these ``names`` are replaced."""
        prepare(docs.sparkSession)
        docs = docs.drop(*names)
        samples = self.samples
        schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
        place = docs.columns.index(text_col)

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    found = _parser(samples).predict(part.column(place).to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*part.schema.names, *names])

        return docs.mapInArrow(tidied(predict), schema)

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
        """The id, columns of ``keep``, lang_pred, score."""
        annotated = self.annotate(docs.select(F.col(id_col), *(keep or []), F.col(text_col)), text_col)
        return annotated.drop(text_col)


def held_out(doc_id: str = "doc_id"):
    """The fold that training leaves out: crc32 of doc_id as text, modulo 4, is 2. A null id isn't in it and never trains."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
