"""Embeddings: a function from texts to vectors, applied in batches; a hash embedder that needs no model."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from corpusloom.session import prepare
from corpusloom.sources.transport import post

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]
DIMENSION = 128
# Weight and salt of the three places that a token takes.
PLACES = ((1.0, ""), (0.5, "secondary:"), (0.25, "tertiary:"))
_TOKEN = re.compile(r"[A-Za-z0-9_]+")


def hash_vector(text: str, dimension: int = DIMENSION) -> list[float]:
    """A unit vector of signed token hashes; zero if the text has no token."""
    v = [0.0] * dimension
    for token in _TOKEN.findall(text):
        for weight, salt in PLACES:
            d = hashlib.blake2b((salt + token.lower()).encode(), digest_size=16).digest()
            v[int.from_bytes(d[:4], "big") % dimension] += -weight if d[4] & 1 else weight
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v


def hash_embed(texts: Sequence[str]) -> list[list[float]]:
    return [hash_vector(t) for t in texts]


def with_embeddings(rows: DataFrame, text_col: str, embed: Embed = hash_embed, out: str = "embedding", batch: int = 64) -> DataFrame:
    """``rows`` with the vector of ``text_col``; texts go to ``embed`` in batches, in order, and as many vectors must come back."""
    prepare(rows.sparkSession)
    rows = rows.drop(out)
    place = rows.columns.index(text_col)
    schema = StructType([*rows.schema.fields, StructField(out, ArrayType(FloatType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(place).to_pylist()]
            vectors: list[Sequence[float]] = []
            for at in range(0, len(texts), batch):
                part = embed(texts[at : at + batch])
                if len(part) != len(texts[at : at + batch]):
                    raise ValueError(f"{len(part)} vectors for {len(texts[at : at + batch])} texts")
                vectors += part
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.field("element", pa.float32(), False)))], names=[*b.schema.names, out])

    return rows.mapInArrow(run, schema)


def embedding_request(texts: Sequence[str], model: str) -> str:
    """The body of a request to an embeddings endpoint: one text as a string, several as a list."""
    return json.dumps({"model": model, "encoding_format": "float", "input": texts[0] if len(texts) == 1 else list(texts)})


def parse_embeddings(body: str, expected: int) -> list[list[float]]:
    """The vectors of an endpoint's answer, by index; a single text may be answered by a bare ``embedding``."""
    payload = json.loads(body)
    if expected == 1 and isinstance(payload.get("embedding"), list):
        return [payload["embedding"]]
    rows = payload.get("data") or []
    if len(rows) != expected:
        raise ValueError(f"{len(rows)} vectors for {expected} texts")
    return [r["embedding"] for _, r in sorted(enumerate(rows), key=lambda x: (x[1].get("index", x[0]), x[0]))]


class EndpointEmbed:
    """An ``Embed`` that posts to an embeddings endpoint through ``send`` (body to status and answer).

    Failures of transport, 429 and 5xx are tried again; as many vectors of one dimension must come back as texts were sent. No text makes no
    request. ``dimension``: checked if given.
    """

    def __init__(self, send: Callable[[str], tuple[int, str]], model: str, dimension: int | None = None, retries: int = 3, first_wait: float = 0.25, longest_wait: float = 4.0, sleep: Callable[[float], None] = time.sleep) -> None:
        self.send, self.model, self.dimension, self.retries = send, model, dimension, retries
        self.first_wait, self.longest_wait, self.sleep = first_wait, longest_wait, sleep

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        answer = post(self.send, embedding_request(texts, self.model), "embedding", self.retries, self.first_wait, self.longest_wait, self.sleep)
        vectors = parse_embeddings(answer, len(texts))
        wanted = self.dimension or len(vectors[0])
        if any(len(v) != wanted for v in vectors):
            raise ValueError(f"vectors of {sorted({len(v) for v in vectors})} dimensions where {wanted} were expected")
        return vectors
