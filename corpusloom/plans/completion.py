"""Calls of a chat endpoint: bodies, retries, streams."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.session import prepare
from corpusloom.sources.transport import Send, post

# Names under which one backend answers.
MODEL_ALIASES = ("fast", "balanced", "deep", "moe")


def request_body(messages: Sequence[dict[str, str]], model: str, stream: bool = False, **options: Any) -> str:
    """The request as JSON; options that are None are left out."""
    allowed = ("temperature", "max_tokens", "top_p")
    return json.dumps({"model": model, "messages": list(messages), "stream": stream, **{k: options[k] for k in allowed if options.get(k) is not None}})


def content_of(payload: dict[str, Any]) -> str | None:
    """The text of a completion, or of a chunk of one."""
    choice = (payload.get("choices") or [{}])[0]
    for part in ("delta", "message"):
        if isinstance(choice.get(part), dict) and choice[part].get("content") is not None:
            return choice[part]["content"]
    return choice.get("text")


def stream_chunks(body: str) -> Iterator[str]:
    """The texts of a server-sent stream's events, up to ``[DONE]``."""
    for event in body.replace("\r\n", "\n").split("\n\n"):
        data = "\n".join(s[5:].lstrip() for s in event.split("\n") if s.startswith("data:"))
        if data == "[DONE]":
            return
        if data and (text := content_of(json.loads(data))):
            yield text


def complete(send: Send, body: str, retries: int = 3, first_wait: float = 0.25, longest_wait: float = 4.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The completion that ``send`` (body to status and answer) gives; see ``sources.transport.post``. An answer without content is an error."""
    text = content_of(json.loads(post(send, body, "completion", retries, first_wait, longest_wait, sleep)))
    if not text:
        raise RuntimeError("the completion has no content")
    return text


class Completer:
    """What an ``Engine`` asks for completions: messages and a model to a text. A model is one of ``aliases``, or the default."""

    def __init__(self, send: Send, default: str = MODEL_ALIASES[0], aliases: Sequence[str] = MODEL_ALIASES, **options: Any) -> None:
        if default not in aliases:
            raise ValueError(f"unknown model {default!r}")
        self.send, self.default, self.aliases, self.options = send, default, tuple(aliases), options

    def __call__(self, messages: Sequence[dict[str, str]], model: str | None = None) -> str:
        name = (model or "").strip() or self.default
        if name not in self.aliases:
            raise ValueError(f"unknown model {name!r}, there are {', '.join(self.aliases)}")
        return complete(self.send, request_body(messages, name, **self.options))


def with_completions(requests: DataFrame, completer: Callable[[], Completer], out: str = "completion") -> DataFrame:
    """``requests`` (system_text, user_text, ...) with their completions, asked from the tasks; a request that fails has null and ``<out>_error``."""
    prepare(requests.sparkSession)
    requests = requests.drop(out, f"{out}_error")
    at = requests.columns.index("system_text"), requests.columns.index("user_text")
    schema = StructType([*requests.schema.fields, StructField(out, StringType()), StructField(f"{out}_error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = completer()
        for batch in batches:
            texts: list[str | None] = []
            errors: list[str | None] = []
            for system, user in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                try:
                    texts.append(ask([{"role": "system", "content": system or ""}, {"role": "user", "content": user or ""}]))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one request's failure must not stop the others
                    texts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, out, f"{out}_error"])

    return requests.mapInArrow(run, schema)


def complete_stream(body: str, each: Callable[[str], bool]) -> str:
    """The whole text of a stream, each chunk shown to ``each``, which may end it by returning False."""
    out = []
    for chunk in stream_chunks(body):
        out.append(chunk)
        if not each(chunk):
            break
    return "".join(out)
