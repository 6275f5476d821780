"""Settings: a file of KEY=VALUE lines under environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from pathlib import Path

_TRUE, _FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def parse_env(text: str) -> dict[str, str]:
    """KEY=VALUE lines; ``export`` before a key and quotes about a value go, and of equal keys the first counts."""
    out: dict[str, str] = {}
    for raw in text.splitlines():
        line = raw.strip(" \t\r\n")
        if not line or line.startswith("#"):
            continue
        key, equals, value = line.removeprefix("export ").partition("=")
        value = value.strip(" \t\r\n")
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        if equals and key.strip():
            out.setdefault(key.strip(), value)
    return out


class Settings:
    """Values by key: the environment's before the file's before the default."""

    def __init__(self, values: Mapping[str, str], environ: Mapping[str, str] | None = None) -> None:
        self.values, self.environ = dict(values), os.environ if environ is None else environ

    @classmethod
    def load(cls, path: str | None = None, environ: Mapping[str, str] | None = None) -> Settings:
        return cls(parse_env(Path(path).read_text()) if path and Path(path).exists() else {}, environ)

    def text(self, key: str, default: str = "") -> str:
        return self.environ.get(key, self.values.get(key, default))

    def flag(self, key: str, default: bool) -> bool:
        value = self.text(key).strip().lower()
        if value and value not in _TRUE | _FALSE:
            raise ValueError(f"{key}: {value!r} is no boolean")
        return value in _TRUE if value else default

    def number(self, key: str, default: int, least: int = 0, most: int | None = None) -> int:
        value = self.text(key).strip()
        n = int(value) if value else default
        if n < least or (most is not None and n > most):
            raise ValueError(f"{key}: {n} is out of range")
        return n

    def names(self, key: str, default: tuple[str, ...] = ()) -> tuple[str, ...]:
        value = self.text(key)
        return tuple(x.strip() for x in value.split(",") if x.strip()) if value else default
