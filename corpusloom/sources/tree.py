"""A source tree as a data source: ``spark.read.format("source_tree").load(root)``.

Rows are (path, relative_path, text, error) of the tree's files of some extensions. Listing is split by folder: the planner lists
the upper levels until there are enough folders, and each task lists and reads what lies below its own. A folder of a skipped name
is never opened, nor is one that no pushed filter can match. Names may begin with anything. Links to files are followed, links to folders are not.

Options: ``extensions`` and ``skip`` (JSON lists), ``recursive``, ``read`` (false: texts are null, no file is opened), ``only`` (a JSON list
of relative paths: nothing is listed; those that aren't there give no row) and ``splits`` (folders to look for before tasks begin).

Pushed filters: equality, IN and a prefix of ``relative_path``; a session enables that with ``spark.sql.python.filterPushdown.enabled``, as ``register`` does.

A file that can't be read is a row with a null text and the error; a folder that can't be listed is passed over. A root that isn't
there fails. Roots are local (shared) folders, or of a store that pyarrow opens by URI.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from corpusloom.model import SKIPPED_FOLDERS, SOURCE_EXTENSIONS
from corpusloom.session import prepare

SCHEMA = "path string, relative_path string, text string, error string"
NAME = "source_tree"
SPLITS = 256
#: Files that ``only`` names, to a task.
NAMED_FILES = 64
BATCH_BYTES = 4 << 20


def file_extension(name: str) -> str:
    """From the last dot on, unless that is the name's first character."""
    return name[name.rindex(".") :] if "." in name[1:] else ""


class _Local:
    def __init__(self, root: str) -> None:
        self.root = os.path.normpath(root)

    def path(self, relative: str) -> str:
        return f"{self.root.rstrip('/')}/{relative}" if relative else self.root

    def list(self, relative: str) -> tuple[list[str], list[str]]:
        """Names of a folder's folders and files."""
        folders, files = [], []
        with os.scandir(self.path(relative)) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    folders.append(e.name)
                elif e.is_file():
                    files.append(e.name)
        return folders, files

    def is_file(self, relative: str) -> bool:
        return os.path.isfile(self.path(relative))

    def read(self, relative: str) -> bytes:
        with open(self.path(relative), "rb") as f:
            return f.read()


class _Remote:
    """A store that pyarrow knows by its URI's scheme."""

    def __init__(self, uri: str) -> None:
        import pyarrow.fs as fs

        self.kind = fs.FileType
        self.selector = fs.FileSelector
        self.store, self.root = fs.FileSystem.from_uri(uri)
        self.prefix = uri.rstrip("/")

    def path(self, relative: str) -> str:
        return f"{self.prefix}/{relative}" if relative else self.prefix

    def _inner(self, relative: str) -> str:
        return f"{self.root.rstrip('/')}/{relative}" if relative else self.root

    def list(self, relative: str) -> tuple[list[str], list[str]]:
        found = self.store.get_file_info(self.selector(self._inner(relative)))
        return [f.base_name for f in found if f.type == self.kind.Directory], [f.base_name for f in found if f.type == self.kind.File]

    def is_file(self, relative: str) -> bool:
        return self.store.get_file_info(self._inner(relative)).type == self.kind.File

    def read(self, relative: str) -> bytes:
        with self.store.open_input_stream(self._inner(relative)) as f:
            return f.read()


def opened(root: str) -> _Local | _Remote:
    scheme, there, rest = root.partition(":")
    if there and scheme == "file":
        return _Local("/" + rest.lstrip("/"))
    return _Remote(root) if there and rest.startswith("//") else _Local(root)


@dataclass
class Wanted:
    """Which files: by extension and folder, and by what filters ask of ``relative_path``."""

    extensions: tuple[str, ...]
    skip: tuple[str, ...]
    recursive: bool = True
    named: list[set[str]] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)

    def folder(self, relative: str) -> bool:
        """Whether a folder may hold a wanted file."""
        if not self.recursive or relative.rpartition("/")[2] in self.skip:
            return False
        below = relative + "/"
        return all(below.startswith(p) or p.startswith(below) for p in self.prefixes) and all(any(n.startswith(below) for n in names) for names in self.named)

    def file(self, relative: str) -> bool:
        *folders, name = relative.split("/")
        if file_extension(name) not in self.extensions or any(f in self.skip for f in folders) or (folders and not self.recursive):
            return False
        return all(relative.startswith(p) for p in self.prefixes) and all(relative in names for names in self.named)


class Part(InputPartition):
    """Files by name, then a folder with all below it."""

    def __init__(self, files: Sequence[str], folder: str | None = None) -> None:
        self.files, self.folder = list(files), folder


class SourceTreeReader(DataSourceReader):
    def __init__(self, root: str, wanted: Wanted, read: bool, only: list[str] | None, splits: int) -> None:
        self.root, self.wanted, self.texts, self.only, self.splits = root, wanted, read, only, splits

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("relative_path",):
                self.wanted.named.append({f.value})
            elif isinstance(f, In) and f.attribute == ("relative_path",):
                self.wanted.named.append(set(f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == ("relative_path",):
                self.wanted.prefixes.append(f.value)
            elif not (isinstance(f, IsNotNull) and f.attribute == ("relative_path",)):  # which always holds
                yield f

    def partitions(self) -> list[Part]:
        if self.only is not None:
            names = sorted({n for n in self.only if self.wanted.file(n)})
            return [Part(names[k : k + NAMED_FILES]) for k in range(0, len(names), NAMED_FILES)]
        store = opened(self.root)
        files, level = [], [""]
        top = True
        # Level by level, as long as there are fewer folders than tasks could take.
        while level and (top or len(level) < self.splits):
            below = []
            for folder in level:
                inner, own = self._listed(store, folder, top)
                files += own
                below += inner
            level, top = below, False
        step = max(1, -(-len(files) // self.splits))
        return [Part(files[k : k + step]) for k in range(0, len(files), step)] + [Part([], f) for f in level]

    def _listed(self, store: _Local | _Remote, folder: str, strict: bool = False) -> tuple[list[str], list[str]]:
        """Wanted folders and files of one folder, in order."""
        try:
            folders, files = store.list(folder)
        except OSError:
            if strict:
                raise
            return [], []
        at = f"{folder}/" if folder else ""
        return [at + n for n in sorted(folders) if self.wanted.folder(at + n)], [at + n for n in sorted(files) if self.wanted.file(at + n)]

    def _files(self, store: _Local | _Remote, part: Part) -> Iterator[str]:
        yield from part.files
        waiting = [] if part.folder is None else [part.folder]
        while waiting:
            folders, files = self._listed(store, waiting.pop())
            yield from files
            waiting += reversed(folders)

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        """``partition`` is None where there is none."""
        if partition is None:
            return
        store, rows, size = opened(self.root), [], 0
        for relative in self._files(store, partition):
            text = error = None
            if self.only is not None and not store.is_file(relative):
                continue
            if self.texts:
                try:
                    text = store.read(relative).decode("utf-8", "replace")
                except OSError as e:
                    error = str(e)
            rows.append((store.path(relative), relative, text, error))
            size += len(text or "") + 256
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["path", "relative_path", "text", "error"])


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SourceTreeReader:
        o = self.options
        if not o.get("path"):
            raise ValueError("a root is needed: load(root)")
        wanted = Wanted(tuple(json.loads(o.get("extensions", json.dumps(SOURCE_EXTENSIONS)))), tuple(json.loads(o.get("skip", json.dumps(SKIPPED_FOLDERS)))), o.get("recursive", "true").lower() == "true")
        only = json.loads(o["only"]) if "only" in o else None
        return SourceTreeReader(o["path"], wanted, o.get("read", "true").lower() == "true", only, int(o.get("splits", SPLITS)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down."""
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
