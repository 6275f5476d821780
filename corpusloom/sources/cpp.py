"""C++ sources to symbols: a scanner of declarations that needs no compiler and no headers.

Comments, literals and preprocessor lines are blanked first, so that braces and parentheses match; then a
recursive walk over statements at namespace and class level finds what is declared. Inside function bodies only
calls are read. What the scanner cannot make sense of it skips to the end of the statement.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.model import PARSED
from corpusloom.session import dealt, prepare

ANONYMOUS = "(anonymous)"
#: A batch of parsed rows ends after the file that brings it to so many rows, or its texts to so many characters.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 20
_LITERAL = re.compile(r'//[^\n]*|/\*.*?\*/|R"([^()\\\s]{0,16})\(.*?\)\1"|"(?:\\.|[^"\\\n])*"|(?<![0-9A-Za-z_])\'(?:\\.|[^\'\\\n])+\'', re.S)
_INCLUDE = re.compile(r'^[ \t]*#[ \t]*include[ \t]*("[^"\n]*"|<[^>\n]*>)', re.M)
_DIRECTIVE = re.compile(r"^[ \t]*#(?:\\\r?\n|[^\n])*", re.M)
_CLASS = re.compile(r"(?:^|[\s>])(class|struct|union)\b(?:\s*\[\[.*?\]\])?(?:\s+alignas\s*\([^)]*\))?\s*((?:[A-Za-z_]\w*\s*(?:<[^{};]*>)?\s*(?:::\s*)?)*)", re.S)
_NAME = r"(?:~?[A-Za-z_]\w*)"
_CALL = re.compile(r"([A-Za-z_~][\w]*(?:\s*<[^<>(){};]*(?:<[^<>(){};]*>[^<>(){};]*)*>)?(?:\s*(?:::|\.|->)\s*(?:template\s+)?~?[A-Za-z_]\w*(?:\s*<[^<>(){};]*(?:<[^<>(){};]*>[^<>(){};]*)*>)?)*)\s*\(")
# Words before a parenthesis that call nothing.
_NO_CALL = frozenset("if for while switch return catch sizeof alignof decltype noexcept static_assert throw new delete co_return co_await co_yield typeid requires alignas constexpr and or not".split())
_FUNCTION = re.compile(rf"((?:{_NAME}\s*(?:<[^<>()]*(?:<[^<>()]*>[^<>()]*)*>)?\s*::\s*)*(?:operator\s*(?:\(\s*\)|\[\s*\]|[^\s\w(]+|\s(?:new|delete)(?:\s*\[\s*\])?|\s[\w:<>,\s*&]+?)|{_NAME}))\s*\(")
_SKIP = re.compile(r"[\s;]+|(?:public|private|protected)\s*(?:\w+\s*)?:(?!:)")
_VISIBLE, _COMMENT, _BRACKET, _BLANKS, _ATTRIBUTE = re.compile(r"[^\n]"), re.compile(r"/\*.*?\*/", re.S), re.compile(r"[(){}\[\]]"), re.compile(r"\s+"), re.compile(r"\[\[.*?\]\]", re.S)
_ASSIGNED, _INIT_LIST, _LISTED, _TYPE = re.compile(r"=\s*$"), re.compile(r"\)\s*(?:noexcept\s*)?:(?!:)"), re.compile(r"\s*[,{]"), re.compile(r"\b(class|struct|union|enum)\b")
_NAMESPACE, _NAMESPACE_WORD, _EXTERN, _TEMPLATE = re.compile(r"(?:inline\s+)?namespace\b"), re.compile(r"^(?:inline\s+)?namespace"), re.compile(r"extern\s*$"), re.compile(r"template\b")
_PASSED = re.compile(r"(?:using|typedef|static_assert|friend\s+(?:class|struct))\b|namespace\b")
_ENUM = re.compile(r"enum\b\s*(?:class\b|struct\b)?\s*([A-Za-z_]\w*(?:\s*::\s*\w+)*)?")
_FINAL, _COLON, _BASE_WORD = re.compile(r"\bfinal\s*$"), re.compile(r"(?<!:):(?!:)"), re.compile(r"\b(?:public|protected|private|virtual)\b|\[\[.*?\]\]")
_EQUALS, _OPERATOR, _DEFAULTED, _FRIEND = re.compile(r"=(?!=)"), re.compile(r"operator\s*[^\s\w(]+"), re.compile(r"=\s*(?:0|default|delete)\s*;"), re.compile(r"friend\b")
_STOP = re.compile(r"[;(\[{}]")
_MEMBER = re.compile(r"::|\.|->")
_DECLARES = re.compile(r"(?:^|[;{}(,])\s*(?!return\b|else\b|do\b|co_\w+\b|throw\b|case\b)[A-Za-z_][\w:]*(?:<[^;]*>)?[*&\s]+$")
_TAIL = re.compile(r"^(?:\s|const\b|volatile\b|noexcept\b(?:\s*\([^)]*\))?|override\b|final\b|&&?|->[^{;=]*|requires\b[^{;]*|try\b|throw\s*\([^)]*\)|\[\[.*?\]\])*", re.S)


@dataclass
class Symbol:
    kind: str
    qualified_name: str
    signature: str
    start_line: int
    end_line: int
    calls: list[str] = field(default_factory=list)
    bases: list[str] = field(default_factory=list)


def _spaces(m: re.Match) -> str:
    return _VISIBLE.sub(" ", m[0]) if "\n" in m[0] else " " * len(m[0])


def blank(text: str) -> str:
    """``text`` with comments, literals and directives as spaces, at the same places."""
    return _DIRECTIVE.sub(_spaces, _LITERAL.sub(_spaces, text))


def includes(text: str) -> list[str]:
    """The file's include paths, each once, without their quotes."""
    bare = _COMMENT.sub(_spaces, text)
    return list(dict.fromkeys(m[1][1:-1].strip() for m in _INCLUDE.finditer(bare)))


def strip_arguments(part: str) -> str:
    """A name's part without template arguments; operators and destructors keep theirs."""
    part = part.strip()
    if part.startswith(("operator", "~")):
        return part
    out, depth = [], 0
    for c in part:
        if c == "<":
            depth += 1
        elif c == ">" and depth:
            depth -= 1
        elif not depth:
            out.append(c)
    return "".join(out).strip()


def normal_name(text: str) -> str:
    """A qualified name without template arguments and empty parts; the trimmed text if nothing is left."""
    if "<" not in text:
        kept = [p for p in map(str.strip, text.split("::")) if p]
        return "::".join(kept) if kept else text.strip()
    parts, depth, at = [], 0, 0
    i = 0
    while i < len(text):
        c = text[i]
        if c == "<":
            depth += 1
        elif c == ">" and depth:
            depth -= 1
        elif c == ":" and not depth and text.startswith("::", i):
            parts.append(text[at:i])
            at = i = i + 2
            continue
        i += 1
    parts.append(text[at:])
    kept = [p for p in map(strip_arguments, parts) if p]
    return "::".join(kept) if kept else text.strip()


def qualify(scope: list[str], name: str) -> str:
    """``name`` inside ``scope``, unless it names the scope already; nothing is called ``(anonymous)``."""
    if not name:
        name = ANONYMOUS
    prefix = "::".join(s for s in scope if s)
    if not prefix or name == prefix or name.startswith(prefix + "::"):
        return name
    return f"{prefix}::{name}"


def qualify_base(scope: list[str], name: str) -> str:
    """A base class as written, or in the enclosing scope if it has no ``::``; template arguments stay."""
    name = name.strip().removeprefix("::")
    prefix = "::".join(s for s in scope if s)
    return name if "::" in name or not prefix or not name else f"{prefix}::{name}"


def signature(text: str) -> str:
    return text.strip().rstrip(";").rstrip()


class Scanner:
    """The symbols of one file, in order of their beginning."""

    def __init__(self, text: str) -> None:
        self.text, self.code = text, blank(text)
        self.closes = self._match()
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.symbols: list[Symbol] = []
        self.classes: set[str] = set()

    def _match(self) -> dict[int, int]:
        """Where each bracket closes; one that doesn't closes at the end of the text."""
        opens: list[tuple[str, int]] = []
        closes: dict[int, int] = {}
        pairs = {")": "(", "}": "{", "]": "["}
        for m in _BRACKET.finditer(self.code):
            c = m[0]
            if c in "({[":
                opens.append((c, m.start()))
                continue
            while opens and opens[-1][0] != pairs[c] and c == "}":
                closes[opens.pop()[1]] = m.start()
            if opens and opens[-1][0] == pairs[c]:
                closes[opens.pop()[1]] = m.start()
        closes.update((at, len(self.code)) for _, at in opens)
        return closes

    def line(self, at: int) -> int:
        return bisect_left(self.lines, at) + 1

    def scan(self) -> list[Symbol]:
        self._scope(0, len(self.code), [], 0)
        return self.symbols

    def _statement(self, at: int, end: int) -> tuple[int, int, int]:
        """(end, body, body's end) of the statement at ``at``: up to its semicolon or the brace that ends it; -1 without a body."""
        i, code = at, self.code
        while i < end:
            m = _STOP.search(code, i, end)
            if not m:
                break
            i, c = m.start(), m[0]
            if c == ";":
                return i + 1, -1, -1
            if c in "([":
                i = self.closes.get(i, end)
            elif c == "{":
                close = min(self.closes.get(i, end), end)
                head = code[at:i]
                if _ASSIGNED.search(head) or (_INIT_LIST.search(head) and _LISTED.match(code, close + 1, end)):
                    i = close
                else:
                    after = close + 1
                    if _TYPE.search(head) and not _FUNCTION.search(head):
                        semicolon = code.find(";", after, end)
                        return (semicolon + 1 if semicolon >= 0 else end), i, close
                    return after, i, close
            elif c == "}":
                return i + 1, -1, -1
            i += 1
        return end, -1, -1

    def _scope(self, at: int, end: int, scope: list[str], depth: int) -> None:
        code = self.code
        while at < end:
            m = _SKIP.match(code, at, end)
            if m:
                at = m.end()
                continue
            if code[at] == "}":
                at += 1
                continue
            stop, body, close = self._statement(at, end)
            self._declaration(at, stop, body, close, scope, depth, at)
            at = max(stop, at + 1)

    def _declaration(self, at: int, stop: int, body: int, close: int, scope: list[str], depth: int, begin: int) -> None:
        code = self.code
        head_end = body if body >= 0 else stop
        head = code[at:head_end]
        last = (close if body >= 0 and not code[close + 1 : stop].strip() else stop - 1) if stop > at else at
        if _NAMESPACE.match(head) and body >= 0:
            name = _ATTRIBUTE.sub("", _NAMESPACE_WORD.sub("", head)).strip()
            full = qualify(scope, normal_name(name) if name else "")
            self._add("namespace", full, "", begin, close)
            self._scope(body + 1, close, [full], 0)
        elif _EXTERN.match(head) and body >= 0:
            self._scope(body + 1, close, scope, depth)
        elif _PASSED.match(head):
            return
        elif _TEMPLATE.match(head) and "<" in head:
            inner = self._after_arguments(at)
            rest = code[inner:head_end]
            kind_at = inner + len(rest) - len(rest.lstrip())
            before = len(self.symbols)
            self._declaration(kind_at, stop, body, close, scope, depth, kind_at)
            found = self.symbols[before:]
            if found:
                self.symbols[before:] = [Symbol("template", found[0].qualified_name, signature(self.text[at:inner]), self.line(begin), found[0].end_line), *found]
        elif (m := _ENUM.match(head)) and not _FUNCTION.search(head):
            if body >= 0:
                self._add("enum", qualify(scope, normal_name(m[1] or "")), "", begin, close)
        elif (m := _CLASS.match(head)) and not _FUNCTION.search(head):
            if body >= 0:
                self._class(m, head, at, body, close, scope, depth, begin)
        else:
            self._callable(head, at, head_end, body, close, last, scope, depth, begin)

    def _after_arguments(self, at: int) -> int:
        i = self.code.index("<", at)
        depth = 0
        while i < len(self.code):
            c = self.code[i]
            if c == "(":
                i = self.closes.get(i, i)
            depth += (c == "<") - (c == ">" and self.code[i - 1] != "-")
            i += 1
            if not depth:
                break
        return i

    def _class(self, m: re.Match, head: str, at: int, body: int, close: int, scope: list[str], depth: int, begin: int) -> None:
        name = _FINAL.sub("", m[2].strip()).strip()
        full = qualify(scope, normal_name(name) if name else "")
        bases: list[str] = []
        colon = _COLON.search(head[m.end(1) :])
        if colon:
            for part in _split(self.text[at + m.end(1) + colon.end() : body]):
                base = _BASE_WORD.sub("", part).strip()
                if base:
                    bases.append(qualify_base(scope, base))
        self._add("class", full, "", begin, close, bases=list(dict.fromkeys(bases)))
        self.classes.add(full)
        self._scope(body + 1, close, [full], depth + 1)

    def _callable(self, head: str, at: int, head_end: int, body: int, close: int, last: int, scope: list[str], depth: int, begin: int) -> None:
        m = _FUNCTION.search(head)  # its name before the parenthesis of its parameters
        if not m or _EQUALS.search(_OPERATOR.sub("", head[: m.start()])):
            return
        raw = _BLANKS.sub(" ", m[1].strip())
        opening = at + m.end() - 1
        closing = self.closes.get(opening, head_end)
        if closing >= head_end:
            return
        tail = self.code[closing + 1 : head_end]
        rest = tail[_TAIL.match(tail).end() :].strip()
        if raw in _NO_CALL or (body < 0 and rest not in ("", ";") and not _DEFAULTED.match(rest)):
            return
        if body >= 0 and rest and not rest.startswith(":") and not rest.startswith("="):
            return
        before = head[: m.start()].strip()
        own = raw.split("::")[-1].strip()
        prefix = normal_name(raw.rpartition("::")[0]) if "::" in raw and not own.startswith("operator ::") else ""
        special = own.startswith(("operator", "~")) or own == scope_name(scope) or own == prefix.rpartition("::")[2]
        if not before and not special and not depth:
            return  # a macro or a call, not a declaration
        name = normal_name(raw) if not own.startswith("operator") else "::".join(x for x in (prefix, own) if x)
        full = qualify(scope, name)
        friend = bool(_FRIEND.match(before))
        owner = full.rpartition("::")[0]
        method = not friend and (depth > 0 or owner in self.classes or qualify(scope, prefix) in self.classes and bool(prefix))
        calls = self.calls(body + 1, close) if body >= 0 else []
        stop = head_end if body >= 0 else last
        self._add("method" if method else "function", full, signature(self.text[at:stop]), begin, close if body >= 0 else last, calls=calls)

    def calls(self, at: int, end: int) -> list[str]:
        """The names called between two places, each once."""
        found: dict[str, None] = {}
        for m in _CALL.finditer(self.code, at, end):
            name = normal_name(_BLANKS.sub("", m[1]))
            if _MEMBER.split(name)[-1] in _NO_CALL or name in _NO_CALL:
                continue
            # ``Type name(...)`` declares; a type's name is followed by white space and the name alone.
            plain = "::" not in m[1] and "." not in m[1] and "->" not in m[1]
            if plain and _DECLARES.search(self.code[self.code.rfind("\n", 0, m.start()) + 1 : m.start()]):
                continue
            found.setdefault(name)
        return list(found)

    def _add(self, kind: str, name: str, text: str, begin: int, end: int, calls: list[str] | None = None, bases: list[str] | None = None) -> None:
        self.symbols.append(Symbol(kind, name, text, self.line(begin), self.line(min(end, max(0, len(self.text) - 1))), calls or [], bases or []))


def scope_name(scope: list[str]) -> str:
    return scope[-1].rpartition("::")[2] if scope else ""


def _split(text: str) -> list[str]:
    """Parts between commas outside brackets."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and not depth:
            parts.append(text[at:i])
            at = i + 1
    return [*parts, text[at:]]


def parse(text: str) -> list[Symbol]:
    return Scanner(text).scan()


def parse_files(files: DataFrame, deal: bool = True) -> DataFrame:
    """The symbols of each file (path, text) in order; a file that can't be parsed gives one row with ``error``.

    Scanning costs far more than reading: a table that one task reads may keep a core busy for hours. So texts are dealt over tasks by their paths first;
    ``deal=False`` leaves them where they are, for files that lie evenly already.
    """
    prepare(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        made = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], PARSED.names)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    if text is None:
                        raise ValueError("no text")
                    own = includes(text)
                    rows += [(path, i, s.kind, s.qualified_name, s.signature, s.start_line, s.end_line, own, s.calls, s.bases, None) for i, s in enumerate(parse(text))]
                except Exception as e:  # noqa: BLE001  one bad file must not stop the others
                    rows.append((path, -1, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                held += len(text or "")
                if rows and (len(rows) >= BATCH_ROWS or held >= BATCH_CHARS):
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    files = files.select("path", "text")
    return (dealt(files, "path") if deal else files).mapInArrow(run, PARSED)
