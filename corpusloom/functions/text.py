"""Column functions over names, paths, lines and token budgets; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.model import HEADER_EXTENSIONS, KIND_NAMES, KIND_RANKS

#: A token is a maximal run of anything but ASCII white space.
TOKEN = "[^ \\t\\n\\x0B\\f\\r]+"
_WS6, _WS4 = " \t\n\r\f\x0b", " \t\r\n"


def trim_ws(x: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(x, F.lit(_WS6))


def trim_api(x: Column) -> Column:
    """Without the four kinds of white space that request fields may carry."""
    return F.btrim(x, F.lit(_WS4))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))


def token_count(x: Column) -> Column:
    return F.size(tokens(F.coalesce(x, F.lit(""))))


def truncate_line(x: Column, limit: int) -> Column:
    """At most ``limit`` tokens, then `` ...``; a shorter line is unchanged."""
    return F.when(token_count(x) > limit, F.concat(F.array_join(F.slice(tokens(x), 1, limit), " "), F.lit(" ..."))).otherwise(x)


def lines(x: Column) -> Column:
    """Lines without their ends (LF or CRLF); no empty line after the last end."""
    parts = F.transform(F.split(x, "\n"), lambda s: F.regexp_replace(s, "\r$", ""))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def snippet(x: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1, inclusive, end cut to the text); empty if the range holds none."""
    of = lines(x)
    last = F.least(end, F.size(of).cast("long"))
    good = (start >= 1) & (start <= last)
    return F.when(good, F.array_join(F.slice(of, start.cast("int"), (last - start + 1).cast("int")), "\n")).otherwise("")


def trim_to_token_limit(x: Column, limit: Column | int) -> Column:
    """Whole lines until one would overflow, then ``[truncated]`` on a line of its own if that stays below the limit.

    A text within the limit is unchanged; if not even the first line fits, the result is empty. Lines without a token cost
    nothing and only end the line before them.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit

    split = F.split(x, "\n")
    counts = F.transform(split, token_count)

    def step(a: Column, n: Column) -> Column:
        fits = a["open"] & (a["used"] + n <= limit)
        return F.struct((a["lines"] + fits.cast("int")).alias("lines"), F.when(fits, a["used"] + n).otherwise(a["used"]).alias("used"), fits.alias("open"))

    # Only numbers are folded; the text is cut once.
    end = F.aggregate(counts, F.struct(F.lit(0).alias("lines"), F.lit(0).alias("used"), F.lit(True).alias("open")), step)
    kept = F.array_join(F.filter(F.slice(split, F.lit(1), end["lines"]), lambda s: token_count(s) > 0), "\n")
    blank_end = (end["lines"] > 0) & (F.try_element_at(counts, end["lines"]) == 0)
    cut = F.when(kept == "", kept).when(end["used"] < limit, F.concat(kept, F.lit("\n[truncated]"))).when(blank_end, F.concat(kept, F.lit("\n"))).otherwise(kept)
    return F.when(token_count(x) <= limit, x).otherwise(cut)


def short_name(x: Column) -> Column:
    """What follows the last ``::``."""
    return F.substring_index(x, "::", -1)


def name_parts(x: Column) -> Column:
    """The parts between ``::``; no empty part at the end."""
    parts = F.split(x, "::")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def candidate_names(source: Column, target: Column) -> Column:
    """Qualified names that ``target`` may mean inside ``source``, the innermost scope first.

    A target with ``::`` means itself alone.
    """
    parts = name_parts(source)
    depths = F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    scoped = F.transform(depths, lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "::"), F.lit("::"), target))
    return F.when(F.contains(target, F.lit("::")), F.array(target)).otherwise(F.concat(scoped, F.array(target)))


def module_text(x: Column, fallback: Column) -> Column:
    """A module's name or path: trimmed, else the fallback, else ``root``."""
    return F.coalesce(F.nullif(trim_ws(x), F.lit("")), F.nullif(trim_ws(fallback), F.lit("")), F.lit("root"))


def include_path(x: Column) -> Column:
    """Without white space and one pair of quotes or angle brackets."""
    return trim_ws(F.regexp_replace(trim_ws(x), '(?s)^(?:"(.*)"|<(.*)>)$', "$1$2"))


def file_stem(x: Column) -> Column:
    """A path's file name without its last extension; a name that only begins with a dot is kept."""
    return F.regexp_replace(F.substring_index(x, "/", -1), "^(.+)\\.[^.]*$", "$1")


def include_target(x: Column) -> Column:
    """The module that an include path names: its stem, else the path itself."""
    return F.when(file_stem(x) == "", x).otherwise(file_stem(x))


def extension(x: Column) -> Column:
    return F.regexp_extract(F.substring_index(x, "/", -1), "^.+(\\.[^.]*)$", 1)


def is_header(path: Column) -> Column:
    return extension(path).isin(*HEADER_EXTENSIONS)


def normal_path(x: Column) -> Column:
    """A path without ``.``, ``..`` behind a name, or doubled slashes; empty stays empty, a final slash stays."""
    parts = F.filter(F.split(x, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), a), -1) != ".."), F.slice(a, 1, F.size(a) - 1)).when((p == "..") & x.startswith("/"), a).otherwise(F.concat(a, F.array(p))),
    )
    body = F.concat(F.when(x.startswith("/"), "/").otherwise(""), F.array_join(walked, "/"))
    slash = (x.endswith("/") | x.endswith("/.")) & (F.size(walked) > 0) & (F.element_at(F.concat(F.array(F.lit("")), walked), -1) != "..")
    return F.when(x == "", x).when(body == "", ".").when(slash, F.concat(body, F.lit("/"))).otherwise(body)


def signature_text(x: Column) -> Column:
    """A declaration's text without the final semicolons and white space."""
    return F.regexp_replace(trim_ws(x), ";+[ \\t\\n\\r\\f\\x0B]*$", "")


def kind_name(kind: Column) -> Column:
    out = F.lit("unknown")
    for code, name in KIND_NAMES.items():
        out = F.when(kind == code, name).otherwise(out)
    return out


def kind_rank(kind: Column) -> Column:
    out = F.lit(len(KIND_RANKS))
    for code, name in KIND_NAMES.items():
        out = F.when(kind == code, KIND_RANKS[name]).otherwise(out)
    return out


def relation_line(name: Column, signature: Column, module: Column, gap: str = "- ") -> Column:
    """A line about a related symbol, after a dash and ``gap``'s spaces."""
    return F.concat(F.lit(gap), F.lit(" "), name, F.when(signature != "", F.concat(F.lit(" :: "), signature)).otherwise(""), F.when(module != "", F.concat(F.lit(" ["), module, F.lit("]"))).otherwise(""))


def request_path(x: Column) -> Column:
    """A request's target without its query."""
    return F.substring_index(x, "?", 1)


def strip_question(x: Column) -> Column:
    """An evaluation query reduced to the name that it asks about."""
    return trim_api(F.regexp_replace(F.regexp_replace(x, "^(?:Explain |Dependencies of |Who calls |Overview of the )", ""), "\\?$", ""))


def like_suffix(name: str) -> str:
    """A LIKE pattern (escape ``\\``) for qualified names that end in ``::name``."""
    escaped = name.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%::{escaped}"


def sse_events(body: Column) -> Column:
    """The data of each event of a server-sent stream, in order, up to ``[DONE]``."""
    events = F.transform(F.split(F.regexp_replace(body, "\r\n", "\n"), "\n\n"), lambda e: F.array_join(F.transform(F.filter(F.split(e, "\n"), lambda s: s.startswith("data:")), lambda s: F.ltrim(F.substring(s, 6, 1 << 30))), "\n"))
    full = F.filter(events, lambda e: e != "")
    done = F.array_position(full, "[DONE]")
    return F.when(done > 0, F.slice(full, F.lit(1), (done - 1).cast("int"))).otherwise(full)


def completion_text(payload: Column) -> Column:
    """The text of a completion or of a chunk of one."""
    paths = ("$.choices[0].delta.content", "$.choices[0].message.content", "$.choices[0].text")
    return F.coalesce(*(F.get_json_object(payload, p) for p in paths))


def eta_ms(elapsed_ms: Column, done: Column, remaining: Column) -> Column:
    """Time left at the pace so far, cut to whole milliseconds."""
    return F.when(done > 0, F.floor(elapsed_ms / done * remaining)).otherwise(F.lit(None).cast("long"))
