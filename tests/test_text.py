import posixpath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.prompts import trim_to_limit


def value(spark, column, text=""):
    return spark.range(1).select(F.lit(text).alias("x")).select(column).first()[0]


@pytest.mark.parametrize("path, wanted", [("a/./b//c", "a/b/c"), ("a/b/../c", "a/c"), ("../a", "../a"), ("/../a", "/a"), ("a/..", "."), ("", ""), ("../../b/..", "../.."), ("/", "/"), ("a/b/", "a/b/"), ("./a/b/../../x.cpp", "x.cpp")])
def test_normal_path(spark, path, wanted):
    assert value(spark, X.normal_path(F.col("x")), path) == wanted


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "..", ".", "", "c.h"]), min_size=1, max_size=6).map("/".join), min_size=20, max_size=20))
def test_normal_path_like_posix(spark, paths):
    paths = [p for p in paths if p and not p.startswith("//")]
    got = spark.createDataFrame([(p,) for p in paths] or [("a",)], "x string").select("x", X.normal_path(F.col("x")).alias("y")).collect()
    for r in got:
        # posixpath drops the final slash that a lexical normal form keeps.
        assert r["y"].rstrip("/") == posixpath.normpath(r["x"]).rstrip("/"), r["x"]


@pytest.mark.parametrize("raw, wanted", [(' "a/b.hpp" ', "a/b.hpp"), ("<vector>", "vector"), ("< x >", "x"), ("plain", "plain"), ('"half>', '"half>'), ("\x0b<a>\f", "a")])
def test_include_path(spark, raw, wanted):
    assert value(spark, X.include_path(F.col("x")), raw) == wanted


@pytest.mark.parametrize("raw, wanted", [("a/b.hpp", "b"), ("string", "string"), ("x.tar.gz", "x.tar"), (".hidden", ".hidden"), ("", "")])
def test_include_target(spark, raw, wanted):
    assert value(spark, X.include_target(F.col("x")), raw) == wanted


def test_candidates(spark):
    def names(source, target):
        return value(spark, X.candidate_names(F.lit(source), F.lit(target)))

    assert names("a::b::c", "t") == ["a::b::t", "a::t", "t"]
    assert names("a", "t") == ["t"]
    assert names("a::b::c", "x::t") == ["x::t"]
    assert names("", "t") == ["t"]


def test_lines_and_snippets(spark):
    text = "one\r\ntwo\n\nfour\n"
    assert value(spark, X.lines(F.col("x")), text) == ["one", "two", "", "four"]
    cut = lambda a, b: value(spark, X.snippet(F.col("x"), F.lit(a).cast("long"), F.lit(b).cast("long")), text)
    assert cut(2, 3) == "two\n" and cut(4, 9) == "four" and cut(5, 6) == "" and cut(0, 1) == "" and cut(3, 2) == ""


def test_tokens_split_at_ascii_white_space_only(spark):
    assert value(spark, X.token_count(F.col("x")), " a\x0bb c\td ") == 3
    assert value(spark, X.token_count(F.col("x")), "") == 0
    assert value(spark, X.truncate_line(F.col("x"), 2), "a  b c") == "a b ..."
    assert value(spark, X.truncate_line(F.col("x"), 3), "a  b c") == "a  b c"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab \n", max_size=30), st.integers(0, 8)), min_size=10, max_size=10))
def test_trim_column_equals_trim_of_prompts(spark, rows):
    df = spark.createDataFrame(rows, "x string, n int")
    for r in df.select("x", "n", X.trim_to_token_limit(F.col("x"), F.col("n")).alias("y")).collect():
        assert r["y"] == trim_to_limit(r["x"], r["n"]), (r["x"], r["n"])


def test_trim(spark):
    trim = lambda x, n: value(spark, X.trim_to_token_limit(F.col("x"), n), x)
    assert trim("a b\nc d\ne", 3) == "a b\n[truncated]"
    assert trim("a b\nc d\ne", 4) == "a b\nc d"
    assert trim("a b c", 2) == "" and trim("a b", 2) == "a b"


def test_like_suffix(spark):
    rows = spark.createDataFrame([("x::a_b",), ("x::aXb",), ("a_b",)], "n string")
    pattern = X.like_suffix("a_b")
    assert [r[0] for r in rows.where(F.expr(f"n LIKE r'{pattern}' ESCAPE '\\\\'")).collect()] == ["x::a_b"]


def test_stream_events(spark):
    body = 'data: {"choices":[{"delta":{"content":"Hel"}}]}\r\n\r\ndata: {"choices":[{"delta":{"content":"lo"}}]}\n\ndata: [DONE]\n\ndata: {"choices":[]}\n\n'
    assert value(spark, F.array_join(F.transform(X.sse_events(F.col("x")), X.completion_text), ""), body) == "Hello"


def test_names_and_kinds(spark):
    assert value(spark, X.short_name(F.col("x")), "a::b::c") == "c"
    assert value(spark, X.name_parts(F.col("x")), "a::b::") == ["a", "b"]
    assert value(spark, X.module_text(F.col("x"), F.lit(" f ")), " \t") == "f"
    assert value(spark, X.module_text(F.col("x"), F.lit(" ")), "") == "root"
    assert value(spark, X.signature_text(F.col("x")), " int f(); \n") == "int f()"
    assert [value(spark, X.kind_name(F.lit(k))) for k in (0, 5, 9)] == ["namespace", "enum", "unknown"]
    assert value(spark, X.is_header(F.col("x")), "a/b.hh") and not value(spark, X.is_header(F.col("x")), "a/b.HPP")
    assert value(spark, X.relation_line(F.col("x"), F.lit("void f()"), F.lit("m")), "f") == "-  f :: void f() [m]"
    assert value(spark, X.strip_question(F.col("x")), "Who calls a::b?") == "a::b"
    assert value(spark, X.eta_ms(F.lit(1000), F.lit(3), F.lit(2))) == 666
