import json
import math
import subprocess
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import completion
from corpusloom.queries import QUERIES
from corpusloom.sources import cpp, embedding, files, git
from corpusloom.sources.config import Settings, parse_env

GAUGE = """namespace kit {
class Gauge {
public:
  Gauge() {}
  Gauge& operator++();
  explicit operator bool() const;
};
Gauge& Gauge::operator++() {
  return *this;
}
Gauge::operator bool() const {
  return true;
}
void with_lambda() {
  auto value = [](int x) { return x + 1; };
  (void)value;
}
} // namespace kit
"""
MIXED = """#include "a.hpp"
#include <vector>  // #include <no>
/* #include <never> */
namespace lib {
template <typename T, typename... R>
class Pack {
public:
  Pack(T first, R... rest) : first_(first) {
    init(rest...);
  }
  std::size_t size() const {
    return sizeof...(R) + 1;
  }
};
enum class Mode { a, b };
struct Both : public Base, private other::Thing<int> {
  void draw() override { helper(1); std::move(x); helper(2); const char* s = "fake()"; same<int>(2); }
  friend void peek(const Both&);
};
namespace { int hidden() { return 3; } }
}
int main() { return lib::hidden(); }
"""


def rows(text):
    return [(s.kind, s.qualified_name, s.signature, s.start_line, s.end_line) for s in cpp.parse(text)]


def test_operators_and_lambdas():
    assert rows(GAUGE) == [
        ("namespace", "kit", "", 1, 18),
        ("class", "kit::Gauge", "", 2, 7),
        ("method", "kit::Gauge::Gauge", "Gauge()", 4, 4),
        ("method", "kit::Gauge::operator++", "Gauge& operator++()", 5, 5),
        ("method", "kit::Gauge::operator bool", "explicit operator bool() const", 6, 6),
        ("method", "kit::Gauge::operator++", "Gauge& Gauge::operator++()", 8, 10),
        ("method", "kit::Gauge::operator bool", "Gauge::operator bool() const", 11, 13),
        ("function", "kit::with_lambda", "void with_lambda()", 14, 17),
    ]


def test_templates_classes_and_calls():
    got = {(s.kind, s.qualified_name): s for s in cpp.parse(MIXED)}
    assert cpp.includes(MIXED) == ["a.hpp", "vector"]
    assert got["template", "lib::Pack"].signature == "template <typename T, typename... R>"
    assert got["method", "lib::Pack::Pack"].signature == "Pack(T first, R... rest) : first_(first)"
    assert got["method", "lib::Pack::Pack"].calls == ["init"] and got["method", "lib::Pack::size"].calls == []
    assert got["class", "lib::Both"].bases == ["lib::Base", "other::Thing<int>"]
    assert got["method", "lib::Both::draw"].calls == ["helper", "std::move", "same"]
    assert ("function", "lib::Both::peek") in got and ("enum", "lib::Mode") in got
    assert ("namespace", "lib::(anonymous)") in got and got["function", "main"].calls == ["lib::hidden"]


@pytest.mark.parametrize("text", ["", "}", "{{{", "class", "template <", "int f(", "namespace x {", '"', "#include", "a::b::", "operator", "struct {", "/*"])
def test_broken_sources_don_t_stop_the_scanner(text):
    cpp.parse(text)


def test_names():
    assert cpp.normal_name("std::vector<a::b<c>>::iterator") == "std::vector::iterator"
    assert cpp.normal_name("A::operator<") == "A::operator<" and cpp.normal_name(" ::x ") == "x"
    assert cpp.qualify(["a::b"], "") == "a::b::(anonymous)" and cpp.qualify(["a"], "a::x") == "a::x"
    assert cpp.qualify_base(["a"], "::b::C") == "b::C" and cpp.qualify_base(["a"], "C<int>") == "a::C<int>"


def test_a_bad_file_is_one_row(spark):
    df = spark.createDataFrame([("x.cpp", None), ("y.cpp", "int f() { return g(); }"), ("z.cpp", "")], "path string, text string")
    got = {(r["path"], r["qualified_name"], r["error"] is None) for r in cpp.parse_files(df).collect()}
    assert got == {("x.cpp", None, False), ("y.cpp", "f", True)}


def test_scan(spark, tmp_path):
    for p in ("a/b.cpp", "a.h", "build/x.cpp", "a/node_modules/y.cpp", "a/n.txt", "a/Z.CPP"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("int x;\n")
    got = [r["relative_path"] for r in files.scan_files(spark, str(tmp_path)).orderBy(files.path_order()).collect()]
    assert got == ["a/b.cpp", "a.h"]
    assert [r["relative_path"] for r in files.scan_files(spark, str(tmp_path), recursive=False).collect()] == ["a.h"]


def test_changed_files(spark):
    df = spark.createDataFrame([("src/./b.cpp",), ("/r/src/b.cpp",), ("x.txt",), ("a.h",), (None,)], "path string")
    assert [r[0] for r in files.changed_files(df, "/r").collect()] == ["/r/a.h", "/r/src/b.cpp"]


def test_module_identities(spark):
    df = spark.createDataFrame([("/r/a/b/c.cpp",), ("/r/a/x.cpp",), ("/r/top.cpp",), ("/r/z/y.cpp",)], "path string")
    some = spark.createDataFrame([("/r/a/b",), ("/r/a",)], "folder string")
    assert {r[0]: r[1] for r in files.module_identities(df, some, "/r").collect()} == {"/r/a/b/c.cpp": "a/b", "/r/a/x.cpp": "a", "/r/top.cpp": "r", "/r/z/y.cpp": "z"}
    assert files.module_identities(df, spark.createDataFrame([("/r",)], "folder string"), "/r").where("path = '/r/z/y.cpp'").first()[1] == "r"


def test_inputs_of_requests(spark, tmp_path):
    assert files.parse_local_files('[{"path": "a"}, 3, {"content": "c"}, {}]') == [{"path": "a", "content": ""}, {"path": "", "content": "c"}]
    assert files.workspace_path("x/../y", "/w") == "y" and files.workspace_path("  ", "/w") == ""
    with pytest.raises(ValueError):
        files.workspace_path("../v", "/w")
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "tool": "deps", "query": "Dependencies of a::b?", "depth": 3, "expected_symbols": ["x"]}]))
    row = files.evaluation_queries(spark, str(tmp_path / "q.json")).first()
    assert files.tool_arguments(row.asDict()) == {"name": "a::b", "depth": 3}


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nexport A='x y'\nA=second\nB = off\nN=7\nL=.h, .cpp\n")
    s = Settings.load(str(tmp_path / ".env"), {"N": "9"})
    assert (s.text("A"), s.flag("B", True), s.number("N", 1), s.names("L"), s.flag("none", True)) == ("x y", False, 9, (".h", ".cpp"), True)
    assert parse_env("=x\nnoequals\n") == {}
    with pytest.raises(ValueError):
        s.flag("A", True)
    with pytest.raises(ValueError):
        s.number("N", 1, most=8)


def test_git(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init")
    for n in range(2):
        for p in ("a.cpp", "b.hpp"):
            (tmp_path / p).write_text(str(n))
        (tmp_path / "same.txt").write_text("x")
        run("add", "-A")
        run("commit", "-m", str(n))
    assert sorted(git.changed_paths(str(tmp_path))) == ["a.cpp", "b.hpp"]
    with pytest.raises(RuntimeError):
        git.changed_paths(str(tmp_path), "nowhere")
    with pytest.raises(FileNotFoundError):
        git.changed_paths(str(tmp_path / "none"))


def test_hash_embedding(spark):
    v = embedding.hash_vector("Parse the parse")
    assert math.isclose(sum(x * x for x in v), 1) and v == embedding.hash_vector("the PARSE, parse!") and embedding.hash_vector("..") == [0.0] * 128
    seen = []
    out = embedding.with_embeddings(spark.createDataFrame([("a",), ("b",), (None,)], "t string").coalesce(1), "t", embedding.hash_embed, batch=2)
    assert [len(r["embedding"]) for r in out.collect()] == [128] * 3 and seen == []
    with pytest.raises(Exception, match="vectors for"):
        embedding.with_embeddings(spark.createDataFrame([("a",)], "t string"), "t", lambda texts: []).collect()


def test_embedding_endpoint():
    assert json.loads(embedding.embedding_request(["a"], "m"))["input"] == "a"
    assert json.loads(embedding.embedding_request(["a", "b"], "m"))["input"] == ["a", "b"]
    assert embedding.parse_embeddings('{"data":[{"index":1,"embedding":[2]},{"index":0,"embedding":[1]}]}', 2) == [[1], [2]]
    assert embedding.parse_embeddings('{"embedding":[3]}', 1) == [[3]]
    with pytest.raises(ValueError):
        embedding.parse_embeddings('{"data":[]}', 1)


def test_completion():
    answers = [(503, ""), (200, '{"choices":[{"message":{"content":"hi"}}]}')]
    waits = []
    assert completion.complete(lambda body: answers.pop(0), "{}", sleep=waits.append) == "hi" and waits == [0.25]
    with pytest.raises(RuntimeError):
        completion.complete(lambda body: (400, ""), "{}")
    with pytest.raises(RuntimeError):
        completion.complete(lambda body: (200, '{"choices":[]}'), "{}")
    stream = 'data: {"choices":[{"delta":{"content":"Hello "}}]}\n\ndata: {"choices":[{"delta":{"content":"world"}}]}\n\ndata: [DONE]\n\n'
    assert completion.complete_stream(stream, lambda c: True) == "Hello world" and completion.complete_stream(stream, lambda c: False) == "Hello "
    assert "top_p" not in completion.request_body([], "m", temperature=0.1)


def test_files_that_one_task_reads_are_parsed_by_many(spark):
    """Parsing is many tasks' work though all texts lie in one partition; the rows are those of each file all the same."""
    made = [(f"{i}.cpp", f"int f{i}() {{ return g{i}(); }}" if i % 50 else None) for i in range(400)]
    df = spark.createDataFrame(made, "path string, text string").coalesce(1)
    got = cpp.parse_files(df).withColumn("task", F.spark_partition_id()).collect()
    per_task = Counter(r["task"] for r in got)
    assert len(per_task) >= 4 and max(per_task.values()) < 200
    assert sorted((r["path"], r["qualified_name"], r["error"] is None) for r in got) == sorted((p, t and f"f{p[:-4]}", t is not None) for p, t in made)
    here = cpp.parse_files(df, deal=False).withColumn("task", F.spark_partition_id()).drop("task")
    assert sorted(here.collect(), key=lambda r: r["path"]) == sorted((r[:-1] for r in got), key=lambda r: r[0])


def test_parse_cpp_spreads_the_symbols_of_one_file(spark, sf):
    """The table of customers is one small file; its texts are scanned by as many tasks as there are partitions."""
    out = QUERIES["parse_cpp"](spark, sf).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(out) >= 4 and max(r["count"] for r in out) < sum(r["count"] for r in out) / 2
