"""Source trees: what is listed, what is not even opened, and what fails."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import files
from corpusloom.sources.tree import SourceTree, SourceTreeReader, Wanted, file_extension, register

ODD = ("a/x.cpp", "_impl/y.cpp", "a/_z.hpp", ".hid/w.cpp", "a/.v.cpp")


def plant(root, *names):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(f"int {len(n)};\n")


def listed(df):
    return sorted(r["relative_path"] for r in df.collect())


def test_names_may_begin_with_anything(spark, tmp_path):
    plant(tmp_path, *ODD, ".cpp", "a/b.txt", "a/c.CPP", "d.cpp/e.h", "x y/ü[1]*{2}.cc")
    want = sorted([*ODD, "d.cpp/e.h", "x y/ü[1]*{2}.cc"])
    assert listed(files.scan_files(spark, str(tmp_path))) == want
    assert listed(files.scan_files(spark, f"file://{tmp_path}")) == want
    assert listed(files.read_files(spark, str(tmp_path), [*want, "a/none.cpp", ".cpp", "a/b.txt"])) == want
    rows = files.scan_files(spark, str(tmp_path)).where("relative_path = 'a/x.cpp'").collect()
    assert [(r["path"], r["text"]) for r in rows] == [(f"{tmp_path}/a/x.cpp", "int 7;\n")]


def test_extensions():
    assert [file_extension(n) for n in ("a.cpp", ".cpp", ".v.cpp", "a.b.h", "none", "end.", "..h")] == [".cpp", "", ".cpp", ".h", "", ".", ".h"]


def test_skipped_folders_are_never_opened(spark, tmp_path, monkeypatch):
    plant(tmp_path, "a/x.cpp", "build/y.cpp", "a/node_modules/z.cpp", "a/.git/w.h", "b/c/d/e.h", "builds/f.h")
    seen = []
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: seen.append(os.path.relpath(p, tmp_path)) or real(p))
    reader = SourceTree({"path": str(tmp_path), "splits": "2"}).reader(None)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["relative_path"] for r in rows) == ["a/x.cpp", "b/c/d/e.h", "builds/f.h"]
    assert sorted(seen) == [".", "a", "b", "b/c", "b/c/d", "builds"] and len(reader.partitions()) > 1
    # A folder that can't be entered would fail the scan if it were opened strictly; it isn't.
    assert listed(files.scan_files(spark, str(tmp_path))) == ["a/x.cpp", "b/c/d/e.h", "builds/f.h"]


def test_filters_prune_folders(spark, tmp_path, monkeypatch):
    plant(tmp_path, "a/x.cpp", "a/b/y.cpp", "c/d/z.cpp", "c/e/w.cpp", "v.h")
    register(spark)
    tree = spark.read.format("source_tree").load(str(tmp_path))
    assert listed(tree.where(F.col("relative_path").startswith("c/d"))) == ["c/d/z.cpp"]
    assert listed(tree.where("relative_path in ('a/x.cpp', 'c/e/w.cpp', 'q')")) == ["a/x.cpp", "c/e/w.cpp"]
    assert listed(tree.where("relative_path = 'v.h' and text like 'int%'")) == ["v.h"]
    assert listed(tree.where("relative_path like '%/z.cpp'")) == ["c/d/z.cpp"]
    plan = tree.where(F.col("relative_path").startswith("c/d"))._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "source_tree" in plan
    seen = []
    real = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: seen.append(os.path.relpath(p, tmp_path)) or real(p))
    wanted = Wanted((".cpp",), (), prefixes=["c/d"])
    reader = SourceTreeReader(str(tmp_path), wanted, True, None, 1)
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [1] and sorted(seen) == [".", "c", "c/d"]


def test_what_can_t_be_read(spark, tmp_path):
    plant(tmp_path / "t", "a/x.cpp", "a/y.cpp")
    (tmp_path / "t/a/y.cpp").write_bytes(b"int \xff;")
    (tmp_path / "t/l.cpp").symlink_to(tmp_path / "t/a/x.cpp")
    (tmp_path / "t/loop").symlink_to(tmp_path / "t")
    (tmp_path / "t/gone.cpp").symlink_to(tmp_path / "nowhere.cpp")
    assert listed(files.scan_files(spark, str(tmp_path / "t"))) == ["a/x.cpp", "a/y.cpp", "l.cpp"]
    assert listed(files.scan_files(spark, str(tmp_path / "t"), recursive=False)) == ["l.cpp"]
    texts = {r["relative_path"]: r["text"] for r in files.scan_files(spark, str(tmp_path / "t")).collect()}
    assert texts["a/y.cpp"] == "int �;"
    assert {r["text"] for r in files.scan_files(spark, str(tmp_path / "t"), read=False).collect()} == {None}
    with pytest.raises(Exception, match="No such file"):
        files.scan_files(spark, str(tmp_path / "none")).collect()
    with pytest.raises(ValueError):
        SourceTree({}).reader(None)


def test_an_error_is_one_row(tmp_path, monkeypatch):
    from corpusloom.sources.tree import _Local

    plant(tmp_path, "a.h", "b.h")
    real = _Local.read

    def read(self, relative):
        if relative == "a.h":
            raise PermissionError("denied")
        return real(self, relative)

    monkeypatch.setattr(_Local, "read", read)
    reader = SourceTree({"path": str(tmp_path)}).reader(None)
    rows = [(r["relative_path"], r["text"], r["error"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert rows == [("a.h", None, "denied"), ("b.h", "int 3;\n", None)]


def test_a_store_by_uri(tmp_path):
    from corpusloom.sources.tree import _Remote

    plant(tmp_path, *ODD)
    store = _Remote(f"file://{tmp_path}")
    assert tuple(map(sorted, store.list(""))) == ([".hid", "_impl", "a"], []) and store.read("a/_z.hpp") == b"int 8;\n"
    assert store.is_file("a/_z.hpp") and not store.is_file("a") and store.path("a") == f"file://{tmp_path}/a"


def test_an_empty_tree(spark, tmp_path):
    assert files.scan_files(spark, str(tmp_path)).collect() == [] and files.read_files(spark, str(tmp_path), []).collect() == []
