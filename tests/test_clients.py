"""Clients with a transport of their own: embeddings, completions, a vector store, templates."""

import json

import pytest

from corpusloom.operators import dml
from corpusloom.operators.prompts import PromptBuilder, TemplateError, load_templates
from corpusloom.plans.completion import MODEL_ALIASES, Completer, with_completions
from corpusloom.plans.facade import Engine
from corpusloom.plans.index import Indexer
from corpusloom.sources.embedding import EndpointEmbed, hash_vector, with_embeddings
from corpusloom.sources.store import SnapshotStore
from corpusloom.sources.vector_store import PAYLOAD, VectorStore, VectorStoreError, checked, files_of, write_points


def answer(body):
    given = json.loads(body)["input"]
    texts = [given] if isinstance(given, str) else given
    return 200, json.dumps({"data": [{"index": i, "embedding": hash_vector(t, 8)} for i, t in reversed(list(enumerate(texts)))]})


def test_endpoint_embed(spark):
    embed = EndpointEmbed(answer, "m", 8)
    assert embed([]) == [] and embed(["a b", "c"]) == [hash_vector("a b", 8), hash_vector("c", 8)]
    got = with_embeddings(spark.createDataFrame([("a",), (None,), ("b c",)], "t string"), "t", embed, batch=2).collect()
    assert {r["t"]: [round(x, 5) for x in r["embedding"]] for r in got} == {t: [round(x, 5) for x in hash_vector(t or "", 8)] for t in ("a", None, "b c")}
    with pytest.raises(ValueError, match="dimensions"):
        EndpointEmbed(answer, "m", 9)(["a"])
    tries = []
    flaky = lambda body: tries.append(1) or ((503, "") if len(tries) < 3 else answer(body))
    assert EndpointEmbed(flaky, "m", sleep=lambda s: None)(["a"]) == [hash_vector("a", 8)] and len(tries) == 3
    with pytest.raises(RuntimeError, match="embedding failed: status 400"):
        EndpointEmbed(lambda body: (400, ""), "m")(["a"])


def chat(body):
    asked = json.loads(body)
    text = asked["messages"][1]["content"]
    return (500, "") if text == "fail" else (200, json.dumps({"choices": [{"message": {"content": f"{asked['model']}:{text}"}}]}))


def test_completions_in_bulk(spark):
    rows = spark.createDataFrame([("s", "one"), ("s", "fail"), (None, "two")], "system_text string, user_text string")
    got = {r["user_text"]: (r["completion"], r["completion_error"]) for r in with_completions(rows, lambda: Completer(lambda b: chat(b) if "fail" not in b else (400, ""))).collect()}
    assert got == {"one": ("fast:one", None), "two": ("fast:two", None), "fail": (None, "completion failed: status 400")}
    messages = [{"role": "system", "content": ""}, {"role": "user", "content": "x"}]
    assert [Completer(chat)(messages, m) for m in MODEL_ALIASES] == [f"{m}:x" for m in MODEL_ALIASES]
    with pytest.raises(ValueError):
        Completer(chat)(messages, "nobody")
    with pytest.raises(ValueError):
        Completer(chat, default="nobody")


class FakeServer:
    """Collections kept in memory, searched in full."""

    def __init__(self):
        self.collections, self.log = {}, []

    def __call__(self, method, path, body):
        self.log.append((method, path.split("?")[0]))
        name, _, rest = path.removeprefix("/collections/").partition("/")
        body = json.loads(body) if body else {}
        if not rest:
            if method == "PUT":
                self.collections[name] = {}
            return (200, "{}") if name in self.collections else (404, "")
        points = self.collections[name]
        if rest.startswith("points/delete"):
            path = body["filter"]["must"][0]["match"]["value"]
            self.collections[name] = {k: p for k, p in points.items() if p["payload"]["file_path"] != path}
        elif rest.startswith("points/search"):
            score = lambda p: sum(a * b for a, b in zip(p["vector"], body["vector"]))
            best = sorted(points.values(), key=score, reverse=True)[: body["limit"]]
            return 200, json.dumps({"result": [{"id": p["id"], "score": score(p), "payload": p["payload"]} for p in best]})
        else:
            points.update({p["id"]: p for p in body["points"]})
        return 200, "{}"


def point(i, path="a.cpp"):
    return dict.fromkeys(PAYLOAD, "") | {"symbol_id": i, "kind": 2, "start_line": 1, "end_line": 2, "file_path": path, "qualified_name": f"f{i}", "embedding": [float(i == 1), float(i == 2)]}


def test_vector_store():
    server = FakeServer()
    store = VectorStore(server, "c", 2, batch=2)
    store.upsert([point(1), point(2), point(3, "b.cpp")])
    store.upsert([point(1)])
    assert [p["symbol_id"] for p, _ in store.search([1.0, 0.0], 2)][0] == 1 and len(server.collections["c"]) == 3
    assert server.log.count(("PUT", "/collections/c")) == 1
    store.delete_files(["b.cpp", ""])
    assert set(server.collections["c"]) == {1, 2} and store.search([], 3) == store.search([1.0, 0.0], 0) == []
    for bad in (lambda: store.upsert([point(1) | {"embedding": [1.0]}]), lambda: store.search([1.0], 2)):
        with pytest.raises(VectorStoreError, match="dimensions"):
            bad()
    with pytest.raises(VectorStoreError, match="status 500"):
        VectorStore(lambda *a: (500, "no"), "c", 2).search([1.0, 0.0], 1)
    assert VectorStore(server, "", 2).search([1.0, 0.0], 1) == []


def test_points_from_a_table(spark, tmp_path):
    rows = spark.createDataFrame([point(i) for i in range(1, 6)]).repartition(2)
    folder = str(tmp_path)

    def connect():
        import os
        import uuid

        def send(method, path, body):
            if method == "PUT" and "points" in path:
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                    f.write(body)
            return 200, "{}"

        return VectorStore(send, "c", 2)

    assert write_points(rows, connect) == 5
    assert sorted(p["id"] for f in tmp_path.iterdir() for p in json.loads(f.read_text())["points"]) == [1, 2, 3, 4, 5]
    assert checked(rows, 2).count() == 5 and files_of(spark.createDataFrame([("./a.cpp",), ("a.cpp",)], "path string")) == ["a.cpp"]
    with pytest.raises(Exception, match="expected 3 dimensions"):
        checked(rows, 3).collect()


def test_the_vector_store_answers_first(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.cpp").write_text("int alpha() { return 1; }\nint beta() { return alpha(); }\nint gamma() { return 3; }\n")
    indexer = Indexer(SnapshotStore(spark, str(tmp_path / "s")), str(tmp_path / "t"))
    indexer.index()
    server = FakeServer()
    store = VectorStore(server, "c", 128)
    engine = Engine(indexer, vector_store=store).load()
    ask = lambda **body: engine.handle("POST", "/search", json.dumps({"query": "beta", **body}))
    by_modules = ask()["body"]["symbols"]
    rows = [r.asDict() for r in engine.tables["vectors"].collect()]
    store.upsert([r for r in rows if r["qualified_name"] != "beta"])
    found = ask(limit=2)["body"]["symbols"]
    assert "beta" in {s["qualified_name"] for s in by_modules} and {s["qualified_name"] for s in found} == {"alpha", "gamma"}
    assert [ask(limit=n)["status"] for n in (0, 101, "x", 1)] == [400, 400, 400, 200]
    deps = lambda d: engine.handle("POST", "/deps", json.dumps({"name": "beta", "depth": d}))["status"]
    assert [deps(d) for d in (0, 1, 8, 9, None)] == [400, 200, 200, 400, 400]


def test_templates_of_a_folder(tmp_path):
    (tmp_path / "search.yaml").write_text("context_token_limit: 64\nsystem: own system\nuser: |\n  Q={{query}}\n")
    (tmp_path / "deps.yaml").write_text("name: other\nsystem: a\nuser: b\n")
    with pytest.raises(TemplateError, match="other"):
        load_templates(str(tmp_path))
    (tmp_path / "deps.yaml").unlink()
    builder = PromptBuilder(templates=load_templates(str(tmp_path)))
    assert builder.build("search", "x")["user_text"] == "Q=x" and "explain" in builder.templates


def test_edges_to_unknown_symbols(spark):
    symbols = spark.createDataFrame([(1, 5)], "symbol_id long, module_id long")
    pairs = spark.createDataFrame([(1, 7, 1), (1, 1, 2)], "caller_symbol_id long, callee_symbol_id long, ord int")
    assert dml.call_edges(pairs, symbols, 1).count() == 1
    with pytest.raises(ValueError, match="7"):
        dml.call_edges(pairs, symbols, 1, strict=True)
    assert dml.call_edges(pairs.where("ord = 2"), symbols, 1, strict=True).count() == 1
