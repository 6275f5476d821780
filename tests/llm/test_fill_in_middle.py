import hashlib
import random
import re

from pyspark.sql import functions as F

from corpusloom.llm.fill_in_middle import FillInMiddle, restored

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    u = UNITS.findall(text)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", text, None, None
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (len(u), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)) if h[3] % 100 < spm else (len(u), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


def outcome(r):
    return r["n"], r["form"], r["output"], r["prefix_chars"], r["middle_chars"]


def test_outputs_and_round_trip_of_odd_texts(spark):
    draw = random.Random(5)
    alphabet = ["a", "b", " ", " ", "\n", "\t", "\x01", "\x02", "e", "d", "<", "S", "P", "M", ">", "é", "😀", " ", "$", "\\", "0"]
    docs = [(i, "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40)))) for i in range(1500)]
    docs += [(None, "a b c d"), (7000, None), (7001, " \n "), (7002, "say <P> here"), (7003, "<<S"), (7, docs[7][1])]
    rows = FillInMiddle().transform(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    assert [outcome(r) for r in rows] == [by_hand(*d) for d in docs]
    assert [r["again"] for r in rows] == [t or "" for _, t in docs]
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_every_text_is_cut_at_full_rate(spark):
    docs = spark.createDataFrame([(i, f"x{i} y z") for i in range(50)], "doc_id long, text string")
    assert {r["form"] for r in FillInMiddle(seed=1, rate=100, spm_rate=0).transform(docs).collect()} == {"psm"}
    assert {r["form"] for r in FillInMiddle(seed=1, rate=0).transform(docs).collect()} == {"plain"}


def test_a_very_long_text(spark):
    text = "word  and\n" * 300_000 + " " * 200_000
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    for r in FillInMiddle(rate=100).transform(docs).collect():
        assert outcome(r) == by_hand(r["doc_id"], text, rate=100)


def test_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", 3)], "doc_id long, text string, form string, doc string, N int")
    out = FillInMiddle().transform(docs)
    assert out.columns == ["doc_id", "text", "doc", "n", "form", "output", "prefix_chars", "middle_chars"]
    assert out.first()["doc"] == "y"
    assert FillInMiddle().transform(docs.limit(0)).collect() == []
