"""The queries against their SQL, and the pipeline against the plain statements of its stages."""

import pytest

import corpus_pipeline as P
from corpusloom.llm.language_id import LanguageId, held_out
from corpusloom.llm.queries import oracle_sql, queries
from tests.compare import connection, same_rows
from tests.llm import brute
from tests.llm.test_other_operators import mix_by_hand


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    same_rows(queries()[name](spark, sf), connection(sf), oracle_sql()[name])


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert [n for n, _ in P.STAGES] == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "mix_sources"]


def test_pipeline_equals_its_stages_by_hand(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in table.collect()}
    docs = sorted((i, r["text"]) for i, r in rows.items())
    told = {r["doc_id"]: r["lang_pred"] for r in LanguageId().fit(table.where(~held_out())).predict(table).collect()}
    docs = [d for d in docs if told[d[0]] != "und"]
    docs = [d for d, (i, _, c) in zip(docs, brute.jaccard_join(docs)) if i == c]
    cut = {i: s for i, _, _, _, s in brute.suffix_dedup(docs)}
    after = P.drop_repeated_passages(spark, spark.createDataFrame([rows[i] for i, _ in docs], table.schema), sf)
    texts = {r["doc_id"]: r["text"] for r in after.collect()}
    assert after.columns == table.columns and {i: brute.sha(t) for i, t in texts.items()} == cut
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(i, texts[i]) for i, *_, leak in brute.decontaminate(sorted(texts.items()), items) if not leak]
    wanted = [(i, texts[i], k) for i, _, k in mix_by_hand([(i, rows[i]["source"]) for i, _ in docs])]
    got = P.run(spark, sf)
    assert sorted((r["doc_id"], r["text"], r["mix_copy"]) for r in got.collect()) == sorted(wanted)


def test_stages_take_odd_rows(spark, sf):
    rows = [(1, "the cat sat on the mat today", None, None, None), (1, "the cat sat on the mat today", "en", "s", 3), (None, "another text about the and of", "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "the cat sat on the mat today", "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        kept = stage(spark, docs, sf)
        assert kept.columns[: len(docs.columns)] == docs.columns, name
        stage(spark, docs.limit(0), sf).collect()
        if name == "ngram_jaccard_join":
            assert sorted((r["text"] or "") for r in kept.collect()) == ["", "", "another text about the and of", "the cat sat on the mat today"]
        kept.collect()


def test_stages_keep_columns_of_any_name(spark, sf):
    names = ["lang_pred", "score", "label", "node", "group", "block_id", "rest", "items", "gone", "copies", "key", "rate", "a", "x"]
    rows = [(i, f"the cat sat on the mat and the dog {i} ran to the house of {'x' * i}", "en", "s", 1, *([None] * 7), *range(7)) for i in range(1, 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` {'string' if k < 7 else 'int'}" for k, n in enumerate(names))
    docs = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES:
        kept = stage(spark, docs, sf)
        assert kept.columns[: len(docs.columns)] == docs.columns, name
        assert {tuple(r)[4:][-14 + (0 if name != "mix_sources" else -2) :][7:14] for r in kept.collect()} <= {tuple(range(7))}, name
