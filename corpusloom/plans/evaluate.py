"""Scoring an engine on a manifest of evaluation queries, with a report."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame

from corpusloom.operators.evaluation import TOOL_GROUPS, first_ranks, metrics
from corpusloom.plans.facade import Engine, ranked_names
from corpusloom.sources.files import tool_arguments

_PATHS = {"semantic_search": "/search", "search": "/search", "explain": "/explain", "module": "/module", "callers": "/callers", "deps": "/deps"}


def evaluate(engine: Engine, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranks by query, metrics by group) of a manifest (``sources.files.evaluation_queries``).

    Requests go one by one, as a manifest is a list that people write; an answer that fails ranks nothing.
    """
    spark = queries.sparkSession
    rows: list[tuple[str, str, str]] = []
    ranked: list[tuple[str, int, str]] = []
    expected: list[tuple[str, str]] = []
    for q in queries.collect():
        row: dict[str, Any] = q.asDict()
        answer = engine.handle("POST", _PATHS.get(row["tool"], "/search"), json.dumps(tool_arguments(row)))
        names = ranked_names(row["tool"], answer["body"]) if answer["status"] == 200 else []
        rows.append((row["id"], row["tool"], TOOL_GROUPS.get(row["tool"], "auxiliary")))
        ranked += [(row["id"], k, name) for k, name in enumerate(names, 1)]
        expected += [(row["id"], name) for name in row["expected_symbols"] or []]
    ranks = first_ranks(
        spark.createDataFrame(ranked, "query_id string, rank int, name string"),
        spark.createDataFrame(expected, "query_id string, name string").distinct(),
        spark.createDataFrame(rows, "query_id string, tool string, tool_group string"),
    )
    return ranks, metrics(ranks)


def write_report(ranks: DataFrame, scores: DataFrame, folder: str) -> None:
    """Both tables as JSON lines below ``folder``."""
    ranks.coalesce(1).write.mode("overwrite").json(f"{folder}/ranks")
    scores.coalesce(1).write.mode("overwrite").json(f"{folder}/metrics")
