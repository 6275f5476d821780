"""Request bodies in bulk: the checks that ``facade.Engine`` makes one by one, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.search import SYMBOL_TOP_K
from corpusloom.plans.facade import MAX_DEPTH, SEARCH_LIMIT

BODY = "query string, name string, symbol_name string, module_name string, model string, base_ref string, depth long, limit long, files array<string>"
# The fields that name what an endpoint is asked about, the first that is there counts.
SUBJECTS = {"/search": ("query",), "/explain": ("name", "symbol_name"), "/deps": ("name", "symbol_name"), "/callers": ("name", "symbol_name"), "/module": ("module_name", "name")}
DEPTHS = {"/deps": 2, "/module": 1}


def parsed_requests(requests: DataFrame, target: str = "target", body: str = "body") -> DataFrame:
    """``requests`` with path, subject, depth, limit and status: 200, 404 for an unknown path, 400 for a body that is no JSON object,
    lacks its subject, or has a number out of bounds. What an endpoint doesn't take is null."""
    path = X.request_path(F.col(target))
    given = F.from_json(F.coalesce(F.col(body), F.lit("{}")), f"{BODY}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = requests.withColumn("path", path).withColumn("_given", given)

    def field(*names: str) -> Column:
        return F.coalesce(*(F.nullif(X.trim_api(F.col("_given")[n]), F.lit("")) for n in names))

    subject, depth, limit = F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for endpoint, names in SUBJECTS.items():
        subject = F.when(F.col("path") == endpoint, field(*names)).otherwise(subject)
    for endpoint, default in DEPTHS.items():
        depth = F.when(F.col("path") == endpoint, F.coalesce(F.col("_given")["depth"], F.lit(default).cast("long"))).otherwise(depth)
    limit = F.when(F.col("path") == "/search", F.coalesce(F.col("_given")["limit"], F.lit(SYMBOL_TOP_K).cast("long"))).otherwise(limit)
    bad = F.col("_given").isNull() | F.col("_given")["_bad"].isNotNull() | F.col("subject").isNull() | ~F.coalesce(F.col("depth").between(1, MAX_DEPTH), F.lit(True)) | ~F.coalesce(F.col("limit").between(1, SEARCH_LIMIT), F.lit(True))
    status = F.when(~F.col("path").isin(*SUBJECTS), 404).when(bad, 400).otherwise(200)
    return rows.withColumn("subject", subject).withColumn("depth", depth).withColumn("limit", limit).withColumn("status", status).drop("_given")
