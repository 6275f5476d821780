"""URL filters: a list of allowed and blocked hosts, and association rules mined from labels; DataFrame functions only.

A url is cut into tokens (scheme, host labels by level, path segments, extension, query keys, fragment; digits count as ``#``). Spark's FP-growth mines the
combinations of tokens that stand often enough in labelled urls, with and without the label. A combination is a rule for a label if enough of the
urls that hold it have the label (confidence), more than of all urls (lift), and no part of the combination says so as surely. A url takes the label of
its surest rule; without one it is allowed. Rules are found by an inverted index: each is listed under its rarest token only, so that a token of
every url lists none but the rules of such tokens alone, and what is found is checked against the url's other tokens.

Bounds of the fit (not of the match): a labelled url enters with its ``max_tokens`` most telling tokens, those whose counts differ most between the labels, as FP-growth
lists up to 2 ** max_tokens combinations of them. A combination counts from ``min_count`` urls and ``min_support`` of all labelled ones on, so at most
2 ** max_tokens / min_support rules exist, however many labels. Urls are judged by all of their tokens. All labelled urls are used, and counts are exact.

The list comes first: the longest entry that fits decides. Where an entry's host and path are as long as another's, that of the longer host does.

Defined cases: a null url, or one without ``://``, has an empty host and path; it may still match by no rule, and is allowed. Labels that are null
are none; of several labels of a page, blocked counts. Rows that share a page_id are judged one by one; of equal urls all get one verdict. Without labels there are no rules.
Columns of the input named as those that are added are replaced, others kept. An empty table gives an empty result. A very long url is worked on in one row; its tokens are exploded without it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import durable


class Entry(NamedTuple):
    """``verdict`` for a host, with its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The list of the registered query.
ENTRIES = (
    Entry("allow", "com", "/"),
    Entry("block", "example.com", "/en/"),
    Entry("allow", "www.example.com", "/en/"),
    Entry("block", "net", "/es/"),
    Entry("block", "net", "/fr/"),
)
MIN_COUNT, MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 5, 0.005, 80, 10
#: Rules of at most so many bytes are broadcast; more are joined by token.
BROADCAST_BYTES = 4 << 20
RULE_SCHEMA = "antecedent array<string>, blocked boolean, freq long, n long, ppm long, rarest string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tokens begin with a letter and a colon, or h, a number and a colon: neither is one.
_BLOCK, _ALLOW = "=block", "=allow"


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def url_host(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """The distinct tokens of a url, in order; none for null."""

    def named(kind: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(f"{kind}:"), F.regexp_replace(v, "[0-9]+", "#")))

    url = F.coalesce(url, F.lit(""))
    labels = F.transform(F.reverse(F.split(url_host(url), r"\.")), lambda v, i: F.concat(F.lit("h"), (i + 1).cast("string"), F.lit(":"), v))
    path = _lower(url_path(url))
    extension = F.regexp_extract(path, r"\.([^./]+)$", 1)
    query = F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda v: F.substring_index(v, "=", 1))
    return F.array_sort(
        F.array_distinct(
            F.concat(
                named("s", F.array(_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
                F.filter(labels, lambda v: ~v.endswith(":")),
                named("p", F.split(path, "/")),
                named("x", F.array(extension)),
                named("q", keys),
                named("f", F.array(F.regexp_extract(url, r"(?s)#(.*)$", 1))),
            )
        )
    )


def listed(host: Column, path: Column, entries: Sequence[Entry] = ENTRIES) -> tuple[Column, Column]:
    """Name and verdict of the entry that decides; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for e in sorted(entries, key=lambda e: (len(e.name), len(e.host))):
        fits = ((host == e.host) | host.endswith("." + e.host)) & path.startswith(e.path)
        name, verdict = F.when(fits, e.name).otherwise(name), F.when(fits, e.verdict).otherwise(verdict)
    return name, verdict


class UrlFilter:
    """``fit(labelled)`` mines rules, ``judge(pages, rules)`` gives verdicts; see the module."""

    def __init__(self, entries: Sequence[Entry] = ENTRIES, min_count: int = MIN_COUNT, min_support: float = MIN_SUPPORT, min_confidence: int = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS, broadcast_bytes: int = BROADCAST_BYTES) -> None:
        """``min_support``: share of the labelled urls; ``min_confidence``: percent. The list is a short one: it becomes one expression."""
        self.entries, self.min_count, self.min_support, self.min_confidence, self.max_tokens, self.broadcast_bytes = tuple(entries), min_count, min_support, min_confidence, max_tokens, broadcast_bytes

    # --- mining --------------------------------------------------------------------------------

    def fit(self, labelled: DataFrame, url_col: str = "url", blocked_col: str = "blocked") -> DataFrame:
        """(antecedent, blocked, freq, n, ppm, rarest) of the rules: of the ``n`` labelled urls that hold the antecedent, ``freq`` have the label."""
        spark = labelled.sparkSession
        sets = labelled.where(F.col(blocked_col).isNotNull()).groupBy(url_tokens(F.col(url_col)).alias("tokens")).agg(F.count("*").alias("n"), F.sum(F.col(blocked_col).cast("long")).alias("nb"))
        sets = durable(sets)
        total, total_b = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("nb"), F.lit(0))).first()
        if not total:
            return spark.createDataFrame([], RULE_SCHEMA)
        least = max(self.min_count, math.ceil(self.min_support * total))
        stats = self._stats(sets, total, total_b, least)
        items = durable(self._transactions(sets, stats))
        # Half a url less, as FP-growth rounds up the product of share and number.
        found = durable(FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total).fit(items).freqItemsets)
        return durable(self._indexed(self._pruned(self._rules(found, total, total_b)), stats))

    def _stats(self, sets: DataFrame, total: int, total_b: int, least: int) -> DataFrame:
        """(token, n, telling) of the tokens that stand often enough."""
        counts = sets.select(F.explode("tokens").alias("token"), "n", "nb").groupBy("token").agg(F.sum("n").alias("n"), F.sum("nb").alias("nb"))
        telling = F.abs(F.col("nb").cast("decimal(18,0)") * F.lit(total) - F.col("n").cast("decimal(18,0)") * F.lit(total_b))
        return durable(counts.where(F.col("n") >= least).select("token", "n", telling.alias("telling")))

    def _transactions(self, sets: DataFrame, stats: DataFrame) -> DataFrame:
        """(items): a row per labelled url, its most telling tokens and its label."""
        keyed = sets.select(F.sha2(F.to_json("tokens"), 256).alias("part"), "n", "nb", F.explode_outer("tokens").alias("token"))
        known = keyed.join(stats.select("token", "telling"), "token", "left")
        ranked = F.array_sort(F.collect_list(F.when(F.col("telling").isNotNull(), F.struct((-F.col("telling")).alias("by"), "token"))))
        chosen = known.groupBy("part", "n", "nb").agg(F.transform(F.slice(ranked, 1, self.max_tokens), lambda s: s["token"]).alias("chosen"))
        both = F.explode(F.array(F.struct(F.lit(_BLOCK).alias("label"), F.col("nb").alias("times")), F.struct(F.lit(_ALLOW).alias("label"), (F.col("n") - F.col("nb")).alias("times"))))
        merged = chosen.select("chosen", both.alias("b")).groupBy("chosen", F.col("b.label").alias("label")).agg(F.sum("b.times").alias("times")).where("times > 0")
        each = merged.select(F.array_append("chosen", F.col("label")).alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_"))
        return each.select("items")

    def _rules(self, found: DataFrame, total: int, total_b: int) -> DataFrame:
        labels = F.array(F.lit(_BLOCK), F.lit(_ALLOW))
        bare = F.array_sort(F.array_except("items", labels))
        kept = found.select(bare.alias("antecedent"), F.array_contains("items", _BLOCK).alias("blocked"), (F.size("items") > F.size(bare)).alias("told"), "freq").where(F.size("antecedent") > 0)
        ours = kept.where("told").drop("told")
        of = kept.where("not told").select("antecedent", F.col("freq").alias("n"))
        prior = F.when(F.col("blocked"), F.lit(total_b)).otherwise(F.lit(total - total_b)).cast("decimal(18,0)")
        sure = (F.col("freq") * 100 >= F.col("n") * self.min_confidence) & (F.col("freq").cast("decimal(18,0)") * F.lit(total) > F.col("n") * prior)
        return ours.join(of, "antecedent").where(sure).withColumn("ppm", F.expr("freq * 1000000 div n"))

    @staticmethod
    def _pruned(rules: DataFrame) -> DataFrame:
        """Rules of which no part is a rule as sure. An antecedent has at most ``max_tokens`` tokens, and so at most 2 ** max_tokens parts."""
        rules = durable(rules)
        masks = F.explode(F.sequence(F.lit(1).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.size("antecedent")) - 2))
        parts = rules.where(F.size("antecedent") > 1).select("antecedent", "blocked", F.col("ppm").alias("own"), masks.alias("mask"))
        part = F.filter("antecedent", lambda _, i: F.getbit(F.col("mask"), i) == 1)
        parts = parts.select("blocked", "own", F.col("antecedent").alias("whole"), part.alias("antecedent"))
        less = parts.join(rules.select("antecedent", "blocked", "ppm"), ["antecedent", "blocked"]).where("ppm >= own").select(F.col("whole").alias("antecedent"), "blocked").distinct()
        return rules.join(less, ["antecedent", "blocked"], "left_anti")

    @staticmethod
    def _indexed(rules: DataFrame, stats: DataFrame) -> DataFrame:
        """``rules`` with the token that they are listed under."""
        tokens = rules.select("antecedent", F.explode("antecedent").alias("token")).distinct().join(stats.select("token", F.col("n").alias("of")), "token")
        rarest = tokens.groupBy("antecedent").agg(F.min(F.struct("of", "token"))["token"].alias("rarest"))
        return rules.join(rarest, "antecedent").select("antecedent", "blocked", "freq", "n", "ppm", "rarest")

    # --- matching ------------------------------------------------------------------------------

    def matches(self, urls: DataFrame, rules: DataFrame, key: str = "key", tokens: str = "tokens") -> DataFrame:
        """(key, best): of each url that a rule matches the surest rule, then the most frequent, the shortest, the first by its tokens."""
        size = rules.agg(F.coalesce(F.sum(F.length(F.array_join("antecedent", " ")) + 64), F.lit(0))).first()[0]
        near = F.broadcast if size <= self.broadcast_bytes else (lambda df: df)
        used = rules.select(F.explode("antecedent").alias("token")).distinct()
        held = urls.select(key, F.explode(tokens).alias("token")).join(near(used), "token", "left_semi")
        held = held.groupBy(key).agg(F.collect_set("token").alias("held"))
        rule = F.struct((-F.col("ppm")).alias("ppm"), (-F.col("freq")).alias("freq"), F.size("antecedent").alias("size"), "antecedent", "blocked")
        index = rules.select(F.col("rarest").alias("token"), rule.alias("rule"))
        asked = held.select(key, "held", F.explode("held").alias("token")).join(near(index), "token")
        whole = F.forall("rule.antecedent", lambda t: F.array_contains(F.col("held"), t))
        return asked.where(whole).groupBy(key).agg(F.min("rule").alias("best"))

    def judge(self, pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
        """The columns of ``pages`` and: host, path, rule (of the list, null if none fits), verdict, pattern and pattern_ppm (the mined rule that decided and its confidence, null if none did)."""
        added = ("host", "path", "rule", "verdict", "pattern", "pattern_ppm")
        names = [c for c in pages.columns if c.lower() not in added]
        url = F.col("doc")[url_col].cast("string")
        rows = pages.select(F.struct("*").alias("doc"))
        rows = rows.select("doc", url.alias("url"), url_host(url).alias("host"), url_path(url).alias("path"))
        name, verdict = listed(F.col("host"), F.col("path"), self.entries)
        # Urls that the list decides are asked for no rule; they and null ones have keys all the same, or they would meet in one task.
        rows = rows.select("doc", "url", "host", "path", name.alias("rule"), verdict.alias("told"))
        rows = rows.withColumn("key", F.coalesce(F.sha2("url", 256), F.monotonically_increasing_id().cast("string")))
        asked = rows.where("url is not null and rule is null").select("key", url_tokens(F.col("url")).alias("tokens"))
        joined = rows.join(self.matches(asked, rules), "key", "left")
        mined = F.when(F.col("best.blocked"), "block").otherwise("allow")
        return joined.select(
            *(F.col("doc")[c].alias(c) for c in names),
            "host",
            "path",
            "rule",
            F.coalesce("told", mined).alias("verdict"),
            F.array_join("best.antecedent", " ").alias("pattern"),
            (-F.col("best.ppm")).alias("pattern_ppm"),
        )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked) of the pages whose id has a label: blocked if any label of it is toxic."""
    told = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("blocked"))
    return pages.join(told, F.col("page_id") == F.col("doc_id")).select("url", "blocked")
