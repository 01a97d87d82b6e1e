"""Retrieval quality on labelled queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_results(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """(case_id, first_rank, hit_at_3, hit_at_5, snippet_at_5) of each case.

    cases: case_id, expected_url (a part of the page's URL), expected_snippet; ranked: case_id, rank, page_url, text. The
    join is by case; containment is a condition on its rows. A blank snippet is never hit; a case without results has no
    first rank."""
    snippet = F.lower(F.coalesce("expected_snippet", F.lit("")))
    hit = F.contains("page_url", "expected_url")
    seen = cases.join(ranked.where("rank <= 5"), "case_id", "left").groupBy("case_id").agg(
        F.min(F.when(hit, F.col("rank"))).alias("first_rank"),
        F.coalesce(F.bool_or((snippet != "") & F.contains(F.lower("text"), snippet)), F.lit(False)).alias("snippet_at_5"),
    )
    return seen.select("case_id", "first_rank", F.coalesce(F.col("first_rank") <= 3, F.lit(False)).alias("hit_at_3"), F.coalesce(F.col("first_rank") <= 5, F.lit(False)).alias("hit_at_5"), "snippet_at_5")


def summary(results: DataFrame) -> DataFrame:
    """One row: cases, hit_at_3, hit_at_5, snippet_at_5, mrr; means over all cases, null where there is none."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    return results.agg(F.count(F.lit(1)).alias("cases"), share("hit_at_3"), share("hit_at_5"), share("snippet_at_5"), F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"))
