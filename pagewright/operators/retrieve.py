"""Ranking chunks for queries, with a cap on the chunks of one page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(scores: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """scores with rank 1 to k within each query; equal scores by key."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def page_capped(scores: DataFrame, query: str, key: str, page: str, k: int = 6, max_per_page: int | None = 3) -> DataFrame:
    """The best k of each query with at most max_per_page of a page, out of the best 2k; None or 0 takes the best k.

    Taking a page's first max_per_page in order of rank is what a greedy walk down the ranking keeps."""
    if not max_per_page:
        return top_k(scores, query, key, k)
    wide = top_k(scores, query, key, 2 * k)
    within = wide.withColumn("n", F.row_number().over(Window.partitionBy(query, page).orderBy("rank"))).where(F.col("n") <= max_per_page)
    return within.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col("rank")))).where(F.col("rank") <= k).drop("n")
