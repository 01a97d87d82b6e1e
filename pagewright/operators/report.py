"""Page summaries and the report as Markdown, whole or by section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import last_segment, snippet


def page_summaries(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(page_id, url, title, word_count, chunk_count, summary_line): title falls back to the last part of the URL, then the
    URL; the line to the description, then the start of the text. Pages without chunks count 0."""
    counts = chunks.groupBy("page_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    given = lambda c: F.when(F.trim(c) != "", c)
    title = F.coalesce(given(F.col("title")), given(last_segment(F.col("url"))), F.col("url"))
    line = F.coalesce(given(F.col("meta_description")), snippet(F.regexp_replace("text", r"\n", " ")))
    return pages.join(counts, "page_id", "left").select("page_id", "url", title.alias("title"), "word_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), line.alias("summary_line"))


def markdown(points: DataFrame, chunks: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """(section_id, markdown): a heading a section and a bullet a point, with its citation, in order of rank."""
    bullets = points.join(chunks.select(key, "page_url"), key).select("section", "rank", F.concat(F.lit("- "), F.col("sentence"), F.lit(" ["), F.col(key).cast("string"), F.lit("]("), F.coalesce("page_url", F.lit("")), F.lit(")")).alias("bullet"))
    body = bullets.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "bullet"))), lambda x: x["bullet"]), "\n").alias("body"))
    return sections.join(body, "section", "left").select("section_id", F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.coalesce("body", F.lit("No findings."))).alias("markdown"))


def document(title: str, summary: DataFrame, sections: DataFrame, pages: DataFrame, stages: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(part, ord, line): the whole report as lines, to be sorted by part and ord: head, executive summary, sections, a
    table of pages, a table of stages, and an index of all chunks, cited or not.

    summary: summary, one row; sections: section, markdown; pages: as page_summaries; stages: ord, stage, items; chunks: key,
    page_title, heading_path, page_url. Rows stay rows, so that a report over many pages is no single value."""
    spark = summary.sparkSession
    fixed = [(0, 0, f"# {title}\n"), (1, 0, "## Executive summary\n"), (3, -2, "## Pages\n"), (3, -1, "| Page | Title | Words | Chunks |\n|-|-|-|-|"), (4, -2, "\n## Stages\n"), (4, -1, "| Stage | Items |\n|-|-|"), (5, -1, "\n## Citations\n")]
    heads = spark.createDataFrame(fixed, "part int, ord long, line string")
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("/")) for c in cells]), F.lit(" |"))
    as_lines = lambda df, part, at, line: df.select(F.lit(part).alias("part"), at.cast("long").alias("ord"), line.alias("line"))
    given = lambda c: F.when(F.trim(c) != "", F.col(c))
    cited = F.concat(F.lit("- "), F.col(key).cast("string"), F.lit(": "), F.concat_ws(" > ", given("page_title"), given("heading_path")), F.lit(" ("), F.coalesce("page_url", F.lit("")), F.lit(")"))
    out = heads.unionByName(as_lines(summary, 1, F.lit(1), F.concat("summary", F.lit("\n")))).unionByName(as_lines(sections, 2, F.col("section"), F.concat("markdown", F.lit("\n"))))
    out = out.unionByName(as_lines(pages, 3, F.col("page_id"), row("url", "title", "word_count", "chunk_count"))).unionByName(as_lines(stages, 4, F.col("ord"), row("stage", "items")))
    return out.unionByName(as_lines(chunks, 5, F.col(key), cited))


def failed_document(spark: SparkSession, title: str, run_id: str, error: str) -> DataFrame:
    """The report of a run that ended in an error, as document."""
    return spark.createDataFrame([(0, 0, f"# {title}\n"), (0, 1, f"Run `{run_id}` failed: {error or 'unknown error'}")], "part int, ord long, line string")
