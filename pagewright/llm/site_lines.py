"""Lines repeated across one site's documents, found with compressed bitmaps of documents per line."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.text import compared_form, host_of
from pagewright.llm import bitmaps
from pagewright.sources.tables import cut, sized

#: A line is repeated when it stands in so many documents of its site.
MIN_PAGES = 12
_KEY = ["k1", "k2"]


@F.pandas_udf(T.BinaryType())
def _pack(low: pd.Series) -> pd.Series:
    return low.map(bitmaps.pack)


@F.pandas_udf(T.BinaryType())
def _union(parts: pd.Series) -> pd.Series:
    return parts.map(lambda p: bitmaps.union(list(p)))


@F.pandas_udf(T.IntegerType())
def _cardinality(bitmap: pd.Series) -> pd.Series:
    return bitmap.map(bitmaps.cardinality)


@F.pandas_udf(T.BooleanType())
def _contains(bitmap: pd.Series, low: pd.Series) -> pd.Series:
    return pd.Series([bitmaps.contains(b, n) for b, n in zip(bitmap, low)])


def site_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, k1, k2, variant, container, low) of every line that can count: not a heading, with a letter.

    k1 and k2 hash the host and the compared form to 96 bits, variant the line as written; container and low are the two
    parts of the page_id in the bitmaps."""
    lines = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).where(F.col("page_id").isNotNull() & F.col("host").isNotNull() & ~F.col("line").startswith("#") & F.col("line").rlike(r"\p{L}"))
    keyed = lines.withColumn("form", compared_form(F.col("line")))
    return keyed.select(
        "page_id", "line_no", F.xxhash64("host", "form").alias("k1"), F.hash("host", "form").alias("k2"), F.xxhash64("line").alias("variant"),
        F.shiftright("page_id", 16).alias("container"), F.col("page_id").bitwiseAND(65535).cast("int").alias("low"),
    )


def hopeful_lines(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """The site_lines whose host and form occur min_pages times at least, all others can't be on so many pages; written once.

    The counts are added up before the shuffle, so a line on a third of all pages is one row a task; most lines are
    unique to a page and go no further than this."""
    lines = site_lines(pages)
    often = sized(lines.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select(*_KEY))
    return cut(lines.join(often, _KEY, "left_semi"))


def repeated_line_bitmaps(lines: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(k1, k2, container, bitmap) of the lines on at least min_pages different pages of their host.

    Each spelling of a line has its own bitmaps; they are united per compared form, and the exact cardinality counts. A
    hot line is spread over its containers of 65,536 page ids, so no group grows with the site."""
    own = lines.groupBy(*_KEY, "variant", "container").agg(F.collect_set("low").alias("low")).withColumn("part", _pack("low"))
    united = own.groupBy(*_KEY, "container").agg(F.collect_list("part").alias("parts")).select(*_KEY, "container", _union("parts").alias("bitmap"))
    counted = cut(united.withColumn("n", _cardinality("bitmap")))
    enough = counted.groupBy(*_KEY).agg(F.sum("n").alias("pages")).where(F.col("pages") >= min_pages)
    return counted.join(enough.select(*_KEY), _KEY, "left_semi").select(*_KEY, "container", "bitmap")


def repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, line_no) of every line whose compared form stands on min_pages or more pages of its host.

    pages: page_id, url, text. Rows with a null page_id, text or host have no lines; a page_id that occurs twice counts
    once; a line that a page repeats counts once but every place of it comes out."""
    lines = hopeful_lines(pages, min_pages)
    found = lines.join(repeated_line_bitmaps(lines, min_pages), [*_KEY, "container"])
    return found.where(_contains("bitmap", "low")).select("page_id", "line_no").distinct()


def without_repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, text, lines_removed) for every page, its repeated lines taken out; a null text stays null."""
    gone = repeated_lines(pages, min_pages).groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "text").join(gone, "page_id", "left")
    none = F.array().cast("array<int>")
    own = own.withColumn("gone", F.coalesce("gone", none))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("gone"), i))
    return own.select("page_id", F.array_join(kept, "\n").alias("text"), F.size("gone").alias("lines_removed"))
