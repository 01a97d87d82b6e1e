"""Fetched pages as a stream: each page once, extracted as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.functions.text import host_of
from pagewright.operators.extract import extract, ok


def page_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of fetched pages as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _key():
    """What tells pages apart: the page_id, or the URL where there is none."""
    return F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("url "), F.coalesce("url", F.lit(""))))


def first_arrivals(batch: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """Each page of a micro-batch once, the one stored first, without the pages already written (page_id, url).

    Pages without a stored_at come after those with one; a page without a page_id goes by its URL. However late a page
    is, it isn't dropped unless it was written before; only keys are compared with what is written."""
    order = Window.partitionBy("key").orderBy(F.asc_nulls_last("stored_at"), F.xxhash64("html"))
    first = batch.withColumn("key", _key()).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    if written is not None:
        first = first.join(written.select(_key().alias("key")), "key", "left_anti")
    return first.drop("key")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def host_counts(pages: DataFrame, window: str = "1 day", lateness: str = "30 days") -> DataFrame:
    """(window, host, pages, failed) by the time of storing; rows later than the lateness are left out."""
    good = F.col("error").isNull() & F.col("status").between(200, 299)
    timed = pages.withColumn("host", host_of(F.col("url"))).withWatermark("stored_at", lateness)
    return timed.groupBy(F.window("stored_at", window), "host").agg(F.count(F.lit(1)).alias("pages"), F.sum((~good).cast("int")).alias("failed"))


def extract_to(pages: DataFrame, target: str, checkpoint: str):
    """Start a query that appends extracted pages to a folder, each page once; ends when what is there now is done.

    Only pages that can be extracted count as arrived, so a failed fetch doesn't keep a later good one out, in one batch or
    in two. What was written is read from the folder itself, so a batch that is run again writes nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if _exists(spark, f"{target}/_spark_metadata"):
            raise ValueError(f"{target} was written by a file sink, whose log would hide new files; choose another folder")
        written = spark.read.schema("page_id long, url string").parquet(target) if _exists(spark, target) else None
        extract(first_arrivals(batch.where(ok()), written)).write.mode("append").parquet(target)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
