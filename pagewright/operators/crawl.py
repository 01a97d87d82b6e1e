"""Breadth-first crawls over stored pages and links, all runs at once, a level a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.sources.tables import cut

MAX_PAGES, MAX_DEPTH = 25, 2


def crawl(starts: DataFrame, links: DataFrame, blocked: DataFrame | None = None, max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(visited, stats): run_id, url, depth, ord of every fetched URL, and per run how many were fetched, skipped by robots
    and skipped by the budget.

    starts: run_id, url; links: url, position, link; blocked: url. Within a level URLs keep the order of their parents and
    of the links on them. A level that reaches the budget is cut where the count does; what is queued then, and the links
    already found at that level, count as skipped by the budget; blocked URLs before the cut count as skipped by robots and
    use no budget. Seen URLs are an anti join; every level is written to the shared folder, so lineage doesn't grow."""
    queue = cut(starts.select("run_id", "url").distinct().withColumn("ord", F.lit(0).cast("long")))
    seen, visited, stats = queue.select("run_id", "url"), None, None
    for depth in range(max_depth + 1):
        q = queue if blocked is None else queue.join(blocked.select("url", F.lit(True).alias("no")).distinct(), "url", "left")
        q = q.withColumn("no", F.coalesce(F.col("no"), F.lit(False)) if blocked is not None else F.lit(False))
        done = queue.select("run_id").distinct().withColumn("done", F.lit(0).cast("long")) if visited is None else visited.groupBy("run_id").agg(F.count(F.lit(1)).alias("done"))
        before = Window.partitionBy("run_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        counted = q.join(done, "run_id", "left").na.fill(0, ["done"]).withColumn("taken", F.col("done") + F.coalesce(F.sum((~F.col("no")).cast("long")).over(before), F.lit(0)))
        level = cut(counted.withColumn("popped", F.col("taken") < max_pages))
        fetched = level.where("popped AND NOT no").select("run_id", "url", F.lit(depth).alias("depth"), "ord")
        visited = cut(fetched if visited is None else visited.unionByName(fetched))
        part = level.groupBy("run_id").agg(F.sum((F.col("popped") & ~F.col("no")).cast("long")).alias("fetched"), F.sum((F.col("popped") & F.col("no")).cast("long")).alias("robots"), F.sum((~F.col("popped")).cast("long")).alias("budget"))
        stats = part if stats is None else stats.unionByName(part)
        if depth == max_depth:
            break
        found = fetched.join(links, "url").select("run_id", F.col("link").alias("url"), F.struct("ord", "position").alias("at"))
        new = found.groupBy("run_id", "url").agg(F.min("at").alias("at")).join(seen, ["run_id", "url"], "left_anti")
        queue = cut(new.select("run_id", "url", (F.row_number().over(Window.partitionBy("run_id").orderBy("at")) - 1).cast("long").alias("ord")))
        seen = cut(seen.unionByName(queue.select("run_id", "url")))
        if queue.isEmpty():
            break
    return visited, stats.groupBy("run_id").agg(F.sum("fetched").alias("pages_fetched"), F.sum("robots").alias("skipped_robots"), F.sum("budget").alias("skipped_budget"))


def _with_referrers(pages: DataFrame, range_bits: int) -> DataFrame:
    """pages (run_id, page_id, url, depth) with parent, the last page of depth - 1 before it in its run, else the first one
    after it, and same, the last page of its own depth before it; each (page_id, url) or null.

    A page looks among those of its run and depth in its own range of ids, then at the last one of the ranges before, so
    no task holds more than a range of ids, and one row a range and depth of a run."""
    at = F.struct("page_id", "url")
    asks = pages.withColumn("range", F.shiftright("page_id", range_bits))
    rows = asks.withColumn("need", F.col("depth")).withColumn("source", at).unionByName(asks.withColumn("need", F.col("depth") - 1).withColumn("source", F.lit(None).cast(pages.select(at.alias("s")).schema["s"].dataType)))
    run = Window.partitionBy("run_id", "need").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("run_id", "need", "range").agg(F.max("source").alias("last")).withColumn("carry", F.max("last").over(run)).drop("last")
    first = rows.groupBy("run_id", "need").agg(F.min("source").alias("first"))
    own = Window.partitionBy("run_id", "need", "range").orderBy("page_id").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("near", F.max("source").over(own)).join(carried, ["run_id", "need", "range"]).withColumn("before", F.coalesce("near", "carry"))
    same = found.where("source IS NOT NULL").select("run_id", "page_id", "url", "depth", F.col("before").alias("same"))
    parent = found.where("source IS NULL").join(first, ["run_id", "need"]).select("page_id", F.coalesce("before", "first").alias("parent"))
    return same.join(parent, "page_id")


def stored_graph(pages: DataFrame, starts: DataFrame, range_bits: int = 14) -> tuple[DataFrame, DataFrame, int]:
    """(starts, links, deepest depth): a link graph from the stored depths, of any depth.

    A page of depth d is linked from the last page of depth d - 1 before it in its run (else the first after it, else the
    start), and from the last page of that depth before this one; it links back to the first of these. pages: page_id, which
    is unique, run_id, url, depth; starts: run_id, url."""
    own = pages.where("depth IS NOT NULL AND page_id IS NOT NULL AND url IS NOT NULL AND run_id IS NOT NULL").select("run_id", F.col("page_id").cast("long").alias("page_id"), "url", F.col("depth").cast("int").alias("depth"))
    deepest = own.agg(F.max("depth")).first()[0] or 0
    starts = starts.distinct()
    known = cut(_with_referrers(own, range_bits).join(starts.withColumnRenamed("url", "start"), "run_id"))
    up = F.coalesce("parent.url", "start")
    down = known.select(up.alias("url"), F.col("page_id").alias("position"), F.col("url").alias("link"))
    back = known.select("url", F.coalesce("parent.page_id", F.lit(-1).cast("long")).alias("position"), up.alias("link"))
    others = known.select(F.col("page_id").alias("parent_id"), F.col("same.url").alias("other")).where("other IS NOT NULL")
    second = known.select("page_id", F.col("url").alias("link"), F.col("parent.page_id").alias("parent_id")).join(others, "parent_id").select(F.col("other").alias("url"), F.col("page_id").alias("position"), "link")
    return starts, cut(down.unionByName(second).unionByName(back)), deepest


def run_counters(pages: DataFrame) -> DataFrame:
    """(run_id, pages_fetched, pages_failed, deepest): what the stored pages of each run add up to."""
    good = F.col("error").isNull() & F.col("status").between(200, 299)
    return pages.groupBy("run_id").agg(F.sum(F.when(good, 1).otherwise(0)).alias("pages_fetched"), F.sum(F.when(good, 0).otherwise(1)).alias("pages_failed"), F.max("depth").alias("deepest"))
