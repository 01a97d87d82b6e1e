"""Robots rules as rows, joined to URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.urls import authority_of, path_of, query_of, scheme_of


def rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, rule_no, allow, path) of the group that names the agent, else of the group for all agents.

    files: host, robots (the file's text, null where none could be read). Expressions parse the lines; an empty Disallow
    allows everything and gives no row."""
    lines = files.select("host", F.posexplode(F.split(F.coalesce("robots", F.lit("")), r"\r?\n")).alias("no", "line"))
    clean = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    parsed = clean.select("host", "no", F.lower(F.trim(F.regexp_extract("line", r"^([A-Za-z\-]+)\s*:", 1))).alias("field"), F.trim(F.regexp_extract("line", r"^[A-Za-z\-]+\s*:(.*)$", 1)).alias("value")).where("field IN ('user-agent', 'allow', 'disallow')")
    order = Window.partitionBy("host").orderBy("no")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = parsed.withColumn("starts", starts.cast("int")).withColumn("group", F.sum("starts").over(order))
    agents = grouped.where("field = 'user-agent'").select("host", "group", F.lower("value").alias("value"))
    token = agent.lower().split("/")[0]
    fit = agents.where((F.col("value") == "*") | F.contains(F.lit(token), F.col("value"))).withColumn("named", F.col("value") != "*")
    chosen = fit.groupBy("host").agg(F.max_by("group", F.struct("named", -F.col("group"))).alias("group"))
    return grouped.join(chosen, ["host", "group"]).where("field <> 'user-agent' AND value <> ''").select("host", F.col("no").alias("rule_no"), (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))


def allowed(urls: DataFrame, rules_: DataFrame, respect: bool = True) -> DataFrame:
    """(url, allowed): the first rule of the host whose path begins the URL's path and query decides; no rule allows, and so
    does every URL that isn't http or https. Rules meet URLs by host."""
    own = urls.select("url").distinct()
    if not respect:
        return own.withColumn("allowed", F.lit(True))
    keyed = own.withColumn("host", authority_of(F.col("url"))).withColumn("target", F.concat(path_of(F.col("url")), query_of(F.col("url"))))
    hit = keyed.join(rules_, "host").where(F.startswith("target", "path")).groupBy("url").agg(F.min_by("allow", "rule_no").alias("allow"))
    return keyed.join(hit, "url", "left").select("url", (F.coalesce("allow", F.lit(True)) | ~scheme_of(F.col("url")).isin("http", "https")).alias("allowed"))
