"""Mixing sources to target shares of all tokens by entropy balancing, with a cap on how often a record is used."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Targets are read by the driver: the dual has one variable a source.
MAX_SOURCES = 10_000
#: The mix is this share of the largest one that the caps allow, so that no tilt has to sit on its cap.
HEADROOM = 0.98
SALTS = 64


def source_key(source: Column) -> Column:
    """Sources for comparison: trimmed, lower case."""
    return F.lower(F.trim(source))


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (share, most uses). Rows without a source, a positive share or a positive number of uses ask for nothing."""
    rows = (
        targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap"))
        .where("source <> '' AND share > 0 AND NOT isnan(share) AND cap > 0").groupBy("source").agg(F.sum("share").alias("share"), F.min("cap").alias("cap"))
        .limit(MAX_SOURCES + 1).collect()
    )
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    return {r["source"]: (r["share"], r["cap"]) for r in rows}


def solve_dual(cells: DataFrame, goals: dict[str, tuple[float, float, int]], scale: float, rounds: int = 40, tolerance: float = 1e-10) -> dict[str, float]:
    """The dual variable of each source: rates min(cap, base * exp(x * tokens / scale)) that give its goal in tokens.

    cells: source, tokens, docs. goals: source -> (goal, base, cap). Each round is one aggregation over the cells that
    gives every source's tokens and their slope; only these two numbers a source come to the driver. A Newton step that
    leaves the known bracket is replaced by its middle."""
    spark = cells.sparkSession
    x = dict.fromkeys(goals, 0.0)
    low, high = dict.fromkeys(goals, -np.inf), dict.fromkeys(goals, np.inf)
    for _ in range(rounds):
        now = spark.createDataFrame([(s, x[s], goals[s][1], float(goals[s][2])) for s in sorted(goals)], "source string, x double, base double, cap double")
        free = F.col("base") * F.exp(F.least(F.col("x") * F.col("tokens") / scale, F.lit(500.0)))
        mass = F.col("docs") * F.col("tokens")
        sums = (
            cells.join(F.broadcast(now), "source").groupBy("source")  # now has one row a source, MAX_SOURCES at most
            .agg(F.sum(mass * F.least(free, F.col("cap"))).alias("t"), F.sum(F.when(free < F.col("cap"), mass * free * F.col("tokens") / scale).otherwise(0.0)).alias("d"))
            .collect()
        )
        worst = 0.0
        for r in sums:
            s, goal = r["source"], goals[r["source"]][0]
            gap = r["t"] - goal
            worst = max(worst, abs(gap) / goal)
            if gap > 0:
                high[s] = min(high[s], x[s])
            else:
                low[s] = max(low[s], x[s])
            if abs(gap) <= tolerance * goal:
                continue
            step = x[s] - gap / r["d"] if r["d"] > 0 else np.inf * -np.sign(gap)
            step = float(np.clip(step, x[s] - 4, x[s] + 4))
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if np.isfinite(low[s] + high[s]) else x[s] + (4 if gap < 0 else -4)
            x[s] = step
        if worst <= tolerance:
            break
    return x


def _round_cells(cells: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for each cell, from the largest size to the smallest, what a cell gets too little or too much being
    carried on in tokens: in the end a source misses its goal by half its smallest record, caps permitting."""
    cells = cells.sort_values("tokens", ascending=False)
    carry, out = 0.0, []
    for tokens, docs, rate, cap in zip(cells["tokens"], cells["docs"], cells["rate"], cells["cap"]):
        wanted = docs * rate * tokens + carry
        copies = int(min(max(np.floor(wanted / tokens + 0.5), 0), docs * cap))
        carry = wanted - copies * tokens
        out.append(copies)
    return cells.assign(cell_copies=out)[["source", "tokens", "docs", "rate", "cell_copies"]]


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(doc_id, source, tokens, rate, copies) of every record that is used, copies being at least 1.

    docs: doc_id, source, tokens; targets: source, target_share, max_repeats. Sources are compared trimmed and in lower
    case; records of other or null sources, without an id or without tokens are not used. Shares are divided by their
    sum over the sources that have tokens. Without total_tokens the mix is HEADROOM of the largest one in which no
    source needs more than its cap; a larger total is refused. Copies of one text are records of their own.

    Rates minimise the relative entropy to the even rate under one token constraint a source; solved on cells of equal
    source and size, so an iteration reads a histogram and not the records. Then cells are rounded, the rest being
    carried on in tokens, and a cell's copies go evenly over its records, the first by a hash taking one more;
    ranks within a cell are counted in SALTS salted groups, so a cell that holds a third of all records is no hot group."""
    from pagewright.sources.tables import cut

    goal = read_targets(targets)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), F.col("tokens").cast("long").alias("tokens"))
    own = cut(own.where(F.col("doc_id").isNotNull() & (F.col("tokens") > 0) & F.col("source").isin(sorted(goal))))
    cells = cut(own.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("docs")))
    have = {r["source"]: r["t"] for r in cells.groupBy("source").agg(F.sum(F.col("tokens") * F.col("docs")).alias("t")).collect()}
    if not have:
        return own.select("doc_id", "source", "tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
    whole = sum(goal[s][0] for s in have)
    share = {s: goal[s][0] / whole for s in have}
    most = min(have[s] * goal[s][1] / share[s] for s in have)
    total = HEADROOM * most if total_tokens is None else float(total_tokens)
    if total > most:
        raise ValueError(f"the caps allow at most {most:.0f} tokens")
    base = total / sum(have.values())
    scale = sum(have.values()) / own.count()
    goals = {s: (total * share[s], min(base, float(goal[s][1])), goal[s][1]) for s in have}
    x = solve_dual(cells, goals, scale)
    dual = own.sparkSession.createDataFrame([(s, x[s], goals[s][1], goals[s][2]) for s in sorted(have)], "source string, x double, base double, cap int")
    rates = cells.join(F.broadcast(dual), "source").withColumn("rate", F.least(F.col("base") * F.exp(F.least(F.col("x") * F.col("tokens") / scale, F.lit(500.0))), F.col("cap").cast("double")))
    # A group here is a source's histogram: one row a size in tokens, however many records there are.
    rounded = rates.select("source", "tokens", "docs", "rate", "cap").groupBy("source").applyInPandas(_round_cells, "source string, tokens long, docs long, rate double, cell_copies long")
    key = F.xxhash64("doc_id", F.lit(11))
    salted = own.withColumn("key", key).withColumn("salt", F.floor((F.col("key") / 2.0**63 + 1) * (SALTS / 2)).cast("int"))
    counts = salted.groupBy("source", "tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    offset = counts.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("source", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("source", "tokens", "salt").orderBy("key", "doc_id")) - 1).drop("key")
    placed = ranked.join(offset, ["source", "tokens", "salt"]).join(rounded, ["source", "tokens"])
    # Rank r of a cell with c copies over n records: floor((r + 1) * c / n) - floor(r * c / n), the same as one each and a rest.
    rank = F.col("rank") + F.col("offset")
    copies = F.floor((rank + 1) * F.col("cell_copies") / F.col("docs")) - F.floor(rank * F.col("cell_copies") / F.col("docs"))
    return placed.select("doc_id", "source", "tokens", "rate", copies.cast("int").alias("copies")).where("copies > 0")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, share, tokens, records, copies, most_repeats): what the mix really holds, one row a target."""
    per = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("records"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"))
    whole = per.agg(F.sum("tokens")).first()[0] or 1
    wanted = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"))
    out = wanted.join(per, "source", "left").na.fill(0, ["tokens", "records", "copies", "most_repeats"])
    return out.select("source", "target_share", (F.col("tokens") / F.lit(float(whole))).alias("share"), "tokens", "records", "copies", "most_repeats")
