"""Filling containers of fixed capacity: minimum bin slack over windows of items, by subset sums kept as bit sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.sources.tables import cut

#: Items of one window, about; each window is packed on its own.
WINDOW_ITEMS = 1500
#: A bin of which more than this share is unused is packed again, in windows of the items of such bins only.
SLACK = 0.005
#: The table of containers is read by the driver; more kinds than this are refused.
MAX_CONTAINERS = 1000
PACKED = "container string, capacity_tokens int, window_no long, bin_no int, item_id long, part_no int, start_token long, tokens int"
_FILLED = "container string, capacity_tokens int, window_no long, item_id long, part_no int, copy long, start_token long, tokens int, bin_no int, loose boolean"


def fullest(capacity: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length (at most counts) add up to as much of capacity as any choice does.

    Bit t of a set says that some choice adds up to t. A length that occurs n times enters as lengths times 1, 2, 4, ...
    and the rest; the sets before each step are kept, and going back through them gives the counts."""
    mask = (1 << capacity + 1) - 1
    sets, steps, reach = [], [], 1
    for length in sorted(counts, reverse=True):
        left, times = min(counts[length], capacity // length), 1
        while left > 0:
            n = min(times, left)
            sets.append(reach)
            steps.append((length, n))
            reach |= reach << length * n & mask
            left -= n
            times *= 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for (length, n), before in zip(reversed(steps), reversed(sets)):
        if not before >> total & 1:
            total -= length * n
            used[length] = used.get(length, 0) + n
    return used


def pack_window(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item positions. The largest item left opens each bin, and the fullest choice of the others fills it."""
    at: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        at.setdefault(n, []).append(i)
    bins = []
    while at:
        largest = max(at)
        chosen = {largest: 1}
        counts = {n: len(p) - (n == largest) for n, p in at.items() if n <= capacity - largest and len(p) > (n == largest)}
        for n, times in (fullest(capacity - largest, counts) if counts else {}).items():
            chosen[n] = chosen.get(n, 0) + times
        own = []
        for n, times in chosen.items():
            own += [at[n].pop() for _ in range(times)]
            if not at[n]:
                del at[n]
        bins.append(own)
    return bins


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    """Pack the rows of one container and window, in an order that doesn't depend on how they came."""
    rows = group.sort_values(["item_id", "part_no", "copy"], kind="stable").reset_index(drop=True)
    capacity = int(rows["capacity_tokens"].iloc[0])
    lengths = rows["tokens"].to_numpy()
    bins = pack_window(lengths.tolist(), capacity)
    at = np.array([i for b in bins for i in b], dtype=np.int64)
    out = rows.iloc[at].copy()
    out["bin_no"] = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    used = np.array([lengths[b].sum() for b in bins])
    out["loose"] = np.repeat(used < (1 - SLACK) * capacity, [len(b) for b in bins])
    return out


def pack(sizes: DataFrame, containers: DataFrame, window_items: int = WINDOW_ITEMS) -> DataFrame:
    """Every item in bins of every container, as PACKED.

    sizes: item_id, tokens; containers: container, capacity_tokens. An item over a capacity alone is cut into parts of
    exactly the capacity and a rest; no other item is cut. Items of 0 tokens or without id or size, and containers
    without a positive capacity, take no part. A repeated item_id is packed once for every row. Windows are drawn by a
    hash of the item and its number among rows of the same id and size, so bins depend neither on the files nor on the
    cluster, and no window holds all copies of a text. A window and container is a group of its own, and there are as
    many tasks as groups allow. The items of bins that windows leave badly filled go into windows of their own, of the
    same size, as long as that leaves a quarter fewer windows."""
    boxes = containers.select(F.col("container").cast("string").alias("container"), F.col("capacity_tokens").cast("int").alias("capacity_tokens")).where("capacity_tokens > 0").distinct().limit(MAX_CONTAINERS + 1).collect()
    if len(boxes) > MAX_CONTAINERS:
        raise ValueError(f"more than {MAX_CONTAINERS} kinds of containers")
    if not boxes:
        return sizes.sparkSession.createDataFrame([], PACKED)
    own = sizes.select(F.col("item_id").cast("long").alias("item_id"), F.col("tokens").cast("long").alias("tokens")).where("item_id IS NOT NULL AND tokens > 0")
    # Copies are numbered from their count: a row for each of equal rows, without sorting any group.
    counted = cut(own.groupBy("item_id", "tokens").agg(F.count(F.lit(1)).alias("n")))
    rows = counted.agg(F.sum("n")).first()[0] or 0
    windows = max(1, -(-rows // window_items))
    each = counted.select("item_id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")).withColumn("window_no", F.pmod(F.xxhash64("item_id", "tokens", "copy"), F.lit(windows)))
    kinds = F.array(*[F.struct(F.lit(name).alias("container"), F.lit(int(capacity)).alias("capacity_tokens")) for name, capacity in boxes])
    parts = each.withColumn("box", F.explode(kinds)).select("*", "box.*").withColumn("part_no", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("int") - 1)))
    start = F.col("part_no").cast("long") * F.col("capacity_tokens")
    todo = parts.select("container", "capacity_tokens", "window_no", "item_id", "part_no", "copy", start.alias("start_token"), F.least(F.col("tokens") - start, F.col("capacity_tokens").cast("long")).cast("int").alias("tokens"))

    result, round_ = None, 0
    while True:
        # An explicit number, as small groups would otherwise be merged into few tasks.
        spread = todo.repartition(min(windows * len(boxes), 10_000), "container", "capacity_tokens", "window_no")
        filled = cut(spread.groupBy("container", "capacity_tokens", "window_no").applyInPandas(_fill, _FILLED).withColumn("round", F.lit(round_)))
        again = -(-filled.where("loose").count() // (window_items * len(boxes))) if windows > 1 else 0
        again = 1 if again <= 4 else again  # one window of a few times the size at the end
        last = windows == 1 or again > windows * 3 // 4
        kept = filled if last else filled.where("NOT loose")
        result = kept if result is None else result.unionByName(kept)
        if last:
            break
        windows, round_ = again, round_ + 1
        todo = filled.where("loose").select("container", "capacity_tokens", F.pmod(F.xxhash64("item_id", "part_no", "copy"), F.lit(windows)).alias("window_no"), "item_id", "part_no", "copy", "start_token", "tokens")
    # A bin is told by its window and number; those of later rounds are numbered on from the windows before.
    return result.select("container", "capacity_tokens", (F.col("window_no") * 64 + F.col("round")).alias("window_no"), "bin_no", "item_id", "part_no", "start_token", "tokens")


def fill_report(packed: DataFrame) -> DataFrame:
    """(container, capacity_tokens, bins, items, tokens, fill): fill is the share of all bins' capacity that is used."""
    total = F.sum(F.col("tokens").cast("long"))
    bins = packed.groupBy("container", "capacity_tokens", "window_no", "bin_no").agg(total.alias("t"), F.count(F.lit(1)).alias("n"))
    out = bins.groupBy("container", "capacity_tokens").agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("items"), F.sum("t").alias("tokens"))
    return out.withColumn("fill", F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")))
