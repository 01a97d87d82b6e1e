"""Near-duplicate records: shards of texts with equal minimum hashes, BK-trees of short codes in each, and an exact comparison."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.bktree import hamming, pairs_across, pairs_within
from pagewright.sources.tables import cut, sized, written

#: Words of a shingle, and the fewest words of a text that takes part.
SHINGLE = 5
MIN_WORDS = 40
SIMILARITY = 0.6
#: A shard is one of BANDS tables and ROWS equal minimum hashes. In it each text has a code of CODE_BITS bits, one of each
#: of so many other minimum hashes: two texts of similarity s differ in (1 - s) / 2 of them, unrelated ones in half.
BANDS, ROWS, CODE_BITS = 48, 2, 16
#: Codes up to this distance are candidates. A pair is met in a table with probability s^ROWS * P(Binomial(CODE_BITS,
#: (1 - s) / 2) <= RADIUS): 0.13 at 0.6, where one of the tables meets it with 0.99, and 0.34 at 0.75.
RADIUS = 2
#: Larger shards are cut into blocks of about so many texts, and every two blocks are compared by a task of their own.
SHARD_TEXTS = 2000
#: Shards are counted one by one only in those of so many cells that hold many more rows than the mean cell.
CELLS = 1 << 16
#: Bits of the filter by which texts that have a candidate are told from most others before their texts are moved: at most
#: a 64th of this in rows, whatever the number of texts. With very many candidates it lets more pass, never less.
FILTER_BITS = 1 << 26
#: Groups of exact copies up to this size come out as all their pairs, larger ones as pairs with their representative.
ALL_PAIRS_OF_COPIES = 200
#: Components must have settled after so many rounds; they need about the logarithm of the largest component.
MAX_ROUNDS = 60

_WORDS = re.compile(r"[a-z0-9]+")
_rng = np.random.default_rng(20240229)
_HASHES = BANDS * ROWS
_MUL = _rng.integers(1, 2**63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, _HASHES, dtype=np.uint64)
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_BAND_NO = np.arange(BANDS, dtype=np.uint64) * _FOLD
#: Of each table's code: the minimum hashes that give its bits, none of them its own, and which bit of each.
_OF = np.stack([_rng.permutation(np.setdiff1d(np.arange(_HASHES), np.arange(b * ROWS, (b + 1) * ROWS)))[:CODE_BITS] for b in range(BANDS)])
_BIT = _rng.integers(0, 64, (BANDS, CODE_BITS), dtype=np.uint64)
_PLACE = np.uint64(1) << np.arange(CODE_BITS, dtype=np.uint64)
_CODE = np.uint64((1 << CODE_BITS) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, hashes: dict[str, int]) -> np.ndarray | None:
    """Hashes of the different runs of SHINGLE words, sorted; None for a text of fewer than MIN_WORDS words."""
    words = _WORDS.findall(text.lower())
    if len(words) < MIN_WORDS:
        return None
    for w in set(words).difference(hashes):
        hashes[w] = xxhash.xxh64_intdigest(w)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    run = w[: len(w) - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        run = run * np.uint64(0x100000001B3) + w[i : len(w) - SHINGLE + 1 + i]
    return np.unique(_mix(run))


def sketch(runs: np.ndarray) -> np.ndarray:
    """One number a table: the hash of the shard in the upper bits, the code in the CODE_BITS lowest."""
    least = np.full(_HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(runs), 2048):
        least = np.minimum(least, (runs[at : at + 2048, None] * _MUL + _ADD).min(axis=0))
    least = _mix(least)
    rows, key = least.reshape(BANDS, ROWS), _BAND_NO.copy()
    for i in range(ROWS):
        key = _mix(key ^ rows[:, i]) * _FOLD
    code = ((least[_OF] >> _BIT & np.uint64(1)) * _PLACE).sum(axis=1, dtype=np.uint64)
    return key & ~_CODE | code


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


class _Runs:
    """Runs and uid of a text, with the hashes of its words and of the kinds kept."""

    def __init__(self):
        self.hashes: dict[str, int] = {}
        self.kinds: dict[str, int] = {}

    def of(self, item: str, text: str) -> tuple[np.ndarray, int, int] | None:
        """(runs, uid, hash of the kind); None for a text of too few words. uid is a hash of the kind and the set of runs."""
        if len(self.hashes) > 1_000_000:
            self.hashes.clear()
        runs = shingles(text, self.hashes)
        if runs is None:
            return None
        if item not in self.kinds:
            self.kinds[item] = xxhash.xxh64_intdigest(item)
        kind = self.kinds[item]
        return runs, _signed(xxhash.xxh64_intdigest(runs.tobytes(), kind)), kind


_SKETCHES = "item string, id long, uid long, bands array<long>"


def _sketches(texts: DataFrame) -> DataFrame:
    """item, id and uid of every text that takes part; bands where a task meets a uid first. Copies have one uid, so a
    group of them, however large, goes on as one text a task at most."""

    def measure(batches):
        known, seen = _Runs(), set()
        for b in batches:
            rows, bands, first = [], [], []
            for item, id_, text in zip(b.column("item").to_pylist(), b.column("id").to_pylist(), b.column("text").to_pylist()):
                if (found := known.of(item, text)) is None:
                    continue
                runs, uid, kind = found
                rows.append((item, id_, uid))
                first.append(uid not in seen)
                if uid not in seen:
                    seen.add(uid)
                    bands.append((sketch(runs) ^ (np.uint64(kind) & ~_CODE)).view(np.int64))
            new = np.array(first, dtype=bool)
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new)]) * BANDS, pa.int32()), flat, mask=pa.array(~new))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, lists], ["item", "id", "uid", "bands"])

    return texts.mapInArrow(measure, _SKETCHES)


def _run_sets(texts: DataFrame) -> DataFrame:
    """(uid, runs) with 32 bits of each run's hash."""

    def measure(batches):
        known = _Runs()
        for b in batches:
            found = [known.of(item, text) for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist())]
            found = [f for f in found if f]
            sets = [np.unique(f[0].astype(np.uint32)).astype("<u4").tobytes() for f in found]
            yield pa.RecordBatch.from_arrays([pa.array([f[1] for f in found], pa.int64()), pa.array(sets, pa.binary())], ["uid", "runs"])

    return texts.select("item", "text").mapInArrow(measure, "uid long, runs binary")


def _texts_of(texts: DataFrame, members: DataFrame, asked: DataFrame) -> DataFrame:
    """The texts of the asked uids, of each uid at least one. A bit for the hash of each wanted id, in rows of 64 bits that
    are broadcast, keeps nearly all others from being moved; a join on the hash follows."""
    key = F.xxhash64("item", "id")
    word, bit = F.shiftright(F.pmod(F.col("key"), F.lit(FILTER_BITS)), 6), F.pmod(F.col("key"), F.lit(64)).cast("int")
    wanted = cut(members.join(asked, "uid", "left_semi").groupBy("uid").agg(F.min(F.struct("item", "id")).alias("m")).select(F.xxhash64("m.item", "m.id").alias("key")))
    bits = wanted.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(key, 64) AS INT))")).alias("bits"))
    passed = texts.withColumn("key", key).withColumn("word", word).join(F.broadcast(bits), "word").where(F.getbit("bits", bit) == 1)  # FILTER_BITS / 64 rows at most
    return passed.select("key", "item", "text").join(wanted, "key", "left_semi")


def _search_shards(batches):
    """Pairs within RADIUS of each shard and pair of blocks; the rows come sorted by shard, block pair and side, code and uid."""

    def solve(rows: np.ndarray, side: np.ndarray):
        codes = (rows[:, 0].view(np.uint64) & _CODE).astype(np.uint16)
        uid, right = rows[:, 1], side == 1
        if right.any():
            left = ~right
            a, b = pairs_across(codes[left], codes[right], RADIUS)
            return uid[left][a], uid[right][b]
        a, b = pairs_within(codes, RADIUS)
        return uid[a], uid[b]

    rest_rows, rest_at = [], []  # of the shard that the last batch ended in

    def close(rows: np.ndarray, at: np.ndarray):
        """Pairs of whole shards, one after the other."""
        bucket = rows[:, 0] >> CODE_BITS
        pair = at >> 1
        again = np.r_[False, (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1]) & (at[1:] == at[:-1])]
        rows, at, bucket, pair = rows[~again], at[~again], bucket[~again], pair[~again]  # copies that several tasks sent
        starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1])])
        sizes = np.diff(np.r_[starts, len(rows)])
        out = []
        two = starts[(sizes == 2) & (pair[starts] == 0)]  # a tree of one edge, all such trees at once
        codes = (rows[:, 0].view(np.uint64) & _CODE).astype(np.uint16)
        near = two[hamming(codes[two], codes[two + 1]) <= RADIUS]
        out.append((rows[near, 1], rows[near + 1, 1]))
        for a, n in zip(starts[(sizes > 2) | (pair[starts] > 0)].tolist(), sizes[(sizes > 2) | (pair[starts] > 0)].tolist()):
            out.append(solve(rows[a : a + n], at[a : a + n] & 1))
        x, y = np.concatenate([p for p, _ in out]), np.concatenate([p for _, p in out])
        keep = x != y
        x, y = x[keep], y[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([b.column(c).to_numpy() for c in ("packed", "uid")], axis=1)
        at = b.column("at").to_numpy().astype(np.int64)
        shard = np.stack([rows[:, 0] >> CODE_BITS, at >> 1], axis=1)
        change = np.flatnonzero(np.any(shard[1:] != shard[:-1], axis=1))
        last = change[-1] + 1 if len(change) else 0
        if rest_rows and (rest_rows[0][0, 0] >> CODE_BITS != shard[0, 0] or rest_at[0][0] >> 1 != shard[0, 1]):
            yield close(np.concatenate(rest_rows), np.concatenate(rest_at))
            rest_rows, rest_at = [], []
        if last:
            yield close(np.concatenate([*rest_rows, rows[:last]]), np.concatenate([*rest_at, at[:last]]))
            rest_rows, rest_at = [], []
        rest_rows.append(rows[last:])
        rest_at.append(at[last:])
    if rest_rows:
        yield close(np.concatenate(rest_rows), np.concatenate(rest_at))


@F.pandas_udf(T.BooleanType())
def _similar(x: pd.Series, y: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(x, y):
        a, b = np.frombuffer(a, dtype="<u4"), np.frombuffer(b, dtype="<u4")
        common = len(np.intersect1d(a, b, assume_unique=True))
        out.append(common >= SIMILARITY * (len(a) + len(b) - common))
    return pd.Series(out, dtype=bool)


def _texts(items: DataFrame) -> DataFrame:
    return items.select(F.col("item").cast("string").alias("item"), F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("item IS NOT NULL AND id IS NOT NULL AND text IS NOT NULL")


def _blocks_of_large(rows: DataFrame, shard_texts: int) -> DataFrame:
    """(shard, blocks) of the shards that hold more than about shard_texts rows. Shards are first counted together in CELLS
    cells, which map tasks add up before the shuffle, and one by one only where a cell holds that much above the mean."""
    cells = rows.groupBy(F.pmod(F.hash("shard"), F.lit(CELLS)).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    counts = cells.collect()  # at most CELLS small rows
    mean = sum(r["n"] for r in counts) / CELLS
    crowded = [r["cell"] for r in counts if r["n"] > mean + shard_texts]
    marked = F.broadcast(rows.sparkSession.createDataFrame([(c,) for c in crowded], "cell int"))  # CELLS rows at most
    some = rows.withColumn("cell", F.pmod(F.hash("shard"), F.lit(CELLS))).join(marked, "cell", "left_semi")
    return sized(some.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_texts).cast("int").alias("blocks")).where("blocks > 1"))


def link_texts(items: DataFrame, shard_texts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, members). links: a, b, each two different texts of one item kind that are similar, by their uid. members:
    item, id, uid for every text that takes part; texts with the same set of runs have one uid.

    items: item, item_id, text; item names the kind (page, chunk) and only texts of one kind are compared. Texts with
    fewer than MIN_WORDS words, null texts, ids and kinds take no part. A repeated id counts once a text.
    One shuffle brings the texts of a shard together, by 64 bits of shard and code and 64 of uid; then only texts that have
    a candidate are read again and moved, for the exact comparison. The same plan holds at every size."""
    shard_texts = shard_texts or SHARD_TEXTS
    texts = _texts(items)
    sketches = written(_sketches(texts))
    members = sketches.select("item", "id", "uid").distinct()
    rows = sketches.where("bands IS NOT NULL").select(F.explode("bands").alias("packed"), "uid").withColumn("shard", F.shiftright("packed", CODE_BITS))
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    cut_up = rows.join(_blocks_of_large(rows, shard_texts), "shard", "left").withColumn("block", F.pmod(F.xxhash64("uid"), blocks).cast("int"))
    other = F.explode(F.when(blocks == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))).alias("other")
    each = cut_up.select("packed", "uid", "block", other)
    # Both sides of a pair of blocks meet by the same number; a block with itself has one side only.
    pair = F.least("block", "other") * F.lit(1 << 15) + F.greatest("block", "other")
    placed = each.select("packed", "uid", (pair.cast("long") * 2 + (F.col("block") > F.col("other")).cast("int")).alias("at"))
    spread = placed.repartition(F.shiftright("packed", CODE_BITS), F.shiftright("at", 1)).sortWithinPartitions(F.shiftright("packed", CODE_BITS), "at", "packed", "uid")
    near = cut(spread.mapInArrow(_search_shards, "a long, b long").distinct())
    asked = near.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    sets = cut(_run_sets(_texts_of(texts, members, asked)).groupBy("uid").agg(F.first("runs").alias("runs")))
    checked = near.join(sets.select(F.col("uid").alias("a"), F.col("runs").alias("x")), "a").join(sets.select(F.col("uid").alias("b"), F.col("runs").alias("y")), "b")
    return checked.where(_similar("x", "y")).select("a", "b"), members


def duplicate_pairs(items: DataFrame, all_pairs_of_copies: int | None = ALL_PAIRS_OF_COPIES) -> DataFrame:
    """(item, id_a, id_b), id_a < id_b: every two texts of a kind whose common runs are at least SIMILARITY of all their
    runs, stored repeats included. Within a group of more than all_pairs_of_copies exact copies, and between two groups
    that are both that large, each member is paired with the representatives only, which duplicate_groups names for each
    text, so no link is lost; None pairs them all."""
    links, members = link_texts(items)
    links, members = cut(links), cut(members)
    classes = members.groupBy("uid").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    linked = links.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    # Only classes that come out: those of several members, and those with a link.
    own = classes.join(linked.withColumn("linked", F.lit(True)), "uid", "left").where("n > 1 OR linked")
    everyone = cut(members.join(own.select("uid", "rep", "n"), "uid"))
    spoken = F.lit(True) if all_pairs_of_copies is None else (F.col("n") <= all_pairs_of_copies) | (F.col("id") == F.col("rep"))
    # Of a large group only the representative speaks for it, so a join below meets each member at most that often.
    speakers = everyone.where(spoken).select("uid", F.col("id").alias("other"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(own.where("n > 1").select(F.col("uid").alias("a"), F.col("uid").alias("b")))
    met = both.join(everyone.select(F.col("uid").alias("a"), "item", "id"), "a").join(speakers.withColumnRenamed("uid", "b"), "b").where("id <> other")
    return met.select("item", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def duplicate_groups(items: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(item, id, rep, group_id, links) for every text that takes part: rep is the smallest id with the same set of runs,
    group_id the smallest id reachable over links, links the number of different texts it is similar to. Components by
    large and small stars, each round a shuffle; an error if they have not settled after the rounds."""
    links, members = link_texts(items)
    links, members = cut(links), cut(members)
    reps = cut(members.groupBy("item", "uid").agg(F.min("id").alias("rep")))
    ends = links.join(reps.select(F.col("uid").alias("a"), "item", F.col("rep").alias("u")), "a").join(reps.select(F.col("uid").alias("b"), F.col("rep").alias("v")), "b").select("item", "u", "v")
    links = cut(ends)
    edges, before, settled = links, None, False
    for _ in range(rounds):
        sym = edges.unionByName(edges.select("item", F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("item", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.where("v > u").join(low, ["item", "u"]).select("item", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("item", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["item", "u"]).select("item", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("item", "u", F.col("m").alias("v"))).where("u <> v")
        edges = cut(small.distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("item", "u", "v") % 1_000_000_007)).first()
        if state == before:
            settled = True
            break
        before = state
    if not settled:
        raise RuntimeError(f"components of near-duplicates have not settled after {rounds} rounds")
    root = edges.groupBy("item", "u").agg(F.min("v").alias("root")).withColumnRenamed("u", "rep")
    degree = links.select("item", F.explode(F.array("u", "v")).alias("rep")).groupBy("item", "rep").agg(F.count(F.lit(1)).alias("links"))
    out = members.join(reps, ["item", "uid"]).join(root, ["item", "rep"], "left").join(degree, ["item", "rep"], "left")
    return out.select("item", "id", "rep", F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
