"""Personal information in free text: seed entities teach contexts, contexts find entities that no grammar knows."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.mentions import mentions
from pagewright.sources.tables import cut, sized

#: A context is trusted when at least so many of its places are known entities, and this share of them.
MIN_SEEDS = 3
MIN_SHARE = 0.6
#: An instance (surname, number shape) is trusted when so many of its places are accepted by patterns of one side (before,
#: after, both), and this share of them.
MIN_ACCEPTED = 2
MIN_ACCEPTED_SHARE = 0.7
ROUNDS = 3
#: The list of given names is read by the driver and sent to the tasks.
MAX_GIVEN_NAMES = 1_000_000
_SCHEMA = "doc_id long, text_key long, start_pos int, end_pos int, kind string, sure boolean, seed boolean, instance long, patterns array<long>"


def scan(docs: DataFrame, given_names: DataFrame) -> DataFrame:
    """Every place of the texts that may be personal information, with hashes of its instance and its contexts."""
    names = given_names.select(F.lower(F.trim(F.col("given_name").cast("string"))).alias("n")).where("n <> ''").distinct().limit(MAX_GIVEN_NAMES + 1).collect()
    if len(names) > MAX_GIVEN_NAMES:
        raise ValueError(f"more than {MAX_GIVEN_NAMES} given names")
    given = frozenset(r["n"] for r in names)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    own = own.where("doc_id IS NOT NULL AND text <> ''")
    signed = lambda s: xxhash.xxh64_intdigest(s) - 2**63

    def find(batches):
        for b in batches:
            rows = ([], [], [], [], [], [], [], [], [])
            for doc, text, key in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("text_key").to_pylist()):
                for start, end, kind, sure, seed, instance, patterns in mentions(text, given):
                    for column, value in zip(rows, (doc, key, start, end, kind, sure, seed, signed(kind + instance.lower()), [signed(p) for p in patterns])):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], [c.split()[0] for c in _SCHEMA.split(", ")])

    return own.mapInArrow(find, _SCHEMA)


def _trusted(counts: DataFrame, key: str, least: int, share: float) -> DataFrame:
    return counts.where((F.col("good") >= least) & (F.col("good") >= share * F.col("n"))).select(key).distinct()


def pattern_graph(places: DataFrame) -> DataFrame:
    """(side, pattern, instance, n, seeds, sures), written once: how many places each pattern and instance have in common. A
    frequent context or name is one row a partner here, however many places it has."""
    each = places.where(F.size("patterns") > 0).select("instance", "seed", "sure", F.posexplode("patterns").alias("side", "pattern"))
    return cut(each.groupBy("side", "pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("seed").cast("long")).alias("seeds"), F.sum(F.col("sure").cast("long")).alias("sures")))


def bootstrap(places: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern) and (instance): what is trusted after the rounds.

    A round scores the patterns by the share of their places that are seeds or of trusted instances, accepts the places
    of trusted patterns, and scores the instances by the share of their places that are accepted. Rounds join the counts
    of pattern_graph, not places; nothing of it comes to the driver."""
    edges = pattern_graph(places)
    known = None
    for _ in range(rounds):
        good = F.col("seeds")
        scored = edges
        if known is not None:
            scored = edges.join(known.withColumn("known", F.lit(True)), "instance", "left")
            good = F.when(F.col("known"), F.col("n")).otherwise(good)
        patterns = sized(_trusted(scored.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum(good).alias("good")), "pattern", MIN_SEEDS, MIN_SHARE))
        hits = edges.join(patterns.withColumn("hit", F.lit(True)), "pattern", "left")
        accepted = hits.groupBy("instance", "side").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(F.col("sures"))).alias("good"))
        known = sized(_trusted(accepted, "instance", MIN_ACCEPTED, MIN_ACCEPTED_SHARE))
    return patterns, known


def find_personal(docs: DataFrame, given_names: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_key, kind, start_pos, end_pos) of personal information; positions in characters, end exclusive.

    docs: doc_id, text; given_names: given_name. kind is email, phone, id_number, address or name. Rows with a null
    doc_id or a null or empty text have none; equal rows give equal places once; without given names only titles and
    labels seed. Whole texts are read. text_key is xxhash64 of the text, so that texts under one doc_id stay apart. Where
    a number is accepted both as a phone and as an identity number, it is the latter."""
    places = cut(scan(docs, given_names))
    patterns, instances = bootstrap(places, rounds)
    span = ["doc_id", "text_key", "kind", "start_pos", "end_pos"]
    open_ = places.where("NOT sure")
    by_pattern = open_.select(*span, F.explode("patterns").alias("pattern")).join(patterns, "pattern", "left_semi").drop("pattern")
    by_instance = open_.where("kind = 'name'").join(instances, "instance", "left_semi").select(*span)
    learned = cut(by_pattern.unionByName(by_instance).distinct())
    numbers = learned.where("kind = 'id_number'").select("doc_id", "text_key", F.lit("phone").alias("kind"), "start_pos")
    learned = learned.join(numbers, ["doc_id", "text_key", "kind", "start_pos"], "left_anti").select(*span)
    return places.where("sure").select(*span).unionByName(learned).distinct()


@F.pandas_udf(T.StringType())
def _replace(text: pd.Series, found: pd.Series) -> pd.Series:
    out = []
    for t, spans in zip(text, found):
        if t is not None and spans is not None and len(spans):
            parts, at = [], 0
            for s in sorted(spans, key=lambda s: (s["start_pos"], -s["end_pos"])):
                if s["start_pos"] >= at:
                    parts += [t[at : s["start_pos"]], f"[{s['kind'].upper()}]"]
                    at = s["end_pos"]
            t = "".join([*parts, t[at:]])
        out.append(t)
    return pd.Series(out, dtype=object)


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text, places): each text with typed placeholders such as [EMAIL] in place of what was found.

    Where places overlap the first, then the longest, is replaced. Texts without a place stay in the JVM. A text with
    very many places is one row of its own, as long as the text."""
    spans = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start_pos", "end_pos", "kind")).alias("found"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    joined = own.join(spans, ["doc_id", "text_key"], "left")
    touched = joined.where("found IS NOT NULL").select("doc_id", _replace("text", "found").alias("text"), F.size("found").alias("places"))
    return touched.unionByName(joined.where("found IS NULL").select("doc_id", "text", F.lit(0).alias("places")))
