"""Sublinear TF-IDF as sparse postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.text import tokens
from pagewright.sources.tables import cut, sized


def term_counts(texts: DataFrame, key: str, stop_words: DataFrame) -> DataFrame:
    """(key, term, tf): how often each term occurs in each text, stop words (column word) left out."""
    found = texts.select(key, F.explode(tokens(F.col("text"))).alias("term"))
    stop = stop_words.select(F.lower("word").alias("term")).distinct()
    return found.join(stop, "term", "left_anti").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def idf(counts: DataFrame, documents: int) -> DataFrame:
    """(term, df, idf) with idf = ln((N + 1) / (df + 1)) + 1, N counting texts without terms too."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log((F.lit(documents) + 1) / (F.col("df") + 1)) + 1)


def postings(counts: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, term, weight, norm): weight = (1 + ln tf) * idf, terms outside the corpus left out; norm is the length of
    the text's vector."""
    own = counts.join(weights.select("term", "idf"), "term").withColumn("weight", (1 + F.log("tf")) * F.col("idf"))
    norms = own.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return own.select(key, "term", "weight").join(norms, key)


def cosine(queries: DataFrame, corpus: DataFrame, query_key: str, key: str) -> DataFrame:
    """(query_key, key, score): cosines above 0 of all pairs that share a term, to 6 places. The join is by term, so pairs
    without one are never made."""
    q = queries.select(query_key, "term", F.col("weight").alias("qw"), F.col("norm").alias("qn"))
    hit = q.join(corpus, "term").groupBy(query_key, key).agg(F.sum(F.col("qw") * F.col("weight")).alias("dot"), F.first("qn").alias("qn"), F.first("norm").alias("norm"))
    return hit.select(query_key, key, F.round(F.col("dot") / (F.col("qn") * F.col("norm")), 6).alias("score")).where("score > 0")


#: Postings of one term that one task joins; those of more frequent terms are spread by key.
TERM_ROWS = 1 << 20
#: A query's rarest terms with so many postings together, and its rarest one anyway, give the floor of its k-th score.
SEED_ROWS = 1000
#: Scores have 6 places, so what could round to the floor is kept.
_MARGIN = 2e-6


def best_cosine(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, k: int, term_rows: int = TERM_ROWS, seed_rows: int = SEED_ROWS) -> DataFrame:
    """(query_key, key, score) with the k best of each query among them, as cosine gives them, ties at the k-th place
    included; for query sets that grow with the corpus, where cosine would meet nearly all pairs by frequent terms.

    The k-th score over a query's rarest terms is a floor of its k-th score. Its most frequent terms are left out of the
    join while the most they could add together is below the floor: a text that has none of the other terms can't be among
    the best. Texts that could still reach the floor then get what the left out terms add. Nothing is cut off: a query
    with fewer than k texts for its rarest terms, or with frequent terms only, joins by all of them."""
    terms = sized(queries.select("term").distinct())
    kept = cut(corpus.select(key, "term", "weight", "norm").join(terms, "term", "left_semi"))
    bounds = cut(kept.groupBy("term").agg(F.max(F.col("weight") / F.col("norm")).alias("most"), F.count(F.lit(1)).alias("df")))
    heavy = sized(bounds.where(F.col("df") > term_rows).select("term", F.ceil(F.col("df") / term_rows).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    spread = kept.join(heavy, "term", "left").withColumn("part", F.pmod(F.xxhash64(key), parts).cast("int")).drop("parts")
    of = Window.partitionBy(query_key)
    rarest = of.orderBy("df", "term")
    own = queries.select(query_key, "term", F.col("weight").alias("qw"), F.col("norm").alias("qn")).join(bounds, "term").withColumn("cap", F.col("qw") / F.col("qn") * F.col("most"))
    own = cut(own.withColumn("seed", (F.row_number().over(rarest) == 1) | (F.sum("df").over(rarest) <= seed_rows)).join(heavy, "term", "left"))

    def met(asked: DataFrame, *carried: str) -> DataFrame:
        each = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(query_key, "term", "part", "qw", "qn", *carried)
        sums = [F.sum(F.col("qw") * F.col("weight")).alias("dot"), *(F.first(c).alias(c) for c in ("qn", "norm", *carried))]
        return each.join(spread, ["term", "part"]).groupBy(query_key, key).agg(*sums).withColumn("part_score", F.col("dot") / (F.col("qn") * F.col("norm")))

    first = met(own.where("seed")).withColumn("place", F.row_number().over(of.orderBy(F.desc("part_score")))).where(F.col("place") <= k)
    floors = first.groupBy(query_key).agg(F.min("part_score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).drop("n")
    floor = F.coalesce("floor", F.lit(0.0)) - _MARGIN
    known = own.join(floors, query_key, "left").withColumn("floor", floor).withColumn("left_out", F.sum("cap").over(of.orderBy(F.desc("df"), "term")) < F.col("floor"))
    out = F.col("left_out")
    known = known.withColumn("others", F.collect_list(F.when(out, F.struct("term", "qw"))).over(of)).withColumn("rest", F.coalesce(F.sum(F.when(out, F.col("cap"))).over(of), F.lit(0.0)))
    could = met(known.where(~out), "others", "rest", "floor").where(F.col("part_score") + F.col("rest") >= F.col("floor"))
    each = could.select(query_key, key, "dot", "qn", "norm", F.explode_outer("others").alias("o")).select(query_key, key, "dot", "qn", "norm", F.col("o.term").alias("term"), F.col("o.qw").alias("qw"))
    more = each.join(kept.select(key, "term", "weight"), [key, "term"], "left").groupBy(query_key, key).agg(
        (F.first("dot") + F.coalesce(F.sum(F.col("qw") * F.col("weight")), F.lit(0.0))).alias("dot"), F.first("qn").alias("qn"), F.first("norm").alias("norm")
    )
    return more.select(query_key, key, F.round(F.col("dot") / (F.col("qn") * F.col("norm")), 6).alias("score")).where("score > 0")


#: Folders of a stored index; a query reads those of its terms.
BUCKETS = 64


def bucket(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def store_index(texts: DataFrame, key: str, stop_words: DataFrame, folder: str) -> None:
    """Fit once: terms with their idf, and postings with weights and norms in BUCKETS folders by term, each spread over
    some files, so that a term of a third of the texts is no file of its own. texts: key, text."""
    counts = cut(term_counts(texts, key, stop_words))
    weights = idf(counts, texts.count())
    weights.write.mode("overwrite").parquet(f"{folder}/terms")
    stored = postings(counts, texts.sparkSession.read.parquet(f"{folder}/terms"), key).withColumn("bucket", bucket("term"))
    stored.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")


def search_index(spark: SparkSession, folder: str, queries: DataFrame, query_key: str, key: str, stop_words: DataFrame, k: int | None = None) -> DataFrame:
    """(query_key, key, score) of queries (query_key, text) against a stored index; as cosine over the same texts, or as
    best_cosine where k is given."""
    counts = cut(term_counts(queries.select(query_key, "text"), query_key, stop_words))
    asked = postings(counts, spark.read.parquet(f"{folder}/terms"), query_key)
    wanted = sorted(r[0] for r in counts.select(bucket("term")).distinct().collect())  # BUCKETS at most
    corpus = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(wanted)).drop("bucket")
    return cosine(asked, corpus, query_key, key) if k is None else best_cosine(asked, corpus, query_key, key, k)
