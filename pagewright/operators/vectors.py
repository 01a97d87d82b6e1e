"""Exact and hashed search among dense vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.sources.tables import cut, sized

#: Queries of one block and vectors of one block, about: a task compares two blocks, QUERY_ROWS queries at a time.
QUERY_BLOCK, VECTOR_BLOCK, QUERY_ROWS = 4096, 16384, 512
#: Vectors of one bucket of the hashed search, about, and the most rows of one block of a bucket, about.
HASH_ROWS, HASH_BLOCK = 2000, 8192


def common_size(vectors: DataFrame) -> int:
    """The most frequent size of the vectors, the smaller of equals; 0 for none."""
    most = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return most["dim"] if most else 0


def knn(vectors: DataFrame, queries: DataFrame, k: int = 5, dim: int | None = None, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors of highest cosine above 0 for each query, itself apart; ties by id.

    vectors and queries: vec_id, embedding. dim: the size of vectors that count, else the most frequent one; zero, null and
    other vectors have no neighbours. Blocks of queries meet blocks of vectors in one cogroup, as matrices; each pair of
    blocks keeps its own best k, which a window merges. Nothing but counts comes to the driver."""
    dim = common_size(vectors) if dim is None else dim
    usable = lambda df: df.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(F.size("embedding") == dim).select("vec_id", "embedding")
    base, asked = usable(vectors), usable(queries)
    blocks = lambda df, most: max(1, -(-df.count() // most))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    nq = blocks(asked, query_block)
    nv = max(blocks(base, vector_block), -(-vectors.sparkSession.sparkContext.defaultParallelism // nq))
    q = asked.withColumn("b", own(nq)).withColumn("a", every(nv))
    v = base.withColumn("a", own(nv)).withColumn("b", every(nq))

    def best(ask: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        parts = [next(_best_of(ask.iloc[at : at + QUERY_ROWS], k, dim)([others])) for at in range(0, len(ask), QUERY_ROWS)] if len(others) else []
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    # An explicit number of parts, as blocks would otherwise be merged into few tasks.
    parts = min(nq * nv, 10_000)
    found = q.repartition(parts, "a", "b").groupBy("a", "b").cogroup(v.repartition(parts, "a", "b").groupBy("a", "b")).applyInPandas(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(rows: pd.Series, dim: int) -> np.ndarray:
    m = np.array(rows.to_list(), dtype=np.float64).reshape(-1, dim)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.where(np.isfinite(norm) & (norm > 0), m / np.where(norm > 0, norm, 1), 0)


def _best_of(queries: pd.DataFrame, k: int, dim: int):
    unit, ids = _unit(queries["embedding"], dim), queries["vec_id"].to_numpy()

    def run(batches):
        for b in batches:
            near = np.round(unit @ _unit(b["embedding"], dim).T, 6)
            own = b["vec_id"].to_numpy()
            near[ids[:, None] == own[None, :]] = 0
            q, v = np.nonzero(near > 0)
            out = pd.DataFrame({"query_id": ids[q], "vec_id": own[v], "score": near[q, v]}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            yield out.groupby("query_id").head(k)

    return run


def label_agreement(neighbours: DataFrame, vectors: DataFrame) -> DataFrame:
    """(label, neighbours, agreement): the share of neighbours that have their query's label."""
    q = vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("label"))
    v = vectors.select("vec_id", F.col("label").alias("other"))
    own = neighbours.join(q, "query_id").join(v, "vec_id")
    return own.groupBy("label").agg(F.count(F.lit(1)).alias("neighbours"), F.round(F.avg((F.col("label") == F.col("other")).cast("double")), 6).alias("agreement"))


def sure_cosine(bits: int, tables: int, recall: float) -> float:
    """The cosine from which two vectors share a bucket of one of the tables with at least this probability: signs of
    random projections differ with probability angle / pi."""
    same = (1 - (1 - recall) ** (1 / tables)) ** (1 / bits)
    return float(np.cos(np.pi * (1 - same)))


def knn_hashed(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = 8, recall: float = 0.99, block: int = HASH_BLOCK, dim: int | None = None) -> DataFrame:
    """As knn, with candidates from buckets of random projections where these are enough, and the exact search elsewhere.

    A bucket is the signs of `bits` projections, so many that buckets hold about HASH_ROWS vectors and all tables together
    compare a quarter of the pairs at most where vectors spread. A query is settled by its buckets when its k best
    there all have the sure_cosine of that many bits: a nearer vector was then met with probability `recall` at least. All
    other queries, those of fewer than k hits among them, get knn: on vectors without near neighbours that is nearly every
    query. Buckets are cut into blocks of about `block` vectors and queries, so hot ones are spread.
    dim: the size of vectors that count, else the most frequent one."""
    dim = common_size(vectors) if dim is None else dim

    def usable(df: DataFrame) -> DataFrame:
        own = df.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(F.size("embedding") == dim).where(F.exists("embedding", lambda x: x != 0))
        return cut(own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))

    base, asked = usable(vectors), usable(queries)
    bits = max(int(np.ceil(np.log2(4 * tables))), int(np.ceil(np.log2(max(base.count(), 1) / HASH_ROWS))))
    planes = np.random.default_rng(3).normal(size=(dim, tables * bits))

    def hashed(df: DataFrame) -> DataFrame:
        def run(batches):
            weights = 1 << np.arange(bits, dtype=np.int64)
            for b in batches:
                signs = (np.stack(b["embedding"].to_list()) @ planes > 0).reshape(-1, tables, bits) if len(b) else np.zeros((0, tables, bits), bool)
                keys = (signs @ weights) * tables + np.arange(tables)
                yield b.assign(keys=list(keys))

        return df.mapInPandas(run, "vec_id long, embedding array<double>, keys array<long>").select("vec_id", "embedding", F.explode("keys").alias("key"))

    v, q = hashed(base), hashed(asked)
    blocks = lambda df, name: df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = sized(blocks(v, "v_blocks").join(blocks(q, "q_blocks"), "key"))
    part = lambda of: F.pmod(F.xxhash64("vec_id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    v = v.join(sizes, "key").withColumn("a", part("v_blocks")).withColumn("b", every("q_blocks")).select("key", "a", "b", "vec_id", "embedding")
    q = q.join(sizes, "key").withColumn("b", part("q_blocks")).withColumn("a", every("v_blocks")).select("key", "a", "b", "vec_id", "embedding")

    def best(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        parts = [next(_best_of(own.iloc[at : at + QUERY_ROWS], k, dim)([others])) for at in range(0, len(own), QUERY_ROWS)] if len(others) else []
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    met = q.groupBy("key", "a", "b").cogroup(v.groupBy("key", "a", "b")).applyInPandas(best, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = cut(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    settled = near.where((F.col("rank") == k) & (F.col("score") >= sure_cosine(bits, tables, recall))).select("query_id")
    rest = asked.join(settled.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    return near.join(settled, "query_id", "left_semi").unionByName(knn(base, rest, k, dim).select("query_id", "vec_id", "score", "rank"))
