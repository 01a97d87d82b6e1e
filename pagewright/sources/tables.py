"""Reading the stored tables, and cutting lineage in the folder the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of few files is spread over the cores only up to this size; what is larger is read as it is stored.
SPREAD_BYTES = 64 << 20


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One stored table; Parquet, so that column pruning and filters reach the scan.

    A table of at most SPREAD_BYTES in fewer files than half the cores is spread over them, as all that follows would run
    on a few cores otherwise. That shuffle is bounded in bytes, however many cores there are."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    small = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SPREAD_BYTES
    return df.repartition(cores) if small and len(df.inputFiles()) * 2 <= cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a temporary folder on local masters (tests, one
    machine), removed at exit; an error on a cluster, whose executors would not share it."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pagewright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: it survives lost executors and is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As cut, but as a table in that folder: for wide rows of which later steps read some columns only."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes that may be broadcast, counting every row with some overhead.
BROADCAST_BYTES = 32 << 20
_WIDTH = {"bigint": 8, "double": 8, "timestamp": 8, "int": 4, "float": 4, "date": 4, "smallint": 2, "tinyint": 1, "boolean": 1}


def fits(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether all rows of df, which are counted and whose strings are measured, may be broadcast. Columns are numbers or strings."""
    texts = [c for c, kind in df.dtypes if kind not in _WIDTH]
    fixed = 32 + sum(_WIDTH.get(kind, 8) for _, kind in df.dtypes)
    rows, chars = df.agg(F.count(F.lit(1)), sum((F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)) for c in texts), F.lit(0))).first()
    return rows * fixed + chars <= most_bytes


def sized(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df, written once and measured: marked for broadcast where it fits, left to a shuffle join beyond."""
    df = cut(df)
    return F.broadcast(df) if fits(df, most_bytes) else df


def hash_sample(df: DataFrame, key: str, most: int, rows: int) -> DataFrame:
    """About the first `most` of the rows by a hash of their key, never more; rows: how many there are, or a bound of it.

    The hash is cut off first where there are many rows, so that the sort meets some 1.5 x most rows however large df is."""
    if rows > 2 * most:
        df = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * 1.5 * most / rows))
    return df.orderBy(F.xxhash64(key), key).limit(most)
