"""Helpers shared by the operators: the shared folder, stored tables, key-ordered shards, hot-key joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; in a local session without that setting, an own temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="repolens-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: later readers neither recompute nor depend on executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shard_bounds(df: DataFrame, key: str, shards: int | None = None) -> list[int]:
    """Ascending upper bounds (values of `key` that occur) that cut the rows into about equal shards.

    Reads the key column alone; the list has at most as many entries as the session has shuffle partitions.
    """
    n = shards or shuffle_width(df.sparkSession)
    at = [i / n for i in range(1, n)]
    found = df.select(F.percentile_approx(key, at, max(10_000, 20 * n))).first()[0] if at else None
    return sorted(set(found or []))


def shard_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds below the key; a null key goes first."""
    if not bounds:
        return F.lit(0)
    # a binary search over a constant, so that the expression stays small
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key <= bounds[middle], search(low, middle)).otherwise(search(middle + 1, high))

    return F.when(key.isNull(), 0).otherwise(search(0, len(bounds))).cast("int")


def deal_by_shard(df: DataFrame, bounds: list[int], shard: str = "shard") -> DataFrame:
    """One partition per shard, in shard order."""
    return df.repartitionById(len(bounds) + 1, F.col(shard))


def starts_of(totals: DataFrame, shard: str, total: str) -> DataFrame:
    """Sum of the totals of all shards before each shard: one row per shard, at most one per shuffle partition."""
    rows = sorted((r[shard], r[total]) for r in totals.select(shard, total).collect())
    out, at = [], 0
    for number, n in rows:
        out.append((number, at))
        at += n
    return totals.sparkSession.createDataFrame(out, f"{shard} int, base long")


def join_spread(rows: DataFrame, groups: DataFrame, key: str, sizes: DataFrame, n: str, by: str, parts: int = 1000) -> DataFrame:
    """Inner join of `rows` with `groups` (one row per key), the rows of a frequent key dealt over several tasks.

    `sizes` (stored, one row per key) counts the rows of each key in `n`. A key with more than 1/`parts` of all rows
    gets a salt from the hash of `by`, and its row of `groups` is repeated for each salt. At most `parts` keys can
    be that frequent, which bounds both the broadcast list of them and the repeated rows.
    """
    total, largest = sizes.agg(F.sum(n), F.max(n)).first()
    limit = max((total or 0) // parts, 1000)
    if (largest or 0) <= limit:
        return rows.join(groups, key)
    hot = F.broadcast(sizes.where(F.col(n) > limit).select(key, F.ceil(F.col(n) / limit).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    salted = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int"))
    repeated = groups.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.drop("_salts").join(repeated.drop("_salts"), [key, "_salt"]).drop("_salt")
