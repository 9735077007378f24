"""Top rows per group without handing a hot group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this limit Spark itself prunes every map task to the first k rows of a group
# (WindowGroupLimit, spark.sql.optimizer.windowGroupLimitThreshold).
BUILT_IN_LIMIT = 1000

c = F.col


def top_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int, rank: str = "rank", salts: int = 64
) -> DataFrame:
    """First `limit` rows of every group under a total order, with their rank from 1.

    Above the built-in limit the group is cut in salted parts first; only the first rows of each
    part meet in the final window, so the last task sees at most `limit * salts` rows of a group.
    """
    if limit > BUILT_IN_LIMIT:
        parts = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
        inner = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = parts.withColumn("_first", F.row_number().over(inner)).where(F.col("_first") <= limit).drop("_salt", "_first")
    outer = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= limit)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key under an order; combines before the shuffle, keeps no window."""
    rest = [x for x in df.columns if x not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{x}").alias(x) for x in rest])
    )


def spread_join(asked: DataFrame, rows: DataFrame, keys: Sequence[str], by: Sequence[str], salts: int = 16) -> DataFrame:
    """Inner join whose result is far larger than its sides: the rows of a key are dealt over tasks, each of which meets all that ask for it.

    The narrow `asked` is repeated for each salt, `rows` are not; the number of tasks does not follow the small size of the sides.
    """
    width = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    repeated = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return repeated.repartition(width, *keys, "_salt").join(dealt, [*keys, "_salt"]).drop("_salt")


def broadcast_small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """The narrow table with a broadcast hint when a count finds at most `most` rows, so that the large side of its join is not shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fan_out(askers: DataFrame, rows: DataFrame, key: str, hot: int = 10_000) -> DataFrame:
    """Rows of each answer `key` for all that asked for it, without `key`: the join is the last step, its result meets no shuffle.

    A null key meets the rows of a null key. The askers of a key that more than `hot` share are dealt over tasks, each with the rows of the key. Such keys are at most
    one in `hot` askers, so their list is broadcast.
    """
    many = askers.groupBy(key).agg(F.count("*").alias("_n")).where(c("_n") > hot).select(key, F.ceil(c("_n") / hot).cast("int").alias("_parts"))
    many = F.broadcast(many)
    dealt = askers.join(many, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*askers.columns), "_parts").cast("int"), F.lit(0))).drop("_parts")
    last = F.coalesce("_parts", F.lit(1)) - 1
    repeated = rows.join(many, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), last))).drop("_parts")
    repeated = repeated.withColumnsRenamed({key: "_key", "_part": "_of"})
    return dealt.join(repeated, c(key).eqNullSafe(c("_key")) & (c("_part") == c("_of"))).drop(key, "_part", "_key", "_of")
