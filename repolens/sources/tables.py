"""Index tables: scan, append, insert-if-absent, upsert, reset, delete and counts.

Tables are Parquet folders partitioned by `repo_hash`. Operators are frame -> frame, so a caller
decides where the result is written; `write_table` replaces only the partitions it touches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables holding rows of a repository; run tables are kept when a repository is deleted.
REPO_TABLES = (
    "repos", "files", "symbols", "refs", "symbol_embeddings", "flows", "clusters",
    "cluster_dependencies", "invariants", "index_jobs", "search_names", "search_words", "search_grams",
)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Append, or overwrite only the repositories present in `df` (dynamic partition overwrite).

    Rows are spread by a salted key before the write, so a big repository becomes many files written
    by many tasks instead of one.
    """
    (
        df.repartition("repo_hash", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo_hash")
        .parquet(f"{root}/{name}")
    )


def scan(table: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Rows of the wanted repositories (all when `repos` is None)."""
    return table if repos is None else table.join(repos.select("repo_hash"), "repo_hash", "left_semi")


def scan_invariants(invariants: DataFrame) -> DataFrame:
    return invariants.orderBy(F.desc("confidence"), "invariant_id")


def append(existing: DataFrame, incoming: DataFrame, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Keep every row, parallel duplicates included; fill the given defaults into new rows."""
    for name, value in (defaults or {}).items():
        current = F.col(name) if name in incoming.columns else F.lit(None)
        incoming = incoming.withColumn(name, F.coalesce(current, value))
    return existing.unionByName(incoming.select(*existing.columns))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Add the first row per key, only for keys the table does not hold yet."""
    rest = [c for c in existing.columns if c not in keys]
    first = (
        incoming.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(seq)).alias("row"))
        .select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])
    )
    return existing.unionByName(first.join(existing, list(keys), "left_anti").select(*existing.columns))


def ids_for(incoming: DataFrame, table: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """Stored id next to every input row (replaces ids aligned with an input list)."""
    return incoming.join(table.select(*keys, id_column), list(keys), "left")


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    seq: str,
    *,
    overwrite: Sequence[str] = (),
    if_present: Sequence[str] = (),
    on_insert: Sequence[str] = (),
) -> DataFrame:
    """Merge rows by key in arrival order.

    `overwrite` takes the last row's value even when null, `if_present` the last value that is not
    null, `on_insert` the first row's value. One aggregation, so rows combine before the shuffle.
    """
    order = F.col("_seq")
    both = existing.withColumn("_seq", F.lit(None).cast("bigint")).unionByName(
        incoming.withColumn("_seq", F.col(seq).cast("bigint")).select(*existing.columns, "_seq")
    )
    rank = F.struct(F.coalesce(order, F.lit(-(2**62))))
    picks = [F.max_by(F.struct(c), rank).getField(c).alias(c) for c in overwrite]
    picks += [F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in if_present]
    picks += [F.min_by(F.struct(c), rank).getField(c).alias(c) for c in on_insert]
    return both.groupBy(*keys).agg(*picks).select(*existing.columns)


def assign_clusters(files: DataFrame, assignments: DataFrame) -> DataFrame:
    """Set `cluster_id` on the assigned files; a null assignment clears it."""
    assigned = assignments.select("repo_hash", "file_path", F.col("cluster_id").alias("_new"), F.lit(True).alias("_hit"))
    return (
        files.join(assigned, ["repo_hash", "file_path"], "left")
        .withColumn("cluster_id", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("cluster_id")))
        .drop("_new", "_hit")
    )


def without_repos(table: DataFrame, repos: DataFrame) -> DataFrame:
    """Delete or reset: rows of the given repositories are gone; unknown repositories are no error."""
    return table.join(repos.select("repo_hash").distinct(), "repo_hash", "left_anti")


def clear_file_clusters(files: DataFrame, repos: DataFrame) -> DataFrame:
    """The file half of a cluster reset."""
    gone = repos.select("repo_hash", F.lit(True).alias("_gone")).distinct()
    return (
        files.join(gone, "repo_hash", "left")
        .withColumn("cluster_id", F.when(F.col("_gone").isNull(), F.col("cluster_id")))
        .drop("_gone")
    )


def delete_repos(tables: Mapping[str, DataFrame], repos: DataFrame) -> dict[str, DataFrame]:
    """Remove repositories from every repository table; other tables come back unchanged."""
    return {n: without_repos(df, repos) if n in REPO_TABLES else df for n, df in tables.items()}


def layer_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per repository and table, one aggregation over all tables."""
    tagged = None
    for name, df in tables.items():
        one = df.select("repo_hash", F.lit(name).alias("layer_table"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy("repo_hash", "layer_table").agg(F.count("*").alias("n"))
