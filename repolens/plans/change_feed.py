"""Deltas between two states of the index, as rows of a change feed.

A state is a table with one row per key. Rows of both states meet by key, a hash of the other columns tells whether a row
is another one, and the feed holds what a reader of the old state needs to have the new one: added and updated rows as
they are now, removed ones by their key. Keys are distinct, so the join has no hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = ("repo_hash", "symbol_id")
EDGE = ("repo_hash", "source_symbol_id", "target_symbol_id", "edge_kind")


def edge_rows(refs: DataFrame) -> DataFrame:
    """Parallel edges as one row with their number."""
    return refs.groupBy(*EDGE).agg(F.count("*").alias("n"))


def change_feed(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys`, `change` (added, updated or removed) and the other columns as they are now (null in removed rows)."""
    rest = [c for c in after.columns if c not in keys]
    row = F.struct(*rest) if rest else F.struct(F.lit(None).alias("none"))

    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.xxhash64(row).alias(f"_{name}"), *([row.alias("_row")] if name == "new" else []))

    both = hashed(before, "old").join(hashed(after, "new"), list(keys), "full")
    old, new = F.col("_old"), F.col("_new")
    change = F.when(old.isNull(), "added").when(new.isNull(), "removed").when(old != new, "updated")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change", *[F.col("_row")[c].alias(c) for c in rest])


def replay(before: DataFrame, feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state after a feed: unnamed rows stay, the others are as the feed says."""
    kept = before.join(feed.select(*keys), list(keys), "left_anti")
    return kept.unionByName(feed.where("change <> 'removed'").select(before.columns))
