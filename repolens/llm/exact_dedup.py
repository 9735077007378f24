"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by the digest of the normalised text (all characters of
[\\x20\\x09-\\x0D] deleted). A batch is summed to one row per digest, the digests that the index does not hold
are found with a sort-merge anti-join that moves the batch alone, and those are appended. The row that stays for
a digest is the one that the index holds, else the row of the batch with the most code points, then the smallest
doc_id. Null text counts as empty; a null doc_id loses against any other. Rows that share doc_id and digest all
count in `group_size`; `distinct_documents` keeps one of them. It carries the decision by digest, never by doc_id
alone: rows with null or shared ids and different texts all stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, join_spread, new_path, shuffle_width, stored

INDEX = "digest string, keep_id long, n_chars int"


def digest_of(text: str) -> Column:
    return F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, ""), 256)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, digest) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("n_chars"), digest_of("text").alias("digest"))


class DigestIndex:
    """The digests seen so far, at `path`; a later session opens the same path with the same number of buckets."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or new_path(spark, "digest-index")
        self.buckets = buckets or shuffle_width(spark)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({INDEX}) USING parquet LOCATION '{self.path}' "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, found: DataFrame) -> None:
        found.select("digest", "keep_id", "n_chars").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def groups(self, rows: DataFrame) -> DataFrame:
        """(digest, group_size, best) of the digests of a batch."""
        best = F.min(F.struct((-F.col("n_chars")).alias("order"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
        return rows.groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("best"))

    def fresh(self, groups: DataFrame) -> DataFrame:
        """(digest, keep_id, n_chars) of the digests that the index does not hold."""
        found = groups.join(self.rows().hint("merge"), "digest", "left_anti")
        return found.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.order")).alias("n_chars"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Append the new digests of a batch; (doc_id, keep_id, group_size, kept, text_sha256) of every row of it."""
        rows = stored(digests(batch), "digests")
        groups = stored(self.groups(rows), "digest-groups")
        self.append(self.fresh(groups))
        held = groups.select("digest", "group_size").join(self.rows().select("digest", "keep_id").hint("merge"), "digest")
        return join_spread(rows, held, "digest", groups.select("digest", "group_size").withColumnRenamed("group_size", "n"), "n", "doc_id").select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The decision on every row of `docs`."""
    return (index or DigestIndex(docs.sparkSession)).add(docs)


def chosen_rows(docs: DataFrame, digest: Column, chosen: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The row of `docs` for each (doc_id, n_chars, digest) of `chosen`, whose digests are distinct.

    Of rows that share all three the one whose columns are largest stays. `known` may give the three of every row, so that
    copies are counted without another look at the texts. A row travels packed, whatever its columns are called.
    """
    chosen = stored(chosen.select(F.col("doc_id").alias("chosen_id"), F.col("n_chars").alias("chosen_n"), F.col("digest").alias("chosen_digest")), "chosen")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), digest.alias("digest"), row)

    def among(rows: DataFrame) -> DataFrame:
        # a sort-merge join at every size: the keys grow with the rows, so they are no side to broadcast
        same = (F.col("digest") == F.col("chosen_digest")) & (F.col("n_chars") == F.col("chosen_n")) & F.col("doc_id").eqNullSafe(F.col("chosen_id"))
        return rows.join(chosen.hint("merge"), same, "left_semi")

    found = among(keyed)
    counts = (keyed.drop("row") if known is None else known).groupBy("doc_id", "n_chars", "digest").agg(F.count("*").alias("n"))
    repeated = stored(among(counts.where("n > 1")).select("digest"), "repeated-rows")
    if repeated.isEmpty():
        return found.select("row.*")
    once = found.join(repeated, "digest", "left_semi").groupBy("digest").agg(F.max("row").alias("row"))
    return found.join(repeated, "digest", "left_anti").select("row.*").unionByName(once.select("row.*"))


def distinct_documents(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of `docs` that stay, all columns: one for each digest that is new to the index."""
    index = index or DigestIndex(docs.sparkSession)
    rows = stored(digests(docs), "digests")
    # stored before the anti-join: raw rows of a frequent digest are summed where they are and do not meet in one task
    fresh = stored(index.fresh(stored(index.groups(rows), "digest-groups")), "fresh-digests")
    index.append(fresh)
    return chosen_rows(docs, digest_of("text"), fresh.withColumnRenamed("keep_id", "doc_id"), rows)
