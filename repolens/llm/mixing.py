"""Mix sources to target weights, with DataFrame functions alone.

Tokens (words) are summed per source; every source gets a share of all words by its weight, at most `most` times
its own size, the excess going to the others by weight. The repetition rate of a source is target / size: each of
its documents is taken floor(rate) times, and once more if a number in [0, 1) made from the seed and the doc_id
lies below the fraction of the rate. Null source is a source of its own, null text has size 0, a null doc_id hashes
as the empty string; rows with equal doc_id get equal copies. A source without words has target and rate 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (1, 2, 3)
SEED = "mix-1"


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, target): one row per source.

    Sources are ordered by most * size / weight; those before some place are held at their bound, and the rest share
    what is left by weight. The place is the first one where the share of the next source is within its bound. The
    windows run over the sums per source, not over documents.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    by_bound = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = by_bound.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    placed = (
        totals.withColumn("weight", weight.cast("long"))
        .withColumn("left_size", F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("within", F.col("left_size") * F.col("weight") <= most * F.col("source_size") * F.col("left_weight"))
        .withColumn("place", F.row_number().over(by_bound))
        .withColumn("first", F.min(F.when(F.col("within"), F.col("place"))).over(every))
    )
    share = placed.withColumn("a", F.max(F.when(F.col("place") == F.col("first"), F.col("left_size"))).over(every)).withColumn(
        "b", F.max(F.when(F.col("place") == F.col("first"), F.col("left_weight"))).over(every))
    capped = F.col("first").isNull() | (F.col("place") < F.col("first"))
    target = F.when(capped, (most * F.col("source_size")).cast("double")).otherwise((F.col("a") * F.col("weight")).cast("double") / F.col("b"))
    return share.select("source", "source_size", target.alias("target"))


def unit_interval(doc_id, seed: str):
    """52 bits of an MD5 as a number in [0, 1)."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = 3, seed: str = SEED) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies) of each row; `row` has all columns of `docs`."""
    targets = stored(source_targets(with_size(docs.select("source", "text")), weights, most), "mix-targets")
    named = targets.withColumnRenamed("source", "target_source")
    if targets.count() <= 100_000:  # one row of three values per source: a few megabytes at most
        named = F.broadcast(named)
    sized = with_size(docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")).drop("text")
    joined = sized.join(named, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (unit_interval(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", F.floor(rate) + extra)


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: int = 3, seed: str = SEED) -> DataFrame:
    """The mix itself: each row `copies` times, with the columns of `docs`."""
    return mix(docs, weights, most, seed).where("copies > 0").select(
        "row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
