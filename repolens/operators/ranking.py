"""Ranking signals over the symbols of a repository and their weighted score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import paths, vectors

from repolens.session import cut_lineage

from .graphs import out_degree, pagerank

SIGNALS = (
    "structural_centrality", "change_recency", "co_change_correlation", "embedding_similarity", "test_coverage_proxy",
)
# Weight of each signal by task type, in the order of SIGNALS.
WEIGHTS = {
    "modify existing": (0.35, 0.10, 0.10, 0.35, 0.10),
    "add new code": (0.15, 0.30, 0.30, 0.15, 0.10),
    "understand": (0.20, 0.05, 0.05, 0.60, 0.10),
}

c = F.col


def weight_rows(spark) -> DataFrame:
    """The weight table in long form: `(task_type, signal, weight)`."""
    wide = spark.createDataFrame([(k, *v) for k, v in WEIGHTS.items()], ["task_type", *SIGNALS])
    return wide.unpivot("task_type", list(SIGNALS), "signal", "weight")


def weight_of(task_type, signal: str):
    """Weight expression; an unknown task type counts as `modify existing`."""
    at = SIGNALS.index(signal)
    out = F.lit(WEIGHTS["modify existing"][at])
    for name, values in WEIGHTS.items():
        out = F.when(task_type == name, F.lit(values[at])).otherwise(out)
    return out


def scaled(values: DataFrame, value: str = "value") -> DataFrame:
    """Min-max scale per repository; all equal -> 0.

    The range is an aggregate joined back (one row per repository), so no window gathers a repository.
    """
    span = values.groupBy("repo_hash").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = (c("_hi") - c("_lo")) <= 1e-9 * F.greatest(F.abs("_hi"), F.abs("_lo"))
    return (
        values.join(span, "repo_hash")
        .withColumn(value, F.when(flat, F.lit(0.0)).otherwise((c(value) - c("_lo")) / (c("_hi") - c("_lo"))))
        .drop("_lo", "_hi")
    )


def centrality(symbols: DataFrame, refs: DataFrame, method: str = "pagerank") -> DataFrame:
    """Raw centrality `(repo_hash, symbol_id, value)` by `pagerank` or `degree`."""
    return pagerank(symbols, refs) if method == "pagerank" else out_degree(symbols, refs)


def change_recency(symbols: DataFrame, files: DataFrame, as_of) -> DataFrame:
    """`1 - age / oldest age` of the symbol's file at `as_of`; files without a time give no row."""
    stamped = files.select("repo_hash", "file_path", c("last_modified").try_cast("timestamp").alias("_t")).where("_t IS NOT NULL")
    now = F.unix_micros(F.lit(as_of).cast("timestamp")) / 1e6
    at = F.unix_micros("_t") / 1e6
    oldest = stamped.groupBy("repo_hash").agg(F.min(at).alias("_oldest"))
    recent = stamped.join(oldest, "repo_hash").select(
        "repo_hash", "file_path", (1.0 - (now - at) / F.greatest(now - c("_oldest"), F.lit(1.0))).alias("value")
    )
    return symbols.join(recent, ["repo_hash", "file_path"]).select("repo_hash", "symbol_id", "value")


def co_change(symbols: DataFrame, seeds: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits a symbol's file shares with the seed file: `(query_id, repo_hash, symbol_id, value)`.

    Seeds meet commits on the file and commits on the commit id, so the pairs made are seed-file x
    partner, never all pairs of a commit.
    """
    changes = commits.select("repo_hash", "commit_id", "file_path").distinct()
    wanted = seeds.select("repo_hash", "file_path").distinct()
    with_seed = changes.join(wanted, ["repo_hash", "file_path"], "left_semi").withColumnRenamed("file_path", "seed_file")
    shared = (
        with_seed.join(changes, ["repo_hash", "commit_id"])
        .where("file_path <> seed_file")
        .groupBy("repo_hash", "seed_file", "file_path")
        .agg(F.count("*").cast("double").alias("value"))
    )
    return (
        seeds.select("query_id", "repo_hash", c("file_path").alias("seed_file"))
        .join(shared, ["repo_hash", "seed_file"])
        .join(symbols.select("repo_hash", "symbol_id", "file_path"), ["repo_hash", "file_path"])
        .select("query_id", "repo_hash", "symbol_id", "value")
    )


def embedding_similarity(candidates: DataFrame, embeddings: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """Cosine of each candidate's vector and its query's vector; candidates without a vector give no row."""
    return (
        candidates.select("query_id", "repo_hash", "symbol_id")
        .join(embeddings.select("repo_hash", "symbol_id", "embedding"), ["repo_hash", "symbol_id"])
        .join(query_vectors.select("query_id", "query_vector"), "query_id")
        .select("query_id", "repo_hash", "symbol_id", vectors.cosine(c("embedding"), c("query_vector")).alias("value"))
    )


def coverage(symbols: DataFrame, refs: DataFrame, distinct_files: bool = False) -> DataFrame:
    """References from test files per target symbol; `distinct_files` counts test files instead."""
    tests = symbols.where(paths.is_test_path_for_ranking(c("file_path"))).select(
        "repo_hash", c("symbol_id").alias("source_symbol_id"), c("file_path").alias("_file")
    )
    hits = refs.where("target_symbol_id IS NOT NULL").join(tests, ["repo_hash", "source_symbol_id"])
    n = F.countDistinct("_file") if distinct_files else F.count("*")
    return hits.groupBy("repo_hash", c("target_symbol_id").alias("symbol_id")).agg(n.cast("double").alias("value"))


def symbol_signals(symbols: DataFrame, refs: DataFrame, files: DataFrame, as_of, method: str = "pagerank") -> DataFrame:
    """Scaled signals that do not depend on a query, one row per symbol.

    Computed once per batch of requests and frozen; each signal is scaled over the rows it has, as missing rows
    count as 0 only after scaling.
    """
    parts = {
        "structural_centrality": scaled(centrality(symbols, refs, method)),
        "change_recency": scaled(change_recency(symbols, files, as_of)),
        "test_coverage_proxy": scaled(coverage(symbols, refs)),
    }
    out = symbols.select("repo_hash", "symbol_id")
    for name, df in parts.items():
        out = out.join(df.withColumnRenamed("value", name), ["repo_hash", "symbol_id"], "left")
    return cut_lineage(out.fillna(0.0, list(parts)))


def combine(
    candidates: DataFrame, signals: DataFrame, similarity: DataFrame | None = None, co_changes: DataFrame | None = None
) -> DataFrame:
    """Score candidates `(query_id, repo_hash, symbol_id, task_type)`; all five signals stay beside the score."""
    rows = candidates
    for name, df in (("embedding_similarity", similarity), ("co_change_correlation", co_changes)):
        if df is None:
            rows = rows.withColumn(name, F.lit(0.0))
        else:
            part = df.select("query_id", "repo_hash", "symbol_id", c("value").alias(name))
            rows = rows.join(part, ["query_id", "repo_hash", "symbol_id"], "left")
    return scored(rows.join(signals, ["repo_hash", "symbol_id"], "left"))


def scored(rows: DataFrame) -> DataFrame:
    """Rows `(task_type, <five signals>)` with their score; a missing signal counts as 0."""
    rows = rows.fillna(0.0, list(SIGNALS)).withColumn("embedding_similarity", F.greatest(F.lit(0.0), c("embedding_similarity")))
    score = F.lit(0.0)
    for name in SIGNALS:
        score = score + c(name) * weight_of(c("task_type"), name)
    return rows.withColumn("score", score)
