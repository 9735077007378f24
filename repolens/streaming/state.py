"""Folds of event tables into keyed state. Each fold is one aggregation, so it runs on a stream in update mode too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.operators.ranked import first_by, top_rows

c = F.col
# Layers, run states, highlight life in milliseconds, kept activity rows and listed runs.
LAYERS = ("symbol", "flow", "architecture", "invariant")
RUN_STATES = ("queued", "running", "succeeded", "failed", "cancelled")
HIGHLIGHT_MS = 5000
KEPT_ACTIVITY = 200
LISTED_RUNS = 50



def _order():
    """Event order: time, then id."""
    return F.struct("ts", "event_id")


def latest_jobs(progress: DataFrame) -> DataFrame:
    """Latest progress of each repository and layer."""
    return progress.groupBy("repo_hash", "layer").agg(F.max_by(F.struct("state", "count"), _order()).alias("job")).select("repo_hash", "layer", "job.*")


def index_status(repos: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per repository and layer; layers without a job are `pending` with count 0."""
    frame = repos.select("repo_hash").distinct().select("repo_hash", F.posexplode(F.array(*[F.lit(x) for x in LAYERS])).alias("position", "layer"))
    return frame.join(jobs, ["repo_hash", "layer"], "left").select(
        "repo_hash", "position", "layer", F.coalesce("state", F.lit("pending")).alias("state"), F.coalesce("count", F.lit(0)).alias("count"))


def jobs_of(repos: DataFrame, jobs: DataFrame) -> DataFrame:
    return jobs.join(repos.select("repo_hash").distinct(), "repo_hash", "left_semi")


def fold_deltas(deltas: DataFrame) -> DataFrame:
    """Latest node or edge change per id and layer."""
    return deltas.groupBy("repo_hash", "layer", "node_id").agg(F.max_by(F.struct("event", "event_id"), _order()).alias("d")).select("repo_hash", "layer", "node_id", "d.*")


def refresh_bursts(deltas: DataFrame, gap: str = "100 milliseconds") -> DataFrame:
    """One refresh per burst of changes of a layer: a burst ends when nothing follows within the gap."""
    return deltas.groupBy("repo_hash", "layer", F.session_window("ts", gap).alias("burst")).agg(F.count("*").alias("n")).select(
        "repo_hash", "layer", c("burst.end").alias("refresh_at"), "n")


def live_highlights(highlights: DataFrame, as_of) -> DataFrame:
    """Highlights alive at `as_of`; the default life is five seconds."""
    life = F.coalesce("ttl_ms", F.lit(HIGHLIGHT_MS)).cast("bigint")
    ends = F.timestamp_micros(F.unix_micros(c("ts").cast("timestamp")) + life * 1000)
    return highlights.withColumn("expires_at", ends).where(c("expires_at") > F.lit(as_of).cast("timestamp"))


def highlighted_ids(live: DataFrame) -> DataFrame:
    return live.select("repo_hash", F.explode("node_ids").alias("node_id")).distinct()


def fold_activity(activity: DataFrame, keep: int = KEPT_ACTIVITY) -> DataFrame:
    """One row per activity id: later events overwrite, a status only when sent; newest first arrivals are kept.

    First arrival decides the place, so an update does not move a row.
    """
    folded = activity.groupBy("repo_hash", "activity_id").agg(
        F.max_by(F.struct("query_type", "task", "ts"), _order()).alias("last"), F.max_by("status", F.when(c("status").isNotNull(), _order())).alias("status"),
        F.min(_order()).alias("first_seen"))
    rows = folded.select("repo_hash", "activity_id", "last.*", "status", "first_seen")
    return top_rows(rows, ["repo_hash"], [F.desc("first_seen")], keep)


def activity_highlights(activity: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names touched by an activity as node ids (names without a node are dropped)."""
    named = activity.select("repo_hash", "activity_id", F.explode("names").alias("label"))
    labels = first_by(nodes.select("repo_hash", "label", "id"), ["repo_hash", "label"], [c("id")])
    return named.join(labels, ["repo_hash", "label"]).select("repo_hash", "activity_id", "id")


def fold_runs(events: DataFrame) -> DataFrame:
    """Start, step and finish events of a run in one row; steps before (or without) a start are ignored."""
    started = F.min(F.when(c("event") == "agent_run_started", _order()))
    starts = events.groupBy("repo_hash", "run_id").agg(started.alias("_start")).where("_start IS NOT NULL")
    rows = events.join(starts, ["repo_hash", "run_id"]).where(_order() >= c("_start"))
    last = F.max_by("status", F.when(c("event") == "agent_run_finished", _order()))
    return rows.groupBy("repo_hash", "run_id").agg(
        F.min("_start.ts").alias("started_at"), F.count_if(c("event") == "agent_step").alias("n_steps"), F.coalesce(last, F.lit("running")).alias("status"))


def run_statuses(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest allowed status per run, and the rejected updates."""
    ok = F.coalesce(c("status").isin(*RUN_STATES), F.lit(False))
    kept = updates.where(ok).groupBy("run_id").agg(F.max_by("status", _order()).alias("status"))
    return kept, updates.where(~ok)


def transcripts(steps: DataFrame) -> DataFrame:
    """Steps of each run, to be read by (run_id, step); a long run stays rows and is never packed into one."""
    return steps.select("run_id", "step", "role", "text")


def newest_runs(runs: DataFrame, limit: int = LISTED_RUNS, status: str | None = None) -> DataFrame:
    """Newest runs of each repository without their transcript."""
    rows = runs if status is None else runs.where(c("status") == status)
    return top_rows(rows.drop("transcript"), ["repo_hash"], [F.desc("created_at"), F.desc("run_id")], limit)


def repo_list(repos: DataFrame, symbols: DataFrame) -> DataFrame:
    """Repositories newest first with their symbol counts."""
    n = symbols.groupBy("repo_hash").agg(F.count("*").alias("n_symbols"))
    return repos.join(n, "repo_hash", "left").fillna(0, ["n_symbols"]).orderBy(F.desc("created_at"), "repo_hash")
