"""Event state, run state and token-cost checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens.operators import context, costs, search
from repolens.plans.answer import answer_requests
from repolens.streaming import state

from .query_checks import NARROW, TRACE, for_all, index_of
from .registry import check
from .routing_checks import ROUTE

c = F.col


def progress(t):
    return t.events.where("event = 'index_progress'").select(
        "repo_hash", "layer", "ts", "event_id", F.concat(F.lit("s"), (c("event_id") % 4).cast("string")).alias("state"), (c("event_id") % 11).alias("count"))


PROGRESS = "SELECT repo_hash, layer, concat('s', arg_max(event_id, (ts, event_id)) % 4) AS state, arg_max(event_id, (ts, event_id)) % 11 AS count FROM fx_events WHERE event = 'index_progress' GROUP BY ALL"


@check("t2_latest_jobs", PROGRESS)
def t2(t):
    return state.latest_jobs(progress(t))


REPOS = "SELECT DISTINCT repo_hash FROM fx_events UNION SELECT DISTINCT repo_hash FROM fx_symbols"


@check("t3_index_status", f"""
SELECT r.repo_hash, d.layer, CAST(d.p AS INT) AS position, coalesce(j.state, 'pending') AS state, coalesce(j.count, 0) AS count FROM ({REPOS}) r CROSS JOIN (VALUES (0, 'symbol'), (1, 'flow'), (2, 'architecture'), (3, 'invariant')) d(p, layer)
LEFT JOIN ({PROGRESS}) j ON j.repo_hash = r.repo_hash AND j.layer = d.layer""")
def t3(t):
    return state.index_status(t.sql(REPOS), state.latest_jobs(progress(t)))


@check("t5_jobs_of_repos", f"SELECT * FROM ({PROGRESS}) j WHERE repo_hash IN (SELECT repo_hash FROM fx_symbols)")
def t5(t):
    return state.jobs_of(t.symbols, state.latest_jobs(progress(t)))


@check("t6_folded_deltas", "SELECT repo_hash, layer, node_id, arg_max(event, (ts, event_id)) AS event, arg_max(event_id, (ts, event_id)) AS event_id FROM fx_events WHERE event IN ('node_added', 'edge_added') GROUP BY ALL")
def t6(t):
    return state.fold_deltas(t.events.where("event IN ('node_added', 'edge_added')"))


@check("t7_refresh_bursts", """
WITH e AS (SELECT repo_hash, layer, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM fx_events WHERE event IN ('node_added', 'edge_added') WINDOW w AS (PARTITION BY repo_hash, layer ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY repo_hash, layer ORDER BY ts) AS burst FROM e)
SELECT repo_hash, layer, epoch_us(max(ts) + INTERVAL 10 MINUTE) AS refresh_us, count(*) AS n FROM g GROUP BY repo_hash, layer, burst""")
def t7(t):
    out = state.refresh_bursts(t.events.where("event IN ('node_added', 'edge_added')"), "10 minutes")
    return out.select("repo_hash", "layer", F.unix_micros(c("refresh_at").cast("timestamp")).alias("refresh_us"), "n")


LIVE_AT = "2024-01-15 00:00:00"


def highlights(t):
    ttl = F.when(c("event_id") % 2 == 0, (c("event_id") % 100) * 3600 * 1000)
    return t.events.where("event = 'region_highlighted'").select("repo_hash", "ts", "event_id", ttl.alias("ttl_ms"), F.array("node_id", F.concat("node_id", F.lit("b"))).alias("node_ids"))


LIVE = f"SELECT * FROM fx_events WHERE event = 'region_highlighted' AND epoch_us(ts) + (CASE WHEN event_id % 2 = 0 THEN (event_id % 100) * 3600 * 1000 ELSE 5000 END) * 1000 > epoch_us(TIMESTAMP '{LIVE_AT}')"


@check("t8_live_highlights", f"SELECT repo_hash, event_id FROM ({LIVE}) l")
def t8(t):
    return state.live_highlights(highlights(t), LIVE_AT).select("repo_hash", "event_id")


@check("t9_highlighted_ids", f"SELECT repo_hash, node_id FROM ({LIVE}) l UNION SELECT repo_hash, concat(node_id, 'b') FROM ({LIVE}) m")
def t9(t):
    return state.highlighted_ids(state.live_highlights(highlights(t), LIVE_AT))


def activity(t):
    return t.events.select("repo_hash", "ts", "event_id", c("node_id").alias("activity_id"), c("event").alias("query_type"), c("layer").alias("task"),
                           F.when(c("event") == "agent_activity", c("layer")).alias("status"))


@check("t10_folded_activity", """
SELECT repo_hash, activity_id, query_type, task, status, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_hash ORDER BY first_seen DESC) AS rank FROM (
  SELECT repo_hash, node_id AS activity_id, arg_max(event, (ts, event_id)) AS query_type, arg_max(layer, (ts, event_id)) AS task, arg_max(layer, (ts, event_id)) FILTER (WHERE event = 'agent_activity') AS status, min((ts, event_id)) AS first_seen
  FROM fx_events GROUP BY ALL) a) b WHERE rank <= 200""")
def t10(t):
    return state.fold_activity(activity(t)).drop("ts", "first_seen")


@check("t11_activity_highlights", "SELECT r.repo_hash, r.query_id AS activity_id, s.symbol_id AS id FROM fx_requests r JOIN fx_symbols s ON s.repo_hash = r.repo_hash AND s.qualified_name = r.symbol")
def t11(t):
    named = t.requests.select("repo_hash", c("query_id").alias("activity_id"), F.array("symbol", F.lit("no.such.name")).alias("names"))
    return state.activity_highlights(named, t.symbols.select("repo_hash", c("qualified_name").alias("label"), c("symbol_id").alias("id")))


RUN_EVENTS = """SELECT repo_hash, concat(node_id, '-', layer) AS run_id, ts, event_id, CASE event WHEN 'node_added' THEN 'agent_run_started' WHEN 'edge_added' THEN 'agent_run_finished' ELSE 'agent_step' END AS event,
  CASE WHEN event = 'edge_added' THEN CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'succeeded' END ELSE NULL END AS status FROM fx_events"""


@check("t12_folded_runs", f"""
WITH e AS ({RUN_EVENTS}), s AS (SELECT repo_hash, run_id, min((ts, event_id)) AS st, min(ts) AS started FROM e WHERE event = 'agent_run_started' GROUP BY ALL)
SELECT e.repo_hash, e.run_id, epoch_us(s.started) AS started_us, count(*) FILTER (WHERE event = 'agent_step') AS n_steps, coalesce(arg_max(status, (ts, event_id)) FILTER (WHERE event = 'agent_run_finished'), 'running') AS status
FROM e JOIN s ON s.repo_hash = e.repo_hash AND s.run_id = e.run_id WHERE (e.ts, e.event_id) >= s.st GROUP BY ALL""")
def t12(t):
    out = state.fold_runs(t.sql(RUN_EVENTS))
    return out.select("repo_hash", "run_id", F.unix_micros(c("started_at").cast("timestamp")).alias("started_us"), "n_steps", "status")


UPDATES = "SELECT node_id AS run_id, ts, event_id, CASE event_id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'failed' WHEN 4 THEN 'cancelled' ELSE 'odd' END AS status FROM fx_events"


@check("t14_run_statuses", f"SELECT run_id, arg_max(status, (ts, event_id)) AS status FROM ({UPDATES}) u WHERE status <> 'odd' GROUP BY ALL UNION ALL SELECT 'rejected', CAST(count(*) AS VARCHAR) FROM ({UPDATES}) v WHERE status = 'odd'")
def t14(t):
    kept, rejected = state.run_statuses(t.sql(UPDATES))
    return kept.unionAll(rejected.agg(F.count("*").cast("string").alias("status")).select(F.lit("rejected"), "status"))


@check("t15_transcripts", "SELECT run_id, step, role, text FROM fx_agent_steps ORDER BY run_id, step")
def t15(t):
    return state.transcripts(t.agent_steps)


RUNS = "SELECT concat('r', CAST(run_id % 3 AS STRING)) AS repo_hash, run_id, run_id * 7 % 50 AS created_at, CASE WHEN run_id % 4 = 0 THEN 'failed' ELSE 'succeeded' END AS status, 'long' AS transcript FROM fx_agent_steps"


@check("t16_newest_runs", f"SELECT * EXCLUDE (transcript) FROM (SELECT *, row_number() OVER (PARTITION BY repo_hash ORDER BY created_at DESC, run_id DESC) AS rank FROM (SELECT DISTINCT * FROM ({RUNS}) r) d WHERE status = 'succeeded') z WHERE rank <= 50")
def t16(t):
    return state.newest_runs(t.sql(RUNS).distinct(), status="succeeded")


@check("t17_repo_list", f"SELECT r.repo_hash, length(r.repo_hash) AS created_at, coalesce(n, 0) AS n_symbols FROM ({REPOS}) r LEFT JOIN (SELECT repo_hash, count(*) AS n FROM fx_symbols GROUP BY 1) s ON s.repo_hash = r.repo_hash")
def t17(t):
    return state.repo_list(t.sql(REPOS).withColumn("created_at", F.length("repo_hash")), t.symbols)


DOCS = "SELECT source AS repo_hash, CAST(doc_id AS STRING) AS file_path, n_chars AS last_modified, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE text END AS content FROM documents"


@check("m2_repository_cost", f"""
WITH d AS (SELECT *, CASE WHEN coalesce(length(content), 0) = 0 THEN 0 ELSE greatest(1, length(content) // 4) END AS tok, row_number() OVER (PARTITION BY repo_hash ORDER BY last_modified DESC NULLS LAST, file_path) AS rn FROM ({DOCS}) x)
SELECT repo_hash, 'all' AS sample, CAST(sum(tok) AS BIGINT) AS tokens, count(*) AS files_read, count(*) AS files_total FROM d GROUP BY ALL
UNION ALL SELECT repo_hash, 'newest', CAST(sum(tok) FILTER (WHERE rn <= 10) AS BIGINT), count(*) FILTER (WHERE rn <= 10), count(*) FROM d GROUP BY ALL""")
def m2(t):
    docs = t.sql(DOCS)
    return costs.repository_cost(docs).withColumn("sample", F.lit("all")).unionByName(costs.repository_cost(docs, top_k=10).withColumn("sample", F.lit("newest")))


@check("m3_bundle_cost")
def m3(t):
    asks, askers = context.equal_requests(t.sql(NARROW))
    return for_all(askers, costs.bundle_cost(context.find_relevant_context(asks, index_of(t), t.query_vectors)))


SCENARIOS = "SELECT query_id AS scenario_id, query_id, repo_hash, CASE WHEN query_id % 9 = 0 THEN '' ELSE question END AS task FROM fx_requests"
BASE = "SELECT repo_hash, count(*) * 100 AS tokens FROM fx_symbols GROUP BY repo_hash"
SPENT = "SELECT query_id, CAST(length(question) * 3 AS BIGINT) AS tokens FROM fx_requests WHERE question NOT LIKE 'add%'"
RATIOS = f"""SELECT s.scenario_id, s.repo_hash, CASE WHEN task = '' THEN 'missing task' END AS error, CASE WHEN task <> '' THEN coalesce(b.tokens, 0) END AS baseline_tokens, CASE WHEN task <> '' THEN coalesce(p.tokens, 0) END AS bundle_tokens
FROM ({SCENARIOS}) s LEFT JOIN ({BASE}) b ON b.repo_hash = s.repo_hash LEFT JOIN ({SPENT}) p ON p.query_id = s.query_id"""


def ratios(t):
    return costs.scenario_ratios(t.sql(SCENARIOS), t.sql(BASE), t.sql(SPENT))


@check("m4_scenario_ratios", f"SELECT *, round(CASE WHEN baseline_tokens IS NOT NULL THEN baseline_tokens / greatest(1, bundle_tokens) END, 6) AS ratio FROM ({RATIOS}) r")
def m4(t):
    return ratios(t).withColumn("ratio", F.round("ratio", 6))


@check("m5_panel", f"""
SELECT repo_hash, CAST(coalesce(sum(baseline_tokens), 0) AS BIGINT) AS baseline_tokens, CAST(coalesce(sum(bundle_tokens), 0) AS BIGINT) AS bundle_tokens, count(*) AS scenarios_run, count(error) AS scenarios_errored,
  round(coalesce(sum(baseline_tokens), 0) / greatest(1, coalesce(sum(bundle_tokens), 0)), 6) AS ratio FROM ({RATIOS}) r GROUP BY repo_hash""")
def m5(t):
    return costs.panel(ratios(t)).withColumn("ratio", F.round("ratio", 6))


@check("h2_answered_requests", f"""
WITH {TRACE}, q AS (SELECT *, {ROUTE} AS query_type FROM fx_requests), tr AS (SELECT query_id, count(*) AS n FROM hit GROUP BY ALL),
iv AS (SELECT q.query_id, count(*) AS n FROM q JOIN fx_symbols s ON s.repo_hash = q.repo_hash AND s.qualified_name = q.symbol JOIN fx_invariants i ON i.target_symbol_id = s.symbol_id WHERE i.confidence >= q.min_confidence GROUP BY ALL)
SELECT q.query_id, q.query_type, CASE q.query_type WHEN 'trace_data_flow' THEN concat('Traced ', coalesce(tr.n, 0), ' call-chain flow(s).') ELSE concat('Found ', coalesce(iv.n, 0), ' invariant(s) attached to the requested target.') END AS answer
FROM q LEFT JOIN tr USING (query_id) LEFT JOIN iv USING (query_id) WHERE q.query_type IN ('trace_data_flow', 'find_invariants')""")
def h2b(t):
    # The context and exemplar answers have their own checks; the routed answer is compared on the other types.
    out = answer_requests(t.requests.drop("p_partkey"), index_of(t), t.query_vectors)
    return out.where("query_type IN ('trace_data_flow', 'find_invariants')").select("query_id", "query_type", "answer")
