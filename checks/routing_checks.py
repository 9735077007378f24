"""Routing, answer shaping and scope checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens.operators import context, lookups, routing, scopes, search
from repolens.operators.ranked import broadcast_small

from .query_checks import BUNDLE, FLOW_NODES, INV_AT, INV_REQ, NARROW, TRACE, for_all, index_of
from .registry import check

c = F.col

ROUTE = """CASE WHEN contains(lower(question), 'exemplar') THEN 'find_exemplars' WHEN contains(lower(question), 'invariant') THEN 'find_invariants'
  WHEN contains(lower(question), 'flow') OR contains(lower(question), 'trace') THEN 'trace_data_flow' ELSE 'find_relevant_context' END"""
ASKED = """SELECT query_id, repo_hash, question, CASE query_id % 5 WHEN 0 THEN NULL ELSE symbol END AS symbol, CASE query_id % 7 WHEN 0 THEN '' ELSE cluster_id END AS cluster_id,
  CASE query_id % 6 WHEN 0 THEN 'trace_data_flow' WHEN 1 THEN 'mystery' ELSE NULL END AS query_type FROM fx_requests"""


@check("h2_routed_requests", f"SELECT query_id, coalesce(query_type, {ROUTE}) AS query_type FROM ({ASKED}) a")
def h2(t):
    return routing.routed(t.sql(ASKED)).select("query_id", "query_type")


@check("h3_dispatch_errors", f"""
SELECT query_id, CASE WHEN q = 'mystery' THEN 'unknown query_type: mystery' WHEN q = 'trace_data_flow' AND symbol IS NULL THEN 'symbol required for trace_data_flow'
  WHEN q = 'find_exemplars' AND cluster_id = '' THEN 'cluster_id required for find_exemplars' END AS error FROM (SELECT *, coalesce(query_type, {ROUTE}) AS q FROM ({ASKED}) a) b""")
def h3(t):
    return routing.routed(t.sql(ASKED)).select("query_id", "error")


EXTRAS = """SELECT query_id, repo_hash, question, CASE query_id % 4 WHEN 0 THEN NULL ELSE symbol END AS symbol, CASE query_id % 3 WHEN 0 THEN NULL ELSE cluster_id END AS cluster_id, path, min_confidence,
  CASE query_id % 5 WHEN 1 THEN 'x.y' ELSE NULL END AS extra_symbol, CASE query_id % 5 WHEN 2 THEN 'c:z' ELSE NULL END AS extra_cluster_id, CASE query_id % 5 WHEN 3 THEN '/p' ELSE NULL END AS extra_path,
  CAST(CASE query_id % 5 WHEN 4 THEN 0.9 ELSE NULL END AS DOUBLE) AS extra_min_confidence, CASE query_id % 5 WHEN 0 THEN 'task' ELSE NULL END AS extra_task FROM fx_requests"""


@check("h5_payload_defaults", f"""
SELECT query_id, repo_hash, coalesce(extra_path, path) AS path, coalesce(extra_cluster_id, cluster_id) AS cluster_id, coalesce(extra_symbol, symbol, CASE WHEN coalesce(extra_cluster_id, cluster_id) IS NULL THEN
  list_filter(string_split(question, ' '), lambda w: contains(w, '.'))[1] END) AS symbol, coalesce(extra_min_confidence, min_confidence) AS min_confidence, coalesce(extra_task, question) AS task FROM ({EXTRAS}) e""")
def h5(t):
    return routing.payload_defaults(t.sql(EXTRAS))


@check("h7_counts_by_source", """
SELECT s.p_partkey AS query_id, CASE i.source_kind WHEN 'comment' THEN 'unknown' ELSE i.source_kind END AS source_kind, count(*) AS n FROM fx_invariants i JOIN fx_symbols s ON s.symbol_id = i.target_symbol_id GROUP BY ALL""")
def h7(t):
    rows = t.invariants.join(t.symbols.select(c("symbol_id").alias("target_symbol_id"), c("p_partkey").alias("query_id")), "target_symbol_id")
    return routing.counts_by_source(rows.withColumn("source_kind", F.when(c("source_kind") != "comment", c("source_kind"))))


@check("h8_symbol_ids", """
SELECT r.query_id, s.symbol_id FROM fx_requests r JOIN fx_symbols s ON s.repo_hash = r.repo_hash AND s.file_path = r.path
UNION ALL SELECT r.query_id, s.symbol_id FROM fx_requests r JOIN fx_symbols s ON s.repo_hash = r.repo_hash AND s.qualified_name = r.symbol""")
def h8(t):
    files = routing.symbol_ids(t.requests.withColumnRenamed("path", "file_path"), t.symbols, "file_path")
    return files.unionAll(routing.symbol_ids(t.requests.withColumnRenamed("symbol", "qualified_name"), t.symbols, "qualified_name"))


@check("h9_touched_names", f"""
WITH {TRACE}, {FLOW_NODES}, f AS (SELECT h.query_id, h.flow_id, n.names, length(h.flow_id) AS flow_rank FROM hit h JOIN named n USING (flow_id)),
x AS (SELECT query_id, flow_rank, names[1] AS name, 0 AS pos FROM f UNION ALL SELECT query_id, flow_rank, names[-1], 1 FROM f
  UNION ALL SELECT query_id, flow_rank, names[2], 2 FROM f WHERE len(names) > 2 UNION ALL SELECT query_id, flow_rank, names[3], 3 FROM f WHERE len(names) > 3)
SELECT query_id, name, CAST(min(flow_rank * 10 + pos) AS BIGINT) AS first_seen FROM x GROUP BY ALL""")
def h9(t):
    # equal requests touch the same names, which fan out last
    keys = ["repo_hash", "symbol", "direction", "depth"]
    requests = t.requests.select("query_id", *keys)
    first, askers = context.with_nameless(*search.equal_tasks(requests, keys), requests)
    traced = lookups.trace_data_flow(first, t.symbols, t.flows).withColumn("flow_rank", F.length("flow_id"))
    out = routing.touched_names(traced)
    return for_all(askers, out.withColumn("first_seen", (c("first_seen.flow_rank") * 10 + c("first_seen.pos")).cast("bigint")))


ANSWERS = f"SELECT query_id, {ROUTE} AS query_type, query_id % 13 AS n_items, query_id % 4 AS n_files, CAST(NULL AS STRING) AS role FROM fx_requests UNION ALL SELECT n_files, 'describe_architecture', 0, 0, CASE WHEN n_files % 2 = 0 THEN role_description ELSE '' END FROM fx_clusters"


@check("h10_summaries", f"""
SELECT query_id, CASE query_type WHEN 'find_relevant_context' THEN concat('Ranked ', n_items, ' relevant symbols across ', n_files, ' files.') WHEN 'trace_data_flow' THEN concat('Traced ', n_items, ' call-chain flow(s).')
  WHEN 'find_invariants' THEN concat('Found ', n_items, ' invariant(s) attached to the requested target.') WHEN 'find_exemplars' THEN concat('Found ', n_items, ' exemplar file(s) within the cluster.')
  ELSE CASE WHEN coalesce(role, '') = '' THEN 'No matching cluster.' ELSE concat('Cluster role: ', left(role, 120)) END END AS answer FROM ({ANSWERS}) a""")
def h10(t):
    return routing.summaries(t.sql(ANSWERS)).select("query_id", "answer")


@check("h11_sources", """
SELECT query_id, file_path, rank FROM (SELECT query_id, file_path, row_number() OVER (PARTITION BY query_id ORDER BY file_path) AS rank FROM (
  SELECT DISTINCT r.query_id, f.file_path FROM fx_requests r JOIN fx_files f ON f.repo_hash = r.repo_hash AND f.cluster_id = r.cluster_id) d) z WHERE rank <= 25""")
def h11(t):
    mentions = t.requests.select("query_id", "repo_hash", "cluster_id").join(t.files, ["repo_hash", "cluster_id"])
    return routing.sources(mentions)


@check("h12_compact_bundles", f"""
SELECT query_id, region_id AS cluster_id, array_to_string(string_split(symbols, ',')[1:8], ',') AS symbols, least(n_flows, 5) AS n_flows, greatest(0, len(string_split(symbols, ',')) - 8) AS cut_symbols, greatest(0, n_flows - 5) AS cut_flows FROM ({BUNDLE}) b""")
def h12(t):
    asks, askers = context.equal_requests(t.sql(NARROW))
    out = routing.compact(context.find_relevant_context(asks, index_of(t), t.query_vectors))
    ids = F.transform("relevant_symbols", lambda s: F.concat(F.lit("s"), F.regexp_extract(s["qualified_name"], r"_(\d+)$", 1)))
    return for_all(askers, out.select("query_id", "cluster_id", F.array_join(ids, ",").alias("symbols"), F.coalesce(F.size("flows"), F.lit(0)).cast("bigint").alias("n_flows"), "cut_symbols", "cut_flows"))


RESULTS = "SELECT s.run_id, s.step, y.p_partkey AS pos, y.qualified_name, CASE WHEN y.kind = 'type' THEN NULL ELSE y.file_path END AS file_path, y.line_start FROM fx_agent_steps s JOIN fx_symbols y ON y.line_start = (s.run_id + s.step) % 50 * 10 + 1"


@check("h14_citations", f"""
SELECT run_id, qualified_name, coalesce(file_path, '') AS file_path, CAST(min(step) AS BIGINT) AS step, any_value(line_start) AS line_start FROM ({RESULTS}) r GROUP BY ALL""")
def h14(t):
    # the rows of RESULTS; steps go to symbols that are dealt by what a citation is grouped by, so their product is not shuffled
    key = [F.coalesce(k, F.lit("")) for k in ("qualified_name", "file_path")]
    shown = t.symbols.select("qualified_name", F.when(c("kind") == "type", F.lit(None)).otherwise(c("file_path")).alias("file_path"), "line_start", c("p_partkey").alias("pos"))
    steps = broadcast_small(t.agent_steps.select("run_id", "step", ((c("run_id") + c("step")) % 50 * 10 + 1).alias("line_start")))
    width = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    results = shown.repartition(width, *key).join(steps.withColumnRenamed("line_start", "_line"), c("line_start") == c("_line")).drop("_line")
    return routing.citations(results).withColumn("step", c("step").cast("bigint")).drop("pos")


STEPS = """SELECT concat(CAST(run_id AS STRING), '-', CAST(step AS STRING)) AS reply_id, CASE step % 4
  WHEN 0 THEN concat('[{"kind": "final", "text": "done ', CAST(run_id AS STRING), '", "tool": 5, "ts_ms": 12, "citations": ["a.f", 3, "b.g", null]}, {"kind": "odd", "text": "x"}, 7]')
  WHEN 1 THEN '[{"kind": "thought", "text": 3}]' WHEN 2 THEN '[]' ELSE '[{"kind": "tool_call", "text": "t", "tool": "grep", "ts_ms": "12", "citations": "a.f"}]' END AS steps FROM fx_agent_steps"""


@check("h15_clean_steps", """
SELECT concat(CAST(run_id AS VARCHAR), '-', CAST(step AS VARCHAR)) AS reply_id, CASE step % 4 WHEN 0 THEN concat('final|done ', run_id, '|-|12|a.f,b.g') WHEN 3 THEN 'tool_call|t|grep|-|' ELSE '' END AS steps,
  CASE step % 4 WHEN 1 THEN 'dropped malformed ''steps'' entries' END AS warning FROM fx_agent_steps""")
def h15(t):
    out = routing.clean_steps(t.sql(STEPS))
    shown = F.transform("steps", lambda s: F.concat_ws("|", s["kind"], s["text"], F.coalesce(s["tool"], F.lit("-")), F.coalesce(s["ts_ms"].cast("string"), F.lit("-")), F.array_join(s["citations"], ",")))
    return out.withColumn("steps", F.array_join(shown, ";"))


# Scopes: one of each kind per request, some of them malformed.
SCOPES = """SELECT concat('z', CAST(query_id AS STRING)) AS scope_id, query_id, repo_hash, CASE query_id % 5 WHEN 0 THEN 'cluster' WHEN 1 THEN 'folder' WHEN 2 THEN 'file' WHEN 3 THEN 'symbols' ELSE 'cluster' END AS kind,
  CASE WHEN query_id % 5 IN (0) THEN cluster_id ELSE NULL END AS cluster_id,
  CASE query_id % 5 WHEN 1 THEN concat(' /', split_part(path, '/', 2), '//') WHEN 2 THEN path WHEN 4 THEN path ELSE NULL END AS path,
  CASE query_id % 5 WHEN 3 THEN symbol ELSE NULL END AS q1, CASE query_id % 5 WHEN 3 THEN concat(symbol, '.gone') ELSE NULL END AS q2 FROM fx_requests"""


def scope_table(t):
    names = F.when(c("q1").isNotNull(), F.array("q1", "q2"))
    return t.sql(SCOPES).withColumn("qnames", names).drop("q1", "q2")


def valid_scopes(t):
    return scope_table(t).where("kind <> 'cluster' OR path IS NULL")


def scopes_of_kind(t, kind):
    """Valid scopes of one kind, so that only their members are listed."""
    valid = valid_scopes(t)
    return valid.join(valid.where(c("kind") == kind).select("scope_id"), "scope_id", "left_semi")


@check("s1_scope_errors", f"SELECT scope_id, CASE WHEN query_id % 5 = 4 THEN 'cluster requires cluster_id' END AS scope_error FROM ({SCOPES}) s")
def s1(t):
    return scopes.validate(scope_table(t)).select("scope_id", "scope_error")


SFILES = f"""sc AS (SELECT * FROM ({SCOPES}) s WHERE query_id % 5 <> 4),
sf AS MATERIALIZED (SELECT DISTINCT sc.scope_id, sc.kind, f.repo_hash, f.file_path FROM sc JOIN fx_files f ON f.repo_hash = sc.repo_hash AND CASE sc.kind WHEN 'cluster' THEN f.cluster_id = sc.cluster_id
  WHEN 'folder' THEN starts_with(f.file_path, concat(rtrim(trim(sc.path), '/'), '/')) WHEN 'symbols' THEN FALSE ELSE FALSE END
  UNION SELECT scope_id, kind, repo_hash, path FROM sc WHERE kind = 'file'
  UNION SELECT sc.scope_id, sc.kind, s.repo_hash, s.file_path FROM sc JOIN fx_symbols s ON s.repo_hash = sc.repo_hash AND s.qualified_name = sc.q1 WHERE sc.kind = 'symbols'),
sn AS MATERIALIZED (SELECT DISTINCT sf.scope_id, s.qualified_name, TRUE AS found FROM sf JOIN fx_symbols s ON s.repo_hash = sf.repo_hash AND s.file_path = sf.file_path WHERE sf.kind <> 'symbols'
  UNION ALL SELECT scope_id, q, (repo_hash, q) IN (SELECT (repo_hash, qualified_name) FROM fx_symbols) FROM (SELECT scope_id, repo_hash, unnest([q1, q2]) AS q FROM sc WHERE kind = 'symbols') u)"""


def scope_kind(name, kind):
    @check(name, f"WITH {SFILES} SELECT scope_id, file_path AS member FROM sf WHERE kind = '{kind}' UNION ALL SELECT sn.scope_id, qualified_name FROM sn JOIN sc USING (scope_id) WHERE kind = '{kind}'")
    def part(t):
        return scopes.scope_members(scopes_of_kind(t, kind), t.files, t.symbols)


scope_kind("s2_cluster_scope", "cluster")
scope_kind("s3_folder_scope", "folder")
scope_kind("s4_file_scope", "file")


@check("s5_name_scope", f"WITH {SFILES} SELECT sc.scope_id, count(*) AS n_names, count(*) FILTER (WHERE NOT found) AS n_missing FROM sn JOIN sc USING (scope_id) WHERE kind = 'symbols' GROUP BY ALL")
def s5(t):
    valid = valid_scopes(t).where("scope_id IS NULL AND kind = 'symbols'").unionByName(scopes_of_kind(t, "symbols"))
    return scopes.scope_counts(valid, t.files, t.symbols).where("kind = 'symbols'").select("scope_id", "n_names", "n_missing")


ADMIT = """SELECT r.query_id, concat('z', CAST(r.query_id AS STRING)) AS scope_id, r.repo_hash, CASE r.query_id % 6 WHEN 0 THEN 'find_invariants' WHEN 1 THEN 'describe_architecture' WHEN 2 THEN 'trace_data_flow' WHEN 3 THEN 'find_exemplars' ELSE 'find_relevant_context' END AS query_type,
  CASE WHEN r.query_id % 6 IN (1, 3, 5) THEN NULL WHEN r.query_id % 7 = 0 THEN concat(r.symbol, '.gone') ELSE r.symbol END AS symbol, CASE WHEN r.query_id % 6 = 2 THEN NULL ELSE r.cluster_id END AS cluster_id,
  CASE WHEN r.query_id % 6 = 1 THEN concat('/', split_part(r.path, '/', 2), CASE WHEN r.query_id % 7 = 0 THEN 'x' ELSE '/' END) ELSE NULL END AS path FROM fx_requests r"""


@check("s6_admission", f"""
WITH {SFILES}, a AS ({ADMIT}),
sz AS (SELECT repo_hash, cluster_id, count(*) AS n FROM fx_files WHERE cluster_id IS NOT NULL GROUP BY ALL),
ins AS (SELECT sf.scope_id, f.cluster_id, count(*) AS n FROM sf JOIN fx_files f ON f.repo_hash = sf.repo_hash AND f.file_path = sf.file_path GROUP BY ALL),
pin AS (SELECT DISTINCT a.query_id FROM a JOIN sf ON sf.scope_id = a.scope_id WHERE sf.file_path = a.path OR starts_with(sf.file_path, concat(rtrim(a.path, '/'), '/')))
SELECT a.query_id, CASE a.query_type
  WHEN 'find_relevant_context' THEN CASE WHEN a.symbol IS NOT NULL AND (a.scope_id, a.symbol) NOT IN (SELECT (scope_id, qualified_name) FROM sn) THEN 'seed symbol is outside the scope' END
  WHEN 'trace_data_flow' THEN CASE WHEN (a.scope_id, a.symbol) NOT IN (SELECT (scope_id, qualified_name) FROM sn) THEN 'symbol is outside the scope' END
  WHEN 'find_invariants' THEN CASE WHEN (a.scope_id, a.symbol) NOT IN (SELECT (scope_id, qualified_name) FROM sn) THEN 'symbol is outside the scope' WHEN coalesce(ins.n, 0) < coalesce(sz.n, 0) THEN 'cluster contains files outside the scope' END
  WHEN 'describe_architecture' THEN CASE WHEN coalesce(ins.n, 0) = 0 THEN 'cluster does not intersect the scope' WHEN pin.query_id IS NULL THEN 'path is outside the scope' END
  ELSE CASE WHEN coalesce(ins.n, 0) = 0 THEN 'cluster does not intersect the scope' END END AS reason
FROM a LEFT JOIN sz ON sz.repo_hash = a.repo_hash AND sz.cluster_id = a.cluster_id LEFT JOIN ins ON ins.scope_id = a.scope_id AND ins.cluster_id = a.cluster_id LEFT JOIN pin ON pin.query_id = a.query_id""")
def s6(t):
    return scopes.admit_to_scopes(t.sql(ADMIT), valid_scopes(t), t.files, t.symbols).select("query_id", "reason")


@check("s7_path_inside_scope", f"""
WITH {SFILES}, a AS (SELECT * FROM ({ADMIT}) x WHERE path IS NOT NULL)
SELECT DISTINCT a.query_id FROM a JOIN sf ON sf.scope_id = a.scope_id WHERE sf.file_path = a.path OR starts_with(sf.file_path, concat(rtrim(a.path, '/'), '/'))""")
def s7(t):
    return scopes.path_inside_scopes(t.sql(ADMIT).where("path IS NOT NULL"), valid_scopes(t), t.files, t.symbols)


@check("h12_compact_invariants", f"""
WITH q AS ({INV_REQ}), a AS ({INV_AT}), found AS (
  SELECT q.query_id, a.invariant_id, a.confidence FROM q JOIN a ON a.repo_hash = q.repo_hash AND a.qualified_name = q.symbol WHERE a.confidence >= q.min_confidence
  UNION ALL SELECT q.query_id, a.invariant_id, a.confidence FROM q JOIN a ON a.repo_hash = q.repo_hash AND a.cluster_id = q.cluster_id WHERE q.symbol IS NULL AND a.confidence >= q.min_confidence),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, invariant_id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM found)
SELECT query_id, invariant_id, rank, greatest(0, n - 8) AS cut FROM ranked WHERE rank <= 8""")
def h12_invariants(t):
    asks, askers = lookups.shared_asks(t.sql(INV_REQ), ["repo_hash", "symbol", "cluster_id", "min_confidence"])
    rows = lookups.find_invariants(asks, t.symbols, t.files, t.invariants)
    return routing.compact_shared(askers, rows, [F.desc("confidence"), c("invariant_id")], 8).select("query_id", "invariant_id", "rank", "cut")


@check("h12_compact_traces", f"""
WITH {TRACE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY flow_id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM hit)
SELECT query_id, flow_id, rank, greatest(0, n - 5) AS cut FROM ranked WHERE rank <= 5""")
def h12_traces(t):
    rows = lookups.trace_flows(t.requests, t.symbols, t.flows)
    return routing.compact_rows(rows, [c("flow_id")], 5).select("query_id", "flow_id", "rank", "cut")
