"""Retrieval, context and the direct queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens.operators import context, lookups, ranking, search
from repolens.operators.ranked import fan_out
from repolens.session import cut_lineage

from .ranking_checks import AS_OF, SCORE, SIGNAL_CTES
from .registry import check
from .scalars import keywords_sql, task_type_sql

c = F.col

# Three shapes of task: the question, a cut word that no name holds whole, and text that matches nothing.
TASKS = """
SELECT query_id, repo_hash, CASE query_id % 3 WHEN 0 THEN question WHEN 1 THEN concat(substr(symbol, 2, 5), ' ', direction) ELSE 'zzz qqq' END AS question,
       CASE WHEN query_id % 6 = 5 THEN symbol ELSE NULL END AS seed_symbol, query_id % 2 AS odd FROM fx_requests"""
HITS = f"""
task AS (SELECT *, {keywords_sql('question')} AS keywords, {task_type_sql('question')} AS task_type FROM ({{tasks}}) x),
tok AS (SELECT repo_hash, symbol_id, qualified_name, token, count(*) AS hits FROM (SELECT repo_hash, symbol_id, qualified_name,
  unnest(regexp_split_to_array(lower(concat(qualified_name, ' ', signature)), '[^a-z0-9_]+')) AS token FROM fx_symbols) t WHERE token <> '' GROUP BY ALL),
srch AS MATERIALIZED (SELECT DISTINCT repo_hash, keywords FROM task),
srch_hit AS MATERIALIZED (SELECT w.repo_hash, w.keywords, k.symbol_id, k.qualified_name, CAST(sum(k.hits) AS BIGINT) AS hits FROM (SELECT repo_hash, keywords, unnest(list_distinct(keywords)) AS token FROM srch) w
  JOIN tok k ON k.repo_hash = w.repo_hash AND k.token = w.token GROUP BY ALL),
srch_top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_hash, keywords ORDER BY hits DESC, qualified_name, symbol_id) AS rank FROM srch_hit) z WHERE rank <= 200),
sub_top AS MATERIALIZED (SELECT * FROM (SELECT w.repo_hash, w.word, s.symbol_id, row_number() OVER (PARTITION BY w.repo_hash, w.word ORDER BY s.qualified_name, s.symbol_id) AS rank
  FROM (SELECT DISTINCT repo_hash, keywords[1] AS word FROM srch) w JOIN fx_symbols s ON s.repo_hash = w.repo_hash AND contains(lower(s.qualified_name), w.word)) z WHERE rank <= 200)"""
CANDS = f"""{HITS},
word_hit AS (SELECT t.query_id, t.repo_hash, h.symbol_id FROM task t JOIN srch_top h ON h.repo_hash = t.repo_hash AND h.keywords = t.keywords),
any_hit AS (SELECT * FROM word_hit UNION ALL SELECT t.query_id, t.repo_hash, h.symbol_id FROM task t JOIN sub_top h ON h.repo_hash = t.repo_hash AND h.word = t.keywords[1]
  WHERE NOT EXISTS (SELECT 1 FROM srch_top x WHERE x.repo_hash = t.repo_hash AND x.keywords = t.keywords)),
seeded AS (SELECT * FROM any_hit UNION SELECT t.query_id, t.repo_hash, s.symbol_id FROM task t JOIN fx_symbols s ON s.repo_hash = t.repo_hash AND s.qualified_name = t.seed_symbol),
cand AS MATERIALIZED (SELECT * FROM seeded UNION ALL SELECT t.query_id, t.repo_hash, f.symbol_id FROM task t JOIN (SELECT * FROM (SELECT repo_hash, symbol_id,
  row_number() OVER (PARTITION BY repo_hash ORDER BY qualified_name, symbol_id) AS rn FROM fx_symbols) z WHERE rn <= 200) f ON f.repo_hash = t.repo_hash
  WHERE t.query_id NOT IN (SELECT query_id FROM seeded))"""


def tasks_of(t):
    return search.decompose(t.sql(TASKS))


REPLIES = """
SELECT query_id, CASE query_id % 4 WHEN 0 THEN concat('```json', chr(10), '{"task_type": "understand", "keywords": ["Auth", "LOGIN", "a", "b", "c", "d", "e", "f", "g"], "constraints": ["x", "y", "z", "w"]}', chr(10), '```')
  WHEN 1 THEN '{"task_type": "nonsense", "keywords": ["One"]}' WHEN 2 THEN 'not json' END AS reply FROM fx_requests"""


@check("g2_model_decomposition", f"""
SELECT query_id, CASE query_id % 4 WHEN 0 THEN 'understand' WHEN 1 THEN 'modify existing' ELSE {task_type_sql('question')} END AS task_type,
  CASE query_id % 4 WHEN 0 THEN 'auth login a b c d e f' WHEN 1 THEN 'one' ELSE array_to_string({keywords_sql('question')}, ' ') END AS keywords,
  CASE query_id % 4 WHEN 0 THEN 'x,y,z' ELSE '' END AS constraints FROM fx_requests""")
def g2(t):
    out = search.decompose(t.requests, t.sql(REPLIES))
    return out.select("query_id", "task_type", F.array_join("keywords", " ").alias("keywords"), F.array_join("constraints", ",").alias("constraints"))


@check("g3_text_search", f"""
WITH {HITS.format(tasks='SELECT query_id, repo_hash, question FROM fx_requests')}
SELECT t.query_id, h.symbol_id, h.hits, h.rank FROM task t JOIN srch_top h ON h.repo_hash = t.repo_hash AND h.keywords = t.keywords""")
def g3(t):
    searches = search.search_terms(search.decompose(t.requests))
    return search.text_search(searches, t.symbols).drop("repo_hash")


@check("g4_substring_search", f"""
WITH {HITS.format(tasks=TASKS)} SELECT t.query_id, h.symbol_id, h.rank FROM task t JOIN sub_top h ON h.repo_hash = t.repo_hash AND h.word = t.keywords[1]""")
def g4(t):
    return search.substring_search(search.search_terms(tasks_of(t)), t.symbols).drop("repo_hash")


@check("g5_candidates", f"WITH {CANDS.format(tasks=TASKS)} SELECT query_id, symbol_id FROM cand")
def g5(t):
    return search.candidates(tasks_of(t), t.symbols, tables=t.search_tables).drop("repo_hash")


REGION = """at_file AS (SELECT s.symbol_id, f.cluster_id FROM fx_symbols s JOIN fx_files f ON f.repo_hash = s.repo_hash AND f.file_path = s.file_path),
per AS (SELECT d.query_id, a.cluster_id, count(*) AS n FROM cand d LEFT JOIN at_file a ON a.symbol_id = d.symbol_id GROUP BY ALL),
region AS (SELECT query_id, first(cluster_id ORDER BY n DESC, cluster_id) FILTER (WHERE cluster_id IS NOT NULL) AS region_id,
  max(n) FILTER (WHERE cluster_id IS NOT NULL) / sum(n) AS share FROM per GROUP BY query_id),
dominant AS (SELECT query_id, region_id FROM region WHERE share >= 0.6),
scoped AS (SELECT d.query_id, d.repo_hash, d.symbol_id, r.region_id FROM cand d LEFT JOIN dominant r ON r.query_id = d.query_id JOIN at_file a ON a.symbol_id = d.symbol_id
  WHERE r.region_id IS NULL OR a.cluster_id = r.region_id)"""
# Tasks that name one folder, so that some have a dominant region.
NARROW = """SELECT query_id, repo_hash, CASE query_id % 2 WHEN 0 THEN question ELSE concat('fix ', split_part(symbol, '.', 4)) END AS question, CAST(NULL AS STRING) AS seed_symbol FROM fx_requests"""


@check("g6_region_scoping", f"WITH {CANDS.format(tasks=NARROW)}, {REGION} SELECT query_id, symbol_id, region_id FROM scoped")
def g6(t):
    # equal tasks are searched and scoped once
    first, askers = context.equal_searches(search.decompose(t.sql(NARROW)), t.symbols, t.search_tables)
    cands = cut_lineage(search.candidates(first, t.symbols, tables=t.search_tables))
    regions = context.dominant_regions(cands, t.symbols, t.files, t.clusters)
    scoped = context.scope_to_region(cands, regions, t.symbols, t.files).drop("repo_hash")
    return for_all(askers, scoped)


RANKED = f"""{CANDS.format(tasks=NARROW)}, {REGION}, {SIGNAL_CTES},
qv AS (SELECT query_id, query_vector FROM fx_query_vectors),
es AS (SELECT s.query_id, s.symbol_id, greatest(0, list_cosine_similarity(e.embedding::DOUBLE[], qv.query_vector::DOUBLE[])) AS es FROM scoped s JOIN fx_embeddings e ON e.symbol_id = s.symbol_id JOIN qv ON qv.query_id = s.query_id),
scored AS (SELECT s.query_id, s.region_id, sig.*, t.task_type, coalesce(es.es, 0) AS es FROM scoped s JOIN task t ON t.query_id = s.query_id JOIN sig ON sig.symbol_id = s.symbol_id
  LEFT JOIN es ON es.query_id = s.query_id AND es.symbol_id = s.symbol_id),
score AS (SELECT *, {SCORE.format(sc='sc', cr='cr', cc='0', es='es', tc='tc')} AS score FROM scored),
ranked AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, qualified_name, symbol_id) AS rank FROM score) z WHERE rank <= 12)"""


def index_of(t):
    return context.Index(
        t.symbols, t.refs, t.files, t.clusters, t.cluster_deps, t.flows, t.invariants,
        ranking.symbol_signals(t.symbols, t.refs, t.files, AS_OF, "degree"), t.embeddings, t.search_tables)


def ranked_of(t):
    return context.ranked_symbols(search.decompose(t.sql(NARROW)), index_of(t), t.query_vectors)


def ranked_once_of(t):
    """Symbols of requests that rank the same ones, and who asked for them; what is attached to them fans out last."""
    ranked, _, askers = context.ranked_once(search.decompose(t.sql(NARROW)), index_of(t), t.query_vectors)
    return ranked, askers


def for_all(askers, rows):
    return fan_out(askers, rows.withColumnRenamed("query_id", "lead"), "lead")


@check("g07_top_symbols", f"WITH {RANKED} SELECT query_id, rank, symbol_id, round(score, 5) AS score FROM ranked")
def g7(t):
    return ranked_of(t).select("query_id", "rank", "symbol_id", F.round("score", 5).alias("score"))


@check("g8_hydrated_symbols", f"""
WITH {RANKED} SELECT r.query_id, r.rank, s.qualified_name, s.file_path, s.line_start, s.line_end, s.kind, s.signature, round(r.es, 5) AS embedding_similarity FROM ranked r JOIN fx_symbols s USING (symbol_id)""")
def g8(t):
    return ranked_of(t).select("query_id", "rank", "qualified_name", "file_path", "line_start", "line_end", "kind", "signature",
                               F.round("embedding_similarity", 5).alias("embedding_similarity"))


@check("g9_attached_invariants", f"""
WITH {RANKED} SELECT r.query_id, count(*) FILTER (WHERE i.confidence >= 0.4) AS n_attached, count(*) FILTER (WHERE i.confidence < 0.4) AS n_filtered
FROM ranked r JOIN fx_invariants i ON i.target_symbol_id = r.symbol_id GROUP BY r.query_id""")
def g9(t):
    ranked, askers = ranked_once_of(t)
    return for_all(askers, context.invariant_counts(context.attach_invariants(ranked, t.invariants)))


FLOW_NODES = """node AS (SELECT flow_id, unnest(list_filter([source_symbol_id, mid1, mid2, sink_symbol_id], lambda x: x IS NOT NULL)) AS symbol_id,
  generate_subscripts(list_filter([source_symbol_id, mid1, mid2, sink_symbol_id], lambda x: x IS NOT NULL), 1) AS pos FROM fx_flows),
named AS (SELECT f.flow_id, list(s.qualified_name ORDER BY n.pos) AS names FROM fx_flows f JOIN node n USING (flow_id) JOIN fx_symbols s ON s.symbol_id = n.symbol_id GROUP BY ALL)"""
FLOW_HITS = f"""{FLOW_NODES},
touch AS (SELECT DISTINCT r.query_id, n.flow_id FROM ranked r JOIN node n ON n.symbol_id = r.symbol_id),
flow_hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY flow_id) AS flow_rank FROM touch) z WHERE flow_rank <= 25)"""


@check("g10_attached_flows", f"WITH {RANKED}, {FLOW_HITS} SELECT h.query_id, h.flow_rank, n.names[1] AS source_symbol, n.names[-1] AS sink_symbol, array_to_string(n.names[2:-2], '>') AS path FROM flow_hit h JOIN named n USING (flow_id)")
def g10(t):
    ranked, askers = ranked_once_of(t)
    hits = cut_lineage(context.attach_flows(ranked, t.flows))
    used = t.flows.join(hits.select("repo_hash", "flow_id").distinct(), ["repo_hash", "flow_id"], "left_semi")
    named = lookups.flow_payloads(used, t.symbols)
    return for_all(askers, hits.join(named, ["repo_hash", "flow_id"]).select(
        "query_id", "flow_rank", "source_symbol", "sink_symbol", F.array_join("path", ">").alias("path")))


EXEMPLARS = """exm AS (SELECT * FROM (SELECT query_id, file_path, best, qn, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank FROM (
  SELECT query_id, file_path, min(rank) AS best, arg_min(qualified_name, rank) AS qn FROM ranked GROUP BY ALL) a) z WHERE rank <= 3)"""


@check("g11_bundle_exemplars", f"WITH {RANKED}, {EXEMPLARS} SELECT query_id, rank, file_path, concat('top-ranked symbol ', qn) AS reason FROM exm")
def g11(t):
    ranked, askers = ranked_once_of(t)
    return for_all(askers, context.exemplars(ranked).drop("repo_hash"))


BUNDLE = f"""WITH {RANKED}, {FLOW_HITS}, {EXEMPLARS},
inv AS (SELECT r.query_id, count(*) FILTER (WHERE i.confidence >= 0.4) AS hi, count(*) FILTER (WHERE i.confidence < 0.4) AS lo FROM ranked r JOIN fx_invariants i ON i.target_symbol_id = r.symbol_id GROUP BY ALL),
sy AS (SELECT query_id, string_agg(symbol_id, ',' ORDER BY rank) AS symbols, max(region_id) AS region_id FROM ranked GROUP BY ALL),
ex AS (SELECT query_id, string_agg(file_path, ',' ORDER BY rank) AS exemplars FROM exm GROUP BY ALL),
fl AS (SELECT query_id, count(*) AS n_flows FROM flow_hit GROUP BY ALL)
SELECT t.query_id, t.task_type, sy.symbols, ex.exemplars, coalesce(fl.n_flows, 0) AS n_flows, sy.region_id,
  concat_ws('; ', CASE WHEN sy.region_id IS NOT NULL THEN 'region scoping applied' END, CASE WHEN qv.query_id IS NULL THEN 'embedding model unavailable; ranking used text + structure only' END,
   CASE WHEN hi > 0 THEN concat('attached ', hi, ' invariant(s) to ranked symbols') END, CASE WHEN lo > 0 THEN concat('filtered ', lo, ' low-confidence invariant(s) (< 0.4)') END,
   CASE WHEN n_flows > 0 THEN concat('attached ', n_flows, ' flow(s) touching ranked symbols') END) AS notes
FROM task t JOIN sy USING (query_id) LEFT JOIN ex USING (query_id) LEFT JOIN fl USING (query_id) LEFT JOIN inv USING (query_id) LEFT JOIN qv USING (query_id)"""


def flat_bundle(out, t):
    ids = F.transform("relevant_symbols", lambda s: F.concat(F.lit("s"), F.regexp_extract(s["qualified_name"], r"_(\d+)$", 1)))
    return out.select(
        "query_id", "task_type", F.array_join(ids, ",").alias("symbols"),
        F.array_join(F.transform("exemplars", lambda e: e["file_path"]), ",").alias("exemplars"),
        F.coalesce(F.size("flows"), F.lit(0)).cast("bigint").alias("n_flows"), c("region.cluster_id").alias("region_id"),
        F.array_join("notes", "; ").alias("notes"))


@check("g12_bundles", BUNDLE)
def g12(t):
    tasks, index = search.decompose(t.sql(NARROW)), index_of(t)
    ranked, first, askers = context.ranked_once(tasks, index, t.query_vectors)
    first, askers = context.with_nameless(first, askers, tasks)
    out = context.bundles(first, ranked, context.attach_invariants(ranked, t.invariants), context.attach_flows(ranked, t.flows), index, t.query_vectors)
    return for_all(askers, flat_bundle(out, t))


@check("g13_find_relevant_context", BUNDLE)
def g13(t):
    asks, askers = context.equal_requests(t.sql(NARROW))
    return for_all(askers, flat_bundle(context.find_relevant_context(asks, index_of(t), t.query_vectors), t))


TRACE = """hit AS (SELECT r.query_id, f.flow_id FROM fx_requests r JOIN fx_symbols s ON s.repo_hash = r.repo_hash AND s.qualified_name = r.symbol
  JOIN fx_flows f ON CASE WHEN r.direction = 'forward' THEN f.source_symbol_id ELSE f.sink_symbol_id END = s.symbol_id
  WHERE (CASE WHEN mid1 IS NULL THEN 0 ELSE 1 END + CASE WHEN mid2 IS NULL THEN 0 ELSE 1 END) <= greatest(0, r.depth - 1))"""


@check("g14_trace_data_flow", f"""
WITH {TRACE}, {FLOW_NODES} SELECT h.query_id, n.names[1] AS source_symbol, n.names[-1] AS sink_symbol, array_to_string(n.names[2:-2], '>') AS path, f.sensitivity
FROM hit h JOIN named n USING (flow_id) JOIN fx_flows f USING (flow_id)""")
def g14(t):
    out = lookups.trace_data_flow(t.requests, t.symbols, t.flows)
    return out.select("query_id", "source_symbol", "sink_symbol", F.array_join("path", ">").alias("path"), "sensitivity")


@check("g15_trace_depth", f"WITH {TRACE} SELECT query_id, flow_id FROM hit")
def g15(t):
    return lookups.trace_flows(t.requests, t.symbols, t.flows).select("query_id", "flow_id")


@check("g16_flows_touching", f"""
WITH {FLOW_NODES} SELECT DISTINCT s.repo_hash, s.file_path, n.flow_id FROM fx_symbols s JOIN node n ON n.symbol_id = s.symbol_id""")
def g16(t):
    ids = t.symbols.select(c("file_path").alias("query_id"), "repo_hash", "symbol_id")
    return lookups.flows_touching(ids, t.flows_once).withColumnRenamed("query_id", "file_path")


@check("g17_flow_payloads", f"""
WITH {FLOW_NODES} SELECT f.flow_id, coalesce(a.qualified_name, '') AS source_symbol, coalesce(b.qualified_name, '') AS sink_symbol, f.flow_kind, f.sensitivity
FROM fx_flows f LEFT JOIN fx_symbols a ON a.symbol_id = f.source_symbol_id AND a.kind = 'function' LEFT JOIN fx_symbols b ON b.symbol_id = f.sink_symbol_id AND b.kind = 'function'""")
def g17(t):
    out = lookups.flow_payloads(t.flows, t.symbols.where("kind = 'function'"))
    return out.select("flow_id", "source_symbol", "sink_symbol", "flow_kind", "sensitivity")


INV_REQ = "SELECT query_id, repo_hash, CASE WHEN query_id % 2 = 0 THEN symbol ELSE NULL END AS symbol, CASE WHEN query_id % 16 = 1 THEN NULL ELSE cluster_id END AS cluster_id, min_confidence FROM fx_requests"
INV_AT = "SELECT s.repo_hash, s.symbol_id, s.qualified_name, f.cluster_id, i.invariant_id, i.confidence, i.text FROM fx_invariants i JOIN fx_symbols s ON s.symbol_id = i.target_symbol_id JOIN fx_files f ON f.repo_hash = s.repo_hash AND f.file_path = s.file_path"


@check("g18_find_invariants", f"""
WITH q AS ({INV_REQ}), a AS ({INV_AT})
SELECT q.query_id, a.invariant_id, a.qualified_name AS target_symbol, a.text, a.confidence FROM q JOIN a ON a.repo_hash = q.repo_hash AND a.qualified_name = q.symbol WHERE a.confidence >= q.min_confidence
UNION ALL SELECT q.query_id, a.invariant_id, a.qualified_name, a.text, a.confidence FROM q JOIN a ON a.repo_hash = q.repo_hash AND a.cluster_id = q.cluster_id WHERE q.symbol IS NULL AND a.confidence >= q.min_confidence""")
def g18(t):
    out = lookups.find_invariants(t.sql(INV_REQ), t.symbols, t.files, t.invariants)
    return out.select("query_id", "invariant_id", "target_symbol", "text", "confidence")


@check("g19_invariants_of_symbols", "SELECT i.invariant_id, i.confidence FROM fx_invariants i JOIN fx_symbols s ON s.symbol_id = i.target_symbol_id WHERE confidence >= 0.5")
def g19(t):
    return lookups.invariants_of_symbols(t.symbols, t.plain("fx_invariants"), 0.5).select("invariant_id", "confidence")


@check("g20_invariants_per_symbol", """
SELECT i.target_symbol_id, count(*) AS n, max(confidence) AS best FROM fx_invariants i JOIN fx_symbols s ON s.symbol_id = i.target_symbol_id JOIN fx_requests r ON r.symbol = s.qualified_name AND r.query_id = (SELECT min(query_id) FROM fx_requests r2 WHERE r2.symbol = s.qualified_name AND r2.repo_hash = s.repo_hash) GROUP BY ALL""")
def g20(t):
    ids = lookups.symbols_by_name(t.requests, t.symbols)
    rows = lookups.invariants_of_symbols(ids, t.plain("fx_invariants"))
    return rows.groupBy("target_symbol_id").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


@check("g21_invariants_of_files", """
SELECT i.invariant_id FROM fx_invariants i JOIN fx_symbols s ON s.symbol_id = i.target_symbol_id WHERE (s.repo_hash, s.file_path) IN (SELECT (repo_hash, path) FROM fx_requests)""")
def g21(t):
    return lookups.invariants_of_files(t.requests, t.plain("fx_invariants"), t.symbols).select("invariant_id")


@check("g22_invariants_of_clusters", f"WITH a AS ({INV_AT}) SELECT invariant_id FROM a WHERE confidence >= 0.5 AND (repo_hash, cluster_id) IN (SELECT (repo_hash, cluster_id) FROM fx_requests)")
def g22(t):
    return lookups.invariants_of_clusters(t.requests, t.plain("fx_invariants"), t.symbols, t.files, 0.5).select("invariant_id")


@check("g23_invariant_payloads", "SELECT i.invariant_id, coalesce(s.qualified_name, '') AS target_symbol, i.text, i.source_kind, i.source_location, i.confidence FROM fx_invariants i LEFT JOIN fx_symbols s ON s.symbol_id = i.target_symbol_id")
def g23(t):
    return lookups.invariant_payloads(t.invariants, t.symbols).drop("repo_hash", "target_symbol_id", "file_path")


ARCH_REQ = "SELECT query_id, repo_hash, CASE query_id % 3 WHEN 0 THEN cluster_id WHEN 1 THEN 'c:unknown' ELSE NULL END AS cluster_id, path FROM fx_requests"


def shaped(clusters):
    """Stored clusters with a code shape."""
    return clusters.withColumns({"patterns": F.array(F.concat(c("n_files"), F.lit(" files"))), "source": F.lit("heuristic")})


def shape_text():
    shape = F.concat(F.array_join("code_shape.patterns", ","), F.lit("|"), c("code_shape.source"))
    return F.when(c("code_shape").isNotNull(), shape).alias("shape")


@check("g24_describe_architecture", f"""
WITH q AS (SELECT r.query_id, r.repo_hash, coalesce(r.cluster_id, f.cluster_id) AS cid FROM ({ARCH_REQ}) r LEFT JOIN fx_files f ON f.repo_hash = r.repo_hash AND f.file_path = r.path)
SELECT q.query_id, k.cluster_id, coalesce(k.role_description, '') AS role, k.naming_convention AS naming, CASE WHEN k.cluster_id IS NOT NULL THEN concat(k.n_files, ' files|heuristic') END AS shape,
  coalesce((SELECT string_agg(d.target_cluster_id, ',' ORDER BY d.target_cluster_id) FROM fx_cluster_deps d WHERE d.repo_hash = q.repo_hash AND d.source_cluster_id = k.cluster_id AND d.kind = 'allowed'), '') AS allowed,
  coalesce((SELECT string_agg(d.target_cluster_id, ',' ORDER BY d.target_cluster_id) FROM fx_cluster_deps d WHERE d.repo_hash = q.repo_hash AND d.source_cluster_id = k.cluster_id AND d.kind = 'forbidden'), '') AS forbidden,
  coalesce(k.n_files, 0) AS n_members FROM q LEFT JOIN fx_clusters k ON k.repo_hash = q.repo_hash AND k.cluster_id = q.cid""")
def g24(t):
    out = lookups.describe_architecture(t.sql(ARCH_REQ), t.files, shaped(t.clusters), t.cluster_deps)
    return out.select("query_id", "cluster_id", "role", "naming", shape_text(), *[F.array_join(n, ",").alias(n) for n in ("allowed", "forbidden")], "n_members")


@check("g25_regions", """
SELECT k.repo_hash, k.cluster_id, k.role_description AS role, concat(any_value(k.n_files), ' files|heuristic') AS shape, coalesce(string_agg(CASE WHEN kind = 'allowed' THEN target_cluster_id END, ',' ORDER BY target_cluster_id), '') AS allowed,
  coalesce(string_agg(CASE WHEN kind = 'forbidden' THEN target_cluster_id END, ',' ORDER BY target_cluster_id), '') AS forbidden
FROM fx_clusters k LEFT JOIN fx_cluster_deps d ON d.repo_hash = k.repo_hash AND d.source_cluster_id = k.cluster_id GROUP BY ALL""")
def g25(t):
    out = lookups.regions(shaped(t.clusters), t.cluster_deps).drop("naming")
    out = out.withColumn("shape", shape_text()).drop("code_shape")
    return out.withColumns({n: F.array_join(n, ",") for n in ("allowed", "forbidden")})


@check("g26_find_exemplars", f"""
WITH {SIGNAL_CTES}, req AS (SELECT min(query_id) AS query_id, repo_hash, cluster_id, question FROM fx_requests GROUP BY repo_hash, cluster_id, question),
sc2 AS (SELECT q.query_id, m.file_path, 0.35::DOUBLE * sig.sc + 0.1::DOUBLE * sig.cr + 0.35::DOUBLE * greatest(0, coalesce(list_cosine_similarity(e.embedding::DOUBLE[], v.query_vector::DOUBLE[]), 0)) + 0.1::DOUBLE * sig.tc AS score
  FROM req q JOIN fx_files m ON m.repo_hash = q.repo_hash AND m.cluster_id = q.cluster_id JOIN fx_symbols s ON s.repo_hash = m.repo_hash AND s.file_path = m.file_path JOIN sig ON sig.symbol_id = s.symbol_id
  LEFT JOIN fx_embeddings e ON e.symbol_id = s.symbol_id LEFT JOIN fx_query_vectors v ON v.query_id = q.query_id),
best AS (SELECT query_id, file_path, max(score) AS score FROM sc2 GROUP BY ALL),
top AS (SELECT query_id, file_path, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, file_path) AS rank, TRUE AS scored FROM best
  UNION ALL SELECT q.query_id, m.file_path, row_number() OVER (PARTITION BY q.query_id ORDER BY m.file_path), FALSE FROM req q JOIN fx_files m ON m.repo_hash = q.repo_hash AND m.cluster_id = q.cluster_id WHERE q.query_id NOT IN (SELECT query_id FROM best))
SELECT r.query_id, t.rank, t.file_path, t.scored FROM fx_requests r JOIN req q ON q.repo_hash = r.repo_hash AND q.cluster_id = r.cluster_id AND q.question = r.question JOIN top t ON t.query_id = q.query_id WHERE t.rank <= 5""")
def g26(t):
    signals = ranking.symbol_signals(t.symbols, t.refs, t.files, AS_OF, "degree")
    out = lookups.find_exemplars(t.requests, t.files, t.symbols, signals, t.embeddings, t.query_vectors)
    return out.select("query_id", "rank", "file_path", c("reason").startswith("top-ranked").alias("scored"))


@check("g27_symbol_lookup", """
SELECT r.query_id, s.symbol_id FROM fx_requests r JOIN fx_symbols s ON s.repo_hash = r.repo_hash AND s.qualified_name = r.symbol
UNION ALL SELECT -1, symbol_id FROM fx_symbols WHERE symbol_id IN (SELECT source_symbol_id FROM fx_refs)""")
def g27(t):
    by_name = lookups.symbols_by_name(t.requests, t.symbols).select("query_id", "symbol_id")
    by_id = lookups.symbols_by_id(t.refs.select("repo_hash", c("source_symbol_id").alias("symbol_id")), t.symbols)
    return by_name.union(by_id.select(F.lit(-1).cast("bigint"), "symbol_id"))


@check("g28_symbols_of_files", "SELECT symbol_id, line_start FROM fx_symbols WHERE (repo_hash, file_path) IN (SELECT (repo_hash, path) FROM fx_requests)")
def g28(t):
    return lookups.symbols_of_files(t.requests, t.symbols).select("symbol_id", "line_start")


@check("g29_cluster_of_files", "SELECT f.repo_hash, f.file_path, k.cluster_id, k.role_description FROM fx_files f JOIN fx_clusters k ON k.repo_hash = f.repo_hash AND k.cluster_id = f.cluster_id WHERE (f.repo_hash, f.file_path) IN (SELECT (repo_hash, path) FROM fx_requests)")
def g29(t):
    return lookups.clusters_of_files(t.requests, t.files, t.clusters).select("repo_hash", "file_path", "cluster_id", "role_description")


@check("g30_cluster_by_id", "SELECT repo_hash, cluster_id, role_description FROM fx_clusters WHERE (repo_hash, cluster_id) IN (SELECT (repo_hash, cluster_id) FROM fx_requests)")
def g30(t):
    return lookups.clusters_by_id(t.requests, t.clusters).select("repo_hash", "cluster_id", "role_description")


@check("g31_cluster_members", """
WITH m AS (SELECT repo_hash, cluster_id, file_path FROM fx_files WHERE (repo_hash, cluster_id) IN (SELECT (repo_hash, cluster_id) FROM fx_requests))
SELECT cluster_id, file_path AS member FROM m UNION ALL SELECT m.cluster_id, s.symbol_id FROM m JOIN fx_symbols s ON s.repo_hash = m.repo_hash AND s.file_path = m.file_path""")
def g31(t):
    files = lookups.member_files(t.requests, t.files).select("cluster_id", c("file_path").alias("member"))
    return files.union(lookups.member_symbols(t.requests, t.files, t.symbols).select("cluster_id", "symbol_id"))


@check("g32_embedding_lookup", "SELECT e.symbol_id, len(e.embedding) AS dims FROM fx_embeddings e WHERE e.symbol_id IN (SELECT target_symbol_id FROM fx_refs)")
def g32(t):
    ids = t.refs.select("repo_hash", c("target_symbol_id").alias("symbol_id"))
    return lookups.embeddings_of(ids, t.embeddings).select("symbol_id", F.size("embedding").cast("bigint").alias("dims"))
