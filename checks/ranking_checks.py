"""Ranking and graph-loop checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens.operators import graphs, ranking, search
from repolens.operators.ranked import fan_out

from .registry import check

c = F.col
AS_OF = "2024-06-01 00:00:00"


def rank_rounds(rounds: int = 60) -> str:
    """PageRank as plain SQL rounds; a repository stops changing once it has converged."""
    parts = [
        "links AS MATERIALIZED (SELECT DISTINCT repo_hash, source_symbol_id AS s, target_symbol_id AS t FROM fx_refs)",
        "node AS MATERIALIZED (SELECT y.repo_hash, y.symbol_id, z.n, coalesce(o.k, 0) AS k FROM fx_symbols y JOIN (SELECT repo_hash, count(*) AS n FROM fx_symbols GROUP BY 1) z USING (repo_hash) LEFT JOIN (SELECT s, count(*) AS k FROM links GROUP BY 1) o ON o.s = y.symbol_id)",
        "r0 AS MATERIALIZED (SELECT repo_hash, symbol_id, n, k, 1.0::DOUBLE / n AS v, FALSE AS done FROM node)",
    ]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        parts.append(
            f"m{i} AS MATERIALIZED (SELECT l.t, sum(p.v / p.k) AS m FROM links l JOIN {p} p ON p.symbol_id = l.s GROUP BY 1)"
        )
        parts.append(
            f"x{i} AS MATERIALIZED (SELECT p.*, CASE WHEN p.done THEN p.v ELSE 0.85::DOUBLE * (coalesce(m.m, 0) + d.d / p.n) + 0.15::DOUBLE / p.n END AS w FROM {p} p "
            f"JOIN (SELECT repo_hash, sum(CASE WHEN k = 0 THEN v ELSE 0 END) AS d FROM {p} GROUP BY 1) d USING (repo_hash) LEFT JOIN m{i} m ON m.t = p.symbol_id)"
        )
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT x.repo_hash, x.symbol_id, x.n, x.k, x.w AS v, x.done OR e.e < x.n * 1e-6 AS done FROM x{i} x JOIN (SELECT repo_hash, sum(abs(w - v)) AS e FROM x{i} GROUP BY 1) e USING (repo_hash))"
        )
    return ", ".join(parts) + f", pr AS (SELECT repo_hash, symbol_id, v AS value FROM r{rounds})"


SCALE = """CASE WHEN max(value) OVER w - min(value) OVER w <= 1e-9 * greatest(abs(max(value) OVER w), abs(min(value) OVER w)) THEN 0
  ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END"""
DEGREE = "SELECT s.repo_hash, s.symbol_id, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM fx_symbols s LEFT JOIN (SELECT source_symbol_id, count(*) AS n FROM fx_refs GROUP BY 1) r ON r.source_symbol_id = s.symbol_id"
RECENCY = f"""SELECT s.repo_hash, s.symbol_id, 1 - (epoch(TIMESTAMP '{AS_OF}') - epoch(f.last_modified)) / greatest(epoch(TIMESTAMP '{AS_OF}') - o.oldest, 1) AS value
FROM fx_symbols s JOIN fx_files f ON f.repo_hash = s.repo_hash AND f.file_path = s.file_path
JOIN (SELECT repo_hash, min(epoch(last_modified)) AS oldest FROM fx_files GROUP BY 1) o ON o.repo_hash = s.repo_hash WHERE f.last_modified IS NOT NULL"""
COVERAGE = """SELECT r.repo_hash, r.target_symbol_id AS symbol_id, CAST(count(*) AS DOUBLE) AS value FROM fx_refs r JOIN fx_symbols s ON s.symbol_id = r.source_symbol_id
WHERE split_part(s.file_path, '/', -1) LIKE 'test\\_%' ESCAPE '\\' OR s.file_path LIKE '%\\_test.py' ESCAPE '\\' GROUP BY ALL"""


@check("f1_min_max", f"SELECT repo_hash, symbol_id, round({SCALE}, 6) AS value FROM ({DEGREE}) d WINDOW w AS (PARTITION BY repo_hash)")
def f1(t):
    return ranking.scaled(graphs.out_degree(t.symbols, t.refs)).withColumn("value", F.round("value", 6))


@check("f3_pagerank", f"WITH {rank_rounds()} SELECT repo_hash, symbol_id, round(value, 6) AS value FROM pr")
def f3(t):
    return graphs.pagerank(t.symbols, t.refs).withColumn("value", F.round("value", 6))


@check("f4_out_degree", DEGREE)
def f4(t):
    return graphs.out_degree(t.symbols, t.refs)


@check("f5_centrality_signal", f"WITH {rank_rounds()} SELECT repo_hash, symbol_id, round({SCALE}, 5) AS value FROM pr WINDOW w AS (PARTITION BY repo_hash)")
def f5(t):
    return ranking.scaled(ranking.centrality(t.symbols, t.refs)).withColumn("value", F.round("value", 5))


@check("f6_change_recency", f"SELECT repo_hash, symbol_id, round(value, 6) AS value FROM ({RECENCY}) r")
def f6(t):
    return ranking.change_recency(t.symbols, t.files, AS_OF).withColumn("value", F.round("value", 6))


@check("f7_co_change", """
WITH q AS (SELECT DISTINCT repo_hash, path FROM fx_requests), n AS (SELECT a.repo_hash, a.file_path AS seed, b.file_path, count(*) AS k
  FROM fx_commits a JOIN fx_commits b ON b.commit_id = a.commit_id AND b.repo_hash = a.repo_hash AND b.file_path <> a.file_path
  WHERE (a.repo_hash, a.file_path) IN (SELECT (repo_hash, path) FROM q) GROUP BY ALL)
SELECT q.repo_hash, q.path, s.symbol_id, CAST(n.k AS DOUBLE) AS value FROM q JOIN n ON n.repo_hash = q.repo_hash AND n.seed = q.path
JOIN fx_symbols s ON s.repo_hash = n.repo_hash AND s.file_path = n.file_path""")
def f7(t):
    seeds = t.requests.select(F.concat_ws("|", "repo_hash", "path").alias("query_id"), "repo_hash", c("path").alias("file_path")).distinct()
    out = ranking.co_change(t.symbols, seeds, t.commits)
    return out.select("repo_hash", F.element_at(F.split("query_id", r"\|"), 2).alias("path"), "symbol_id", "value")


@check("f8_embedding_similarity", """
SELECT r.query_id, e.symbol_id, round(list_cosine_similarity(e.embedding::DOUBLE[], v.query_vector::DOUBLE[]), 5) AS value
FROM fx_requests r JOIN fx_query_vectors v ON v.query_id = r.query_id JOIN fx_symbols s ON s.repo_hash = r.repo_hash AND s.file_path = r.path
JOIN fx_embeddings e ON e.symbol_id = s.symbol_id""")
def f8(t):
    # only requests and symbols that have a vector meet, equal requests once
    asked = t.requests.join(t.query_vectors.select("query_id"), "query_id", "left_semi")
    held = t.symbols.join(t.embeddings.select("repo_hash", "symbol_id"), ["repo_hash", "symbol_id"], "left_semi")
    first, askers = search.equal_tasks(asked.select("query_id", "repo_hash", c("path").alias("file_path")), ["repo_hash", "file_path"], t.query_vectors)
    cand = first.join(held, ["repo_hash", "file_path"])
    out = ranking.embedding_similarity(cand, t.embeddings, t.query_vectors)
    return fan_out(askers, out.select(c("query_id").alias("lead"), "symbol_id", F.round("value", 5).alias("value")), "lead")


@check("f9_test_coverage", COVERAGE)
def f9(t):
    return ranking.coverage(t.symbols, t.refs)


# Fixed values, written out here and not taken from the engine.
WEIGHT_ROWS = """
('modify existing', 'structural_centrality', 0.35), ('modify existing', 'change_recency', 0.10), ('modify existing', 'co_change_correlation', 0.10),
('modify existing', 'embedding_similarity', 0.35), ('modify existing', 'test_coverage_proxy', 0.10),
('add new code', 'structural_centrality', 0.15), ('add new code', 'change_recency', 0.30), ('add new code', 'co_change_correlation', 0.30),
('add new code', 'embedding_similarity', 0.15), ('add new code', 'test_coverage_proxy', 0.10),
('understand', 'structural_centrality', 0.20), ('understand', 'change_recency', 0.05), ('understand', 'co_change_correlation', 0.05),
('understand', 'embedding_similarity', 0.60), ('understand', 'test_coverage_proxy', 0.10)"""


def weights_sql():
    return f"SELECT task_type, signal, weight::DOUBLE AS weight FROM (VALUES {WEIGHT_ROWS}) w(task_type, signal, weight)"


# Signals with the degree form of centrality, which is exact in both engines.
SIGNAL_CTES = f"""sc AS (SELECT symbol_id, {SCALE} AS v FROM ({DEGREE}) d WINDOW w AS (PARTITION BY repo_hash)),
cr AS (SELECT symbol_id, {SCALE} AS v FROM ({RECENCY}) d WINDOW w AS (PARTITION BY repo_hash)),
tc AS (SELECT symbol_id, {SCALE} AS v FROM ({COVERAGE}) d WINDOW w AS (PARTITION BY repo_hash)),
sig AS (SELECT s.repo_hash, s.symbol_id, s.qualified_name, s.file_path, coalesce(sc.v, 0) AS sc, coalesce(cr.v, 0) AS cr, coalesce(tc.v, 0) AS tc
  FROM fx_symbols s LEFT JOIN sc USING (symbol_id) LEFT JOIN cr USING (symbol_id) LEFT JOIN tc USING (symbol_id))"""
WEIGHT_CASE = {
    "structural_centrality": "CASE task_type WHEN 'modify existing' THEN 0.35::DOUBLE WHEN 'add new code' THEN 0.15::DOUBLE WHEN 'understand' THEN 0.2::DOUBLE END",
    "change_recency": "CASE task_type WHEN 'modify existing' THEN 0.1::DOUBLE WHEN 'add new code' THEN 0.3::DOUBLE WHEN 'understand' THEN 0.05::DOUBLE END",
    "co_change_correlation": "CASE task_type WHEN 'modify existing' THEN 0.1::DOUBLE WHEN 'add new code' THEN 0.3::DOUBLE WHEN 'understand' THEN 0.05::DOUBLE END",
    "embedding_similarity": "CASE task_type WHEN 'modify existing' THEN 0.35::DOUBLE WHEN 'add new code' THEN 0.15::DOUBLE WHEN 'understand' THEN 0.6::DOUBLE END",
    "test_coverage_proxy": "CASE task_type WHEN 'modify existing' THEN 0.1::DOUBLE WHEN 'add new code' THEN 0.1::DOUBLE WHEN 'understand' THEN 0.1::DOUBLE END",
}
SCORE = (f"({{sc}} * {WEIGHT_CASE['structural_centrality']} + {{cr}} * {WEIGHT_CASE['change_recency']} + {{cc}} * {WEIGHT_CASE['co_change_correlation']}"
         f" + {{es}} * {WEIGHT_CASE['embedding_similarity']} + {{tc}} * {WEIGHT_CASE['test_coverage_proxy']})")


@check("f10_combined_score", f"""
WITH {SIGNAL_CTES}, types AS (SELECT unnest(['modify existing', 'add new code', 'understand']) AS task_type)
SELECT symbol_id, task_type, round(cr, 6) AS change_recency, round(tc, 6) AS test_coverage_proxy, round({SCORE.format(sc='sc', cr='cr', cc='0', es='es', tc='tc')}, 6) AS score
FROM (SELECT sig.*, types.task_type, greatest(0, coalesce(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 0)) AS es
  FROM sig CROSS JOIN types LEFT JOIN fx_embeddings e USING (symbol_id) LEFT JOIN (SELECT min_by(embedding, vec_id) AS embedding FROM embeddings) q ON TRUE) z""")
def f10(t):
    types = F.explode(F.array(*[F.lit(k) for k in ranking.WEIGHTS])).alias("task_type")
    cand = t.symbols.select("repo_hash", "symbol_id", types).withColumn("query_id", c("task_type"))
    vector = t.base("embeddings").agg(F.min_by("embedding", "vec_id").alias("query_vector"))
    queries = vector.select(types.alias("query_id"), "query_vector")
    out = ranking.combine(
        cand, ranking.symbol_signals(t.symbols, t.refs, t.files, AS_OF, "degree"), ranking.embedding_similarity(cand, t.embeddings, queries))
    return out.select("symbol_id", "task_type", F.round("change_recency", 6).alias("change_recency"),
                      F.round("test_coverage_proxy", 6).alias("test_coverage_proxy"), F.round("score", 6).alias("score"))


@check("f11_weight_table", f"""
SELECT r.query_id, w.task_type, w.signal, w.weight FROM fx_requests r JOIN ({weights_sql()}) w
  ON w.task_type = CASE WHEN starts_with(r.question, 'add') THEN 'add new code' WHEN starts_with(r.question, 'explain') THEN 'understand' ELSE 'modify existing' END""")
def f11(t):
    from repolens.functions import text

    tasks = t.requests.select("query_id", text.task_type(c("question")).alias("task_type"))
    return tasks.join(F.broadcast(ranking.weight_rows(t.spark)), "task_type").select("query_id", "task_type", "signal", "weight")


@check("f12_symbol_signals", f"""
WITH {SIGNAL_CTES} SELECT repo_hash, symbol_id, round(sc, 6) AS structural_centrality, round(cr, 6) AS change_recency, round(tc, 6) AS test_coverage_proxy FROM sig""")
def f12(t):
    out = ranking.symbol_signals(t.symbols, t.refs, t.files, AS_OF, "degree")
    return out.select("repo_hash", "symbol_id", *[F.round(n, 6).alias(n) for n in ("structural_centrality", "change_recency", "test_coverage_proxy")])
