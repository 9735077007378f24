"""Scans, writes and resets of the index tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens.functions import paths, text
from repolens.sources import tables as tb
from repolens.sources import tree

from .registry import check


@check("a3_language_routing", """
SELECT language, count(*) AS n FROM (SELECT CASE WHEN f LIKE '%.py' THEN 'python' WHEN f LIKE '%.ts' THEN 'typescript'
  WHEN f LIKE '%.tsx' THEN 'tsx' END AS language FROM (SELECT file_path AS f FROM fx_symbols UNION ALL SELECT url FROM pages) u) t
GROUP BY language""")
def a3(t):
    names = t.symbols.select("file_path").union(t.base("pages").select("url"))
    return names.groupBy(paths.language_of(F.col("file_path")).alias("language")).agg(F.count("*").alias("n"))


INCOMING_FILES = """
SELECT repo_hash, CASE WHEN p_partkey % 5 = 0 THEN concat(file_path, '.new') ELSE file_path END AS file_path, p_partkey AS seq,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' END AS last_modified,
       CASE WHEN p_partkey % 4 = 0 THEN concat('c:n', CAST(line_start AS STRING)) ELSE NULL END AS cluster_id
FROM fx_symbols"""


@check("a5_file_upsert", f"""
SELECT repo_hash, file_path, CAST(arg_max(last_modified, seq) FILTER (WHERE last_modified IS NOT NULL) AS STRING) AS last_modified,
       arg_max(cluster_id, seq) FILTER (WHERE cluster_id IS NOT NULL) AS cluster_id
FROM (SELECT repo_hash, file_path, -1 AS seq, last_modified, cluster_id FROM fx_files
      UNION ALL SELECT repo_hash, file_path, seq, last_modified, cluster_id FROM ({INCOMING_FILES}) i) u
GROUP BY repo_hash, file_path""")
def a5(t):
    out = tb.upsert(t.files, t.sql(INCOMING_FILES), ["repo_hash", "file_path"], "seq", if_present=["last_modified", "cluster_id"])
    return out.withColumn("last_modified", F.col("last_modified").cast("string"))


@check("a6_scan_symbols_refs", """
SELECT repo_hash, symbol_id AS id, qualified_name AS detail FROM fx_symbols
UNION ALL SELECT repo_hash, source_symbol_id, concat(edge_kind, '>', target_symbol_id) FROM fx_refs""")
def a6(t):
    symbols = tb.scan(t.symbols, t.files).select("repo_hash", F.col("symbol_id").alias("id"), F.col("qualified_name").alias("detail"))
    refs = tb.scan(t.refs, t.files)
    return symbols.unionByName(
        refs.select("repo_hash", F.col("source_symbol_id").alias("id"), F.concat("edge_kind", F.lit(">"), "target_symbol_id").alias("detail"))
    )


@check("a7_scan_files", "SELECT repo_hash, file_path, CAST(last_modified AS STRING) AS last_modified, cluster_id FROM fx_files")
def a7(t):
    return tb.scan(t.files).withColumn("last_modified", F.col("last_modified").cast("string"))


@check("a8_scan_flows", "SELECT repo_hash, flow_id, source_symbol_id, sink_symbol_id, sensitivity, concat_ws('>', mid1, mid2) AS path FROM fx_flows")
def a8(t):
    return tb.scan(t.flows, t.symbols).select(
        "repo_hash", "flow_id", "source_symbol_id", "sink_symbol_id", "sensitivity", F.array_join("path", ">").alias("path"))


@check("a9_scan_clusters", """
SELECT repo_hash, cluster_id, role_description AS detail FROM fx_clusters
UNION ALL SELECT repo_hash, source_cluster_id, concat(kind, '>', target_cluster_id) FROM fx_cluster_deps""")
def a9(t):
    clusters = tb.scan(t.clusters).select("repo_hash", "cluster_id", F.col("role_description").alias("detail"))
    return clusters.unionByName(tb.scan(t.cluster_deps).select(
        "repo_hash", F.col("source_cluster_id").alias("cluster_id"), F.concat("kind", F.lit(">"), "target_cluster_id").alias("detail")))


@check("a10_scan_invariants", "SELECT invariant_id, target_symbol_id, text, confidence FROM fx_invariants ORDER BY confidence DESC")
def a10(t):
    return tb.scan_invariants(t.invariants).select("invariant_id", "target_symbol_id", "text", "confidence")


KEY = ["repo_hash", "qualified_name", "file_path", "line_start"]
# Stored rows: all but functions. Incoming rows: one per order line of every part, so keys repeat.
STORED = "SELECT repo_hash, qualified_name, file_path, line_start, line_end, kind, signature FROM fx_symbols WHERE kind <> 'function'"
OFFERED = """
SELECT s.repo_hash, s.qualified_name, s.file_path, s.line_start, CAST(s.line_end + l.l_linenumber AS INT) AS line_end, s.kind, s.signature,
       l.l_orderkey * 100000 + l.l_linenumber * 1000 + l.l_suppkey AS seq
FROM lineitem l JOIN fx_symbols s ON s.p_partkey = l.l_partkey"""


@check("a11_insert_symbols_if_absent", f"""
SELECT * FROM ({STORED}) o UNION ALL
SELECT repo_hash, qualified_name, file_path, line_start, min_line, kind, signature FROM (
  SELECT repo_hash, qualified_name, file_path, line_start, arg_min(line_end, seq) AS min_line, any_value(kind) AS kind, any_value(signature) AS signature
  FROM ({OFFERED}) i GROUP BY repo_hash, qualified_name, file_path, line_start) f
WHERE qualified_name NOT IN (SELECT qualified_name FROM ({STORED}) o2)""")
def a11(t):
    return tb.insert_if_absent(t.sql(STORED), t.sql(OFFERED), KEY, "seq")


@check("a12_ids_of_offered_symbols", f"""
SELECT i.seq, i.qualified_name, s.symbol_id FROM ({OFFERED}) i JOIN fx_symbols s ON s.qualified_name = i.qualified_name""")
def a12(t):
    return tb.ids_for(t.sql(OFFERED), t.symbols, KEY, "symbol_id").select("seq", "qualified_name", "symbol_id")


NEW_VECTORS = """
SELECT s.repo_hash, s.symbol_id, e.embedding, e.vec_id AS seq FROM embeddings e
JOIN fx_symbols s ON s.p_partkey = e.vec_id % 100"""


@check("a13_embedding_overwrite", f"""
SELECT repo_hash, symbol_id, round(CAST(arg_max(embedding[1], seq) AS DOUBLE), 6) AS head FROM (
  SELECT repo_hash, symbol_id, embedding, -1 AS seq FROM fx_embeddings UNION ALL SELECT * FROM ({NEW_VECTORS}) n) u
GROUP BY repo_hash, symbol_id""")
def a13(t):
    out = tb.upsert(t.embeddings, t.sql(NEW_VECTORS), ["repo_hash", "symbol_id"], "seq", overwrite=["embedding"])
    return out.select("repo_hash", "symbol_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("head"))


@check("a14_append_refs", """
SELECT repo_hash, source_symbol_id, target_symbol_id, edge_kind, 2 * count(*) AS n FROM fx_refs GROUP BY ALL""")
def a14(t):
    both = tb.append(t.refs, t.refs)
    return both.groupBy(*t.refs.columns).agg(F.count("*").alias("n"))


@check("a15_append_flows", """
SELECT repo_hash, source_symbol_id, concat_ws('>', mid1, mid2) AS path, 2 * count(*) AS n FROM fx_flows GROUP BY ALL""")
def a15(t):
    both = tb.append(t.flows, t.flows)
    return both.groupBy("repo_hash", "source_symbol_id", F.array_join("path", ">").alias("path")).agg(F.count("*").alias("n"))


@check("a16_append_clusters", """
SELECT repo_hash, concat(cluster_id, '+') AS cluster_id, role_description, naming_convention FROM fx_clusters
UNION ALL SELECT repo_hash, cluster_id, role_description, naming_convention FROM fx_clusters""")
def a16(t):
    rows = t.clusters.withColumnRenamed("n_files", "member_files")
    stored = rows.drop("member_files")
    return tb.append(stored, rows.withColumn("cluster_id", F.concat("cluster_id", F.lit("+"))))


@check("a17_append_dependencies", """
SELECT repo_hash, source_cluster_id, target_cluster_id, kind, 2 AS n FROM fx_cluster_deps""")
def a17(t):
    return tb.append(t.cluster_deps, t.cluster_deps).groupBy(*t.cluster_deps.columns).agg(F.count("*").cast("int").alias("n"))


@check("a18_append_invariants_default_time", """
SELECT invariant_id, CASE WHEN source_kind = 'test' THEN '2023-05-05 00:00:00' ELSE '2024-02-02 00:00:00' END AS extracted_at FROM fx_invariants""")
def a18(t):
    rows = t.plain("fx_invariants").withColumn("extracted_at", F.when(F.col("source_kind") == "test", F.lit("2023-05-05").cast("timestamp")))
    out = tb.append(rows.limit(0), rows, {"extracted_at": F.lit("2024-02-02").cast("timestamp")})
    return out.select("invariant_id", F.col("extracted_at").cast("string").alias("extracted_at"))


ASSIGN = "SELECT DISTINCT repo_hash, file_path, CASE WHEN file_path LIKE '%.py' THEN NULL ELSE 'c:new' END AS cluster_id FROM fx_symbols WHERE kind = 'class'"


@check("a19_assign_clusters", f"""
SELECT f.repo_hash, f.file_path, CASE WHEN a.file_path IS NOT NULL THEN a.cluster_id ELSE f.cluster_id END AS cluster_id
FROM fx_files f LEFT JOIN ({ASSIGN}) a ON a.repo_hash = f.repo_hash AND a.file_path = f.file_path""")
def a19(t):
    return tb.assign_clusters(t.files, t.sql(ASSIGN)).drop("last_modified")


REPO_EVENTS = """
SELECT repo_hash, concat('name-', node_id) AS name, concat('http://', node_id) AS git_url, CAST(NULL AS STRING) AS local_path, layer AS status,
       CAST(ts AS STRING) AS created_at, event_id FROM fx_events"""


@check("a20_repo_upsert", f"""
SELECT repo_hash, arg_max(name, event_id) AS name, arg_max(git_url, event_id) AS git_url, CAST(NULL AS STRING) AS local_path,
       arg_max(status, event_id) AS status, arg_min(substr(created_at, 1, 19), event_id) AS created_at FROM ({REPO_EVENTS}) e GROUP BY repo_hash""")
def a20(t):
    rows = t.sql(REPO_EVENTS).withColumn("created_at", F.substring("created_at", 1, 19))
    return tb.upsert(
        rows.drop("event_id").limit(0), rows, ["repo_hash"], "event_id",
        overwrite=["name", "git_url", "local_path", "status"], on_insert=["created_at"])


GONE = "SELECT DISTINCT repo_hash FROM fx_symbols WHERE repo_hash LIKE 'r1%'"


@check("a21_reset_clusters", f"""
SELECT f.repo_hash, f.file_path, CASE WHEN g.repo_hash IS NULL THEN f.cluster_id END AS cluster_id FROM fx_files f
LEFT JOIN ({GONE}) g ON g.repo_hash = f.repo_hash
UNION ALL SELECT repo_hash, cluster_id, role_description FROM fx_clusters WHERE repo_hash NOT IN (SELECT repo_hash FROM ({GONE}) h)""")
def a21(t):
    gone = t.sql(GONE)
    files = tb.clear_file_clusters(t.files, gone).select("repo_hash", "file_path", "cluster_id")
    left = tb.without_repos(t.clusters, gone)
    return files.union(left.select("repo_hash", "cluster_id", "role_description"))


@check("a22_reset_invariants", f"SELECT invariant_id FROM fx_invariants WHERE repo_hash NOT IN (SELECT repo_hash FROM ({GONE}) h)")
def a22(t):
    return tb.without_repos(t.plain("fx_invariants"), t.sql(GONE)).select("invariant_id")


@check("a23_delete_repo", f"""
SELECT 'symbols' AS name, count(*) AS n FROM fx_symbols WHERE repo_hash NOT IN (SELECT repo_hash FROM ({GONE}) h)
UNION ALL SELECT 'refs', count(*) FROM fx_refs WHERE repo_hash NOT IN (SELECT repo_hash FROM ({GONE}) h)
UNION ALL SELECT 'files', count(*) FROM fx_files WHERE repo_hash NOT IN (SELECT repo_hash FROM ({GONE}) h)
UNION ALL SELECT 'agent_runs', count(*) FROM fx_events""")
def a23(t):
    left = tb.delete_repos({"symbols": t.symbols, "refs": t.refs, "files": t.files, "agent_runs": t.events}, t.sql(GONE))
    out = None
    for name, df in left.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@check("a24_layer_counts", """
SELECT repo_hash, 'symbols' AS layer_table, count(*) AS n FROM fx_symbols GROUP BY repo_hash
UNION ALL SELECT repo_hash, 'flows', count(*) FROM fx_flows GROUP BY repo_hash
UNION ALL SELECT repo_hash, 'clusters', count(*) FROM fx_clusters GROUP BY repo_hash
UNION ALL SELECT repo_hash, 'cluster_dependencies', count(*) FROM fx_cluster_deps GROUP BY repo_hash
UNION ALL SELECT repo_hash, 'invariants', count(*) FROM fx_invariants GROUP BY repo_hash""")
def a24(t):
    return tb.layer_counts({
        "symbols": t.symbols, "flows": t.flows_once, "clusters": t.clusters,
        "cluster_dependencies": t.cluster_deps, "invariants": t.plain("fx_invariants")})


LISTING = """SELECT page_id, concat(CASE page_id % 7 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/.cache/' WHEN 2 THEN 'a/__pycache__/b/' WHEN 3 THEN 'src/node_modules_x/' ELSE 'src/' END,
  'f', CAST(page_id AS STRING), CASE page_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.d.ts' WHEN 3 THEN '.tsx' ELSE '.js' END) AS relative_path FROM pages"""


@check("a1_source_files", "SELECT page_id FROM pages WHERE page_id % 7 > 2 AND page_id % 5 IN (0, 1, 3)")
def a1(t):
    listed = t.sql(LISTING)
    return listed.where(~paths.in_pruned_directory(F.col("relative_path")) & paths.is_source_file(F.col("relative_path"))).select("page_id")


@check("a2_scan_summary", """
SELECT count(*) AS seen, count(*) FILTER (WHERE page_id % 5 IN (0, 1, 3)) AS kept, count(*) FILTER (WHERE page_id % 5 = 4) AS skipped_suffix,
  count(*) FILTER (WHERE page_id % 5 = 2) AS skipped_declaration FROM pages WHERE page_id % 7 > 2""")
def a2(t):
    return tree.scan_summary(t.sql(LISTING))
