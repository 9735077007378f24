"""Projection and rollup checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens.functions import labels
from repolens.operators import projections as pj
from repolens.operators import rollups as ru

from .registry import check
from .scalars import GUESS, TIER_SQL, drill_sql, rules_sql, short_tag_sql

c = F.col

TAGS = f"""par AS (SELECT repo_hash, cluster_id, split_part(file_path, '/', -2) AS parent, count(*) AS n, min(file_path) AS seen FROM fx_files WHERE cluster_id IS NOT NULL GROUP BY ALL),
tag AS (SELECT repo_hash, cluster_id, first({short_tag_sql('parent')} ORDER BY n DESC, seen) AS cluster_short FROM par GROUP BY ALL)"""
NODES = f"""{TAGS}, nodes AS MATERIALIZED (SELECT s.repo_hash, s.symbol_id AS id, s.qualified_name AS label, s.file_path, s.kind AS symbol_kind, CASE WHEN s.kind = 'method' THEN array_to_string(string_split(s.qualified_name, '.')[:-2], '.') END AS parent_class,
  k.cluster_id AS shown_cluster, f.cluster_id, k.role_description AS cluster_role, g.cluster_short FROM fx_symbols s JOIN fx_files f ON f.repo_hash = s.repo_hash AND f.file_path = s.file_path
  LEFT JOIN fx_clusters k ON k.repo_hash = f.repo_hash AND k.cluster_id = f.cluster_id LEFT JOIN tag g ON g.repo_hash = f.repo_hash AND g.cluster_id = f.cluster_id)"""


def nodes(t):
    return pj.symbol_nodes(t.symbols, t.files, t.clusters)


def edges(t):
    return pj.symbol_projection(t.symbols, t.refs, t.files, t.clusters)[1]


def both(pair, keep=()):
    n, e = pair
    meta = [F.coalesce(c("metadata")[k], F.lit("-")) for k in keep] or [F.lit("")]
    return n.select("repo_hash", c("id").alias("a"), c("kind").alias("b"), c("label").alias("d"), F.concat_ws("|", c("layer").cast("string"), *meta).alias("e")).unionAll(
        e.select("repo_hash", "source", "target", "kind", c("weight").cast("decimal(4,2)").cast("string")))


@check("p1_symbol_projection", f"""
WITH {NODES} SELECT repo_hash, id AS a, 'symbol' AS b, label AS d, concat_ws('|', '1', coalesce(parent_class, '-'), coalesce(cluster_id, '-'), coalesce(cluster_short, '-')) AS e FROM nodes
UNION ALL SELECT repo_hash, source_symbol_id, target_symbol_id, edge_kind, '1.00' FROM fx_refs""")
def p1(t):
    return both(pj.symbol_projection(t.symbols, t.refs, t.files, t.clusters), ("parent_class", "cluster_id", "cluster_short"))


@check("p2_flow_projection", """
SELECT repo_hash, symbol_id AS a, 'flow_node' AS b, qualified_name AS d, concat('2|', kind) AS e FROM fx_symbols WHERE symbol_id IN (SELECT source_symbol_id FROM fx_flows UNION SELECT sink_symbol_id FROM fx_flows UNION SELECT mid1 FROM fx_flows WHERE mid1 IS NOT NULL UNION SELECT mid2 FROM fx_flows WHERE mid2 IS NOT NULL)
UNION ALL SELECT repo_hash, source_symbol_id, sink_symbol_id, 'flow_call_chain', CASE WHEN sensitivity IS NULL THEN '1.00' ELSE '2.00' END FROM fx_flows""")
def p2(t):
    return both(pj.flow_projection(t.symbols, t.flows), ("symbol_kind",))


@check("p3_architecture_projection", """
SELECT repo_hash, cluster_id AS a, 'cluster' AS b, left(role_description, 80) AS d, concat('3|', n_files) AS e FROM fx_clusters
UNION ALL SELECT repo_hash, source_cluster_id, target_cluster_id, CASE kind WHEN 'allowed' THEN 'allows' ELSE 'forbids' END, CASE kind WHEN 'allowed' THEN '1.00' ELSE '2.00' END FROM fx_cluster_deps""")
def p3(t):
    return both(pj.architecture_projection(t.clusters, t.cluster_deps, t.files), ("member_count",))


@check("p4_invariant_projection", """
WITH i AS (SELECT i.*, s.qualified_name FROM fx_invariants i JOIN fx_symbols s ON s.symbol_id = i.target_symbol_id)
SELECT repo_hash, symbol_id AS a, 'symbol' AS b, qualified_name AS d, '1|-' AS e FROM fx_symbols WHERE symbol_id IN (SELECT target_symbol_id FROM i)
UNION ALL SELECT repo_hash, invariant_id, 'invariant', left(text, 80), concat('4|', qualified_name) FROM i
UNION ALL SELECT repo_hash, invariant_id, target_symbol_id, 'constrains', CAST(CAST(confidence AS DECIMAL(4,2)) AS VARCHAR) FROM i""")
def p4(t):
    return both(pj.invariant_projection(t.invariants, t.symbols), ("target_symbol",))


@check("p5_projection_by_layer", "SELECT repo_hash, 'architecture' AS layer, count(*) AS n FROM fx_clusters GROUP BY ALL UNION ALL SELECT repo_hash, 'symbol', count(*) FROM fx_symbols GROUP BY ALL "
       "UNION ALL SELECT repo_hash, 'flow', count(DISTINCT id) FROM (SELECT repo_hash, unnest([source_symbol_id, sink_symbol_id, mid1, mid2]) AS id FROM fx_flows) u WHERE id IS NOT NULL GROUP BY ALL "
       "UNION ALL SELECT i.repo_hash, 'invariant', count(*) + count(DISTINCT target_symbol_id) FROM fx_invariants i JOIN fx_symbols s ON s.symbol_id = i.target_symbol_id GROUP BY ALL")
def p5(t):
    tables = {"symbols": t.symbols, "refs": t.refs, "files": t.files, "clusters": t.clusters, "cluster_dependencies": t.cluster_deps, "flows": t.flows, "invariants": t.invariants}
    out = None
    for layer in ("architecture", "symbol", "flow", "invariant", "nonsense"):
        part = pj.projection_for(layer, tables)[0].groupBy("repo_hash").agg(F.count("*").alias("n")).select("repo_hash", F.lit(layer).alias("layer"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@check("p6_cluster_tags", f"WITH {TAGS} SELECT repo_hash, cluster_id, cluster_short FROM tag UNION ALL SELECT repo_hash, concat('w', cluster_id), 'DIRECTORY' FROM fx_clusters")
def p6(t):
    bare = t.clusters.withColumn("cluster_id", F.concat(F.lit("w"), c("cluster_id")))  # clusters without files: tag from the role
    return pj.cluster_tags(t.files, t.clusters.unionByName(bare))


CLASS_SYMBOLS = """SELECT *, CASE WHEN kind = 'class' THEN concat(split_part(qualified_name, '.', 1), '.', split_part(qualified_name, '.', 3)) WHEN kind = 'method' AND p_partkey % 2 = 0
  THEN concat(split_part(qualified_name, '.', 1), '.', split_part(qualified_name, '.', 3), '.', 'm', CAST(p_partkey AS STRING)) ELSE qualified_name END AS name FROM fx_symbols"""


def class_nodes(t):
    rows = t.sql(CLASS_SYMBOLS).drop("qualified_name").withColumnRenamed("name", "qualified_name")
    return pj.symbol_nodes(rows.drop("p_partkey"), t.files, t.clusters)


MEMBERS = f"""q AS (SELECT repo_hash, symbol_id AS id, name AS label, kind, CASE WHEN kind = 'method' THEN array_to_string(string_split(name, '.')[:-2], '.') END AS parent FROM ({CLASS_SYMBOLS}) z),
cls AS (SELECT DISTINCT repo_hash, label FROM q WHERE kind = 'class'),
short AS (SELECT repo_hash, split_part(label, '.', -1) AS s, arg_max(label, id) AS label FROM q WHERE kind = 'class' GROUP BY ALL),
mem AS (SELECT q.repo_hash, q.id, coalesce(c.label, s.label, p.label) AS class_label, CASE WHEN c.label IS NOT NULL THEN substr(q.label, length(c.label) + 2) WHEN s.label IS NOT NULL THEN split_part(q.label, '.', -1) ELSE substr(q.label, length(p.label) + 2) END AS member
  FROM q LEFT JOIN cls c ON c.repo_hash = q.repo_hash AND c.label = q.parent LEFT JOIN short s ON s.repo_hash = q.repo_hash AND s.s = split_part(q.parent, '.', -1)
  LEFT JOIN (SELECT q.id, arg_max(c.label, length(c.label)) AS label FROM q JOIN cls c ON c.repo_hash = q.repo_hash AND starts_with(q.label, concat(c.label, '.')) GROUP BY ALL) p ON p.id = q.id
  WHERE q.kind = 'method' AND coalesce(c.label, s.label, p.label) IS NOT NULL)"""


@check("u1_class_members", f"WITH {MEMBERS} SELECT repo_hash, id, class_label, member FROM mem UNION ALL SELECT repo_hash, id, '-', label FROM q WHERE id NOT IN (SELECT id FROM mem)")
def u1(t):
    n = class_nodes(t)
    m = ru.class_members(n)
    return m.drop("rule").unionAll(ru.visible_nodes(n, m).select("repo_hash", "id", F.lit("-"), "label"))


@check("u2_dependency_labels", "SELECT r.repo_hash, r.source_symbol_id AS id, s.qualified_name AS dependency FROM fx_refs r JOIN fx_symbols s ON s.symbol_id = r.target_symbol_id")
def u2(t):
    return ru.dependency_labels(nodes(t), edges(t))


# Symbols of a file spread over clusters by their kind.
SPREAD = "CASE s.kind WHEN 'type' THEN NULL WHEN 'function' THEN 'c:fn' ELSE concat('c:', s.kind) END"


def spread(t):
    return nodes(t).withColumn("cluster_id", F.when(c("symbol_kind") == "type", F.lit(None)).when(c("symbol_kind") == "function", "c:fn").otherwise(F.concat(F.lit("c:"), "symbol_kind")))


FILE_META = f"""cnt AS (SELECT s.repo_hash, s.file_path, {SPREAD} AS cid, count(*) AS n FROM fx_symbols s GROUP BY ALL),
meta AS (SELECT repo_hash, file_path, CAST(sum(n) AS BIGINT) AS size, first(cid ORDER BY n DESC, cid) FILTER (WHERE cid IS NOT NULL) AS cluster_id,
  coalesce(max(n) FILTER (WHERE cid IS NOT NULL) / sum(n) < 0.6 AND count(cid) > 1, FALSE) AS mixed FROM cnt GROUP BY ALL)"""


@check("u3_file_clusters", f"WITH {FILE_META} SELECT * FROM meta")
def u3(t):
    return ru.file_clusters(spread(t))


@check("u4_file_order", f"""
WITH {FILE_META} SELECT s.repo_hash, s.symbol_id AS id, s.file_path, s.qualified_name AS label, CASE s.kind WHEN 'class' THEN 1 WHEN 'type' THEN 2 ELSE 3 END AS type_rank, m.size, coalesce(m.cluster_id, '~') AS cluster_key
FROM fx_symbols s JOIN meta m ON m.repo_hash = s.repo_hash AND m.file_path = s.file_path""")
def u4(t):
    return ru.file_order(spread(t))


def layer_sql(node_sql, edge_sql, stepped):
    late = "deepest + row_number() OVER (PARTITION BY repo_hash ORDER BY node)" if stepped else "deepest + 1"
    return f"""WITH RECURSIVE n AS MATERIALIZED ({node_sql}), e AS MATERIALIZED (SELECT DISTINCT * FROM ({edge_sql}) x WHERE src <> dst),
closure AS (SELECT repo_hash, src, dst FROM e UNION SELECT c.repo_hash, c.src, e.dst FROM closure c JOIN e ON e.repo_hash = c.repo_hash AND e.src = c.dst),
cyc AS MATERIALIZED (SELECT repo_hash, src AS node FROM closure WHERE src = dst),
stuck AS MATERIALIZED (SELECT * FROM cyc UNION SELECT c.repo_hash, c.dst FROM closure c JOIN cyc ON cyc.repo_hash = c.repo_hash AND cyc.node = c.src),
walk AS (SELECT repo_hash, node, 0 AS d FROM n WHERE (repo_hash, node) NOT IN (SELECT (repo_hash, node) FROM stuck) UNION
  SELECT w.repo_hash, e.dst, w.d + 1 FROM walk w JOIN e ON e.repo_hash = w.repo_hash AND e.src = w.node WHERE (w.repo_hash, w.node) NOT IN (SELECT (repo_hash, node) FROM stuck)),
lay AS (SELECT n.repo_hash, n.node, max(w.d) AS layer FROM n LEFT JOIN walk w ON w.repo_hash = n.repo_hash AND w.node = n.node GROUP BY ALL),
deep AS (SELECT repo_hash, coalesce(max(layer), 0) AS deepest FROM lay GROUP BY ALL)
SELECT repo_hash, node, CAST(layer AS BIGINT) AS layer FROM lay WHERE layer IS NOT NULL UNION ALL SELECT repo_hash, node, CAST({late} AS BIGINT) FROM lay JOIN deep USING (repo_hash) WHERE layer IS NULL"""


SYMBOL_NODES = "SELECT repo_hash, symbol_id AS node FROM fx_symbols"
SYMBOL_EDGES = "SELECT repo_hash, source_symbol_id AS src, target_symbol_id AS dst FROM fx_refs"
FILE_GRAPH = "SELECT r.repo_hash, a.file_path AS src, b.file_path AS dst FROM fx_refs r JOIN fx_symbols a ON a.symbol_id = r.source_symbol_id JOIN fx_symbols b ON b.symbol_id = r.target_symbol_id WHERE r.edge_kind = 'inherits'"
CONTEXT_GRAPH = "SELECT repo_hash, source_cluster_id AS src, target_cluster_id AS dst FROM fx_cluster_deps WHERE kind = 'forbidden'"


@check("u5_graph_layers", layer_sql(SYMBOL_NODES, SYMBOL_EDGES, True))
def u5(t):
    return ru.graph_layers(nodes(t), edges(t), "stepped").withColumn("layer", c("layer").cast("bigint"))


@check("u17_context_layers", layer_sql("SELECT repo_hash, cluster_id AS node FROM fx_clusters", CONTEXT_GRAPH, False))
def u17(t):
    e = t.cluster_deps.where("kind = 'forbidden'").select("repo_hash", c("source_cluster_id").alias("source"), c("target_cluster_id").alias("target"))
    return ru.graph_layers(t.clusters.withColumnRenamed("cluster_id", "id"), e).withColumn("layer", c("layer").cast("bigint"))


@check("u26_diagram_layers", layer_sql("SELECT repo_hash, file_path AS node FROM fx_files", FILE_GRAPH, False))
def u26(t):
    e = t.sql(FILE_GRAPH).withColumnsRenamed({"src": "source", "dst": "target"})
    return ru.graph_layers(t.files.withColumnRenamed("file_path", "id"), e).withColumn("layer", c("layer").cast("bigint"))


KINDS = "SELECT repo_hash, CASE WHEN event_id % 7 = 0 THEN 'inherits' WHEN event_id % 7 = 1 THEN 'implements' WHEN event_id % 7 = 2 THEN 'owns' WHEN event_id % 7 = 3 THEN 'contains' WHEN event_id % 7 = 4 THEN 'calls' WHEN event_id % 7 = 5 THEN 'class_extends' ELSE 'allows' END AS kind FROM fx_events"


@check("u6_relations", f"SELECT repo_hash, {rules_sql('kind', labels.RELATION_RULES, 'dependency')} AS relation, count(*) AS n FROM ({KINDS}) k GROUP BY ALL")
def u6(t):
    return ru.relation_counts(t.sql(KINDS))


FILTERS = "SELECT DISTINCT repo_hash, concat(path, repo_hash) AS filter_id, CASE WHEN line % 2 = 0 THEN path ELSE concat('/', split_part(path, '/', 2), '/') END AS path, CASE WHEN line % 2 = 0 THEN 'file' ELSE 'folder' END AS kind FROM (SELECT repo_hash, path, length(path) AS line FROM fx_requests) r"


@check("u7_path_filter", f"SELECT f.filter_id, s.symbol_id AS id FROM ({FILTERS}) f JOIN fx_symbols s ON s.repo_hash = f.repo_hash AND CASE f.kind WHEN 'file' THEN s.file_path = f.path ELSE starts_with(s.file_path, f.path) END")
def u7(t):
    return ru.in_path(nodes(t), t.sql(FILTERS)).drop("repo_hash")


@check("u8_overlay_edges", """
SELECT repo_hash, 'symbol' AS source_layer, count(*) AS n FROM fx_refs GROUP BY ALL UNION ALL SELECT repo_hash, 'flow', count(*) FROM fx_flows GROUP BY ALL UNION ALL SELECT repo_hash, 'architecture', count(*) FROM fx_cluster_deps GROUP BY ALL""")
def u8(t):
    layers = {"symbol": edges(t), "flow": pj.flow_projection(t.symbols, t.flows)[1], "architecture": pj.architecture_projection(t.clusters, t.cluster_deps, t.files)[1]}
    return ru.overlay_edges(layers).groupBy("repo_hash", "source_layer").agg(F.count("*").alias("n"))


STUBS = f"""g AS (SELECT s.repo_hash, s.symbol_id, s.qualified_name, s.file_path, coalesce(f.cluster_id, 'Unclustered') AS cluster_id FROM fx_symbols s JOIN fx_files f ON f.repo_hash = s.repo_hash AND f.file_path = s.file_path),
h AS (SELECT *, {GUESS.replace('s.', '').replace('f.', '')} AS tier FROM g),
stub AS (SELECT a.repo_hash, a.symbol_id AS id, b.qualified_name AS dependency, b.cluster_id AS target_group, CASE WHEN a.tier = b.tier THEN NULL WHEN b.tier = 'data' THEN '«SQL»' WHEN b.tier IN ('backend', 'frontend') AND a.tier IN ('backend', 'frontend') THEN '«HTTP»'
  WHEN regexp_matches(lower(b.qualified_name), 'query|select|insert|update|delete|sql') THEN '«SQL»' WHEN regexp_matches(lower(b.qualified_name), 'fetch|axios|request|http|get|post') THEN '«HTTP»' ELSE '«crosses tier»' END AS protocol
  FROM fx_refs r JOIN h a ON a.symbol_id = r.source_symbol_id JOIN h b ON b.symbol_id = r.target_symbol_id WHERE starts_with(a.file_path, '/frontend/') AND NOT starts_with(b.file_path, '/frontend/'))"""


def stubs(t):
    view = nodes(t).where(c("file_path").startswith("/frontend/"))
    return ru.external_stubs(view, nodes(t), edges(t))


@check("u9_external_stubs", f"WITH {STUBS} SELECT * FROM stub")
def u9(t):
    return stubs(t)


@check("u10_placeholders", f"WITH {STUBS} SELECT DISTINCT repo_hash, dependency, target_group FROM stub")
def u10(t):
    return ru.placeholders(stubs(t))


@check("u11_focal_nodes", """
SELECT repo_hash, symbol_id AS id, degree, rank FROM (SELECT s.repo_hash, s.symbol_id, coalesce(n, 0) AS degree, row_number() OVER (PARTITION BY s.repo_hash ORDER BY coalesce(n, 0) DESC, s.symbol_id) AS rank FROM fx_symbols s
  LEFT JOIN (SELECT source_symbol_id, count(*) AS n FROM fx_refs GROUP BY 1) r ON r.source_symbol_id = s.symbol_id) z WHERE rank <= 10""")
def u11(t):
    return ru.focal_nodes(nodes(t), edges(t))


# Packages at two depths, so some contain others.
DEEP = "CASE WHEN s.kind = 'class' THEN concat('/', split_part(s.file_path, '/', 2), '/', split_part(s.file_path, '/', 4)) ELSE s.file_path END"


def deep(t):
    parts = F.split("file_path", "/")
    return nodes(t).withColumn("file_path", F.when(c("symbol_kind") == "class", F.concat(F.lit("/"), parts[1], F.lit("/"), parts[3])).otherwise(c("file_path")))


PKG = f"""pn AS (SELECT s.repo_hash, s.symbol_id AS id, s.kind, regexp_extract({DEEP}, '^(.*)/[^/]*$', 1) AS package, coalesce(f.cluster_id, 'Unclustered') AS context FROM fx_symbols s JOIN fx_files f ON f.repo_hash = s.repo_hash AND f.file_path = s.file_path),
pc AS (SELECT repo_hash, package, context, count(*) AS n, count(*) FILTER (WHERE kind IN ('class', 'type')) AS k FROM pn GROUP BY ALL),
pk AS (SELECT repo_hash, package, CAST(sum(k) AS BIGINT) AS class_count, first(context ORDER BY n DESC, context) AS context FROM pc GROUP BY ALL)"""


@check("u12_packages", f"WITH {PKG} SELECT a.repo_hash, a.package, a.class_count, a.context, split_part(a.package, '/', -1) AS short_name, (SELECT count(*) FROM pk b WHERE b.repo_hash = a.repo_hash AND starts_with(b.package, concat(a.package, '/'))) AS sub_packages FROM pk a")
def u12(t):
    return ru.packages(deep(t))


@check("u13_package_edges", f"""
WITH {PKG} SELECT r.repo_hash, a.package AS source_part, b.package AS target_part, count(*) AS n FROM fx_refs r JOIN pn a ON a.id = r.source_symbol_id JOIN pn b ON b.id = r.target_symbol_id WHERE a.package <> b.package GROUP BY ALL
UNION ALL SELECT DISTINCT r.repo_hash, a.package, b.context, -1 FROM fx_refs r JOIN pn a ON a.id = r.source_symbol_id JOIN pn b ON b.id = r.target_symbol_id WHERE a.context = 'Unclustered' AND b.context <> 'Unclustered'""")
def u13(t):
    outside = ru.package_externals(deep(t), edges(t), "Unclustered")
    return ru.package_edges(deep(t), edges(t)).unionAll(outside.select("repo_hash", "package", "destination", F.lit(-1).cast("bigint")))


@check("u14_package_level", f"""
WITH {PKG} SELECT a.repo_hash, a.package, 'root' AS level FROM pk a WHERE NOT EXISTS (SELECT 1 FROM pk b WHERE b.repo_hash = a.repo_hash AND starts_with(a.package, concat(b.package, '/')))
UNION ALL SELECT repo_hash, package, 'core' FROM pk WHERE starts_with(package, '/core/') AND NOT contains(substr(package, 7), '/')""")
def u14(t):
    p = ru.packages(deep(t))
    return ru.package_level(p).select("repo_hash", "package", F.lit("root").alias("level")).unionAll(ru.package_level(p, "/core").select("repo_hash", "package", F.lit("core")))


@check("u15_contexts", f"""
WITH x AS (SELECT s.repo_hash, coalesce(f.cluster_id, 'Unclustered') AS context, s.symbol_id, s.kind IN ('class', 'type') AS is_class, split_part(s.qualified_name, '.', -1) AS term, regexp_extract(s.file_path, '^(.*)/[^/]*$', 1) AS dir
  FROM fx_symbols s JOIN fx_files f ON f.repo_hash = s.repo_hash AND f.file_path = s.file_path)
SELECT repo_hash, context, count(*) FILTER (WHERE is_class) AS class_count, count(DISTINCT dir) AS package_count,
  CASE WHEN count(*) FILTER (WHERE is_class) > 0 THEN array_to_string(list(term ORDER BY symbol_id) FILTER (WHERE is_class)[1:3], ',') ELSE array_to_string(list(term ORDER BY symbol_id)[1:3], ',') END AS terms FROM x GROUP BY ALL""")
def u15(t):
    return ru.contexts(nodes(t)).withColumn("terms", F.array_join("terms", ","))


@check("u16_context_edges", """
WITH g AS (SELECT s.symbol_id, s.kind, coalesce(f.cluster_id, 'Unclustered') AS part FROM fx_symbols s JOIN fx_files f ON f.repo_hash = s.repo_hash AND f.file_path = s.file_path)
SELECT r.repo_hash, a.part AS source_part, b.part AS target_part, count(*) AS n FROM fx_refs r JOIN g a ON a.symbol_id = r.source_symbol_id JOIN g b ON b.symbol_id = r.target_symbol_id WHERE a.part <> b.part AND a.kind <> 'type' AND b.kind <> 'type' GROUP BY ALL
UNION ALL SELECT DISTINCT r.repo_hash, a.part, 'ext', -1 FROM fx_refs r JOIN g a ON a.symbol_id = r.source_symbol_id JOIN g b ON b.symbol_id = r.target_symbol_id WHERE a.kind <> 'type' AND b.kind = 'type'""")
def u16(t):
    shown = nodes(t).where("symbol_kind <> 'type'")
    lost = ru.context_externals(shown, edges(t))
    return ru.context_edges(shown, edges(t)).unionAll(lost.select("repo_hash", "context", F.lit("ext"), F.lit(-1).cast("bigint")))


@check("u18_band_counts", f"""
WITH x AS (SELECT repo_hash, kind, {rules_sql('lower(concat(qualified_name, chr(32), file_path))', labels.BAND_RULES, 'Service')} AS band, {TIER_SQL.format('file_path')} AS tier FROM fx_symbols),
p AS (SELECT repo_hash, concat('band:', band) AS part FROM x WHERE kind NOT IN ('method', 'function') UNION ALL SELECT repo_hash, concat('tier:', tier) FROM x WHERE kind NOT IN ('method', 'function'))
SELECT r.repo_hash, d.part, count(p.part) AS n FROM (SELECT DISTINCT repo_hash FROM fx_symbols) r CROSS JOIN (VALUES ('band:Controller'), ('band:Service'), ('band:Repository'), ('band:Entity'), ('tier:Frontend'), ('tier:Backend'), ('tier:Database')) d(part)
LEFT JOIN p ON p.repo_hash = r.repo_hash AND p.part = d.part GROUP BY ALL""")
def u18(t):
    return ru.band_counts(nodes(t))


@check("u19_drill_children", f"""
SELECT DISTINCT repo_hash, 'contexts' AS level, split_part(file_path, '/', 2) AS name FROM fx_symbols
UNION ALL SELECT DISTINCT repo_hash, 'core', split_part(file_path, '/', 3) FROM fx_symbols WHERE starts_with(file_path, '/core/')
UNION ALL SELECT DISTINCT repo_hash, 'packages', regexp_extract(file_path, '^(.*)/[^/]*$', 1) FROM fx_symbols WHERE {drill_sql('qualified_name', 'file_path')} = 'Controller'
UNION ALL SELECT DISTINCT repo_hash, 'classes', qualified_name FROM fx_symbols UNION ALL SELECT DISTINCT repo_hash, 'layers', b FROM fx_symbols, (VALUES ('Controller'), ('Service'), ('Repository'), ('Entity')) v(b)""")
def u19(t):
    n = nodes(t)
    parts = [("contexts", ru.drill_children(n, "contexts")), ("core", ru.drill_children(n, "contexts", tier="core")), ("packages", ru.drill_children(n, "packages", band="Controller")),
             ("classes", ru.drill_children(n, "classes")), ("layers", ru.drill_children(n, "layers"))]
    out = None
    for level, df in parts:
        one = df.select("repo_hash", F.lit(level).alias("level"), "name")
        out = one if out is None else out.unionByName(one)
    return out


@check("u20_layer_entries", """
SELECT s.repo_hash, concat('symbol:', s.symbol_id) AS entry, coalesce(n, 0) AS n_dependencies FROM fx_symbols s LEFT JOIN (SELECT source_symbol_id, count(*) AS n FROM fx_refs GROUP BY 1) r ON r.source_symbol_id = s.symbol_id
UNION ALL SELECT s.repo_hash, concat('flow:', s.symbol_id), coalesce(n, 0) FROM fx_symbols s LEFT JOIN (SELECT source_symbol_id, count(*) AS n FROM fx_flows GROUP BY 1) r ON r.source_symbol_id = s.symbol_id
  WHERE s.symbol_id IN (SELECT source_symbol_id FROM fx_flows UNION SELECT sink_symbol_id FROM fx_flows UNION SELECT mid1 FROM fx_flows WHERE mid1 IS NOT NULL UNION SELECT mid2 FROM fx_flows WHERE mid2 IS NOT NULL)
UNION ALL SELECT k.repo_hash, concat('architecture:', k.cluster_id), coalesce(n, 0) FROM fx_clusters k LEFT JOIN (SELECT repo_hash, source_cluster_id, count(*) AS n FROM fx_cluster_deps GROUP BY ALL) d ON d.repo_hash = k.repo_hash AND d.source_cluster_id = k.cluster_id""")
def u20(t):
    out = ru.layer_entries({
        "symbol": pj.symbol_projection(t.symbols, t.refs, t.files, t.clusters), "flow": pj.flow_projection(t.symbols, t.flows),
        "architecture": pj.architecture_projection(t.clusters, t.cluster_deps, t.files)})
    return out.select("repo_hash", "entry", "n_dependencies")


@check("u21_invariant_groups", "SELECT repo_hash, target_symbol_id, count(*) AS n, max(confidence) AS best FROM fx_invariants WHERE confidence >= 0.7 AND confidence < 0.9 GROUP BY ALL")
def u21(t):
    high = ru.invariant_groups(t.invariants, "high")
    return ru.invariant_groups(t.invariants, "medium").unionByName(high)


TREE = """tree AS (SELECT DISTINCT repo_hash, file_path AS path, 'file' AS kind FROM fx_files UNION ALL SELECT DISTINCT repo_hash, concat('/', split_part(file_path, '/', 2)), 'folder' FROM fx_files
  UNION ALL SELECT DISTINCT repo_hash, concat('/', split_part(file_path, '/', 2), '/', split_part(file_path, '/', 3)), 'folder' FROM fx_files)"""


@check("u22_file_tree", f"WITH {TREE} SELECT repo_hash, path, kind, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, split_part(path, '/', -1) AS name, CASE kind WHEN 'folder' THEN 0 ELSE 1 END AS folder_first FROM tree")
def u22(t):
    return ru.file_tree(t.files)


CHAINED = """
SELECT repo_hash, concat('/top/mid', file_path) AS file_path FROM fx_files
UNION ALL SELECT DISTINCT repo_hash, '/top/mid/z1/f.py' FROM fx_files UNION ALL SELECT DISTINCT repo_hash, '/top/mid/z2/f.py' FROM fx_files
UNION ALL SELECT repo_hash, concat('/solo/a/b/c/', repo_hash, '.py') FROM fx_files"""


@check("u24_flattened_tree", """
WITH p AS (SELECT DISTINCT repo_hash, split_part(file_path, '/', 2) AS area, split_part(file_path, '/', 3) AS pkg FROM fx_files)
SELECT DISTINCT repo_hash, '/top' AS path, 'top/mid' AS display FROM fx_files UNION ALL SELECT DISTINCT repo_hash, '/top/mid', 'mid' FROM fx_files
UNION ALL SELECT DISTINCT repo_hash, '/top/mid/z1', 'z1' FROM fx_files UNION ALL SELECT DISTINCT repo_hash, '/top/mid/z2', 'z2' FROM fx_files
UNION ALL SELECT repo_hash, concat('/top/mid/', area), CASE WHEN count(*) = 1 THEN concat(area, '/', min(pkg)) ELSE area END FROM p GROUP BY repo_hash, area
UNION ALL SELECT repo_hash, concat('/top/mid/', area, '/', pkg), pkg FROM p
UNION ALL SELECT DISTINCT repo_hash, '/solo', 'solo/a/b/c' FROM fx_files UNION ALL SELECT DISTINCT repo_hash, '/solo/a', 'a/b/c' FROM fx_files UNION ALL SELECT DISTINCT repo_hash, '/solo/a/b', 'b/c' FROM fx_files UNION ALL SELECT DISTINCT repo_hash, '/solo/a/b/c', 'c' FROM fx_files""")
def u24(t):
    return ru.flattened_tree(ru.file_tree(t.sql(CHAINED))).select("repo_hash", "path", "display")


@check("u23_activity_rows", "SELECT repo_hash, event_id AS activity_id, event AS agent, CAST(event_id % 9 AS BIGINT) AS symbols_returned, CAST(700 * (event_id % 9) AS BIGINT) AS tokens_saved FROM fx_events")
def u23(t):
    rows = t.events.select("repo_hash", c("event_id").alias("activity_id"), c("event").alias("query_type"), (c("event_id") % 9).alias("n_symbols"))
    return ru.activity_rows(rows)


LABELLED = """SELECT repo_hash, event_id AS activity_id, CASE event_id % 6 WHEN 0 THEN 'find_relevant_context' WHEN 1 THEN 'trace_data_flow' WHEN 2 THEN 'find_invariants' WHEN 3 THEN 'describe_architecture'
  WHEN 4 THEN 'find_exemplars' ELSE event END AS query_type, event_id % 9 AS n_symbols FROM fx_events"""
AGENTS = "CASE query_type WHEN 'find_relevant_context' THEN 'Coordinator' WHEN 'trace_data_flow' THEN 'Flow Analyst' WHEN 'find_invariants' THEN 'Invariant Reporter' WHEN 'describe_architecture' THEN 'Architecture Analyst' WHEN 'find_exemplars' THEN 'Exemplar Finder' ELSE query_type END"


@check("u23_labelled_activity", f"SELECT repo_hash, activity_id, {AGENTS} AS agent, n_symbols AS symbols_returned, n_symbols * 700 AS tokens_saved FROM ({LABELLED}) l")
def u23_labelled(t):
    return ru.activity_rows(t.sql(LABELLED))


@check("u23_activity_totals", f"SELECT repo_hash, count(*) AS queries, CAST(sum(n_symbols) AS BIGINT) AS symbols_returned, CAST(sum(n_symbols * 700) AS BIGINT) AS tokens_saved FROM ({LABELLED}) l GROUP BY ALL")
def u23_totals(t):
    return ru.activity_totals(ru.activity_rows(t.sql(LABELLED)))


@check("u21_grouped_invariants", """
SELECT b.band, i.repo_hash, i.target_symbol_id, i.invariant_id, i.text, i.source_kind, i.source_location, i.confidence, count(*) OVER (PARTITION BY b.band, i.repo_hash, i.target_symbol_id) AS n
FROM fx_invariants i JOIN (VALUES ('all'), ('high'), ('medium')) b(band) ON CASE b.band WHEN 'high' THEN confidence >= 0.9 WHEN 'medium' THEN confidence >= 0.7 AND confidence < 0.9 ELSE TRUE END""")
def u21_rows(t):
    out = None
    for band in ("all", "high", "medium"):
        part = ru.grouped_invariants(t.invariants, band).withColumn("band", F.lit(band))
        out = part if out is None else out.unionByName(part)
    return out


@check("u3_ranked_clusters", f"""
WITH {FILE_META}, named AS (SELECT *, CASE cid WHEN 'c:fn' THEN NULL ELSE upper(cid) END AS short, concat('role of ', cid) AS role FROM cnt WHERE cid IS NOT NULL)
SELECT n.repo_hash, n.file_path, n.cid AS cluster_id, coalesce(n.short, 'CLUSTER') AS short, n.role, CAST(n.n AS BIGINT) AS n, row_number() OVER (PARTITION BY n.repo_hash, n.file_path ORDER BY n.n DESC, n.cid) AS rank, m.mixed
FROM named n JOIN meta m ON m.repo_hash = n.repo_hash AND m.file_path = n.file_path""")
def u3_ranked(t):
    rows = spread(t).withColumn("cluster_short", F.when(c("cluster_id") != "c:fn", F.upper("cluster_id"))).withColumn("cluster_role", F.concat(F.lit("role of "), "cluster_id"))
    return ru.ranked_clusters(rows).withColumn("rank", c("rank").cast("bigint"))


@check("u25_induced_edges", """
SELECT r.repo_hash, r.source_symbol_id AS source, r.target_symbol_id AS target, count(*) AS n FROM fx_refs r JOIN fx_symbols a ON a.symbol_id = r.source_symbol_id JOIN fx_symbols b ON b.symbol_id = r.target_symbol_id WHERE a.kind = 'class' AND b.kind = 'class' GROUP BY ALL""")
def u25(t):
    view = nodes(t).where("symbol_kind = 'class'")
    return ru.induced_edges(view, edges(t)).groupBy("repo_hash", "source", "target").agg(F.count("*").alias("n"))


@check("u27_file_list", "SELECT DISTINCT repo_hash, file_path FROM fx_symbols")
def u27(t):
    return ru.file_list(nodes(t))
