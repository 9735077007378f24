"""Layer 3 checks. Clusters of the member checks are the stored ones of `fx_files`."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens.functions import paths, vectors
from repolens.operators import clusters as cl

from .registry import check
from .scalars import TOKENS

c = F.col

FILE_EDGES = """SELECT r.repo_hash, a.file_path AS source_file, b.file_path AS target_file FROM fx_refs r
JOIN fx_symbols a ON a.symbol_id = r.source_symbol_id JOIN fx_symbols b ON b.symbol_id = r.target_symbol_id WHERE a.file_path <> b.file_path"""
DIRS = "string_split(file_path, '/')[2:-2]"


def members(t):
    return t.files.where("cluster_id IS NOT NULL").select("repo_hash", "file_path", "cluster_id")


@check("d1_file_dependencies", f"SELECT DISTINCT * FROM ({FILE_EDGES}) e")
def d1(t):
    return cl.file_dependencies(t.symbols, t.refs)


@check("d2_incoming_refs", f"""
SELECT f.repo_hash, f.file_path, coalesce(n, 0) AS incoming FROM fx_files f LEFT JOIN (
  SELECT repo_hash, target_file, count(*) AS n FROM ({FILE_EDGES}) e GROUP BY ALL) x ON x.repo_hash = f.repo_hash AND x.target_file = f.file_path""")
def d2(t):
    return cl.incoming_refs(t.files, t.symbols, t.refs)


@check("d3_cluster_strategy", """
SELECT repo_hash, count(*) AS n_files, CASE WHEN count(*) = 1 THEN 'singleton' WHEN count(*) <= 500 THEN 'pairwise' ELSE 'directory' END AS strategy FROM fx_files GROUP BY repo_hash""")
def d3(t):
    return cl.strategies(t.files, 500)


FEATURES = f"""
f AS (SELECT repo_hash, file_path, {DIRS} AS dirs, {TOKENS} AS words FROM fx_files),
depth AS (SELECT repo_hash, greatest(max(len(dirs)), 1) AS max_depth FROM f GROUP BY repo_hash),
imp AS (SELECT repo_hash, source_file AS file_path, list(DISTINCT target_file) AS imports FROM ({FILE_EDGES}) e GROUP BY ALL),
hist AS (SELECT repo_hash, file_path, count(*) FILTER (WHERE kind = 'function') AS h1, count(*) FILTER (WHERE kind = 'class') AS h2,
  count(*) FILTER (WHERE kind = 'method') AS h3, count(*) FILTER (WHERE kind = 'variable') AS h4 FROM fx_symbols WHERE kind <> 'type' GROUP BY ALL),
feat AS (SELECT f.*, max_depth, coalesce(imports, []) AS imports, h1, h2, h3, h4 FROM f JOIN depth USING (repo_hash)
  LEFT JOIN imp USING (repo_hash, file_path) LEFT JOIN hist USING (repo_hash, file_path)),
pairs AS (SELECT a.repo_hash, a.file_path AS a, b.file_path AS b,
  1 - (CASE WHEN a.dirs[1] IS DISTINCT FROM b.dirs[1] THEN 0 WHEN a.dirs[2] IS DISTINCT FROM b.dirs[2] THEN 1 ELSE 2 END) / a.max_depth AS directory,
  CASE WHEN len(a.words) = 0 OR len(b.words) = 0 THEN 1 ELSE 1 - len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) END AS name,
  CASE WHEN len(a.imports) = 0 OR len(b.imports) = 0 THEN 1 ELSE 1 - len(list_intersect(a.imports, b.imports)) / len(list_distinct(list_concat(a.imports, b.imports))) END AS imports,
  CASE WHEN a.h1 IS NULL OR b.h1 IS NULL THEN 1 ELSE greatest(0, 1 - (a.h1*b.h1 + a.h2*b.h2 + a.h3*b.h3 + a.h4*b.h4)
    / (sqrt(a.h1*a.h1 + a.h2*a.h2 + a.h3*a.h3 + a.h4*a.h4) * sqrt(b.h1*b.h1 + b.h2*b.h2 + b.h3*b.h3 + b.h4*b.h4))) END AS structure
  FROM feat a JOIN feat b ON a.repo_hash = b.repo_hash AND a.file_path < b.file_path),
dist AS (SELECT *, 0.4::DOUBLE * directory + 0.2::DOUBLE * name + 0.25::DOUBLE * imports + 0.15::DOUBLE * structure AS distance FROM pairs)"""


def close_pairs(t):
    features = cl.file_features(t.files, t.symbols, t.refs)
    return cl.pair_distances(features, cl.candidate_pairs(features))


def pair_part(name, sql_name, column):
    """The distances that can matter: of pairs within the cut."""

    @check(name, f"WITH {FEATURES} SELECT repo_hash, a, b, round(CAST({column} AS DOUBLE), 6) AS {column} FROM dist WHERE round(distance, 9) <= 0.55")
    def part(t):
        return close_pairs(t).where(F.round("distance", 9) <= 0.55).select("repo_hash", "a", "b", F.round(column, 6).alias(column))


pair_part("d4_directory_distance", "directory", "directory")
pair_part("d5_name_distance", "name", "name")
pair_part("d6_import_distance", "imports", "imports")
pair_part("d8_structure_distance", "structure", "structure")
pair_part("d9_pair_distance", "distance", "distance")


@check("d7_kind_histogram", f"""
WITH {FEATURES} SELECT repo_hash, file_path, concat_ws('|', CAST(round(h1 / n, 4) AS DECIMAL(6,4)), CAST(round(h2 / n, 4) AS DECIMAL(6,4)), CAST(round(h3 / n, 4) AS DECIMAL(6,4)),
  CAST(round(h4 / n, 4) AS DECIMAL(6,4)), '0.0000') AS histogram FROM (SELECT *, h1 + h2 + h3 + h4 AS n FROM hist) h""")
def d7(t):
    shown = F.transform("histogram", lambda x: F.round(x, 4).cast("decimal(6,4)").cast("string"))
    return cl.kind_histograms(t.symbols).select("repo_hash", "file_path", F.array_join(shown, "|").alias("histogram"))


def linkage_sql(op):
    return f"""WITH RECURSIVE {FEATURES},
link AS (SELECT repo_hash, a, b FROM dist WHERE round(distance, 9) {op} 0.55),
both_ways AS (SELECT * FROM link UNION ALL SELECT repo_hash, b, a FROM link),
reach AS (SELECT repo_hash, file_path AS a, file_path AS b FROM fx_files UNION SELECT r.repo_hash, r.a, l.b FROM reach r JOIN both_ways l ON l.repo_hash = r.repo_hash AND l.a = r.b)
SELECT repo_hash, a AS file_path, min(b) AS cluster_key FROM reach GROUP BY repo_hash, a"""


@check("d10_single_linkage", linkage_sql("<="))
def d10(t):
    return cl.pairwise_clusters(t.files, t.symbols, t.refs)


@check("d11_single_linkage_strict", linkage_sql("<"))
def d11(t):
    return cl.pairwise_clusters(t.files, t.symbols, t.refs, inclusive=False)


@check("d12_directory_clusters", f"SELECT repo_hash, file_path, concat('dir:', array_to_string({DIRS}, '/')) AS cluster_key FROM fx_files")
def d12(t):
    return cl.directory_clusters(t.files)


@check("d13_size_summary", """
WITH s AS (SELECT repo_hash, cluster_id, count(*) AS size FROM fx_files WHERE cluster_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_hash ORDER BY size) AS rn, count(*) OVER (PARTITION BY repo_hash) AS n FROM s)
SELECT repo_hash, max(n) AS clusters, min(size) AS min_size, max(size) FILTER (WHERE rn = n // 2 + 1) AS median_size, max(size) AS max_size FROM r GROUP BY repo_hash""")
def d13(t):
    return cl.size_summary(members(t))


MEM = "(SELECT repo_hash, file_path, CASE WHEN repo_hash = 'r0' THEN concat('c:', split_part(file_path, '/', 2)) ELSE cluster_id END AS cluster_id FROM fx_files WHERE cluster_id IS NOT NULL)"
WIDE = f"SELECT * FROM {MEM} m"


def wide(t):
    """Members whose `r0` clusters span several directories."""
    return t.sql(WIDE)


COMMON_DIR = f"""dirs AS (SELECT repo_hash, cluster_id, string_split(file_path, '/')[2:-2] AS d FROM {MEM} m),
com AS (SELECT repo_hash, cluster_id, CASE WHEN count(DISTINCT d[1]) > 1 THEN '' WHEN count(DISTINCT d[2]) > 1 THEN any_value(d[1])
  ELSE concat(any_value(d[1]), '/', any_value(d[2])) END AS directory FROM dirs GROUP BY ALL)"""


@check("d14_common_directory", f"WITH {COMMON_DIR} SELECT * FROM com")
def d14(t):
    return cl.common_directories(wide(t))


SUFFIX = f"""suf AS (SELECT repo_hash, cluster_id, file_path, concat('*_', lower(list_filter(regexp_split_to_array(regexp_replace(split_part(file_path, '/', -1), '[.][^.]*$', ''), '[_.-]'), lambda x: x <> '')[-1]),
  '.', split_part(file_path, '.', -1)) AS pattern FROM {MEM} m),
cnt AS (SELECT repo_hash, cluster_id, pattern, count(*) AS n, min(file_path) AS ff FROM suf GROUP BY ALL),
naming AS (SELECT repo_hash, cluster_id, CASE WHEN max(n) <= 1 AND sum(n) > 2 THEN '*' ELSE first(pattern ORDER BY n DESC, ff) END AS naming_convention FROM cnt GROUP BY ALL)"""


@check("d15_common_suffix", f"WITH {SUFFIX} SELECT * FROM naming")
def d15(t):
    return cl.common_suffixes(wide(t))


SHAPE = f"""kinds AS (SELECT m.repo_hash, m.cluster_id, s.kind, count(*) AS n, min((s.file_path, s.line_start, s.symbol_id)) AS seen
  FROM {MEM} m JOIN fx_symbols s ON s.repo_hash = m.repo_hash AND s.file_path = m.file_path GROUP BY ALL),
shape AS (SELECT repo_hash, cluster_id, array_to_string(list(concat(n, ' ', kind, CASE WHEN n <> 1 THEN 's' ELSE '' END) ORDER BY n DESC, seen)[1:5], ', ') AS patterns FROM kinds GROUP BY ALL)"""


@check("d16_code_shape", f"WITH {SHAPE} SELECT * FROM shape")
def d16(t):
    return cl.code_shapes(wide(t), t.symbols).withColumn("patterns", F.array_join("patterns", ", "))


@check("d17_heuristic_annotation", f"""
WITH {COMMON_DIR}, {SUFFIX}, {SHAPE}
SELECT repo_hash, cluster_id, concat('files in directory `', CASE directory WHEN '' THEN '<repo root>' ELSE directory END, '` (LLM annotation unavailable)') AS role_description,
  naming_convention, patterns, 'heuristic' AS source FROM com JOIN naming USING (repo_hash, cluster_id) JOIN shape USING (repo_hash, cluster_id)""")
def d17(t):
    out = cl.heuristic_annotations(wide(t), t.symbols)
    return out.withColumn("patterns", F.array_join("patterns", ", ")).drop("forbidden_dependencies")


INCOMING = f"""inc AS (SELECT repo_hash, target_file, count(*) AS n FROM ({FILE_EDGES}) e GROUP BY ALL),
central AS (SELECT m.repo_hash, m.cluster_id, m.file_path, coalesce(n, 0) AS incoming, row_number() OVER (PARTITION BY m.repo_hash, m.cluster_id ORDER BY coalesce(n, 0) DESC, m.file_path) AS rank
  FROM {MEM} m LEFT JOIN inc ON inc.repo_hash = m.repo_hash AND inc.target_file = m.file_path)"""


@check("d18_central_files", f"WITH {INCOMING} SELECT * FROM central WHERE rank <= 5")
def d18(t):
    return cl.central_files(wide(t), cl.incoming_refs(t.files, t.symbols, t.refs))


@check("d19_cluster_prompts", f"""
WITH {INCOMING}, shown AS (SELECT c.repo_hash, c.cluster_id, c.rank, s.*, row_number() OVER (PARTITION BY c.repo_hash, c.cluster_id, c.file_path ORDER BY s.line_start, s.symbol_id) AS pos
  FROM central c JOIN fx_symbols s ON s.repo_hash = c.repo_hash AND s.file_path = c.file_path WHERE c.rank <= 5),
lines AS (SELECT repo_hash, cluster_id, rank, 0 AS pos, concat(chr(10), '- ', file_path) AS line FROM central WHERE rank <= 5
  UNION ALL SELECT repo_hash, cluster_id, rank, pos, concat('    [', kind, '] ', signature) FROM shown WHERE pos <= 20)
SELECT repo_hash, cluster_id, concat('Files in this cluster:', chr(10), string_agg(line, chr(10) ORDER BY rank, pos), chr(10), chr(10), 'Return the JSON description for this cluster.') AS prompt
FROM lines GROUP BY ALL""")
def d19(t):
    return cl.cluster_prompts(wide(t), t.symbols, cl.incoming_refs(t.files, t.symbols, t.refs))


# One reply per cluster; by file count: fenced JSON, JSON inside prose, no JSON, no role.
REPLIES = f"""
SELECT repo_hash, cluster_id, n, CASE n % 4
  WHEN 0 THEN concat('```json', chr(10), '{{"role": "role of ', cluster_id, '", "naming_convention": "  ", "code_shape": ["a", "", "b"], "forbidden_dependencies": ["x", "y"]}}', chr(10), '```')
  WHEN 1 THEN concat('Sure: {{"role": "', cluster_id, '", "naming_convention": " *_n.py ", "code_shape": []}} done')
  WHEN 2 THEN 'no json here' ELSE '{{"naming_convention": "*"}}' END AS reply
FROM (SELECT repo_hash, cluster_id, count(*) AS n FROM {MEM} m GROUP BY repo_hash, cluster_id) g"""


@check("d20_parse_reply", f"""
SELECT repo_hash, cluster_id, CASE n % 4 WHEN 0 THEN concat('role of ', cluster_id) WHEN 1 THEN cluster_id END AS role,
  CASE n % 4 WHEN 0 THEN '  ' WHEN 1 THEN ' *_n.py ' WHEN 3 THEN '*' END AS naming, CASE n % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 END AS shapes
FROM ({REPLIES}) r""")
def d20(t):
    out = cl.parse_replies(t.sql(REPLIES))
    return out.select("repo_hash", "cluster_id", c("parsed.role").alias("role"), c("parsed.naming_convention").alias("naming"),
                      F.when(c("parsed.code_shape").isNotNull(), F.size("parsed.code_shape")).alias("shapes"))


ANNOTATED = f"""{COMMON_DIR}, {SUFFIX}, {SHAPE}, rep AS ({REPLIES}),
ann AS (SELECT repo_hash, cluster_id, CASE n % 4 WHEN 0 THEN concat('role of ', cluster_id) WHEN 1 THEN cluster_id
    ELSE concat('files in directory `', CASE directory WHEN '' THEN '<repo root>' ELSE directory END, '` (LLM annotation unavailable)') END AS role_description,
  CASE n % 4 WHEN 1 THEN '*_n.py' ELSE naming_convention END AS naming_convention, CASE n % 4 WHEN 0 THEN 'a, b' ELSE patterns END AS patterns,
  CASE WHEN n % 4 < 2 THEN 'llm' ELSE 'heuristic' END AS source, CASE n % 4 WHEN 0 THEN 'x, y' END AS forbidden_dependencies
  FROM com JOIN naming USING (repo_hash, cluster_id) JOIN shape USING (repo_hash, cluster_id) JOIN rep USING (repo_hash, cluster_id))"""


@check("d21_merged_annotation", f"WITH {ANNOTATED} SELECT * FROM ann")
def d21(t):
    out = cl.annotate(wide(t), t.symbols, t.sql(REPLIES))
    return out.withColumns({"patterns": F.array_join("patterns", ", "), "forbidden_dependencies": F.array_join("forbidden_dependencies", ", ")})


LIMIT_SQL = f"""WITH RECURSIVE {FEATURES}, big AS (SELECT repo_hash FROM fx_files GROUP BY 1 HAVING count(*) > 500),
link AS (SELECT repo_hash, a, b FROM dist WHERE round(distance, 9) <= 0.55 AND repo_hash NOT IN (SELECT repo_hash FROM big)),
both_ways AS (SELECT * FROM link UNION ALL SELECT repo_hash, b, a FROM link),
reach AS (SELECT repo_hash, file_path AS a, file_path AS b FROM fx_files WHERE repo_hash NOT IN (SELECT repo_hash FROM big)
  UNION SELECT r.repo_hash, r.a, l.b FROM reach r JOIN both_ways l ON l.repo_hash = r.repo_hash AND l.a = r.b),
keys AS (SELECT repo_hash, a AS file_path, min(b) AS k FROM reach GROUP BY ALL
  UNION ALL SELECT repo_hash, file_path, concat('dir:', array_to_string({DIRS}, '/')) FROM fx_files WHERE repo_hash IN (SELECT repo_hash FROM big))
SELECT repo_hash, file_path, sha256(concat(repo_hash, chr(31), k)) AS cluster_id FROM keys"""


@check("d22_file_clusters", LIMIT_SQL)
def d22(t):
    # the documented limit, asked for
    return cl.cluster_files(t.files, t.symbols, t.refs, 500)


def linked_ids():
    """Linkage keys as cluster ids, in the same recursive statement."""
    head, tail = linkage_sql("<=").rsplit("SELECT repo_hash, a AS file_path", 1)
    return f"{head}SELECT repo_hash, file_path, sha256(concat(repo_hash, chr(31), cluster_key)) AS cluster_id FROM (SELECT repo_hash, a AS file_path{tail}) k"


@check("d25_file_clusters_of_any_size", linked_ids())
def d25(t):
    return cl.cluster_files(t.files, t.symbols, t.refs)


DEPS = f"""dep AS (SELECT DISTINCT a.repo_hash, a.cluster_id AS source_cluster_id, b.cluster_id AS target_cluster_id, 'allowed' AS kind FROM ({FILE_EDGES}) e
  JOIN {MEM} a ON a.repo_hash = e.repo_hash AND a.file_path = e.source_file JOIN {MEM} b ON b.repo_hash = e.repo_hash AND b.file_path = e.target_file WHERE a.cluster_id <> b.cluster_id)"""


@check("d23_cluster_dependencies", f"WITH {DEPS} SELECT * FROM dep")
def d23(t):
    return cl.cluster_dependencies(wide(t), cl.file_dependencies(t.symbols, t.refs))


@check("d24_layer_stats", f"""
WITH {ANNOTATED}, {DEPS} SELECT a.repo_hash, a.clusters, a.annotated, coalesce(d.n, 0) AS dependencies FROM (
  SELECT repo_hash, count(*) AS clusters, count(*) FILTER (WHERE source = 'llm') AS annotated FROM ann GROUP BY ALL) a
LEFT JOIN (SELECT repo_hash, count(*) AS n FROM dep GROUP BY ALL) d USING (repo_hash)""")
def d24(t):
    rows = cl.annotate(wide(t), t.symbols, t.sql(REPLIES))
    return cl.layer_stats(rows, cl.cluster_dependencies(wide(t), cl.file_dependencies(t.symbols, t.refs)))
