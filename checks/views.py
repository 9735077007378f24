"""Code-shaped views over the given tables, as SQL that both engines run unchanged.

Every view reads all rows of its tables. Repositories are skewed on purpose: `r0` holds about half
of all symbols. See FIXTURES.md.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from repolens.session import measure_joins

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

VIEWS["fx_symbols"] = """
SELECT CASE WHEN CAST(split_part(p_brand, '#', 2) AS INT) <= 12 THEN 'r0'
            ELSE concat('r', split_part(p_brand, '#', 2)) END AS repo_hash,
       concat('s', CAST(p_partkey AS STRING)) AS symbol_id,
       concat(area, '.', pkg, '.', stem, '.', nm, '_', CAST(p_partkey AS STRING)) AS qualified_name,
       concat('/', area, '/', pkg, '/', pre, stem, ext) AS file_path,
       CAST((p_partkey % 50) * 10 + 1 AS INT) AS line_start,
       CAST((p_partkey % 50) * 10 + 1 + p_size AS INT) AS line_end,
       kind,
       concat(nm, '_', CAST(p_partkey AS STRING), '(', pkg, ')') AS signature,
       p_partkey
FROM (SELECT p_partkey, p_size, p_brand,
             CASE p_size % 4 WHEN 0 THEN 'backend' WHEN 1 THEN 'frontend' WHEN 2 THEN 'db' ELSE 'core' END AS area,
             lower(p_type) AS pkg,
             split_part(p_name, ' ', 2) AS stem,
             CASE p_size % 3 WHEN 0 THEN '.py' WHEN 1 THEN 'Service.ts' ELSE '_view.tsx' END AS ext,
             CASE WHEN p_partkey % 11 = 0 THEN 'test_' ELSE '' END AS pre,
             CASE p_partkey % 17 WHEN 0 THEN 'check_password' WHEN 1 THEN 'getApiKey' WHEN 2 THEN 'user_ssn'
                                 WHEN 3 THEN 'assassin' ELSE 'fn' END AS nm,
             CASE p_partkey % 7 WHEN 0 THEN 'class' WHEN 1 THEN 'variable' WHEN 2 THEN 'type'
                                WHEN 3 THEN 'method' ELSE 'function' END AS kind
      FROM part) t
"""

# Consecutive lines of one order inside one repository; line 7 points backwards, so cycles exist.
VIEWS["fx_refs"] = """
SELECT repo_hash,
       concat('s', CAST(CASE WHEN ln = 7 THEN greatest(a, b) ELSE least(a, b) END AS STRING)) AS source_symbol_id,
       concat('s', CAST(CASE WHEN ln = 7 THEN least(a, b) ELSE greatest(a, b) END AS STRING)) AS target_symbol_id,
       CASE ln % 5 WHEN 0 THEN 'inherits' ELSE 'calls' END AS edge_kind
FROM (SELECT s.repo_hash, l.l_linenumber AS ln, l.l_partkey AS a,
             lead(l.l_partkey) OVER (PARTITION BY s.repo_hash, l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey) AS b
      FROM lineitem l JOIN fx_symbols s ON s.p_partkey = l.l_partkey) t
WHERE b IS NOT NULL
"""

VIEWS["fx_files"] = """
SELECT s.repo_hash, s.file_path, max(l.l_shipdate) AS last_modified,
       CASE WHEN s.file_path LIKE '/core/%.tsx' THEN NULL
            ELSE concat('c:', s.repo_hash, ':', split_part(s.file_path, '/', 2), '/', split_part(s.file_path, '/', 3))
       END AS cluster_id
FROM fx_symbols s LEFT JOIN lineitem l ON l.l_partkey = s.p_partkey
GROUP BY s.repo_hash, s.file_path
"""

VIEWS["fx_clusters"] = """
SELECT repo_hash, cluster_id,
       concat('files in directory ', split_part(cluster_id, ':', 3)) AS role_description,
       concat('*', split_part(min(file_path), '/', 4)) AS naming_convention,
       count(*) AS n_files
FROM fx_files WHERE cluster_id IS NOT NULL
GROUP BY repo_hash, cluster_id
"""

VIEWS["fx_cluster_deps"] = """
SELECT DISTINCT fs.repo_hash, fs.cluster_id AS source_cluster_id, ft.cluster_id AS target_cluster_id,
       CASE WHEN r.edge_kind = 'inherits' THEN 'forbidden' ELSE 'allowed' END AS kind
FROM fx_refs r
JOIN fx_symbols s ON s.symbol_id = r.source_symbol_id JOIN fx_files fs ON fs.repo_hash = s.repo_hash AND fs.file_path = s.file_path
JOIN fx_symbols t ON t.symbol_id = r.target_symbol_id JOIN fx_files ft ON ft.repo_hash = t.repo_hash AND ft.file_path = t.file_path
WHERE fs.cluster_id <> ft.cluster_id
"""

VIEWS["fx_embeddings"] = """
SELECT s.repo_hash, s.symbol_id, e.embedding
FROM embeddings e JOIN fx_symbols s ON s.p_partkey = e.vec_id
"""

VIEWS["fx_commits"] = """
SELECT DISTINCT s.repo_hash, l.l_orderkey AS commit_id, s.file_path
FROM lineitem l JOIN fx_symbols s ON s.p_partkey = l.l_partkey
"""

# Raw invariant candidates; `seq` is the arrival order.
VIEWS["fx_candidates"] = """
SELECT s.repo_hash, concat('i', CAST(l.seq AS STRING)) AS candidate_id, l.seq,
       CASE WHEN l.l_tax = 0.08 THEN concat('x', s.symbol_id) ELSE s.symbol_id END AS target_symbol_id,
       CASE WHEN l.l_discount = 0.1 THEN '   '
            ELSE concat('guard:   qty  <= ', CAST(CAST(l.l_quantity AS INT) AS STRING)) END AS text,
       CASE l.l_returnflag WHEN 'R' THEN 'test' WHEN 'A' THEN 'defensive' ELSE 'comment' END AS source_kind,
       concat(s.file_path, ':', CAST(l.l_linenumber AS STRING)) AS source_location,
       CAST(CASE l.l_returnflag WHEN 'R' THEN 0.85 WHEN 'A' THEN 0.60 ELSE 0.35 END AS DOUBLE) AS confidence
FROM (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                 l_quantity, l_extendedprice, l_shipdate) AS seq, l_partkey, l_linenumber, l_quantity, l_returnflag, l_tax, l_discount
      FROM lineitem) l JOIN fx_symbols s ON s.p_partkey = l.l_partkey
"""

VIEWS["fx_invariants"] = """
SELECT repo_hash, candidate_id AS invariant_id, target_symbol_id, text, source_kind, source_location, confidence
FROM (SELECT c.*, row_number() OVER (PARTITION BY target_symbol_id, source_kind, text ORDER BY seq) AS rn
      FROM fx_candidates c) t WHERE rn = 1
"""

VIEWS["fx_requests"] = """
SELECT e.event_id AS query_id,
       CASE WHEN e.event_id % 10 = 9 THEN 'r0' ELSE s.repo_hash END AS repo_hash,
       concat(CASE e.event_type WHEN 'view' THEN 'explain how ' WHEN 'signup' THEN 'add a check to '
                                WHEN 'error' THEN 'what invariants apply to ' WHEN 'click' THEN 'trace data flow from '
                                ELSE 'show me an exemplar like ' END, s.qualified_name) AS question,
       s.qualified_name AS symbol,
       CASE e.event_id % 2 WHEN 0 THEN 'forward' ELSE 'backward' END AS direction,
       CAST(e.event_id % 3 + 1 AS INT) AS depth,
       s.file_path AS path,
       concat('c:', s.repo_hash, ':', split_part(s.file_path, '/', 2), '/', split_part(s.file_path, '/', 3)) AS cluster_id,
       CAST(CASE e.event_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 0.8 END AS DOUBLE) AS min_confidence,
       s.p_partkey
FROM events e JOIN fx_symbols s ON s.p_partkey = e.user_id
"""

VIEWS["fx_query_vectors"] = """
SELECT r.query_id, v.embedding AS query_vector
FROM fx_requests r JOIN embeddings v ON v.vec_id = r.p_partkey
"""

VIEWS["fx_events"] = """
SELECT event_id, concat('r', CAST(user_id % 3 AS STRING)) AS repo_hash, ts,
       CASE event_type WHEN 'view' THEN 'node_added' WHEN 'click' THEN 'edge_added' WHEN 'signup' THEN 'agent_activity'
                       WHEN 'error' THEN 'index_progress' ELSE 'region_highlighted' END AS event,
       CASE event_id % 4 WHEN 0 THEN 'symbol' WHEN 1 THEN 'flow' WHEN 2 THEN 'architecture' ELSE 'invariant' END AS layer,
       concat('s', CAST(user_id AS STRING)) AS node_id, value
FROM events
"""

VIEWS["fx_agent_steps"] = """
SELECT conv_id AS run_id, turn AS step,
       CASE WHEN role = 'user' THEN 'tool_call' WHEN turn % 4 = 3 THEN 'final' ELSE 'tool_result' END AS role, text
FROM conversations
"""

VIEWS["fx_source_files"] = """
SELECT 'src' AS repo_hash, s.p_partkey, concat('/core/gen/mod_', CAST(s.p_partkey AS STRING), '.py') AS file_path,
       concat('import os', chr(10),
              'from core.gen.mod_', CAST(abs(s.p_partkey - 1) AS STRING), ' import fn as dep', chr(10), chr(10),
              'LIMIT = ', CAST(s.line_start AS STRING), chr(10), chr(10),
              'def fn(x, y):', chr(10),
              '    if x is None:', chr(10),
              '        return None', chr(10),
              '    assert y > ', CAST(s.line_end AS STRING), chr(10),
              '    return dep(x)', chr(10), chr(10),
              'class Box(dep):', chr(10),
              '    def run(self):', chr(10),
              '        return dep(self)', chr(10)) AS content
FROM fx_symbols s
"""

VIEWS["fx_call_edges"] = """
SELECT DISTINCT r.repo_hash, r.source_symbol_id AS src, r.target_symbol_id AS dst
FROM fx_refs r JOIN fx_symbols a ON a.symbol_id = r.source_symbol_id JOIN fx_symbols b ON b.symbol_id = r.target_symbol_id
WHERE r.edge_kind = 'calls' AND a.kind IN ('function', 'method') AND b.kind IN ('function', 'method')
"""

VIEWS["fx_clean_roots"] = """
SELECT s.repo_hash, s.symbol_id FROM fx_symbols s
WHERE s.kind IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM fx_call_edges i WHERE i.dst = s.symbol_id)
"""

# A repository without a clean root starts from every function that calls something.
VIEWS["fx_starts"] = """
SELECT repo_hash, symbol_id FROM fx_clean_roots
UNION ALL
SELECT DISTINCT e.repo_hash, e.src FROM fx_call_edges e
WHERE NOT EXISTS (SELECT 1 FROM fx_clean_roots c WHERE c.repo_hash = e.repo_hash)
"""

VIEWS["fx_paths"] = """
SELECT e1.repo_hash, e1.src AS n1, e1.dst AS n2, CAST(NULL AS STRING) AS n3, CAST(NULL AS STRING) AS n4, 1 AS depth
FROM fx_starts s JOIN fx_call_edges e1 ON e1.src = s.symbol_id WHERE e1.dst <> e1.src
UNION ALL
SELECT e1.repo_hash, e1.src, e1.dst, e2.dst, CAST(NULL AS STRING), 2
FROM fx_starts s JOIN fx_call_edges e1 ON e1.src = s.symbol_id JOIN fx_call_edges e2 ON e2.src = e1.dst
WHERE e1.dst <> e1.src AND e2.dst <> e1.dst AND e2.dst <> e1.src
UNION ALL
SELECT e1.repo_hash, e1.src, e1.dst, e2.dst, e3.dst, 3
FROM fx_starts s JOIN fx_call_edges e1 ON e1.src = s.symbol_id JOIN fx_call_edges e2 ON e2.src = e1.dst JOIN fx_call_edges e3 ON e3.src = e2.dst
WHERE e1.dst <> e1.src AND e2.dst <> e1.dst AND e2.dst <> e1.src
  AND e3.dst <> e2.dst AND e3.dst <> e1.dst AND e3.dst <> e1.src
"""

# Stored flows: every path.
VIEWS["fx_flows"] = """
SELECT p.repo_hash, concat_ws('>', n1, n2, n3, n4) AS flow_id, n1 AS source_symbol_id, coalesce(n4, n3, n2) AS sink_symbol_id,
       CASE WHEN depth > 1 THEN n2 END AS mid1, CASE WHEN depth > 2 THEN n3 END AS mid2, 'call_chain' AS flow_kind,
       CASE WHEN q.symbol_id IS NOT NULL THEN 'password' END AS sensitivity
FROM fx_paths p LEFT JOIN (SELECT symbol_id FROM fx_symbols WHERE qualified_name LIKE '%password%') q ON q.symbol_id = p.n1
"""


def needed(sql: str, views: dict[str, str] = VIEWS) -> list[str]:
    """Views a statement uses, dependencies first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in out and re.search(rf"\b{name}\b", text):
                visit(views[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def with_views(sql: str) -> str:
    """The statement with the views it needs in front."""
    names = needed(sql)
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):].strip()}"
    return f"WITH {ctes}\n{body}"


#: Views that one other view reads once: steps of it, not kept beside it.
STEPS = ("fx_candidates", "fx_paths")

# Derived views built so far in a session, kept in memory or on executor disk like stored index tables.
_BUILT: dict = {}


class Tables:
    """Given tables and derived views of one scale-factor directory, as DataFrames."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        measure_joins(spark)

    def base(self, name: str):
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str):
        """A derived view that a query may read several times: kept with all its columns."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _BUILT:
            _BUILT[key] = self.plain(name).persist()
        return _BUILT[key]

    def plain(self, name: str):
        """A derived view that a query reads once: not kept, so only the columns read are shuffled and nothing is stored."""
        return self.sql(VIEWS[name], steps=STEPS)

    def sql(self, text: str, steps: tuple[str, ...] = ()):
        names = [n for n in VIEWS if re.search(rf"\b{n}\b", text)]
        frames = {n: self.plain(n) if n in steps else self.view(n) for n in names}
        frames |= {n: self.base(n) for n in BASE_TABLES if re.search(rf"\b{n}\b", text)}
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text)

    def __getattr__(self, name: str):
        if f"fx_{name}" not in VIEWS:
            raise AttributeError(name)
        return self.view(f"fx_{name}")

    @property
    def search_tables(self):
        """Index tables of the search, built once in a session; of the substrings only those that are asked for are read, so they are not kept."""
        from repolens.operators.search import SearchTables

        key = (self.spark.sparkContext.applicationId, self.sf_dir, "search_tables")
        if key not in _BUILT:
            found = SearchTables.of(self.symbols)
            _BUILT[key] = SearchTables(found.names.persist(), found.words.persist(), found.grams)
        return _BUILT[key]

    @property
    def flows(self):
        """Stored flows with the intermediates as an array."""
        return with_path(self.view("fx_flows"))

    @property
    def flows_once(self):
        """The same for a query that reads them once."""
        return with_path(self.plain("fx_flows"))


def with_path(flows):
    return flows.withColumn("path", F.array_compact(F.array("mid1", "mid2"))).drop("mid1", "mid2")
