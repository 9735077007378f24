"""Scalar expressions over names, paths and texts of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens.functions import labels, paths, text, vectors

from .registry import check

c = F.col


@check("x1_repo_id", """
SELECT page_id, CASE WHEN url = '' AND page_id % 3 = 0 THEN NULL
  ELSE substr(sha256(concat(CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('/srv/', CAST(page_id AS VARCHAR)) END, '|', url)), 1, 12) END AS repo_id FROM pages""")
def x1(t):
    local = F.when(c("page_id") % 3 != 0, F.concat(F.lit("/srv/"), c("page_id").cast("string")))
    return t.base("pages").select("page_id", text.repo_id(local, c("url")).alias("repo_id"))


@check("x2_split_path", r"""
SELECT file_path, array_to_string(list_filter(regexp_split_to_array(replace(file_path, '/core/', '\core\'), '[\\/]'), lambda x: x <> ''), '|') AS parts FROM fx_files""")
def x2(t):
    mixed = F.replace(c("file_path"), F.lit("/core/"), F.lit("\\core\\"))
    return t.files.select("file_path", F.array_join(paths.split_path(mixed), "|").alias("parts"))


CAMEL = r"""regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1|\2', 'g'), '([A-Z])([A-Z][a-z])', '\1|\2', 'g')"""


@check("x3_camel_split", f"""
SELECT DISTINCT w, {CAMEL.format('w')} AS parts FROM (
  SELECT unnest(string_split(qualified_name, '.')) AS w FROM fx_symbols UNION ALL SELECT unnest(string_split(text, ' ')) FROM benchmark) u""")
def x3(t):
    words = t.symbols.select(F.explode(F.split("qualified_name", r"\.")).alias("w")).union(
        t.base("benchmark").select(F.explode(F.split("text", " "))))
    return words.distinct().select("w", F.array_join(text_camel(c("w")), "|").alias("parts"))


def text_camel(col):
    return paths.split_camel(col)


TOKENS = rf"""list_sort(list_distinct(list_filter(string_split(lower({CAMEL.format("regexp_replace(regexp_replace(split_part(file_path, '/', -1), '[.][^.]*$', ''), '[_.-]', '|', 'g')")}), '|'), lambda x: x <> '')))"""


@check("x4_name_tokens", f"SELECT file_path, array_to_string({TOKENS}, ' ') AS tokens FROM fx_files")
def x4(t):
    return t.files.select("file_path", F.array_join(F.sort_array(paths.name_tokens(c("file_path"))), " ").alias("tokens"))


@check("x5_jaccard", f"""
SELECT file_path, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard
FROM (SELECT file_path, {TOKENS} AS a, list_distinct(list_filter(string_split(file_path, '/'), lambda x: x <> '')) AS b FROM fx_files) t""")
def x5(t):
    other = F.array_distinct(paths.split_path(c("file_path")))
    return t.files.select("file_path", F.round(vectors.jaccard(paths.name_tokens(c("file_path")), other), 6).alias("jaccard"))


@check("x6_cosine_of_arrays", """
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity * l_tax + l_discount * l_quantity)
  / (sqrt(l_quantity * l_quantity + l_discount * l_discount) * sqrt(l_tax * l_tax + l_quantity * l_quantity)), 6) AS cosine FROM lineitem""")
def x6(t):
    a, b = F.array("l_quantity", "l_discount"), F.array("l_tax", "l_quantity")
    return t.base("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(vectors.cosine(a, b), 6).alias("cosine"))


@check("x7_test_path_ranking", """
SELECT file_path, (list_contains(string_split(file_path, '/'), 'tests') OR list_contains(string_split(file_path, '/'), 'test')
  OR starts_with(split_part(file_path, '/', -1), 'test_') OR ends_with(file_path, '_test.py')) AS is_test FROM fx_files""")
def x7(t):
    return t.files.select("file_path", paths.is_test_path_for_ranking(c("file_path")).alias("is_test"))


@check("e1_test_path_mining", """
SELECT file_path, ((starts_with(split_part(file_path, '/', -1), 'test_') AND ends_with(file_path, '.py'))
  OR ends_with(file_path, '_test.py') OR list_contains(string_split(lower(file_path), '/'), 'tests')) AS is_test FROM fx_files""")
def e1(t):
    return t.files.select("file_path", paths.is_test_path_for_mining(c("file_path")).alias("is_test"))


@check("x8_identifier", """
SELECT item_id, pos, regexp_matches(split_part(w, '.', 1), '^[A-Za-z_][A-Za-z0-9_]*$') AS ok FROM (
  SELECT item_id, unnest(string_split(text, ' ')) AS w, CAST(generate_subscripts(string_split(text, ' '), 1) - 1 AS INT) AS pos FROM benchmark) t""")
def x8(t):
    words = t.base("benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    return words.select("item_id", "pos", text.looks_like_identifier(c("w")).alias("ok"))


def short_tag_sql(col):
    clean = f"lower(trim(regexp_replace({col}, '[^A-Za-z0-9]+', '_', 'g'), '_'))"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.TAG_ABBREVIATIONS.items())
    return f"CASE {clean} WHEN '' THEN 'CLUSTER' {cases} ELSE substr(upper({clean}), 1, 12) END"


@check("x9_short_tag", f"""
SELECT w, {short_tag_sql('w')} AS tag FROM (SELECT DISTINCT unnest(string_split(concat('auth|configuration|--|', replace(file_path, '/', '|')), '|')) AS w FROM fx_files) t""")
def x9(t):
    words = t.files.select(F.explode(F.split(F.concat(F.lit("auth|configuration|--|"), F.replace(c("file_path"), F.lit("/"), F.lit("|"))), r"\|")).alias("w"))
    return words.distinct().select("w", text.short_tag(c("w")).alias("tag"))


@check("x10_folder_prefix", """
SELECT file_path, concat(rtrim(trim(concat('  ', file_path, '//')), '/'), '/') AS prefix FROM fx_files""")
def x10(t):
    raw = F.concat(F.lit("  "), "file_path", F.lit("//"))
    return t.files.select("file_path", paths.folder_prefix(raw).alias("prefix"))


@check("x11_file_in_folder", """
SELECT file_path, starts_with(file_path, '/db/') AS in_db, TRUE AS in_root FROM fx_files""")
def x11(t):
    return t.files.select(
        "file_path", paths.in_folder(c("file_path"), paths.folder_prefix(F.lit("/db"))).alias("in_db"),
        paths.in_folder(c("file_path"), paths.folder_prefix(F.lit("/"))).alias("in_root"))


@check("x12_strip_fences", """
SELECT item_id, trim(text) AS body FROM benchmark""")
def x12(t):
    fenced = F.concat(F.lit(" ```json\n"), c("text"), F.lit("\n``` "))
    return t.base("benchmark").select("item_id", text.strip_fences(fenced).alias("body"))


@check("x13_node_class", """
SELECT symbol_id, CASE kind WHEN 'class' THEN 'class' WHEN 'type' THEN 'interface' ELSE 'function' END AS node_class FROM fx_symbols""")
def x13(t):
    return t.symbols.select("symbol_id", labels.node_class(c("kind")).alias("node_class"))


def rules_sql(expr, rules, default):
    whens = " ".join(f"WHEN regexp_matches({expr}, '{p}') THEN '{label}'" for label, p in rules)
    return f"CASE {whens} ELSE '{default}' END"


@check("x14_band", f"SELECT symbol_id, {rules_sql('lower(concat(qualified_name, chr(32), file_path))', labels.BAND_RULES, 'Service')} AS band FROM fx_symbols")
def x14(t):
    return t.symbols.select("symbol_id", labels.band(c("qualified_name"), c("file_path")).alias("band"))


TIER_SQL = (
    "CASE " + " ".join(f"WHEN regexp_matches(split_part(lower({{0}}), '/', 2), '{p}') THEN '{x}'" for x, p in labels.TIER_TOP_RULES)
    + " " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{p}') THEN '{x}'" for x, p in labels.TIER_PATH_RULES)
    + " WHEN regexp_matches(lower({0}), '\\.(tsx|jsx|vue|svelte|html|css|scss)$') THEN 'Frontend' WHEN regexp_matches(lower({0}), '\\.(sql|prisma)$') THEN 'Database' ELSE 'Backend' END"
)


@check("x15_tier", f"""
SELECT p, {TIER_SQL.format('p')} AS tier FROM (SELECT file_path AS p FROM fx_files UNION ALL
  SELECT concat('/', split_part(file_path, '/', 4), file_path) FROM fx_files) u""")
def x15(t):
    moved = F.concat(F.lit("/"), F.element_at(F.split("file_path", "/"), 4), c("file_path"))
    p = t.files.select(c("file_path").alias("p")).unionAll(t.files.select(moved))
    return p.select("p", labels.tier(c("p")).alias("tier"))


@check("x16_layer_of_cluster", f"SELECT cluster_id, {rules_sql('lower(cluster_id)', labels.LAYER_RULES, 'External')} AS layer FROM fx_clusters")
def x16(t):
    return t.clusters.select("cluster_id", labels.layer_of_cluster(c("cluster_id")).alias("layer"))


BLOB = "lower(concat_ws(' ', s.file_path, coalesce(f.cluster_id, ''), s.qualified_name))"
GUESS = rules_sql(BLOB, labels.GUESS_RULES, "unknown")


@check("x17_tier_guess", f"""
SELECT s.symbol_id, {GUESS} AS tier FROM fx_symbols s JOIN fx_files f ON f.repo_hash = s.repo_hash AND f.file_path = s.file_path""")
def x17(t):
    joined = t.symbols.join(t.files, ["repo_hash", "file_path"])
    return joined.select("symbol_id", labels.tier_guess(c("qualified_name"), c("cluster_id"), c("file_path")).alias("tier"))


@check("x18_protocol", f"""
WITH g AS (SELECT s.symbol_id, s.qualified_name, {GUESS} AS tier FROM fx_symbols s JOIN fx_files f ON f.repo_hash = s.repo_hash AND f.file_path = s.file_path)
SELECT r.source_symbol_id, r.target_symbol_id, CASE WHEN a.tier = b.tier THEN NULL WHEN b.tier = 'data' THEN '«SQL»'
  WHEN b.tier = 'backend' AND a.tier = 'frontend' THEN '«HTTP»' WHEN a.tier = 'backend' AND b.tier = 'frontend' THEN '«HTTP»'
  WHEN regexp_matches(lower(b.qualified_name), 'query|select|insert|update|delete|sql') THEN '«SQL»'
  WHEN regexp_matches(lower(b.qualified_name), 'fetch|axios|request|http|get|post') THEN '«HTTP»' ELSE '«crosses tier»' END AS protocol, count(*) AS n
FROM fx_refs r JOIN g a ON a.symbol_id = r.source_symbol_id JOIN g b ON b.symbol_id = r.target_symbol_id GROUP BY ALL""")
def x18(t):
    g = t.symbols.join(t.files, ["repo_hash", "file_path"]).select(
        "symbol_id", "qualified_name", labels.tier_guess(c("qualified_name"), c("cluster_id"), c("file_path")).alias("tier"))
    a = g.select(c("symbol_id").alias("source_symbol_id"), c("tier").alias("a"))
    b = g.select(c("symbol_id").alias("target_symbol_id"), c("tier").alias("b"), "qualified_name")
    joined = t.refs.join(a, "source_symbol_id").join(b, "target_symbol_id")
    return joined.groupBy(
        "source_symbol_id", "target_symbol_id", labels.protocol(c("a"), c("b"), c("qualified_name")).alias("protocol")
    ).agg(F.count("*").alias("n"))


@check("x19_dirname", "SELECT url, CASE WHEN contains(url, '/') THEN left(url, length(url) - position('/' IN reverse(url))) ELSE '' END AS dir FROM pages")
def x19(t):
    return t.base("pages").select("url", paths.dirname(c("url")).alias("dir"))


def drill_sql(name, path):
    whens = " ".join(
        f"WHEN regexp_matches(lower({name}), '{n}') OR regexp_matches(lower({path}), '{p}') THEN '{x}'" for x, n, p in labels.DRILL_RULES)
    return f"CASE {whens} ELSE 'Service' END"


@check("x20_drill_band", f"SELECT symbol_id, {drill_sql('qualified_name', 'file_path')} AS band FROM fx_symbols")
def x20(t):
    return t.symbols.select("symbol_id", labels.drill_band(c("qualified_name"), c("file_path")).alias("band"))


@check("x21_parent_class", """
SELECT symbol_id, CASE WHEN kind = 'method' THEN array_to_string(string_split(qualified_name, '.')[:-2], '.') END AS parent_class FROM fx_symbols""")
def x21(t):
    return t.symbols.select("symbol_id", text.parent_class(c("kind"), c("qualified_name")).alias("parent_class"))


@check("b1_module_name", r"""
SELECT p, CASE WHEN m = '' THEN split_part(split_part(p, '/', -1), '.', 1) ELSE m END AS module FROM (
  SELECT p, trim(regexp_replace(concat('.', replace(regexp_replace(CASE WHEN starts_with(p, '/core/') THEN substr(p, 7) ELSE split_part(p, '/', -1) END, '\.[^./]*$', ''), '/', '.')),
    CASE WHEN ends_with(p, '.py') THEN '\.__init__$' ELSE '\.index$' END, ''), '.') AS m
  FROM (SELECT file_path AS p FROM fx_files UNION ALL SELECT concat('/core/pkg/', CASE WHEN file_path LIKE '%.py' THEN '__init__.py' ELSE 'index.ts' END) FROM fx_files
        UNION ALL SELECT '/core/index.tsx' FROM fx_files) u) v""")
def b1(t):
    init = F.concat(F.lit("/core/pkg/"), F.when(c("file_path").endswith(".py"), "__init__.py").otherwise("index.ts"))
    p = t.files.select(c("file_path").alias("p")).unionAll(t.files.select(init)).unionAll(t.files.select(F.lit("/core/index.tsx")))
    return p.select("p", paths.module_name(F.lit("/core/"), c("p")).alias("module"))


@check("b19_embedding_text", "SELECT symbol_id, trim(concat(kind, ' ', qualified_name, ' ', signature)) AS text FROM fx_symbols")
def b19(t):
    return t.symbols.select("symbol_id", text.embedding_text(c("kind"), c("qualified_name"), c("signature")).alias("text"))


@check("e7_guard_text", """
SELECT doc, pos, CASE WHEN c = '' THEN NULL
  WHEN starts_with(c, 'not ') AND regexp_matches(split_part(trim(substr(c, 5)), '.', 1), '^[A-Za-z_][A-Za-z0-9_]*$') THEN concat(trim(substr(c, 5)), ' must not be falsy/None')
  WHEN ends_with(c, ' is None') AND regexp_matches(split_part(trim(left(c, length(c) - 8)), '.', 1), '^[A-Za-z_][A-Za-z0-9_]*$') THEN concat(trim(left(c, length(c) - 8)), ' must not be None')
  ELSE concat('guard: ', c) END AS guard
FROM (SELECT symbol_id AS doc, pos, trim(CASE pos WHEN 0 THEN concat('not ', qualified_name) WHEN 1 THEN concat(qualified_name, ' is None')
        WHEN 2 THEN concat('not ', signature) WHEN 3 THEN concat('  ', signature, ' is not None') ELSE ' ' END) AS c
      FROM fx_symbols, (VALUES (0), (1), (2), (3), (4)) v(pos)) t""")
def e7(t):
    forms = F.array(
        F.concat(F.lit("not "), c("qualified_name")), F.concat(c("qualified_name"), F.lit(" is None")),
        F.concat(F.lit("not "), c("signature")), F.concat(F.lit("  "), c("signature"), F.lit(" is not None")), F.lit(" "))
    rows = t.symbols.select(c("symbol_id").alias("doc"), F.posexplode(forms).alias("pos", "cond"))
    return rows.select("doc", "pos", text.guard_text(c("cond")).alias("guard"))


STOP = ", ".join(f"'{w}'" for w in text.TASK_STOPWORDS)


def words_sql(col):
    return f"regexp_extract_all(lower({col}), '[a-z_][a-z0-9_]+')"


def keywords_sql(col):
    w = words_sql(col)
    kept = f"list_filter({w}, lambda x: x NOT IN ({STOP}))"
    return f"list_slice(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {w} END, 1, 8)"


def task_type_sql(col):
    has = lambda ws: " OR ".join(f"contains(lower({col}), '{w}')" for w in ws)
    return (f"CASE WHEN len({words_sql(col)}) = 0 THEN 'modify existing' WHEN {has(text.ADD_VERBS)} THEN 'add new code' "
            f"WHEN {has(text.UNDERSTAND_WORDS)} THEN 'understand' ELSE 'modify existing' END")


TASKS = "SELECT concat('q', CAST(query_id AS STRING)) AS id, question AS task FROM fx_requests UNION ALL SELECT concat('b', CAST(item_id AS STRING)), text FROM benchmark"


@check("g1_task_decomposition", f"SELECT id, {task_type_sql('task')} AS task_type, array_to_string({keywords_sql('task')}, ' ') AS keywords FROM ({TASKS}) t")
def g1(t):
    return t.sql(TASKS).select("id", text.task_type(c("task")).alias("task_type"), F.array_join(text.task_keywords(c("task")), " ").alias("keywords"))


@check("h1_question_routing", """
SELECT query_id, CASE WHEN contains(q, 'exemplar') OR contains(q, 'template') THEN 'find_exemplars'
  WHEN contains(q, 'invariant') OR contains(q, 'constraint') THEN 'find_invariants'
  WHEN contains(q, 'architecture') OR contains(q, 'convention') OR contains(q, 'cluster') OR contains(q, 'region') OR contains(q, 'how is the codebase organized') THEN 'describe_architecture'
  WHEN contains(q, 'flow') OR contains(q, 'taint') OR contains(q, 'trace') THEN 'trace_data_flow' ELSE 'find_relevant_context' END AS query_type
FROM (SELECT query_id, lower(question) AS q FROM fx_requests) t""")
def h1(t):
    return t.requests.select("query_id", text.query_type(c("question")).alias("query_type"))


@check("h6_git_url", r"""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('https://github.com/o/r', CAST(page_id AS VARCHAR)) END AS git_url,
  CASE WHEN page_id % 2 = 0 THEN 'index now please' ELSE concat('index o/r', CAST(page_id AS VARCHAR), ' now please') END AS question FROM pages""")
def h6(t):
    site = F.when(c("page_id") % 2 == 0, "https://github.com/").otherwise("")
    message = F.concat(F.lit("index "), site, F.lit("o/r"), c("page_id").cast("string"), F.lit(" now please"))
    return t.base("pages").select("page_id", text.git_url(message).alias("git_url"), text.without_git_url(message).alias("question"))


@check("m1_token_estimate", """
SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS tokens FROM documents""")
def m1(t):
    return t.base("documents").select("doc_id", text.token_estimate(F.length("text")).alias("tokens"))


@check("f2_vector_cosine", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.label""")
def f2(t):
    e = t.base("embeddings")
    b = e.select(c("vec_id").alias("label"), c("embedding").alias("other"))
    return e.withColumn("label", c("label").cast("bigint")).join(b, "label").select(
        "vec_id", F.round(vectors.cosine(c("embedding"), c("other")), 5).alias("cosine"))


@check("h4_flow_payload", """
SELECT query_id, coalesce(symbol, list_filter(string_split(question, ' '), lambda w: contains(w, '.') AND regexp_matches(w, '^[A-Za-z0-9_.]+$') AND regexp_matches(w, '[A-Za-z0-9]'))[1]) AS symbol,
  coalesce(direction, 'forward') AS direction, coalesce(depth, 3) AS depth
FROM (SELECT query_id, question, CASE WHEN query_id % 4 = 0 THEN symbol END AS symbol, CASE WHEN query_id % 3 = 0 THEN direction END AS direction, CASE WHEN query_id % 5 = 0 THEN depth END AS depth FROM fx_requests) t""")
def h4(t):
    from repolens.operators import routing

    q = c("query_id")
    sparse = t.requests.select(
        "query_id", "question", F.when(q % 4 == 0, c("symbol")).alias("symbol"),
        F.when(q % 3 == 0, c("direction")).alias("direction"), F.when(q % 5 == 0, c("depth")).alias("depth"))
    return routing.with_defaults(sparse).select("query_id", "symbol", "direction", "depth")
