"""Extraction and invariant mining over generated source files, with their closed-form result."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolens.functions import text
from repolens.operators import invariants as inv
from repolens.operators import symbols as sy
from repolens.sources import facts as fa

from .registry import check

c = F.col


def files(t):
    # the generated files come from few partitions of a small table
    return t.source_files.repartition(8, "p_partkey").withColumn("root", F.lit("/"))


def facts(t):
    return fa.syntax_facts(files(t))


def symbols(t):
    return sy.give_ids(sy.raw_symbols(facts(t)))


MOD = "concat('core.gen.mod_', CAST(p_partkey AS VARCHAR))"
BEFORE = "concat('core.gen.mod_', CAST(abs(p_partkey - 1) AS VARCHAR), '.fn')"


@check("a4_parse_report", "SELECT repo_hash, count(*) FILTER (WHERE p_partkey % 7 <> 0) AS parsed, count(*) FILTER (WHERE p_partkey % 7 = 0) AS failed FROM fx_source_files GROUP BY repo_hash")
def a4(t):
    # Every seventh file gets a syntax error; the run goes on.
    broken = files(t).withColumn("content", F.when(c("p_partkey") % 7 == 0, F.concat("content", F.lit("\ndef (:\n"))).otherwise(c("content")))
    return fa.parse_report(fa.syntax_facts(broken))


SYMBOLS = f"""
SELECT {MOD} || n AS qualified_name, file_path, ls AS line_start, le AS line_end, kind, sig AS signature FROM fx_source_files,
(VALUES ('.LIMIT', 4, 4, 'variable', 'LIMIT'), ('.fn', 6, 10, 'function', 'fn(x, y)'), ('.Box', 12, 14, 'class', 'class Box(dep)'), ('.Box.run', 13, 14, 'method', 'run(self)')) v(n, ls, le, kind, sig)"""


@check("b2_extracted_symbols", SYMBOLS)
def b2(t):
    return sy.raw_symbols(facts(t)).drop("repo_hash", "seq")


@check("b3_import_aliases", f"SELECT file_path, 'os' AS head, 'os' AS resolved FROM fx_source_files UNION ALL SELECT file_path, 'dep', {BEFORE} FROM fx_source_files")
def b3(t):
    return sy.alias_table(facts(t)).drop("repo_hash")


REFS = f"""
SELECT {MOD} || n AS source_qname, {BEFORE} AS target_qname, kind AS edge_kind FROM fx_source_files, (VALUES ('.fn', 'calls'), ('.Box', 'inherits'), ('.Box.run', 'calls')) v(n, kind)"""


@check("b8_extracted_refs", REFS)
def b8(t):
    return sy.raw_refs(facts(t)).select("source_qname", "target_qname", "edge_kind")


@check("b16_alias_heads", """
SELECT symbol_id, CASE split_part(qualified_name, '.', 1) WHEN 'core' THEN concat('lib.kernel', substr(qualified_name, 5)) ELSE qualified_name END AS target_qname FROM fx_symbols""")
def b16(t):
    targets = t.symbols.select("repo_hash", "file_path", "symbol_id", c("qualified_name").alias("target"))
    aliases = t.files.select("repo_hash", "file_path", F.lit("core").alias("head"), F.lit("lib.kernel").alias("resolved"))
    return sy.resolve_heads(targets, aliases).select("symbol_id", "target_qname")


# Names repeat: symbols of one stem share a name, the last by file and position gets the reference.
NAMED = "SELECT repo_hash, symbol_id, file_path, p_partkey AS seq, concat(split_part(qualified_name, '.', 1), '.', split_part(qualified_name, '.', 3)) AS qualified_name FROM fx_symbols"
NAME_REFS = "SELECT r.repo_hash, a.qualified_name AS source_qname, CASE WHEN r.edge_kind = 'inherits' THEN 'gone.away' ELSE b.qualified_name END AS target_qname, r.edge_kind FROM fx_refs r JOIN (" + NAMED + ") a ON a.symbol_id = r.source_symbol_id JOIN (" + NAMED + ") b ON b.symbol_id = r.target_symbol_id"
LAST = f"(SELECT repo_hash, qualified_name, arg_max(symbol_id, (file_path, seq)) AS symbol_id FROM ({NAMED}) n GROUP BY ALL)"


@check("b17_resolved_refs", f"""
SELECT r.repo_hash, a.symbol_id AS source_symbol_id, b.symbol_id AS target_symbol_id, r.edge_kind FROM ({NAME_REFS}) r JOIN {LAST} a ON a.repo_hash = r.repo_hash AND a.qualified_name = r.source_qname
JOIN {LAST} b ON b.repo_hash = r.repo_hash AND b.qualified_name = r.target_qname""")
def b17(t):
    return sy.resolved_only(sy.resolve_refs(t.sql(NAME_REFS), t.sql(NAMED)))


@check("b18_unresolved_share", f"""
SELECT repo_hash, count(*) AS total, count(*) FILTER (WHERE target_qname = 'gone.away') AS dropped, round(100.0 * count(*) FILTER (WHERE target_qname = 'gone.away') / count(*), 4) AS dropped_percent FROM ({NAME_REFS}) r GROUP BY repo_hash""")
def b18(t):
    return sy.resolution_report(sy.resolve_refs(t.sql(NAME_REFS), t.sql(NAMED)))


def hashed_words(key, rows):
    """Number of filled places, the largest value and the mean place of the default embedding of `(key, text)` rows."""
    return f"""
WITH w AS (SELECT {key}, unnest(regexp_split_to_array(trim(lower(text)), '\\s+')) AS word FROM ({rows}) x),
n AS (SELECT {key}, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 384 AS place, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL)
SELECT {key}, 384 AS dims, count(*) AS filled, round(max(n) / sqrt(sum(n * n)), 4) AS largest, round(sum(place * n) / sum(n), 2) AS mean_place FROM n GROUP BY {key}"""


def vector_facts(rows, key):
    v = c("embedding")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    places = F.aggregate(F.transform(v, lambda x, i: x.cast("double") * i), F.lit(0.0), lambda a, x: a + x)
    return rows.where("embedding_error IS NULL").select(
        key, F.size(v).alias("dims"), F.size(F.filter(v, lambda x: x > 0)).cast("bigint").alias("filled"),
        F.round(F.array_max(v).cast("double"), 4).alias("largest"), F.round(places / total, 2).alias("mean_place"))


EMBEDDED = "SELECT symbol_id, concat(kind, ' ', qualified_name, CASE WHEN coalesce(signature, '') = '' THEN '' ELSE concat(' ', signature) END) AS text FROM fx_symbols"


@check("b20_symbol_embeddings", hashed_words("symbol_id", EMBEDDED))
def b20(t):
    texts = t.symbols.select("symbol_id", text.embedding_text(c("kind"), c("qualified_name"), c("signature")).alias("text"))
    return vector_facts(sy.embed_texts(texts, "text"), "symbol_id")


@check("b21_query_embeddings", hashed_words("query_id", "SELECT query_id, question AS text FROM fx_requests"))
def b21(t):
    return vector_facts(sy.embed_texts(t.requests.select("query_id", "question"), "question"), "query_id")


# Test twins of the generated files: same body, in a tests folder, calling the function before the assert.
@check("e2_test_invariants", f"""
SELECT {MOD} || '.fn' AS target, concat('r == ', CAST(p_partkey AS VARCHAR)) AS text, concat('/core/tests/test_', CAST(p_partkey AS VARCHAR), '.py:5') AS source_location FROM fx_source_files""")
def e2(t):
    body = F.concat(F.lit("from core.gen import x\ndef test_it():\n    assert 1\n    r = core.gen.mod_"), c("p_partkey").cast("string"),
                    F.lit(".fn(1, 2)\n    assert r == "), c("p_partkey").cast("string"), F.lit("\n"))
    tests = files(t).withColumn("file_path", F.concat(F.lit("/core/tests/test_"), c("p_partkey").cast("string"), F.lit(".py"))).withColumn("content", body)
    known = symbols(t)
    found, _ = inv.mine_tests(fa.syntax_facts(tests), known)
    named = found.join(known.select(c("symbol_id").alias("target_symbol_id"), c("qualified_name").alias("target")), "target_symbol_id")
    return named.select("target", "text", "source_location")


EVENTS = "SELECT repo_hash, 'f' AS file_path, CAST(event_id // 50 AS INT) AS fn_line, CAST(event_id % 50 AS INT) AS position, CASE WHEN event = 'index_progress' THEN 'assert' ELSE 'other' END AS kind, CASE WHEN layer = 'flow' THEN NULL ELSE concat('call_', node_id) END AS call_text, event_id FROM fx_events"


@check("e3_prior_call", f"""
SELECT e.event_id, (SELECT arg_max(p.call_text, p.position) FROM ({EVENTS}) p WHERE p.repo_hash = e.repo_hash AND p.fn_line = e.fn_line AND p.position < e.position AND p.kind <> 'assert' AND p.call_text IS NOT NULL) AS prior_call FROM ({EVENTS}) e""")
def e3(t):
    rows = t.sql(EVENTS.replace("event_id // 50", "floor(event_id / 50)"))
    return inv.prior_calls(rows).select("event_id", "prior_call")


CALLS = "SELECT DISTINCT repo_hash, CASE WHEN query_id % 3 = 0 THEN symbol WHEN query_id % 3 = 1 THEN concat('obj.', split_part(symbol, '.', 4)) ELSE concat(split_part(symbol, '.', 3), '.', split_part(symbol, '.', 4)) END AS call_text FROM fx_requests"


@check("e4_resolved_calls", f"""
WITH k AS ({CALLS}), s AS (SELECT repo_hash, symbol_id, qualified_name AS q, file_path, p_partkey FROM fx_symbols),
h AS (SELECT k.*, s.symbol_id, CASE WHEN s.q = k.call_text THEN 0 WHEN ends_with(s.q, concat('.', k.call_text)) THEN 1 ELSE 2 END AS rule, s.file_path, s.p_partkey FROM k JOIN s ON s.repo_hash = k.repo_hash
  AND (s.q = k.call_text OR ends_with(s.q, concat('.', k.call_text)) OR s.q = split_part(k.call_text, '.', -1) OR ends_with(s.q, concat('.', split_part(k.call_text, '.', -1)))))
SELECT repo_hash, call_text, arg_min(symbol_id, (rule, file_path, p_partkey)) AS target_symbol_id FROM h GROUP BY ALL""")
def e4(t):
    return inv.resolve_calls(t.sql(CALLS), t.symbols.withColumnRenamed("p_partkey", "seq"))


@check("e5_guard_invariants", f"""
SELECT {MOD} || '.fn' AS target, CASE k WHEN 0 THEN 'x must not be None' ELSE concat('precondition: ', regexp_extract(content, 'assert (y > [0-9]+)', 1)) END AS text,
  concat(file_path, ':', CASE k WHEN 0 THEN '7' ELSE '9' END) AS source_location FROM fx_source_files, (VALUES (0), (1)) v(k)""")
def e5(t):
    known = symbols(t)
    found = inv.mine_guards(facts(t), known)
    return found.join(known.select(c("symbol_id").alias("target_symbol_id"), c("qualified_name").alias("target")), "target_symbol_id").select(
        "target", "text", "source_location")


POINTS = "SELECT s.repo_hash, s.file_path, CAST(l.l_linenumber * 70 AS INT) AS line FROM fx_symbols s JOIN lineitem l ON l.l_partkey = s.p_partkey"


@check("e8_enclosing_function", f"""
SELECT p.repo_hash, p.file_path, p.line, arg_max(s.symbol_id, (s.line_start, -s.line_end, s.symbol_id)) AS owner_id FROM (SELECT DISTINCT * FROM ({POINTS}) q) p
JOIN fx_symbols s ON s.repo_hash = p.repo_hash AND s.file_path = p.file_path AND s.kind IN ('function', 'method') AND p.line BETWEEN s.line_start AND s.line_end GROUP BY ALL""")
def e8(t):
    return inv.enclosing_functions(t.sql(POINTS), t.symbols)


@check("e9_comment_prompts", f"""
SELECT repo_hash, concat(file_path, ':6') AS source_location, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_hash ORDER BY file_path) AS rank FROM fx_source_files WHERE p_partkey % 2 = 0) z WHERE rank <= 200""")
def e9(t):
    # Every second function gets a comment line in place of the blank line above it.
    commented = F.when(c("p_partkey") % 2 == 0, F.replace(c("content"), F.lit("\n\ndef fn"), F.lit("\n# checks x\ndef fn"))).otherwise(c("content"))
    parsed = fa.syntax_facts(files(t).withColumn("content", commented))
    # the documented budget, asked for
    return inv.comment_prompts(parsed, sy.give_ids(sy.raw_symbols(parsed)), 200).select("repo_hash", "source_location", "rank")


@check("e9_all_comment_prompts", "SELECT repo_hash, concat(file_path, ':6') AS source_location FROM fx_source_files")
def e9_all(t):
    # Every function gets a comment line; all prompts are kept.
    parsed = fa.syntax_facts(files(t).withColumn("content", F.replace(c("content"), F.lit("\n\ndef fn"), F.lit("\n# checks x\ndef fn"))))
    return inv.comment_prompts(parsed, sy.give_ids(sy.raw_symbols(parsed))).select("repo_hash", "source_location")


@check("e11_comment_candidates", """
SELECT target_symbol_id, concat('must hold ', source_location) AS text, 0.35::DOUBLE AS confidence FROM (SELECT DISTINCT repo_hash, target_symbol_id, source_location FROM fx_candidates) d WHERE source_location LIKE '%.py:%'""")
def e11(t):
    prompts = t.candidates.select("repo_hash", "target_symbol_id", "source_location").distinct().withColumn("file_path", F.lit("f")).withColumn("seq", F.lit(0))
    reply = F.when(c("source_location").contains(".py:"), F.concat(F.lit(" must hold "), c("source_location"), F.lit("\n"))).otherwise("  ")
    replies = t.candidates.select("repo_hash", "source_location").distinct().withColumn("reply", reply)
    return inv.comment_candidates(prompts, replies).select("target_symbol_id", "text", "confidence")


CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@check("e12_validated", f"""
SELECT candidate_id, {CLEAN} AS text, CASE WHEN target_symbol_id LIKE 'x%' THEN 'invalid_target' WHEN {CLEAN} = '' THEN 'empty_text' ELSE 'kept' END AS fate FROM fx_candidates""")
def e12(t):
    return inv.validate(t.candidates, t.symbols).select("candidate_id", "text", "fate")


DEDUPED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_symbol_id, source_kind, {CLEAN} ORDER BY seq) AS rn FROM fx_candidates WHERE target_symbol_id NOT LIKE 'x%' AND {CLEAN} <> '') z WHERE rn = 1"""


def deduped(t):
    return inv.dedupe(inv.validate(t.candidates, t.symbols).where("fate = 'kept'"), ("seq",))


@check("e13_deduped", f"SELECT candidate_id FROM ({DEDUPED}) d")
def e13(t):
    return deduped(t).select("candidate_id")


CAPPED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_hash ORDER BY confidence DESC, CASE source_kind WHEN 'test' THEN 0 WHEN 'defensive' THEN 1 ELSE 2 END, seq) AS rank FROM ({DEDUPED}) d) y WHERE rank <= 2000"""


@check("e14_capped", f"SELECT candidate_id, rank FROM ({CAPPED}) q")
def e14(t):
    return inv.cap(deduped(t), ("seq",), 2000).select("candidate_id", "rank")


@check("e15_counts", f"""
SELECT repo_hash, count(*) AS invariants, count(*) FILTER (WHERE source_kind = 'test') AS test, count(*) FILTER (WHERE source_kind = 'defensive') AS defensive, count(*) FILTER (WHERE source_kind = 'comment') AS comment,
  count(*) FILTER (WHERE confidence >= 0.75) AS high, count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.75) AS med, count(*) FILTER (WHERE confidence < 0.5) AS low FROM ({DEDUPED}) q GROUP BY repo_hash""")
def e15(t):
    return inv.counts(deduped(t))
