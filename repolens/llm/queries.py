"""One query per operator over its whole table, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, elias_fano, exact_dedup, html_template, mixing, packing, quartile_digest, robust_graph, simhash_trie, threshold_join, toxicity, turn_repair, warc
from .common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return wrap


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract_pages(table(spark, sf_dir, "pages"))


@query()
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(table(spark, sf_dir, "documents"), width=3, budget=3)


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, docs, table(spark, sf_dir, "labels"))


@query()
def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return elias_fano.token_id_files(docs, vocabulary("word_bpe_49k.json"), keep_spaces=False, end_id=2, with_ids=False)


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), 2048, keep_spaces=True, end_id=1).drop("width", "ids")


@query(r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v
), sized AS (
  SELECT *, 14 + length(role) + 3 * 0
      + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', ''))
      + length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) AS n,
    row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS of_k
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = of_k) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
""".replace("3 * 0\n      + ", ""))
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(turns))


@query(r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY digest ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size FROM rows
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, digest AS text_sha256 FROM ranked
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query()
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quartile_digest.fingerprint_documents(table(spark, sf_dir, "documents"))


@query(r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER o AS place,
    sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_size,
    sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM totals WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)
), opened AS (
  SELECT arg_min(left_size, place) AS a, arg_min(left_weight, place) AS b, min(place) AS place FROM placed WHERE left_size * weight <= 3 * source_size * left_weight
), targets AS (
  SELECT source, source_size, CASE WHEN o.place IS NULL OR p.place < o.place THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(a * weight AS DOUBLE) / b END AS target
  FROM placed p CROSS JOIN opened o
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
""")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query(r"""
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), firsts AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first_id FROM rows)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first_id THEN first_id END AS refers_to, TRUE AS verified FROM firsts
""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


@query(r"""
WITH rows AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i])), lambda a, b: a + b)) AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
""")
def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return robust_graph.search(robust_graph.build_index(rows, most=10), rows.where(F.col("vec_id") % 100 == 0), k=10)


@query(r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM rows a JOIN rows c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return threshold_join.mine_negatives(rows, rows.where(F.col("id") % 50 == 0))


def _cheapest_audit() -> str:
    """DuckDB expression over the list `codes`: fold of the four states' best `cost letters` texts (~: none), joined by |."""

    def add(x: str, cost: str, letter: str) -> str:
        return f"CASE WHEN {x} = '~' THEN '~' ELSE lpad(CAST(CAST(substr({x}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{letter}' END"

    def when(test: str, value: str) -> str:
        return f"CASE WHEN {test} THEN {value} ELSE '~' END"

    def least(*values: str) -> str:
        return f"least({', '.join(values)})"

    late = "CASE WHEN code IN ('S', 'U', 'A', 'O') THEN 5 ELSE 0 END"
    stays, n, s, u, a = "code <> 'x'", "v[1]", "v[2]", "v[3]", "v[4]"
    to_user = [when(f"{stays} AND lower(code) = 'u'", add(x, late, "K")) for x in (n, s, a)] + [when(stays, add(x, f"1 + {late}", "R")) for x in (n, s, a)]
    rows = [
        add(n, "2", "D"), least(add(s, "2", "D"), when("lower(code) = 's'", add(n, late, "K"))), least(add(u, "2", "D"), *to_user),
        least(add(a, "2", "D"), when("lower(code) = 'a'", add(u, late, "K")), when(stays, add(u, f"1 + {late}", "R"))),
    ]
    user = least("w[3]", *[add(x, "5", "I") for x in ("w[1]", "w[2]", "w[4]")])
    closed = f"list_transform([[{', '.join(rows)}]], lambda w: list_transform([{user}], lambda z: w[1] || '|' || w[2] || '|' || z || '|' || {least('w[4]', add('z', '5', 'I'))})[1])[1]"
    step = f"list_transform([string_split(acc, '|')], lambda v: {closed})[1]"
    return f"list_reduce(list_prepend('000000000|~|000000005I|000000010II', codes), lambda acc, code: {step})"


@query(r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 20 AS d
  FROM conversations
), broken AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE d WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM given
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, substr(role, 1, 1) AS initial,
    regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last_char FROM broken
), faulty AS (
  SELECT *, CASE WHEN last_char = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), FALSE) AS illegal
  FROM placed
), talks AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal,
    list(CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END)
      WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END ORDER BY pos) AS codes
  FROM faulty GROUP BY conv_id
), best AS (
  SELECT * EXCLUDE (codes), string_split(CHEAPEST, '|') AS states FROM talks
), plans AS (
  SELECT * EXCLUDE (states), CAST(substr(least(states[1], states[4]), 1, 9) AS BIGINT) AS cost, substr(least(states[1], states[4]), 10) AS audit FROM best
), letters AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS k FROM plans
), counted AS (
  SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS pos FROM letters
), kept AS (
  SELECT c.conv_id, c.letter, p.role, p.text, p.initial, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.k) AS place
  FROM counted c LEFT JOIN placed p ON c.letter <> 'I' AND p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.pos = c.pos WHERE c.letter <> 'D'
), led AS (
  SELECT *, CASE WHEN max(CASE WHEN place = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) = 1 THEN 1 ELSE 0 END AS lead FROM kept
), digests AS (
  SELECT conv_id, sha256(string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END END
    || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS digest FROM led GROUP BY conv_id
)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM g.conv_id
""".replace("CHEAPEST", _cheapest_audit()))
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turn_repair.repair_report(turn_repair.damaged(turns), turns.select("conv_id"))
