"""Requests of equal effect are searched, scoped and ranked once, with the rows of requests taken one by one."""

import random

from pyspark.sql import functions as F

from repolens.operators import context, ranked, search
from test_extraction import largest_output

COLUMNS = "repo_hash string, symbol_id string, qualified_name string, file_path string, signature string"


def rows_of(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def symbols_of(spark, n):
    rows = [("r" if i % 5 else "q", f"s{i}", f"pkg.word_{i % 4}.nm_{i}", f"/a/f{i % 3}.py", f"nm_{i}(word)") for i in range(n)]
    return spark.createDataFrame([*rows, rows[3], ("r", "s3", "pkg.word_9.twin", "/b/f.py", "twin()"), ("r", None, "pkg.none", "/a/f1.py", ""), (None, "s4", "x.y", "/a/f1.py", "")], COLUMNS)


def test_fan_out_deals_keys_that_many_share(spark):
    askers = spark.createDataFrame([(i, 1 if i < 60 else 2) for i in range(80)] + [(7, 1), (90, None), (91, 3)], "query_id long, lead long")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (4, "e")], "lead long, v string")
    got = sorted((r.query_id, r.v) for r in ranked.fan_out(askers, rows, "lead", hot=10).collect())
    want = [(q, v) for q, k in [*((i, 1 if i < 60 else 2) for i in range(80)), (7, 1), (90, None)] for j, v in ((1, "a"), (1, "b"), (2, "c"), (None, "d")) if j == k]
    assert got == sorted(want)


def test_words_are_looked_up_by_their_rarest_substring(spark):
    n = 300
    symbols = symbols_of(spark, n)
    asked = ["nm_12", "NM_123", "word_3.nm_1", "g", "kg", "pkg.word", "_2 more", "", "absent", "nm_1234567"]
    searches = spark.createDataFrame([(i, r, a) for i, (a, r) in enumerate((a, r) for a in asked for r in "rq")], "query_id long, repo_hash string, search string")
    want = set()
    for q in searches.collect():
        word = (q.search.split() or [""])[0].lower()
        hits = sorted((s.qualified_name, s.symbol_id or "") for s in symbols.collect() if word and s.repo_hash == q.repo_hash and word in s.qualified_name)
        want |= {(q.query_id, s, k) for k, (_, s) in enumerate(hits[:9], 1)}
    got = search.substring_search(searches, symbols, 9)
    assert {(r.query_id, r.symbol_id or "", r.rank) for r in got.collect()} == want
    # words that share their first letters meet few names that do not hold them
    many = spark.range(200, n).select("id", F.lit("r").alias("repo_hash"), F.concat(F.lit("nm_"), "id").alias("search")).withColumnRenamed("id", "query_id")
    found = search.substring_search(many, symbols, 9)
    found.collect()
    assert largest_output(found._jdf.queryExecution().executedPlan()) < 100 * n


def test_candidates_of_equal_effect_are_searched_once(spark, monkeypatch):
    symbols = symbols_of(spark, 60)
    texts = ["explain word_1 gone", "fix word_1", "trace word_1 missing", "nm_7x", "zzz qqq", "zzz ppp", "rd_2"]
    asked = [(i, "r" if i % 2 else "q", texts[i % 7], "pkg.word_9.twin" if i % 3 == 0 else None) for i in range(84)]
    asked += [asked[4], (5, "r", texts[3], None), (None, "r", texts[1], None), (None, "r", texts[4], None), (99, None, texts[1], None)]
    tasks = search.decompose(spark.createDataFrame(asked, "query_id long, repo_hash string, question string, seed_symbol string"))
    seen, plain = [], search._found
    monkeypatch.setattr(search, "_found", lambda t, *a: seen.append(t.select("query_id").distinct().count()) or plain(t, *a))
    got = search.candidates(tasks, symbols, 5)
    tables = search.SearchTables.of(symbols)
    each = plain(tasks.withColumn("search", search.search_text()), symbols, 5, None, tables)
    assert rows_of(got, "query_id", "repo_hash", "symbol_id") == rows_of(each, "query_id", "repo_hash", "symbol_id")
    # fewer searches than the 85 requests with an id, and those without
    assert seen[0] <= 40 and seen[1:] == [1]


def test_scoping_at_once_equals_region_then_scope(spark):
    rng = random.Random(2)
    symbols = symbols_of(spark, 40)
    files = spark.createDataFrame([(r, f, k) for r in "rq" for f, k in (("/a/f0.py", "c0"), ("/a/f1.py", "c1"), ("/a/f2.py", "gone"), ("/b/f.py", "c0"))], "repo_hash string, file_path string, cluster_id string")
    clusters = spark.createDataFrame([("r", "c0"), ("r", "c1"), ("q", "c0"), ("r", "c0")], "repo_hash string, cluster_id string")
    cands = [(q, "r" if q % 2 else "q", f"s{i}") for q in range(30) for i in rng.sample([x for x in range(45) if q % 3 or x % 3 == 0], 6)] + [(1, "r", None), (3, "r", "s3"), (3, "r", "s18")]
    cands = spark.createDataFrame(cands, "query_id long, repo_hash string, symbol_id string")
    tasks = spark.createDataFrame([(q, "understand") for q in range(30)] + [(2, "understand")], "query_id long, task_type string")
    regions = context.dominant_regions(cands, symbols, files, clusters)
    want = context.scope_to_region(cands, regions, symbols, files).join(tasks, "query_id")
    got = context.scoped_candidates(cands, tasks, symbols, files, clusters)
    columns = ["query_id", "repo_hash", "symbol_id", "region_id", "task_type"]
    assert rows_of(got, *columns) == rows_of(want, *columns)
    assert 0 < got.where("region_id IS NOT NULL").count() < got.count()
