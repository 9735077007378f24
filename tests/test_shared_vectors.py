"""Requests of equal effect meet vectors, words and symbols once, and large products are made where they are used."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from repolens.operators import lookups, ranking, search
from test_extraction import largest_output

SYMBOLS = "repo_hash string, file_path string, symbol_id string"


def test_similarity_of_equal_requests_is_computed_once(spark, monkeypatch):
    from checks.ranking_checks import f8

    symbols = spark.createDataFrame([("r", "/a.py", f"s{i}") for i in range(6)], SYMBOLS)
    embeddings = spark.createDataFrame([("r", f"s{i}", [1.0, float(i)]) for i in range(4)], "repo_hash string, symbol_id string, embedding array<double>")
    requests = spark.createDataFrame([(i, "r", "/a.py") for i in range(40)] + [(3, "r", "/a.py")], "query_id long, repo_hash string, path string")
    vectors = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(40) if i != 9], "query_id long, query_vector array<double>")
    seen, plain = [], ranking.embedding_similarity
    monkeypatch.setattr(ranking, "embedding_similarity", lambda x, *a: seen.append(x.count()) or plain(x, *a))
    got = f8(SimpleNamespace(requests=requests, symbols=symbols, embeddings=embeddings, query_vectors=vectors)).collect()
    want = [(q, f"s{i}", round((1 + (q % 2) * i) / ((1 + i * i) ** 0.5 * (1 + q % 2) ** 0.5), 5)) for q in [*range(40), 3] if q != 9 for i in range(4)]
    assert sorted((r.query_id, r.symbol_id, r.value) for r in got) == sorted(want)
    assert seen == [4 * 4]  # two vectors once each, and query 3 by itself with its two rows


def test_exemplars_share_the_vectors_of_tasks(spark):
    n = 120
    symbols = spark.createDataFrame([("r", f"/a/f{i % 10}.py", f"s{i}") for i in range(40)], SYMBOLS)
    files = symbols.select("repo_hash", "file_path").distinct().withColumn("cluster_id", F.lit("c"))
    signals = symbols.selectExpr("repo_hash", "symbol_id", "0.1D AS structural_centrality", "0D AS change_recency", "0D AS test_coverage_proxy")
    embeddings = symbols.select("repo_hash", "symbol_id", F.array(F.lit(1.0), F.substring("symbol_id", 2, 9).cast("double") % 10).alias("embedding"))
    requests = spark.range(n).selectExpr("id AS query_id", "'r' AS repo_hash", "'c' AS cluster_id", "concat('task ', id) AS question")
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(n)], "query_id long, query_vector array<double>")
    out = lookups.find_exemplars(requests, files, symbols, signals, embeddings, vectors)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.file_path)
    assert got == {q: [f"/a/f{i}.py" for i in ((0, 1, 2, 3, 4) if q % 2 else (9, 8, 7, 6, 5))] for q in range(n)}
    # not a row for each task and symbol; each task gets five files
    assert largest_output(out._jdf.queryExecution().executedPlan()) <= 5 * n


def test_searches_that_differ_in_unknown_words_are_one(spark, monkeypatch):
    symbols = spark.createDataFrame([("r", f"n{i}", f"s{i}", f"word{i % 3}") for i in range(9)], "repo_hash string, qualified_name string, symbol_id string, signature string")
    searches = spark.createDataFrame([(i, "r", f"word1 gone{i}") for i in range(20)] + [(20, "r", "gone"), (21, None, "word1")], "query_id long, repo_hash string, search string")
    seen, plain = [], search.best_positions
    monkeypatch.setattr(search, "best_positions", lambda once, *a: seen.append(once.count()) or plain(once, *a))
    got = search.text_search(searches, symbols, 2)
    assert sorted((r.query_id, r.symbol_id, r.hits, r.rank) for r in got.collect()) == [(q, s, 1, k) for q in range(20) for k, s in ((1, "s1"), (2, "s4"))]
    assert seen == [1]


def test_citations_are_grouped_where_steps_meet_symbols(spark):
    from checks.routing_checks import h14

    rows = [(f"n{i % 30}" if i % 7 else None, f"/f{i % 4}.py", "type" if i % 9 == 0 else "class", i % 50 * 10 + 1, i) for i in range(200)]
    symbols = spark.createDataFrame(rows, "qualified_name string, file_path string, kind string, line_start int, p_partkey long")
    steps = [(run, step) for run in range(40) for step in range(6)] + [(3, 1), (5, None)]
    t = SimpleNamespace(spark=spark, symbols=symbols, agent_steps=spark.createDataFrame(steps, "run_id long, step long"))
    out = h14(t)
    want = {}
    for run, step in steps:
        for name, path, kind, line, pos in rows:
            if step is not None and line == (run + step) % 50 * 10 + 1:
                key = (run, name or "", "" if kind == "type" else path)
                want[key] = min(want.get(key, (step, pos, line)), (step, pos, line))
    want = {(*k, v[0], v[2]) for k, v in want.items() if k[1] or k[2]}
    assert {(r.run_id, r.qualified_name, r.file_path, r.step, r.line_start) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Exchange" not in plan.split("BroadcastHashJoin")[0]


def test_touched_names_are_traced_once_for_equal_requests(spark, monkeypatch):
    from checks.routing_checks import h9

    symbols = spark.createDataFrame([("r", x, f"n.{x}") for x in "abc"], "repo_hash string, symbol_id string, qualified_name string")
    flows = spark.createDataFrame([("r", "a>b", "a", "b", []), ("r", "a>c>b", "a", "b", ["c"])], "repo_hash string, flow_id string, source_symbol_id string, sink_symbol_id string, path array<string>")
    flows = flows.selectExpr("*", "'call_chain' AS flow_kind", "CAST(NULL AS STRING) AS sensitivity")
    asked = [(i, "r", "n.a" if i % 2 else "n.b", "forward" if i % 2 else "backward", 1 + i % 3) for i in range(60)]
    asked += [(1, "r", "n.b", "backward", 3), (5, *asked[5][1:]), (None, "r", "n.a", "forward", 1), (None, "r", "n.a", "forward", 2)]
    requests = spark.createDataFrame(asked, "query_id long, repo_hash string, symbol string, direction string, depth int")
    seen, plain = [], lookups.trace_data_flow
    monkeypatch.setattr(lookups, "trace_data_flow", lambda r, *a: seen.append(r.count()) or plain(r, *a))
    got = h9(SimpleNamespace(requests=requests, symbols=symbols, flows=flows))
    want = {}
    for q, _, _, _, depth in asked:
        for flow, names in (("a>b", "ab"), ("a>c>b", "abc")):
            if len(names) - 2 <= max(0, depth - 1):
                for pos, x in enumerate(names):
                    want[q, f"n.{x}"] = min(want.get((q, f"n.{x}"), 999), len(flow) * 10 + pos)
    rows = got.collect()
    assert len(rows) == len(want) and {(r.query_id, r.name): r.first_seen for r in rows} == want
    # two symbols at three depths, query 1 with its two requests, query 5 with its repeated one, and those without id
    assert seen == [6 + 2 + 2 + 2]
    assert largest_output(got._jdf.queryExecution().executedPlan()) <= 3 * 64
