"""Requests that are equal are answered once, and the answers equal plain Python."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from repolens.operators import lookups, routing, scopes
from test_extraction import largest_output


def joined_rows(df):
    rows = df.collect()
    return rows, largest_output(df._jdf.queryExecution().executedPlan())


def test_similarity_meets_only_rows_with_a_vector(spark):
    from checks.ranking_checks import f8

    n = 300
    symbols = spark.range(n).select(F.lit("r").alias("repo_hash"), F.lit("/a.py").alias("file_path"), F.concat(F.lit("s"), "id").alias("symbol_id"))
    requests = spark.range(n).select(F.col("id").alias("query_id"), F.lit("r").alias("repo_hash"), F.lit("/a.py").alias("path"))
    embeddings = spark.createDataFrame([("r", "s1", [1.0, 0.0]), ("r", "s2", [1.0, 1.0])], "repo_hash string, symbol_id string, embedding array<double>")
    vectors = spark.createDataFrame([(4, [0.0, 1.0]), (4, [0.0, 1.0])], "query_id long, query_vector array<double>")
    rows, most = joined_rows(f8(SimpleNamespace(requests=requests, symbols=symbols, embeddings=embeddings, query_vectors=vectors)))
    assert sorted((r.query_id, r.symbol_id, r.value) for r in rows) == [(4, "s1", 0.0)] * 2 + [(4, "s2", 0.70711)] * 2
    assert most <= n


def test_exemplars_of_a_large_cluster(spark):
    n = 200
    symbols = spark.range(n).select(F.lit("r").alias("repo_hash"), F.format_string("/a/f%03d.py", F.col("id") % 40).alias("file_path"), F.concat(F.lit("s"), "id").alias("symbol_id"))
    files = symbols.select("repo_hash", "file_path").distinct().withColumn("cluster_id", F.lit("c")).unionByName(
        spark.createDataFrame([("r", f"/b/{i}.py", "empty") for i in range(7)], "repo_hash string, file_path string, cluster_id string"))
    requests = spark.range(n).select(F.col("id").alias("query_id"), F.lit("r").alias("repo_hash"), F.when(F.col("id") < 2, "empty").otherwise("c").alias("cluster_id"),
                                     F.concat(F.lit("task "), "id").alias("question"))
    central = (F.substring("symbol_id", 2, 9).cast("int") % 40) / 100.0
    signals = symbols.select("repo_hash", "symbol_id", central.alias("structural_centrality"), F.lit(0.0).alias("change_recency"), F.lit(0.0).alias("test_coverage_proxy"))
    embeddings = spark.createDataFrame([("r", "s3", [1.0, 0.0])], "repo_hash string, symbol_id string, embedding array<double>")
    vectors = spark.createDataFrame([(5, [1.0, 0.0]), (6, [-1.0, 0.0])], "query_id long, query_vector array<double>")
    rows, most = joined_rows(lookups.find_exemplars(requests, files, symbols, signals, embeddings, vectors))
    got = {}
    for r in sorted(rows, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.file_path)
    best = [f"/a/f{i:03d}.py" for i in (39, 38, 37, 36, 35)]
    assert got == {q: best for q in range(2, n)} | {q: [f"/b/{i}.py" for i in range(5)] for q in (0, 1)} | {5: ["/a/f003.py", *best[:4]]}
    assert most <= 6 * n


def test_scopes_are_resolved_once(spark):
    n = 300
    files = spark.createDataFrame([("r", f"/a/f{i}.py", "c") for i in range(n)], "repo_hash string, file_path string, cluster_id string")
    symbols = files.select("repo_hash", "file_path", F.concat(F.lit("n"), "file_path").alias("qualified_name"))
    table = spark.range(n).select(F.concat(F.lit("z"), "id").alias("scope_id"), F.lit("r").alias("repo_hash"), F.lit("folder").alias("kind"), F.lit(None).cast("string").alias("cluster_id"),
                                  F.lit("/a/").alias("path"), F.lit(None).cast("array<string>").alias("qnames"))
    requests = spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("z"), "id").alias("scope_id"),
                                     F.when(F.col("id") % 3 == 0, "/a/f1.py").when(F.col("id") % 3 == 1, "/a/").otherwise("/b").alias("path"))
    rows, most = joined_rows(scopes.path_inside_scopes(requests, table, files, symbols))
    assert sorted(r.query_id for r in rows) == [i for i in range(n) if i % 3 < 2]
    assert most <= 3 * n


def test_shared_answers_keep_repeated_requests(spark):
    rows = spark.createDataFrame([("a", i, i / 10) for i in range(6)] + [("b", 9, 0.55)], "query_id string, invariant_id long, confidence double")
    askers = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "a"), (3, "b"), (4, "none")], "query_id long, ask string")
    each = askers.join(rows.withColumnRenamed("query_id", "ask"), "ask").drop("ask")
    order = [F.desc("confidence"), F.col("invariant_id")]
    want = sorted(map(tuple, routing.compact_rows(each, order, 4).select("query_id", "rank", "invariant_id", "cut").collect()))
    assert sorted(map(tuple, routing.compact_shared(askers, rows, order, 4).select("query_id", "rank", "invariant_id", "cut").collect())) == want


def test_equal_traces_run_once(spark):
    n = 200
    symbols = spark.createDataFrame([("r", "x", "a"), ("r", "y", "b")], "repo_hash string, symbol_id string, qualified_name string")
    flows = spark.range(n).select(F.lit("r").alias("repo_hash"), F.concat(F.lit("f"), "id").alias("flow_id"), F.lit("x").alias("source_symbol_id"), F.lit("y").alias("sink_symbol_id"),
                                  F.array().cast("array<string>").alias("path"), F.lit("call_chain").alias("flow_kind"), F.lit(None).cast("string").alias("sensitivity"))
    requests = spark.range(n).select(F.col("id").alias("query_id"), F.lit("r").alias("repo_hash"), F.lit("a").alias("symbol"), F.lit("forward").alias("direction"), F.lit(2).alias("depth"))
    asks, askers = lookups.shared_asks(requests, ["repo_hash", "symbol", "direction", "depth"])
    rows, most = joined_rows(routing.touched_names(lookups.trace_data_flow(asks, symbols, flows).withColumn("flow_rank", F.length("flow_id"))))
    assert sorted(r.name for r in rows) == ["a", "b"] and askers.count() == n and most <= 3 * n
    assert lookups.trace_data_flow(requests, symbols, flows).count() == n * n
