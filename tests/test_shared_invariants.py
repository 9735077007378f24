"""Invariants of a request's cluster against brute force; the product of both is made last."""

import re

from repolens.operators import lookups


def test_invariants_of_clusters_meet_requests_last(spark):
    symbols = spark.createDataFrame(
        [("r", f"s{i}", f"n{i % 5}" if i != 7 else None, f"/f{i % 3}") for i in range(9)], "repo_hash string, symbol_id string, qualified_name string, file_path string")
    files = spark.createDataFrame([("r", "/f0", "c0"), ("r", "/f1", "c0"), ("r", "/f2", None)], "repo_hash string, file_path string, cluster_id string")
    invariants = spark.createDataFrame(
        [("r", f"i{i}", f"s{i % 11}", f"t{i}", "test", "x:1", None if i == 4 else i / 40) for i in range(40)] + [("r", "i3", "s3", "t3", "test", "x:1", 0.9)],
        "repo_hash string, invariant_id string, target_symbol_id string, text string, source_kind string, source_location string, confidence double")
    asked = [(1, "r", None, "c0", None), (1, "r", "", "c0", 0.5), (2, "r", "", "gone", 0.0), (3, "r", "n1", "c0", 0.2), (4, "r", None, None, 0.0), (None, "r", None, "c0", 0.9)]
    requests = spark.createDataFrame(asked, "query_id long, repo_hash string, symbol string, cluster_id string, min_confidence double")
    got = lookups.find_invariants(requests, symbols, files, invariants)
    want = []
    for q, _, symbol, cluster, least in asked:
        if symbol:
            ids = [min((r for r in symbols.collect() if r.qualified_name == symbol), key=lambda r: r.symbol_id).symbol_id]
        else:
            ids = [r.symbol_id for r in symbols.collect() if cluster == "c0" and r.file_path in ("/f0", "/f1")]
        want += [(q, i.invariant_id, i.confidence or 0.0) for i in invariants.collect() if i.target_symbol_id in ids and (i.confidence or 0.0) >= (least or 0.0)]
    assert sorted(map(repr, ((r.query_id, r.invariant_id, r.confidence) for r in got.collect()))) == sorted(map(repr, want))
    lines = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
    depth = [len(re.match(r"[ :+\-]*", x)[0]) for x in lines]
    at = next(k for k, x in enumerate(lines) if "Join" in x and "_salt" in x)
    above, level = [], depth[at]
    for k in range(at, -1, -1):
        if depth[k] < level:
            above, level = [*above, lines[k]], depth[k]
    assert above and not any("Exchange" in x for x in above)
