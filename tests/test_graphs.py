"""Graph loops and clustering against plain Python on small graphs."""

import itertools
import random

import pytest

from repolens.operators import clusters, flows, graphs


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)]
    nodes = sorted({n for e in edges for n in e} | {999})
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    want = {n: f"{root(n):04d}" for n in nodes}
    got = graphs.connected_components(
        spark.createDataFrame([("r", f"{n:04d}") for n in nodes], "repo_hash string, node string"),
        spark.createDataFrame([("r", f"{a:04d}", f"{b:04d}") for a, b in edges], "repo_hash string, a string, b string"))
    assert {int(r.node): r.component for r in got.collect()} == want


def test_pagerank_hand_computed(spark):
    symbols = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c")], "repo_hash string, symbol_id string")
    refs = spark.createDataFrame([("r", "a", "b"), ("r", "a", "b"), ("r", "b", "a")], "repo_hash string, source_symbol_id string, target_symbol_id string")
    got = {r.symbol_id: r.value for r in graphs.pagerank(symbols, refs).collect()}
    # a and b exchange all their rank; c is dangling and spreads evenly.
    c = 0.15 / 3 / (1 - 0.85 / 3)
    assert got["c"] == pytest.approx(c, abs=1e-5) and got["a"] == pytest.approx((1 - c) / 2, abs=1e-5) and sum(got.values()) == pytest.approx(1)


def test_layers_with_cycle(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "z"), ("d", "w"), ("w", "v"), ("v", "w")]
    e = spark.createDataFrame([("r", *p) for p in edges], "repo_hash string, src string, dst string")
    n = spark.createDataFrame([("r", x) for x in "abcdxyzwv"], "repo_hash string, node string")
    shared = {r.node: r.layer for r in graphs.longest_path_layers(n, e).collect()}
    assert shared == {"a": 0, "b": 1, "c": 2, "d": 3, "w": 4, "x": 5, "y": 5, "z": 5, "v": 5}
    stepped = {r.node: r.layer for r in graphs.longest_path_layers(n, e, "stepped").collect()}
    assert [stepped[k] for k in "vxyz"] == [5, 6, 7, 8]


def test_paths_brute_force(spark):
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(12)]
    edges = [(a, b) for a, b in itertools.product(nodes, nodes) if rng.random() < 0.2]
    want = set()
    for n in (2, 3, 4):
        for p in itertools.permutations(nodes, n):
            if all((a, b) in set(edges) for a, b in zip(p, p[1:])):
                want.add(p)
    starts = spark.createDataFrame([("r", n) for n in nodes], "repo_hash string, symbol_id string")
    e = spark.createDataFrame([("r", *x) for x in edges + edges[:5]], "repo_hash string, src string, dst string")
    got = [tuple(r.nodes) for r in flows.bounded_paths(starts, e).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_blocking_loses_no_pair(spark):
    rng = random.Random(9)
    files = [f"/{rng.choice('ab')}/{rng.choice('cd')}/{rng.choice('ef')}/{rng.choice(['user', 'order', 'x'])}_{i % 7}.py" for i in range(40)]
    f = spark.createDataFrame([("r", p) for p in sorted(set(files))], "repo_hash string, file_path string")
    symbols = spark.createDataFrame([("r", f"s{i}", p, rng.choice(["function", "class"])) for i, p in enumerate(sorted(set(files)))], "repo_hash string, symbol_id string, file_path string, kind string")
    n = len(set(files))
    refs = spark.createDataFrame([("r", f"s{rng.randrange(n)}", f"s{rng.randrange(n)}", "calls") for _ in range(80)], "repo_hash string, source_symbol_id string, target_symbol_id string, edge_kind string")
    features = clusters.file_features(f, symbols, refs).cache()
    every = f.alias("x").join(f.alias("y"), "repo_hash").selectExpr("repo_hash", "x.file_path a", "y.file_path b").where("a < b")
    want = {(r.a, r.b) for r in clusters.pair_distances(features, every).where("round(distance, 9) <= 0.55").collect()}
    got = {(r.a, r.b) for r in clusters.pair_distances(features, clusters.candidate_pairs(features)).where("round(distance, 9) <= 0.55").collect()}
    assert got == want and want
