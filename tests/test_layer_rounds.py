"""Graph loops compute their edges once and follow each peeled node once; layers of random graphs equal plain peeling."""

import random

from repolens.operators import graphs


def peeled(nodes, links):
    layer = {x: 0 for x in nodes if not any(b == x for _, b in links)}
    final, front = set(layer), set(layer)
    while front:
        for a, b in links:
            if a in front and b not in final:
                layer[b] = max(layer.get(b, 0), layer[a] + 1)
        front = {b for b in nodes if b not in final and any(y == b for _, y in links) and all(x in final for x, y in links if y == b)}
        final |= front
    return layer, final


def test_layers_follow_each_link_once(spark, monkeypatch):
    rng = random.Random(4)
    nodes, links = [], set()
    for r in "ab":
        nodes += [(r, f"n{i:02d}") for i in range(40)]
        links |= {((r, f"n{i:02d}"), (r, f"n{j:02d}")) for i, j in (sorted(rng.sample(range(40), 2)) for _ in range(60))}
    links |= {(("a", "n30"), ("a", "n31")), (("a", "n31"), ("a", "n30")), (("a", "n05"), ("a", "n30"))}
    n = spark.createDataFrame([*nodes, nodes[0], ("a", None)], "repo_hash string, node string")
    e = spark.createDataFrame([(a[0], a[1], b[1]) for a, b in sorted(links)] + [("a", "n00", "n00"), ("a", "gone", "n00")], "repo_hash string, src string, dst string")
    seen, plain = [], graphs.broadcast_small
    monkeypatch.setattr(graphs, "broadcast_small", lambda df: seen.append(df.count()) or plain(df))
    got = {(r.repo_hash, r.node): r.layer for r in graphs.longest_path_layers(n, e).collect()}
    want, final = peeled(nodes, links)
    late = {r: max([want[x] for x in want if x[0] == r]) + 1 for r in "ab"}
    assert {k: v for k, v in got.items() if k[1]} == {x: want.get(x, late[x[0]]) for x in nodes} and got["a", None] == late["a"]
    assert len(final) < len(nodes) and sum(seen) == len(final)


def test_components_compute_their_edges_once(spark, monkeypatch):
    e = spark.createDataFrame([("r", "a", "b"), ("r", "c", "b"), ("r", "d", "d"), ("q", "a", "d"), ("r", None, "a")], "repo_hash string, a string, b string")
    n = spark.createDataFrame([(r, x) for r in "rq" for x in "abcd"], "repo_hash string, node string")
    plans, plain = [], graphs.cut_lineage
    monkeypatch.setattr(graphs, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    got = {(r.repo_hash, r.node): r.component for r in graphs.connected_components(n, e).collect()}
    assert got == {("r", "a"): "a", ("r", "b"): "a", ("r", "c"): "a", ("r", "d"): "d", ("q", "a"): "a", ("q", "b"): "b", ("q", "c"): "c", ("q", "d"): "a"}
    assert plans[0].count("LogicalRDD") == 1
