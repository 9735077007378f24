import numpy as np
import pytest

from repolens.llm.robust_graph import Graph, build_index, search

SCHEMA = "vec_id long, embedding array<float>, shard int, ids string, node long"


def brute(rows, queries, k):
    """Ids of the k nearest by exact distance, ties to the smaller id."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in queries:
        if (q, tuple(v or ())) in good:
            far = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, w)))), i) for i, w in good if i != q and len(w) == len(v))
            out[q] = [(i, round(d, 9)) for d, i in far[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


def test_odd_rows_ties_and_copies(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)]  # 21 distinct vectors, many ties
    rows += [(100, [0.0, 1.0, 0.0])] * 3 + [(i, [5.0, 5.0, 5.0]) for i in range(200, 260)]
    rows += [(300, None), (301, []), (302, [0.0, 0.0, 0.0]), (303, [1.0, None, 2.0]), (304, [float("nan"), 1.0, 1.0]), (305, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(400, [1.0, 2.0]), (401, [1.0, 2.5]), (402, [2.0**100, -(2.0**100)])]
    df = frame(spark, rows)
    for shard_rows in (1000, 7):
        assert found(search(build_index(df, shard_rows=shard_rows), df, k=10)) == brute(rows, rows, 10)
    assert found(search(build_index(df, most=3), df, k=3)) == brute(rows, rows, 3)


def test_empty_table(spark):
    none = frame(spark, []).limit(0)
    assert search(build_index(none), none).count() == 0


@pytest.mark.parametrize("shard_rows", [4000, 900])
def test_recall_of_random_and_clustered_vectors(spark, shard_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 24)) * 3
    data = np.concatenate([rng.normal(size=(1500, 24)), centres[rng.integers(0, 5, 1500)] + rng.normal(size=(1500, 24)) * 0.05]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    queries = rows[::50]
    got = found(search(build_index(frame(spark, rows), shard_rows=shard_rows), frame(spark, queries)))
    want = brute(rows, queries, 10)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert np.mean(hits) / 10 >= 0.95
    assert all(dict(want[q]).get(i, d) == d for q in want for i, d in got[q])


def test_pruning_keeps_a_node_only_if_no_kept_one_is_nearer_to_it():
    graph = Graph(np.random.default_rng(5).normal(size=(300, 8)))
    x = graph.x.astype(float)
    for node, near in enumerate(graph.near):
        kept = [int(k) for k in near if k >= 0]
        assert node not in kept and len(set(kept)) == len(kept) and kept
    proposed = np.arange(1, 60)[None, :]
    kept = [k for k in graph.pruned(np.array([0]), proposed)[0].tolist() if k >= 0]
    want: list[int] = []
    for v in sorted(range(1, 60), key=lambda v: ((x[v] - x[0]) ** 2).sum()):
        if len(want) < graph.near.shape[1] and all(1.2 * np.linalg.norm(x[k] - x[v]) > np.linalg.norm(x[v] - x[0]) for k in want):
            want.append(v)
    assert kept == want
