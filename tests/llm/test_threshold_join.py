import math

import numpy as np
import pytest

from repolens.llm.threshold_join import Lists, mine_negatives

SCHEMA = "id long, label int, vector array<double>, shard int, windows string, which long"


def brute(rows, is_anchor, positives=5, negatives=3):
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i, label, tuple(v)] = [math.floor(256 * x) for x in v]
    out = []
    for (a, label, _), x in good.items():
        if not is_anchor(a):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i, other) for (i, other, _), y in good.items() if i != a and len(y) == len(x)]
        near = sorted((s, i) for s, i, other in scored if other == label)[:positives]
        for p, positive in near:
            fit = sorted((s, i) for s, i, other in scored if other != label and 50 * -p <= 100 * -s <= 95 * -p)[:negatives]
            out += [(a, positive, k + 1, i, -p, -s) for k, (s, i) in enumerate(fit)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", 3) for r in rows], SCHEMA)


def mined(spark, rows, is_anchor, **more):
    df = frame(spark, rows)
    anchors = frame(spark, [r for r in rows if r[0] is not None and is_anchor(r[0])] or rows[:0])
    return sorted(tuple(r) for r in mine_negatives(df, anchors, **more).collect())


@pytest.mark.parametrize("shard_rows", [10_000, 60])
def test_equals_brute_force(spark, shard_rows):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 20)) / 4
    base[200:] = base[7] + rng.normal(size=(200, 20)) / 40  # a dense part
    rows = [(i, int(rng.integers(0, 3)), v.tolist()) for i, v in enumerate(base)]
    assert mined(spark, rows, lambda i: i % 20 == 0, shard_rows=shard_rows) == brute(rows, lambda i: i % 20 == 0)


def test_odd_rows_ties_and_copies(spark):
    rows = [(i, i % 3, [float(i % 5), 1.0, -float(i % 2)]) for i in range(60)]
    rows += [(100 + i, 1, [2.0, 2.0, 2.0]) for i in range(40)] + [(200 + i, 2, [1.5, 1.5, 1.5]) for i in range(40)]
    rows += [(300, None, [1.0, 1.0, 1.0]), (301, 1, None), (302, 1, [1.0, None, 1.0]), (303, 1, [float("nan")] * 3), (304, 1, [float("-inf"), 0.0, 0.0]), (None, 1, [1.0] * 3)]
    rows += [(305, 1, [0.0, 0.0, 0.0]), (306, 1, []), (307, 2, []), (308, 1, [1.0, 2.0]), (310, 2, [1.0, 1.75]), (309, 1, [1.0, 2.0]), (100, 1, [2.0, 2.0, 2.0])]
    assert mined(spark, rows, lambda i: i % 10 == 0, shard_rows=25) == brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows, lambda i: i == -1) == []


def test_scores_beyond_doubles_are_exact(spark):
    big = 2.0**21 + 1  # scores of some 2 ** 58
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 2.0]), (2, 1, [big, 3.0]), (3, 2, [big * 0.75, 0.0]), (4, 2, [big * 0.75, -1.0])]
    assert mined(spark, rows, lambda i: i == 0) == brute(rows, lambda i: i == 0)
    rows = [(0, 1, [1e200, 1.0]), (1, 1, [1e200, 0.0]), (2, 2, [0.9e200, 0.0])]
    assert mined(spark, rows, lambda i: i == 0) == []  # all count as the largest long, so none is below 95 percent of another


def test_empty_table(spark):
    none = frame(spark, []).limit(0)
    assert mine_negatives(none, none).count() == 0


def test_lists_omit_what_suffix_norms_cover_and_lose_no_pair():
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(500, 32)) * np.linspace(60, 2, 32))
    x[::3] /= 8
    x = np.floor(x)
    q = x[:6]
    lists = Lists(x)
    every = q @ x.T
    for share in (0.9, 0.5, 0.1, -1.0):
        least = every.max(axis=1) * share
        a, row, score = lists.reaching(q, least, np.full(6, np.inf), np.ones(every.shape, bool))
        assert {(int(i), int(j)) for i, j in zip(a, row)} == set(zip(*(k.tolist() for k in np.nonzero(every >= least[:, None]))))
        assert (score == every[a, row]).all()
    need = (every.max(axis=1)[:, None] * 0.9 / lists.rests(q)[:, :4]).min(axis=0)
    assert ((lists.rest[:, :4] >= need).sum(axis=1) < 4).any()
