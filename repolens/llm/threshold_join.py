"""Hard negatives by inner-product threshold joins over inverted indexes with suffix-norm bounds.

Each shard holds its distinct vectors as lists by groups of dimensions, those of most weight first. For a threshold
t a vector stays in the lists up to the first group from which its remaining (suffix) norm times the largest remaining
norm of the anchors is below t: dimensions behind it are omitted from the index, as no pair can reach t in them alone.
A join adds up partial scores list by list and drops a pair once its partial score plus the product of both remaining
norms is below the threshold; the pairs that stay are finished from the whole vectors. Each anchor starts at a high
threshold that is lowered until its window is full or nothing lies below it:

* positives: the best `positives` rows of its label,
* negatives of a positive with score p: the best `negatives` rows of other labels with low * p <= 100 * score <= high * p.

Every shard answers for all anchors, which pass through it in batches; the shards' rows are merged by rank, ties
to the smaller id. Scores are inner products of floor(scale * x), exact: in doubles where they cannot round, else
in Python integers (a score beyond a long counts as the nearest long).

Rows with null id, label or vector or a null or non-finite component take no part; vectors of different sizes never
meet. A row that repeats id, label and vector is the same row; rows that share an id but not the rest are several
rows, none of which meets another of its id. Equal vectors of one label are one entry with the smallest ids that a
window can ask for, so copies make no hot group. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .robust_graph import answered, by_shard, distinct_vectors, matrix, sharded

SHARD_ROWS = 20_000
#: Dimensions of one list.
GROUP = 8
#: Anchors that are joined together.
BATCH = 128
#: Share of a window's top by which its first threshold is below it, and how often a threshold is lowered before it takes the whole window.
FIRST_GAP, TURNS = 0.04, 6
LONG = (1 << 63) - 1


def finite(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


class Lists:
    """Dimension lists of one shard over the whole numbers `x` (n x d, as doubles)."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(-(x * x).sum(axis=0), kind="stable")
        self.cuts = list(range(0, x.shape[1], GROUP))
        self.rest = self.rests(x)
        self.norm = float(self.rest[:, 0].max()) if self.cuts else 0.0

    def rests(self, x: np.ndarray) -> np.ndarray:
        """Norms of each row over its dimensions from every group on, a little too large; none are left behind the last group."""
        squares = (x[:, self.order] ** 2)[:, ::-1].cumsum(axis=1)[:, ::-1]
        return np.sqrt(np.concatenate([squares[:, self.cuts], np.zeros((len(x), 1))], axis=1)) * (1 + 1e-9)

    def reaching(self, anchors: np.ndarray, least: np.ndarray, most: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all `allowed` pairs (anchors x rows) whose score is from the anchor's `least` to its `most`."""
        q_rest = self.rests(anchors)
        groups = len(self.cuts)
        indexed = np.full(len(self.x), groups)
        if (least > 0).all():
            # a row is listed up to the group from which no anchor could bring it to its threshold
            with np.errstate(divide="ignore"):
                need = (least[:, None] / q_rest[:, :groups]).min(axis=0)
            indexed = (self.rest[:, :groups] >= need).sum(axis=1)
        rows = np.flatnonzero(indexed) if groups else np.arange(len(self.x))
        rows = rows[np.argsort(-indexed[rows], kind="stable")]
        listed = np.searchsorted(-indexed[rows], -np.arange(1, groups + 1), side="right")
        partial, alive = np.zeros((len(anchors), len(rows))), allowed[:, rows]
        slack = 1e-9 * q_rest[:, :1] * self.norm
        for g, n in enumerate(listed):
            dims = self.order[self.cuts[g] : self.cuts[g] + GROUP]
            partial[:, :n] += anchors[:, dims] @ self.x[np.ix_(rows[:n], dims)].T
            left = q_rest[:, g + 1 : g + 2] * self.rest[rows[:n], g + 1] + slack
            alive[:, :n] &= (partial[:, :n] + left >= least[:, None]) & (partial[:, :n] - left <= most[:, None])
            if np.count_nonzero(alive) < alive.size / 50:
                break
        anchor, at = np.nonzero(alive)
        row = rows[at]
        score = self.scores(anchors, anchor, row)
        kept = (score >= least[anchor]) & (score <= most[anchor])
        return anchor[kept], row[kept], score[kept]

    def scores(self, anchors: np.ndarray, anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Exact scores of pairs: long where none can overflow, else Python integers."""
        bound = float(np.abs(anchors).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * self.x.shape[1]
        whole = (lambda x: x.astype(np.int64)) if bound < 2**62 else (lambda x: np.frompyfunc(int, 1, 1)(x))
        out = [np.zeros(0, np.int64)]
        for a in range(0, len(row), 1 << 16):
            out.append((whole(anchors[anchor[a : a + (1 << 16)]]) * whole(self.x[row[a : a + (1 << 16)]])).sum(axis=1))
        return np.concatenate(out)


def lowered(top: float, bottom: float, turn: int) -> float:
    """The threshold of a turn: the gap below `top` doubles each time, down to `bottom`."""
    return max(bottom, top - FIRST_GAP * 2**turn * abs(top)) if turn < TURNS else bottom


class Shard:
    """Rows of one shard with their labels and ids."""

    def __init__(self, rows: pa.RecordBatch, scale: float):
        self.lists = Lists(np.floor(scale * matrix(rows.column("vector"))))
        self.labels = rows.column("label").to_numpy(zero_copy_only=False)
        self.ids = rows.column("ids").to_pylist()

    def filled(self, anchors: np.ndarray, names: list, same: bool, windows: list[list[tuple[float, float]]], n: int) -> list[list[list[tuple]]]:
        """For every window (bottom, top) of every anchor the `n` best (-score, id) of its label (or of others).

        `names` are (id, label) of the anchors. A window is full when `n` rows reach its threshold of the turn.
        """
        out: list[list] = [[[] for _ in w] for w in windows]
        labels = np.array([label for _, label in names])
        allowed = (labels[:, None] == self.labels[None, :]) == same
        open_windows = {(a, w) for a, of in enumerate(windows) for w, (bottom, top) in enumerate(of) if bottom <= top}
        turn = 0
        while open_windows:
            at = np.array(sorted({a for a, _ in open_windows}))
            limits = {(a, w): lowered(windows[a][w][1], windows[a][w][0], turn) for a, w in open_windows}
            least = np.array([min(limits[a, w] for w in range(len(windows[a])) if (a, w) in limits) for a in at.tolist()])
            most = np.array([max(windows[a][w][1] for w in range(len(windows[a])) if (a, w) in limits) for a in at.tolist()])
            pairs = self.lists.reaching(anchors[at], least, most, allowed[at])
            order = np.lexsort((-pairs[2], pairs[0])) if pairs[2].dtype != object else sorted(range(len(pairs[2])), key=lambda i: (pairs[0][i], -pairs[2][i]))
            anchor, row, score = (x[order] for x in pairs)
            ends = np.searchsorted(anchor, np.arange(len(at) + 1))
            for k, a in enumerate(at.tolist()):
                falling = -score[ends[k] : ends[k + 1]]
                for w in [w for w in range(len(windows[a])) if (a, w) in limits]:
                    bottom, top = windows[a][w]
                    first, last = np.searchsorted(falling, -top, side="left"), np.searchsorted(falling, -limits[a, w], side="right")
                    found: list[tuple] = []
                    for i in range(ends[k] + first, ends[k] + last):
                        if len(found) >= n and score[i] < score[i - 1]:
                            break
                        found += [(-int(score[i]), x) for x in self.ids[row[i]] if x != names[a][0]]
                    if len(found) >= n or limits[a, w] <= bottom:
                        out[a][w] = sorted(found)[:n]
                        open_windows.discard((a, w))
            turn += 1
        return out


def clipped(x: int) -> int:
    return max(-LONG - 1, min(LONG, x))


def arrow(rows: list[tuple], names: str) -> pa.RecordBatch:
    """Rows of longs, the columns named in a schema text."""
    columns = list(zip(*rows)) or [[] for _ in names.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[n.split()[0] for n in names.split(", ")])


POSITIVES = "anchor_id long, which long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, which long, positive_id long, positive_score long, negative_id long, negative_score long"


def mine_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for `anchors`, some of `rows` (id, label, vector).

    A negative's score is from `low` to `high` percent of its positive's.
    """
    read = lambda df: df.select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector")
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    keep = max(positives, negatives) + 1
    vectors, shards = sharded(stored(distinct_vectors(read(rows), keep, "label"), "labelled-vectors"), shard_rows)
    asked = read(anchors).distinct().withColumn("which", F.xxhash64("label", "vector"))

    def join(questions: DataFrame, answer: Callable, schema: str) -> DataFrame:
        columns = ["shard", "size", "kind", "label", "vector", "ids", "windows"]
        dealt = questions.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("size", F.size("vector")).withColumn("kind", F.lit(1))
        dealt = dealt.withColumn("ids", F.array("id", "which"))
        listed = vectors.withColumn("kind", F.lit(0)).withColumn("windows", F.lit(None).cast("array<struct<positive_score:long,positive_id:long>>"))
        both = by_shard(listed.select(columns).unionByName(dealt.select(columns)), shards, "kind", "ids", "label", "vector")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return answered(batches, lambda part: Shard(part, scale), answer, BATCH)

        return both.mapInArrow(run, schema)

    def described(part: pa.RecordBatch) -> tuple[np.ndarray, list, list]:
        ids = part.column("ids").to_pylist()
        return np.floor(scale * matrix(part.column("vector"))), [(i, label) for (i, _), label in zip(ids, part.column("label").to_pylist())], ids

    def best_positives(shard: Shard, part: pa.RecordBatch) -> pa.RecordBatch:
        x, names, ids = described(part)
        bounds = (np.sqrt((x * x).sum(axis=1)) * shard.lists.norm * (1 + 1e-6) + 1).tolist()
        found = shard.filled(x, names, True, [[(-b, b)] for b in bounds], positives)
        return arrow([(*key, i, clipped(-s)) for key, windows in zip(ids, found) for window in windows for s, i in window], POSITIVES)

    def best_negatives(shard: Shard, part: pa.RecordBatch) -> pa.RecordBatch:
        x, names, ids = described(part)
        given = [[(w["positive_score"], w["positive_id"]) for w in of] for of in part.column("windows").to_pylist()]
        found = shard.filled(x, names, False, [[(-(-low * p // 100), high * p // 100) for p, _ in of] for of in given], negatives)
        return arrow([
            (*key, positive, p, i, clipped(-s))
            for key, of, windows in zip(ids, given, found) for (p, positive), window in zip(of, windows) for s, i in window], NEGATIVES)

    first = Window.partitionBy("anchor_id", "which").orderBy(F.col("positive_score").desc(), "positive_id")
    none = F.lit(None).cast("array<struct<positive_score:long,positive_id:long>>")
    chosen = join(asked.withColumn("windows", none), best_positives, POSITIVES)
    chosen = chosen.withColumn("at", F.row_number().over(first)).where(F.col("at") <= positives)
    windows = chosen.groupBy(F.col("anchor_id").alias("id"), "which").agg(
        F.sort_array(F.collect_list(F.struct("positive_score", "positive_id")), asc=False).alias("windows"))
    questions = stored(asked.join(windows, ["id", "which"]), "negative-windows")
    ranked = Window.partitionBy("anchor_id", "which", "positive_id", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    found = join(questions, best_negatives, NEGATIVES).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
