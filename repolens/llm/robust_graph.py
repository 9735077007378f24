"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors.

`build_index` deals the distinct vectors to shards by their hash and builds a graph in each: nodes are inserted in
batches, a greedy search from the entry nodes proposes neighbours, and relaxed distance pruning keeps a proposal only
if no kept neighbour is nearer to it by the factor `ALPHA`; edges are added in both directions and pruned again where
a node has too many. `search` runs a beam search for every query in every shard, measures the nodes of its beam in
double precision and merges the shards by rank.

Equal vectors are one node, so a vector with very many copies is neither a hub nor a hot task. A node keeps the
smallest ids of its copies, as many as a search may return and one more: further copies can be in no result, as
ties go to the smaller id.

Rows with null id or vector, with a null or non-finite component, of length zero or without components take no part;
vectors of different sizes are in different shards and never meet. Rows that repeat an id are the same row if their
vectors are equal, else two candidates; no candidate shares the id of the query. Queries are rows too: each repeated
query row has its own result. Extra columns are ignored, whatever their names. Fewer candidates than asked for: all that
the graphs reach. An empty table gives an empty index and no results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Distinct vectors of a shard, on average: bounds the memory of a task.
SHARD_ROWS = 8_000
DEGREE = 32
ALPHA = 1.2
BUILD_BEAM = 48
SEARCH_BEAM = 120
ENTRIES = 24
BATCH = 256
#: Nodes opened at once for each query of a batch.
OPENED = 4
INDEX = "shard int, size int, node int, vector array<double>, ids array<long>, neighbours array<int>, entry boolean"
FOUND = "query_id long, which long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """A vector that takes part: finite components, at least one of them not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, keep: int, *by: str) -> DataFrame:
    """(by, vector, ids): one row for each distinct vector (and `by`) of `rows` (id, vector, by) with its `keep` smallest ids.

    Repeated rows are merged before the ids are ranked; the rank limit runs ahead of the shuffle, so copies do not
    meet in one task.
    """
    single = rows.groupBy(*by, "vector", "id").agg(F.lit(1).alias("one"))
    ranked = single.withColumn("at", F.row_number().over(Window.partitionBy(*by, "vector").orderBy("id"))).where(F.col("at") <= keep)
    return ranked.groupBy(*by, "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def sharded(vectors: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """`vectors` with the columns `size` and `shard` (0 to the number returned), dealt by the hash of the vector."""
    shards = -(-vectors.count() // shard_rows) or 1
    return vectors.withColumn("size", F.size("vector")).withColumn(
        "shard", F.pmod(F.xxhash64("size", "vector"), F.lit(shards)).cast("int")), shards


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column whose lists have one size."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batches cut where the values of `keys` (no nulls) change, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            yield tuple(v[a] for v in values), batch.slice(a, b - a)


def answered(batches: Iterator[pa.RecordBatch], prepare: Callable, answer: Callable, step: int) -> Iterator[pa.RecordBatch]:
    """For each shard, its rows (`kind` 0, first) prepared once and every `step` questions (`kind` 1) answered from them."""
    for _, group in groupby(runs(batches, "shard", "size", "kind"), lambda x: x[0][:2]):
        rows: list[pa.RecordBatch] = []
        state = None
        for (_, _, kind), part in group:
            if kind == 0:
                rows.append(part)
                continue
            if not rows:  # no vector of this size in the shard
                continue
            if state is None:
                state = prepare(pa.Table.from_batches(rows).combine_chunks().to_batches()[0])
            for a in range(0, part.num_rows, step):
                yield answer(state, part.slice(a, step))


def by_shard(rows: DataFrame, shards: int, *order: str) -> DataFrame:
    """One partition for each shard, its rows in order."""
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "size", *order)


class Graph:
    """The graph of one shard; `near` holds up to `DEGREE` neighbours of each node, -1 where there are fewer."""

    def __init__(self, vectors: np.ndarray, near: np.ndarray | None = None, entries: np.ndarray | None = None):
        #: Scaled so that single precision never overflows; results are measured on the original vectors.
        self.scale = float(np.abs(vectors).max()) or 1.0
        self.x = (vectors / self.scale).astype(np.float32)
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        if near is None:
            self.near = np.full((len(vectors), DEGREE), -1, np.int32)
            self.degree = np.zeros(len(vectors), np.int64)
            self.entries = self.spread()
            self.build()
        else:
            self.near, self.entries = near, entries

    def spread(self) -> np.ndarray:
        """Entry nodes: the one nearest to the mean, then each time the node of a sample that is farthest from those chosen.

        All nodes of a shard that a beam can hold are entries, so that none of its nodes can be out of reach.
        """
        if len(self.x) <= BUILD_BEAM:
            return np.arange(len(self.x))
        sample = np.random.default_rng(7).permutation(len(self.x))[: 40 * ENTRIES]
        mean = self.x.mean(axis=0)
        chosen = [int(np.argmin(self.square - 2 * self.x @ mean))]
        far = np.full(len(sample), np.inf, np.float32)
        while len(chosen) < min(ENTRIES, len(sample)):
            far = np.minimum(far, ((self.x[sample] - self.x[chosen[-1]]) ** 2).sum(axis=1))
            at = int(np.argmax(far))
            if not far[at] > 0:
                break
            chosen.append(int(sample[at]))
        return np.array(chosen, np.int64)

    def distances(self, q: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of pairs, less the square of the query."""
        return self.square[nodes] - 2 * np.einsum("ij,ij->i", q[rows], self.x[nodes])

    def beam(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Beam search of all queries in step: nodes and distances of the beam by distance, and of the nodes opened on the way."""
        b, n = len(q), len(self.x)
        seen = np.zeros((b, n), bool)
        stamp = np.zeros((b, n), np.int16)
        first = np.broadcast_to(self.entries, (b, len(self.entries)))
        seen[:, self.entries] = True
        ids, dist = np.full((b, width), -1, np.int64), np.full((b, width), np.inf, np.float32)
        done = np.zeros((b, width), bool)
        ids, dist, done = self.merged(
            ids, dist, done, first, self.square[self.entries][None, :] - 2 * q @ self.x[self.entries].T, width)
        opened_ids, opened_dist = [], []
        active = np.arange(b)
        while len(active):
            waiting = np.where(done[active], np.inf, dist[active])
            at = np.argsort(waiting, axis=1)[:, :OPENED]
            cost = np.take_along_axis(waiting, at, axis=1)
            some = np.isfinite(cost[:, 0])
            active, at, cost = active[some], at[some], cost[some]
            if not len(active):
                break
            real = np.isfinite(cost)
            nodes = np.where(real, ids[active[:, None], at], -1)
            done[active[:, None], at] |= real
            for out, value, none in ((opened_ids, nodes, -1), (opened_dist, cost, np.inf)):
                full = np.full((b, value.shape[1]), none, value.dtype)
                full[active] = value
                out.append(full)
            reached = self.near[nodes].astype(np.int64)
            reached[nodes < 0] = -1
            reached = reached.reshape(len(active), -1)
            r, c = np.nonzero(reached >= 0)
            node = reached[r, c]
            fresh = ~seen[active[r], node]
            r, c, node = r[fresh], c[fresh], node[fresh]
            stamp[active[r], node] = c  # a node reached twice counts at the place written last
            once = stamp[active[r], node] == c
            r, node = r[once], node[once]
            seen[active[r], node] = True
            counts = np.bincount(r, minlength=len(active))
            k = int(counts.max()) if len(counts) else 0
            if not k:
                continue
            place = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
            more_ids, more = np.full((len(active), k), -1, np.int64), np.full((len(active), k), np.inf, np.float32)
            more_ids[r, place], more[r, place] = node, self.distances(q, active[r], node)
            ids[active], dist[active], done[active] = self.merged(ids[active], dist[active], done[active], more_ids, more, width)
        if not opened_ids:
            return ids, dist, np.zeros((b, 0), np.int64), np.zeros((b, 0), np.float32)
        return ids, dist, np.concatenate(opened_ids, axis=1), np.concatenate(opened_dist, axis=1)

    @staticmethod
    def merged(ids, dist, done, more_ids, more, width):
        every, far = np.concatenate([ids, more_ids], axis=1), np.concatenate([dist, more], axis=1)
        flags = np.concatenate([done, np.zeros(more.shape, bool)], axis=1)
        order = np.argsort(far, axis=1, kind="stable")[:, :width]
        return tuple(np.take_along_axis(x, order, axis=1) for x in (every, far, flags))

    def pruned(self, nodes: np.ndarray, proposed: np.ndarray) -> np.ndarray:
        """Neighbours kept of the proposals (rows of ids, -1: none) of each node."""
        known = np.sort(np.where(proposed == nodes[:, None], -1, proposed), axis=1)
        known[:, 1:][known[:, 1:] == known[:, :-1]] = -1
        there = known >= 0
        x = self.x[known]
        away = ((x - self.x[nodes][:, None, :]) ** 2).sum(axis=2)
        away = np.where(there, away, np.inf)
        order = np.argsort(away, axis=1, kind="stable")
        known, away = np.take_along_axis(known, order, axis=1), np.take_along_axis(away, order, axis=1)
        x = np.take_along_axis(x, order[:, :, None], axis=1)
        square = np.einsum("ijk,ijk->ij", x, x)
        between = square[:, :, None] + square[:, None, :] - 2 * x @ x.transpose(0, 2, 1)
        alive, kept = np.isfinite(away), np.full((len(nodes), DEGREE), -1, np.int32)
        every = np.arange(len(nodes))
        for k in range(DEGREE):
            pick = alive.argmax(axis=1)
            some = alive[every, pick]
            if not some.any():
                break
            kept[some, k] = known[every, pick][some]
            alive &= ALPHA * ALPHA * between[every, pick] > away
            alive[every, pick] = False
        return kept

    def build(self) -> None:
        n = len(self.x)
        rest = np.random.default_rng(13).permutation(np.setdiff1d(np.arange(n), self.entries))
        self.near[self.entries] = self.pruned(self.entries, np.broadcast_to(self.entries, (len(self.entries),) * 2))
        at, step = 0, 16
        while at < len(rest):
            nodes = rest[at : at + step]
            ids, _, opened, _ = self.beam(self.x[nodes], BUILD_BEAM)
            self.near[nodes] = self.pruned(nodes, np.concatenate([ids, opened], axis=1))
            self.add_back(nodes)
            at, step = at + len(nodes), min(2 * step, BATCH)

    def add_back(self, nodes: np.ndarray) -> None:
        """The edges of `nodes` in the other direction; a node with too many prunes them, at most `DEGREE` new ones at a time."""
        source, place = np.nonzero(self.near[nodes] >= 0)
        target = self.near[nodes][source, place].astype(np.int64)
        source = nodes[source]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        starts = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, np.int64)
        turn = (np.arange(len(target)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(target)]])))) // DEGREE
        for k in range(int(turn.max()) + 1 if len(turn) else 0):
            s, t = source[turn == k], target[turn == k]
            into, inverse, counts = np.unique(t, return_inverse=True, return_counts=True)
            new = np.full((len(into), DEGREE), -1, np.int64)
            new[inverse, np.arange(len(t)) - (np.cumsum(counts) - counts)[inverse]] = s
            both = np.concatenate([self.near[into], new], axis=1)
            full = (both >= 0).sum(axis=1) > DEGREE
            # those with room: the known neighbours first
            room = both[~full]
            self.near[into[~full]] = np.take_along_axis(room, np.argsort(room < 0, axis=1, kind="stable"), axis=1)[:, :DEGREE]
            for a in range(0, int(full.sum()), BATCH):
                part = into[full][a : a + BATCH]
                self.near[part] = self.pruned(part, both[full][a : a + BATCH])

    def nearest(self, queries: np.ndarray, width: int = SEARCH_BEAM) -> np.ndarray:
        """Node numbers of the beam of each query (-1: none), nearest first."""
        scaled = np.clip(queries / self.scale, -1e15, 1e15).astype(np.float32)
        return np.concatenate([self.beam(scaled[a : a + BATCH], min(width, len(self.x)))[0] for a in range(0, len(scaled), BATCH)])


def measured(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances of each query (b x d) to its vectors (b x w x d), squares added from the first component on."""
    away = np.ascontiguousarray(np.moveaxis(vectors - queries[:, None, :], 2, 0))
    return np.sqrt(np.add.reduce(away * away, axis=0))


def build_index(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", most: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs of all shards as a stored table (`INDEX`): one row for each distinct vector, for searches of up to `most` results."""
    read = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    read = read.where(F.col("id").isNotNull() & usable(F.col("vector")))
    vectors, shards = sharded(stored(distinct_vectors(read, most + 1), "distinct-vectors"), shard_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, size), parts in groupby(runs(batches, "shard", "size"), lambda x: x[0]):
            group = pa.Table.from_batches([p for _, p in parts]).combine_chunks().to_batches()[0]
            graph = Graph(matrix(group.column("vector")))
            n = group.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(shard, pa.int32()), n), pa.repeat(pa.scalar(size, pa.int32()), n), pa.array(np.arange(n, dtype=np.int32)),
                 group.column("vector"), group.column("ids"), pa.array(list(graph.near), pa.list_(pa.int32())),
                 pa.array(np.isin(np.arange(n), graph.entries))],
                names=["shard", "size", "node", "vector", "ids", "neighbours", "entry"])

    return stored(by_shard(vectors, shards, "ids", "vector").mapInArrow(run, INDEX), "graph-index")


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", width: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest rows found for each row of `queries`, never one with its id.

    A query goes to every shard; a task holds the graph of its shard and a batch of queries at a time.
    """
    last = index.agg(F.max("shard")).first()[0]
    shards = 1 if last is None else last + 1
    asked = queries.select(F.col(id_column).cast("long").alias("query_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    asked = asked.where(F.col("query_id").isNotNull() & usable(F.col("vector"))).distinct()
    asked = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("vector").alias("size"), F.lit(1).alias("kind"),
        F.lit(0).alias("node"), "vector", F.array("query_id", F.xxhash64("vector")).alias("ids"),
        F.lit(None).cast("array<int>").alias("neighbours"), F.lit(False).alias("entry"))
    rows = index.withColumn("kind", F.lit(0)).select(asked.columns).unionByName(asked)

    def prepare(rows: pa.RecordBatch) -> tuple:
        vectors = matrix(rows.column("vector"))
        entries = np.flatnonzero(rows.column("entry").to_numpy(zero_copy_only=False))
        return Graph(vectors, matrix(rows.column("neighbours")), entries), vectors, rows.column("ids").to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return answered(batches, prepare, lambda state, asked: nearest_rows(*state, asked, k, width), BATCH)

    found = by_shard(rows, shards, "kind", "node").mapInArrow(run, FOUND)
    best = Window.partitionBy("query_id", "which").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_rows(graph: Graph, vectors: np.ndarray, ids: list[list[int]], queries: pa.RecordBatch, k: int, width: int) -> pa.RecordBatch:
    """The `k` nearest ids of one shard for each query, by the exact distance and the id."""
    asked, names = matrix(queries.column("vector")), queries.column("ids").to_pylist()
    beam = graph.nearest(asked, width)
    distance = np.where(beam >= 0, measured(asked, vectors[beam]), np.inf)
    order = np.argsort(distance, axis=1, kind="stable")
    beam, distance = np.take_along_axis(beam, order, axis=1).tolist(), np.take_along_axis(distance, order, axis=1).tolist()
    out = []
    for (query_id, which), nodes, far in zip(names, beam, distance):
        rows: list[tuple[float, int]] = []
        for node, d in zip(nodes, far):
            if node < 0 or (len(rows) >= k and d > rows[-1][0]):
                break
            rows += [(d, i) for i in ids[node] if i != query_id]
        out += [(query_id, which, i, d) for d, i in sorted(rows)[:k]]
    columns = list(zip(*out)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64())],
        names=["query_id", "which", "vec_id", "score"])
