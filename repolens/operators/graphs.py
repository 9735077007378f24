"""Iterative graph loops over many graphs at once: rank, components, layers.

Every frame carries `repo_hash`; each repository is its own graph. A round reads the state once and
is materialised in the checkpoint folder, so a lost executor costs one round and plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.session import cut_lineage

from .ranked import broadcast_small


def out_degree(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Out-degree of every symbol, parallel edges counted."""
    counted = refs.groupBy("repo_hash", F.col("source_symbol_id").alias("symbol_id")).agg(F.count("*").alias("n"))
    return symbols.select("repo_hash", "symbol_id").join(counted, ["repo_hash", "symbol_id"], "left").select(
        "repo_hash", "symbol_id", F.coalesce("n", F.lit(0)).cast("double").alias("value")
    )


def pagerank(
    symbols: DataFrame, refs: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, max_rounds: int = 100,
    rounds_per_cut: int = 4,
) -> DataFrame:
    """PageRank of each repository: `(repo_hash, symbol_id, value)`.

    Parallel edges collapse, dangling mass is spread evenly, and a repository freezes at the round
    where its L1 change falls under `nodes * tolerance`. Messages are summed map-side; the
    per-repository totals of a round are one small row per repository. A repository that has not frozen after
    `max_rounds` gets its out-degrees instead.
    """
    nodes = symbols.select("repo_hash", "symbol_id").distinct()
    links = refs.select(
        "repo_hash", F.col("source_symbol_id").alias("symbol_id"), F.col("target_symbol_id").alias("target")
    ).distinct()
    fan_out = links.groupBy("repo_hash", "symbol_id").agg(F.count("*").alias("links"))
    sizes = nodes.groupBy("repo_hash").agg(F.count("*").alias("n"))
    state = cut_lineage(
        nodes.join(fan_out, ["repo_hash", "symbol_id"], "left").join(sizes, "repo_hash").select(
            "repo_hash", "symbol_id", "n", F.coalesce("links", F.lit(0)).alias("links"),
            (F.lit(1.0) / F.col("n")).alias("value"), F.lit(None).cast("double").alias("before"),
        )
    )
    links = cut_lineage(links)
    done = 0
    while done < max_rounds:
        for _ in range(min(rounds_per_cut, max_rounds - done)):
            state = _pagerank_round(state, links, alpha, tolerance)
            done += 1
        state = cut_lineage(state)
        moving = (
            state.groupBy("repo_hash")
            .agg(F.sum(F.abs(F.col("value") - F.col("before"))).alias("err"), F.first("n").alias("n"))
            .where(F.col("err") >= F.col("n") * tolerance)
        )
        if moving.isEmpty():
            return state.select("repo_hash", "symbol_id", "value")
    # what still moves after the last round falls back to the out-degree
    late = cut_lineage(moving.select("repo_hash"))
    return state.select("repo_hash", "symbol_id", "value").join(late, "repo_hash", "left_anti").unionByName(
        out_degree(symbols.join(late, "repo_hash", "left_semi"), refs))


def _pagerank_round(state: DataFrame, links: DataFrame, alpha: float, tolerance: float) -> DataFrame:
    totals = state.groupBy("repo_hash").agg(
        F.sum(F.when(F.col("links") == 0, F.col("value")).otherwise(0.0)).alias("dangling"),
        F.coalesce(
            F.sum(F.abs(F.col("value") - F.col("before"))) < F.first("n") * tolerance, F.lit(False)
        ).alias("frozen"),
    )
    inbound = (
        links.join(state.where("links > 0").select("repo_hash", "symbol_id", (F.col("value") / F.col("links")).alias("m")),
                   ["repo_hash", "symbol_id"])
        .groupBy("repo_hash", F.col("target").alias("symbol_id"))
        .agg(F.sum("m").alias("inbound"))
    )
    fresh = alpha * (F.coalesce("inbound", F.lit(0.0)) + F.col("dangling") / F.col("n")) + (1 - alpha) / F.col("n")
    return (
        state.join(inbound, ["repo_hash", "symbol_id"], "left")
        .join(totals, "repo_hash")
        .select(
            "repo_hash", "symbol_id", "n", "links",
            F.when(F.col("frozen"), F.col("value")).otherwise(fresh).alias("value"),
            F.when(F.col("frozen"), F.col("before")).otherwise(F.col("value")).alias("before"),
        )
    )


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Smallest node of each component: `(repo_hash, node, component)`.

    Parents are hooked to the smallest parent seen over an edge and then halved by a jump, so a long
    chain closes in about log(length) rounds instead of one round per link.
    """
    # both directions out of one row, so that the edges are computed once
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(edges.where("a <> b").select("repo_hash", F.explode(ways).alias("way")).select("repo_hash", "way.a", "way.b").distinct())
    state = cut_lineage(nodes.select("repo_hash", "node", F.col("node").alias("parent")).distinct())
    for _ in range(max_rounds):
        parent_of = state.select("repo_hash", F.col("node").alias("b"), F.col("parent").alias("pb"))
        seen = both.join(parent_of, ["repo_hash", "b"]).join(
            state.select("repo_hash", F.col("node").alias("a"), F.col("parent").alias("pa")), ["repo_hash", "a"]
        ).where("pb < pa")
        offers = seen.select(
            "repo_hash", F.explode(F.array("a", "pa")).alias("node"), F.col("pb").alias("offer")
        ).groupBy("repo_hash", "node").agg(F.min("offer").alias("offer"))
        hooked = state.join(offers, ["repo_hash", "node"], "left").select(
            "repo_hash", "node", F.least("parent", F.coalesce("offer", "parent")).alias("parent"),
            F.col("parent").alias("was"),
        )
        up = hooked.select("repo_hash", F.col("node").alias("parent"), F.col("parent").alias("top"))
        state = cut_lineage(
            hooked.join(up, ["repo_hash", "parent"], "left").select(
                "repo_hash", "node", F.coalesce("top", "parent").alias("parent"), "was"
            )
        )
        changed = not state.where("parent <> was").isEmpty()
        state = state.select("repo_hash", "node", "parent")
        if not changed:
            return state.withColumnRenamed("parent", "component")
    raise RuntimeError(f"components did not close in {max_rounds} rounds")


def longest_path_layers(nodes: DataFrame, edges: DataFrame, cycles: str = "shared", max_rounds: int = 10_000) -> DataFrame:
    """Layer of each node: length of the longest path that ends at it, by peeling sources.

    Nodes of a cycle keep the layer a peeled predecessor gave them. The rest gets the deepest layer
    plus one, once for all (`cycles="shared"`) or one more per node in id order (`cycles="stepped"`).
    """
    links = cut_lineage(
        edges.select("repo_hash", "src", "dst").where("src <> dst")
        .join(nodes.select("repo_hash", F.col("node").alias("src")), ["repo_hash", "src"], "left_semi")
        .join(nodes.select("repo_hash", F.col("node").alias("dst")), ["repo_hash", "dst"], "left_semi")
        .distinct()
    )
    # `layer` holds the layer a node has so far, `waiting` its links from sources that are not peeled yet.
    entering = links.groupBy("repo_hash", F.col("dst").alias("node")).agg(F.count("*").alias("waiting"))
    # A node without id or repository is never peeled.
    free = F.col("waiting").isNull() & F.col("repo_hash").isNotNull() & F.col("node").isNotNull()
    state = cut_lineage(
        nodes.select("repo_hash", "node").distinct().join(entering, ["repo_hash", "node"], "left").select(
            "repo_hash", "node", F.when(free, 0).alias("layer"), F.coalesce("waiting", F.lit(0)).alias("waiting"), free.alias("new")
        )
    )
    kept, gone = links.count(), 0
    for _ in range(1, max_rounds):
        # Only the links of nodes peeled in the round before are followed, each link once in all.
        frontier = state.where("new").select("repo_hash", F.col("node").alias("src"), F.col("layer").alias("src_layer"))
        followed = links.join(broadcast_small(frontier), ["repo_hash", "src"]).groupBy("repo_hash", F.col("dst").alias("node")).agg(
            (F.max("src_layer") + 1).alias("offer"), F.count("*").alias("seen"))
        state = cut_lineage(
            state.join(followed, ["repo_hash", "node"], "left").select(
                "repo_hash", "node", F.greatest("layer", "offer").alias("layer"), (F.col("waiting") - F.coalesce("seen", F.lit(0))).alias("waiting"),
                (F.col("seen").isNotNull() & (F.col("waiting") == F.col("seen"))).alias("new"), F.coalesce("seen", F.lit(0)).alias("seen")
            )
        )
        found = state.agg(F.sum("seen"), F.count_if("new")).first()
        state = state.drop("seen")
        if not found[1]:
            break
        gone += found[0]
        if 2 * gone > kept:  # half of the links are followed: leave them out from here on
            peeled = state.where("waiting = 0 AND NOT new").select("repo_hash", F.col("node").alias("src"))
            links = cut_lineage(links.join(peeled, ["repo_hash", "src"], "left_anti"))
            kept, gone = links.count(), 0
    else:
        raise RuntimeError(f"layers did not close in {max_rounds} rounds")
    deepest = state.groupBy("repo_hash").agg(F.coalesce(F.max("layer"), F.lit(0)).alias("deepest"))
    rest = state.where("layer IS NULL").select("repo_hash", "node")
    if cycles == "stepped":
        rest = number_rows(rest, "node").join(deepest, "repo_hash").select(
            "repo_hash", "node", (F.col("deepest") + F.col("position")).cast("int").alias("layer"))
    else:
        rest = rest.join(deepest, "repo_hash").select("repo_hash", "node", (F.col("deepest") + 1).alias("layer"))
    return state.where("layer IS NOT NULL").select("repo_hash", "node", "layer").unionByName(rest)


def number_rows(df: DataFrame, *order: str) -> DataFrame:
    """Position from 1 of each row inside its repository, without one task per repository.

    Rows are range-partitioned and frozen, numbered inside each partition, and shifted by the counts of
    the partitions before it (a few rows per repository).
    """
    from pyspark.sql import Window

    spread = cut_lineage(
        df.repartitionByRange("repo_hash", *order).withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy("repo_hash", "_part").orderBy(*order)
    before = Window.partitionBy("repo_hash").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("repo_hash", "_part").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))
    )
    return (
        spread.withColumn("_at", F.row_number().over(inside))
        .join(offsets.drop("_n"), ["repo_hash", "_part"])
        .withColumn("position", F.col("_at") + F.col("_before"))
        .drop("_part", "_at", "_before")
    )
