"""Lookups and the four direct queries over the index, each for a whole table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import vectors

from . import ranking, search
from .ranked import fan_out, first_by, spread_join, top_rows

TOP_EXEMPLARS = 5

c = F.col


def shared_asks(requests: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct requests by `keys`, with the key as text for `query_id`, and `(query_id, ask)` of every request."""
    asked = requests.withColumn("ask", F.to_json(F.struct(*keys)))
    return asked.select(c("ask").alias("query_id"), *keys).distinct(), asked.select("query_id", "ask")


# Symbols ---------------------------------------------------------------------------------------


def symbols_by_name(requests: DataFrame, symbols: DataFrame, name: str = "symbol") -> DataFrame:
    """Request -> the symbol of that exact name (smallest id when a name repeats)."""
    unique = first_by(symbols, ["repo_hash", "qualified_name"], [c("symbol_id")])
    return requests.join(unique.withColumnRenamed("qualified_name", name), ["repo_hash", name])


def symbols_by_id(ids: DataFrame, symbols: DataFrame) -> DataFrame:
    return symbols.join(ids.select("repo_hash", "symbol_id").distinct(), ["repo_hash", "symbol_id"], "left_semi")


def symbols_of_files(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols of each requested file; the caller orders them by line where it shows them."""
    wanted = requests.select("repo_hash", c("path").alias("file_path")).distinct()
    return symbols.join(wanted, ["repo_hash", "file_path"], "left_semi")


def embeddings_of(ids: DataFrame, embeddings: DataFrame) -> DataFrame:
    return embeddings.join(ids.select("repo_hash", "symbol_id").distinct(), ["repo_hash", "symbol_id"], "left_semi")


# Clusters --------------------------------------------------------------------------------------


def clusters_of_files(requests: DataFrame, files: DataFrame, clusters: DataFrame) -> DataFrame:
    """File -> cluster row; files without a stored cluster give no row."""
    wanted = requests.select("repo_hash", c("path").alias("file_path")).distinct()
    return files.join(wanted, ["repo_hash", "file_path"], "left_semi").join(clusters, ["repo_hash", "cluster_id"])


def clusters_by_id(requests: DataFrame, clusters: DataFrame) -> DataFrame:
    return clusters.join(requests.select("repo_hash", "cluster_id").distinct(), ["repo_hash", "cluster_id"], "left_semi")


def member_files(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the requested clusters."""
    wanted = requests.select("repo_hash", "cluster_id").distinct()
    return files.join(wanted, ["repo_hash", "cluster_id"], "left_semi").select("repo_hash", "cluster_id", "file_path")


def member_symbols(requests: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    wanted = requests.select("repo_hash", "cluster_id").distinct()
    inside = files.join(wanted, ["repo_hash", "cluster_id"], "left_semi").select("repo_hash", "cluster_id", "file_path")
    return symbols.join(inside, ["repo_hash", "file_path"])


CODE_SHAPE = "struct<patterns:array<string>,source:string>"


def regions(clusters: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Region of each cluster: conventions (naming, code shape) and its allowed and forbidden targets.

    `code_shape` is null for clusters that were stored without patterns.
    """
    shaped = {"patterns", "source"} <= set(clusters.columns)
    shape = F.struct("patterns", "source") if shaped else F.lit(None)
    targets = dependencies.where("target_cluster_id IS NOT NULL").groupBy("repo_hash", c("source_cluster_id").alias("cluster_id")).agg(
        F.sort_array(F.collect_list(F.when(c("kind") == "allowed", c("target_cluster_id")))).alias("allowed"),
        F.sort_array(F.collect_list(F.when(c("kind") == "forbidden", c("target_cluster_id")))).alias("forbidden"),
    )
    empty = F.array().cast("array<string>")
    return clusters.join(targets, ["repo_hash", "cluster_id"], "left").select(
        "repo_hash", "cluster_id", F.coalesce("role_description", F.lit("")).alias("role"), c("naming_convention").alias("naming"),
        shape.cast(CODE_SHAPE).alias("code_shape"),
        F.coalesce("allowed", empty).alias("allowed"), F.coalesce("forbidden", empty).alias("forbidden"),
    )


def describe_architecture(requests: DataFrame, files: DataFrame, clusters: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Region per request, by cluster id or else by exact path; an unknown target gives an empty region.

    Member files stay rows of `member_files`, so a large cluster is never packed into one row.
    """
    at_path = files.select("repo_hash", c("file_path").alias("path"), c("cluster_id").alias("_by_path"))
    resolved = requests.select("query_id", "repo_hash", "cluster_id", "path").join(at_path, ["repo_hash", "path"], "left")
    resolved = resolved.select("query_id", "repo_hash", F.coalesce("cluster_id", "_by_path").alias("cluster_id"))
    found = resolved.join(regions(clusters, dependencies), ["repo_hash", "cluster_id"], "left")
    sizes = files.where("cluster_id IS NOT NULL").groupBy("repo_hash", "cluster_id").agg(F.count("*").alias("n_members"))
    empty = F.array().cast("array<string>")
    return found.join(sizes, ["repo_hash", "cluster_id"], "left").select(
        "query_id", "repo_hash",
        F.when(c("role").isNotNull(), c("cluster_id")).alias("cluster_id"),
        F.coalesce("role", F.lit("")).alias("role"), "naming", "code_shape",
        F.coalesce("allowed", empty).alias("allowed"), F.coalesce("forbidden", empty).alias("forbidden"),
        F.when(c("role").isNotNull(), F.coalesce("n_members", F.lit(0))).otherwise(0).cast("bigint").alias("n_members"),
    )


# Flows -----------------------------------------------------------------------------------------


def flow_nodes(flows: DataFrame) -> DataFrame:
    """Symbols of each flow in path order: `(repo_hash, flow_id, pos, symbol_id)`."""
    nodes = F.concat(F.array("source_symbol_id"), F.coalesce("path", F.array().cast("array<string>")), F.array("sink_symbol_id"))
    return flows.select("repo_hash", "flow_id", F.posexplode(nodes).alias("pos", "symbol_id")).where("symbol_id IS NOT NULL")


def flows_touching(ids: DataFrame, flows: DataFrame) -> DataFrame:
    """`(query_id, repo_hash, flow_id)` of flows whose source, sink or path holds one of the query's symbols."""
    return (
        ids.select("query_id", "repo_hash", "symbol_id")
        .join(flow_nodes(flows).select("repo_hash", "flow_id", "symbol_id"), ["repo_hash", "symbol_id"])
        .select("query_id", "repo_hash", "flow_id")
        .distinct()
    )


def flow_payloads(flows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Flow rows with names for ids; an unknown id becomes ''."""
    names = symbols.select("repo_hash", "symbol_id", "qualified_name")
    shown = (
        flow_nodes(flows)
        .join(names, ["repo_hash", "symbol_id"], "left")
        .groupBy("repo_hash", "flow_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("qualified_name", F.lit("")).alias("name")))), lambda x: x["name"]).alias("names"))
    )
    return flows.select("repo_hash", "flow_id", "flow_kind", "sensitivity").join(shown, ["repo_hash", "flow_id"]).select(
        "repo_hash", "flow_id",
        c("names")[0].alias("source_symbol"),
        F.element_at("names", -1).alias("sink_symbol"),
        F.slice("names", 2, F.size("names") - 2).alias("path"),
        "flow_kind", "sensitivity",
    )


def trace_flows(requests: DataFrame, symbols: DataFrame, flows: DataFrame) -> DataFrame:
    """Flows from (forward) or to (backward) the requested symbol with at most `depth` edges."""
    seeds = symbols_by_name(requests.select("query_id", "repo_hash", "symbol", "direction", "depth"), symbols).select(
        "query_id", "repo_hash", "symbol_id", "direction", "depth"
    )
    ends = flows.select(
        "repo_hash", "flow_id", F.size("path").alias("inner"),
        F.explode(
            F.array(
                F.struct(F.lit("forward").alias("direction"), c("source_symbol_id").alias("symbol_id")),
                F.struct(F.lit("backward").alias("direction"), c("sink_symbol_id").alias("symbol_id")),
            )
        ).alias("end"),
    ).select("repo_hash", "flow_id", "inner", "end.*")
    way = F.when(c("direction") == "forward", "forward").otherwise("backward")
    return (
        seeds.withColumn("direction", way)
        .join(ends, ["repo_hash", "symbol_id", "direction"])
        .where(c("inner") <= F.greatest(F.lit(0), c("depth") - 1))
        .select("query_id", "repo_hash", "flow_id")
    )


def trace_data_flow(requests: DataFrame, symbols: DataFrame, flows: DataFrame) -> DataFrame:
    """Named flows per request. Equal requests are traced once and fanned out; names are resolved once per hit flow."""
    asks, askers = shared_asks(requests, ["repo_hash", "symbol", "direction", "depth"])
    hits = trace_flows(asks, symbols, flows)
    used = flows.join(hits.select("repo_hash", "flow_id").distinct(), ["repo_hash", "flow_id"], "left_semi")
    named = hits.join(flow_payloads(used, symbols), ["repo_hash", "flow_id"])
    return askers.join(named.withColumnRenamed("query_id", "ask"), "ask").drop("ask")


# Invariants ------------------------------------------------------------------------------------


def invariant_payloads(invariants: DataFrame, symbols: DataFrame) -> DataFrame:
    names = symbols.select("repo_hash", c("symbol_id").alias("target_symbol_id"), "qualified_name", "file_path")
    return invariants.join(names, ["repo_hash", "target_symbol_id"], "left").select(
        "repo_hash", "invariant_id", "target_symbol_id", "file_path",
        F.coalesce("qualified_name", F.lit("")).alias("target_symbol"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source_kind", F.lit("")).alias("source_kind"),
        F.coalesce("source_location", F.lit("")).alias("source_location"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def invariants_of_symbols(ids: DataFrame, invariants: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Invariants of a set of symbols, from a confidence on."""
    wanted = ids.select("repo_hash", c("symbol_id").alias("target_symbol_id")).distinct()
    return invariants.where(c("confidence") >= min_confidence).join(wanted, ["repo_hash", "target_symbol_id"], "left_semi")


def invariants_of_files(requests: DataFrame, invariants: DataFrame, symbols: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    return invariants_of_symbols(symbols_of_files(requests, symbols), invariants, min_confidence)


def invariants_of_clusters(requests: DataFrame, invariants: DataFrame, symbols: DataFrame, files: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    return invariants_of_symbols(member_symbols(requests, files, symbols), invariants, min_confidence)


def find_invariants(requests: DataFrame, symbols: DataFrame, files: DataFrame, invariants: DataFrame) -> DataFrame:
    """Invariants per request: of its symbol when given, else of its cluster, at its minimum confidence."""
    base = requests.select("query_id", "repo_hash", "symbol", "cluster_id", F.coalesce("min_confidence", F.lit(0.0)).alias("min_confidence"))
    by_symbol = symbols_by_name(base.where("symbol IS NOT NULL AND symbol <> ''"), symbols).select(
        "query_id", "repo_hash", "symbol_id", "min_confidence")
    at = symbols.join(files.where("cluster_id IS NOT NULL").select("repo_hash", "file_path", "cluster_id"), ["repo_hash", "file_path"])
    rows = invariant_payloads(invariants, symbols).withColumnRenamed("target_symbol_id", "symbol_id")
    # invariants get their cluster before requests meet them, so the product of both is never shuffled
    inside = rows.join(at.select("repo_hash", "cluster_id", "symbol_id"), ["repo_hash", "symbol_id"])
    asked = base.where("coalesce(symbol, '') = '' AND cluster_id IS NOT NULL").select("query_id", "repo_hash", "cluster_id", "min_confidence")
    by_cluster = spread_join(asked, inside, ["repo_hash", "cluster_id"], ["invariant_id"]).drop("cluster_id")
    return by_symbol.join(rows, ["repo_hash", "symbol_id"]).unionByName(by_cluster).where("confidence >= min_confidence").select(
        "query_id", "repo_hash", "invariant_id", "target_symbol", "text", "source_kind", "source_location", "confidence")


# Exemplars -------------------------------------------------------------------------------------


def find_exemplars(
    requests: DataFrame, files: DataFrame, symbols: DataFrame, signals: DataFrame,
    embeddings: DataFrame | None = None, query_vectors: DataFrame | None = None,
) -> DataFrame:
    """Best five files of the requested cluster by their best symbol; without symbols its first five files.

    Requests for the same cluster and task share one scoring, and tasks of a cluster with the same vector too. A vector only adds to a score, so the best files of a
    cluster without vectors, ranked once for all tasks, and the files of symbols with a vector hold the best of each task.
    Vectors meet on the cluster and give their score there, so no vector is repeated for each pair.
    """
    asked = requests.select("query_id", "repo_hash", "cluster_id", F.coalesce("question", F.lit("")).alias("task"))
    once = asked.groupBy("repo_hash", "cluster_id", "task").agg(F.min("query_id").alias("lead"))
    leads = once.join(asked, ["repo_hash", "cluster_id", "task"]).select("query_id", "lead")
    use_vectors = embeddings is not None and query_vectors is not None
    once, askers = search.equal_tasks(
        once.select(c("lead").alias("query_id"), "repo_hash", "cluster_id"), ["repo_hash", "cluster_id"], query_vectors if use_vectors else None)
    once = once.withColumnRenamed("query_id", "lead")
    leads = leads.join(askers.select(c("query_id").alias("lead"), c("lead").alias("_first")), "lead").select("query_id", c("_first").alias("lead"))
    members = files.where("cluster_id IS NOT NULL").select("repo_hash", "cluster_id", "file_path")
    symbols = symbols.select("repo_hash", "file_path", "symbol_id")
    inside = members.join(symbols, ["repo_hash", "file_path"]).withColumn("task_type", F.lit("modify existing"))
    order = [F.desc(F.round("score", 9)), c("file_path")]
    plain = ranking.combine(inside, signals).groupBy("repo_hash", "cluster_id", "file_path").agg(F.max("score").alias("score"))
    plain = top_rows(plain, ["repo_hash", "cluster_id"], order, TOP_EXEMPLARS).drop("rank")
    scored = once.join(plain, ["repo_hash", "cluster_id"]).select(c("lead").alias("query_id"), "repo_hash", "file_path", "score")
    if use_vectors:
        asking = once.join(query_vectors.select(c("query_id").alias("lead"), "query_vector"), "lead")
        held = inside.join(embeddings.select("repo_hash", "symbol_id", "embedding"), ["repo_hash", "symbol_id"]).join(signals, ["repo_hash", "symbol_id"], "left")
        near = spread_join(asking, held, ["repo_hash", "cluster_id"], ["symbol_id"]).withColumns({
            "query_id": c("lead"), "embedding_similarity": vectors.cosine(c("embedding"), c("query_vector")), "co_change_correlation": F.lit(0.0)})
        near = ranking.scored(near)
        scored = scored.unionByName(near.select("query_id", "repo_hash", "file_path", "score"))
    scored = scored.groupBy("query_id", "repo_hash", "file_path").agg(F.max("score").alias("score"))
    best = top_rows(scored, ["query_id", "repo_hash"], order, TOP_EXEMPLARS).withColumn(
        "reason", F.concat(F.lit("top-ranked exemplar in cluster (score "), F.format_string("%.3f", c("score")), F.lit(")")))
    filled = once.join(inside.select("repo_hash", "cluster_id").distinct(), ["repo_hash", "cluster_id"], "left_semi").select("lead")
    heads = top_rows(members, ["repo_hash", "cluster_id"], [c("file_path")], TOP_EXEMPLARS).drop("rank")
    bare = once.join(filled, "lead", "left_anti").join(heads, ["repo_hash", "cluster_id"])
    first = top_rows(bare.select(c("lead").alias("query_id"), "repo_hash", "file_path"), ["query_id", "repo_hash"], [c("file_path")], TOP_EXEMPLARS)
    shown = best.select("query_id", "repo_hash", "file_path", "rank", "reason").unionByName(
        first.withColumn("reason", F.lit("cluster member")))
    return fan_out(leads, shown.withColumnRenamed("query_id", "lead"), "lead").select("query_id", "repo_hash", "rank", "file_path", "reason")
