"""Graph projections: nodes and edges of each layer for every repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import text

c = F.col
NODE_COLUMNS = ("repo_hash", "id", "kind", "label", "layer", "metadata")
EDGE_COLUMNS = ("repo_hash", "source", "target", "kind", "weight", "metadata")
NODE_SCHEMA = "repo_hash string, id string, kind string, label string, layer int, metadata map<string,string>"
EDGE_SCHEMA = "repo_hash string, source string, target string, kind string, weight double, metadata map<string,string>"


def _metadata(**values):
    return F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("string") for v in values.values()]))


def cluster_tags(files: DataFrame, clusters: DataFrame) -> DataFrame:
    """Short tag per cluster: its most common parent folder (earliest file first among equals), else a role word."""
    parts = F.split(F.regexp_replace(F.regexp_replace("file_path", r"\\", "/"), "/+$", ""), "/")
    parents = files.where("cluster_id IS NOT NULL").select("repo_hash", "cluster_id", "file_path", F.try_element_at(parts, F.lit(-2)).alias("parent"))
    counted = parents.where("parent <> ''").groupBy("repo_hash", "cluster_id", "parent").agg(F.count("*").alias("n"), F.min("file_path").alias("seen"))
    best = counted.groupBy("repo_hash", "cluster_id").agg(F.min_by("parent", F.struct(-c("n"), c("seen"))).alias("parent"))
    return clusters.join(best, ["repo_hash", "cluster_id"], "left").select(
        "repo_hash", "cluster_id",
        F.when(c("parent").isNotNull(), text.short_tag(c("parent"))).otherwise(text.role_tag(F.coalesce("role_description", F.lit("")))).alias("cluster_short"))


def symbol_nodes(symbols: DataFrame, files: DataFrame, clusters: DataFrame) -> DataFrame:
    """Symbols with owner class and cluster, as typed columns (`symbol_projection` packs them in a map)."""
    described = clusters.select("repo_hash", "cluster_id", c("role_description").alias("cluster_role")).join(
        cluster_tags(files, clusters), ["repo_hash", "cluster_id"])
    at = files.select("repo_hash", "file_path", "cluster_id")
    return symbols.join(at, ["repo_hash", "file_path"], "left").join(described, ["repo_hash", "cluster_id"], "left").select(
        "repo_hash", c("symbol_id").alias("id"), c("qualified_name").alias("label"), "file_path", "line_start", "line_end",
        F.coalesce("signature", F.lit("")).alias("signature"), c("kind").alias("symbol_kind"),
        text.parent_class(c("kind"), c("qualified_name")).alias("parent_class"), "cluster_id", "cluster_role", "cluster_short")


def _ref_edges(refs: DataFrame) -> DataFrame:
    return refs.select("repo_hash", c("source_symbol_id").alias("source"), c("target_symbol_id").alias("target"), F.coalesce("edge_kind", F.lit("")).alias("kind"),
                       F.lit(1.0).alias("weight"), F.lit(None).cast("map<string,string>").alias("metadata"))


def symbol_projection(symbols: DataFrame, refs: DataFrame, files: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = symbol_nodes(symbols, files, clusters)
    extra = [x for x in rows.columns if x not in ("repo_hash", "id", "label")]
    nodes = rows.select("repo_hash", "id", F.lit("symbol").alias("kind"), "label", F.lit(1).alias("layer"), _metadata(**{x: c(x) for x in extra}).alias("metadata"))
    return nodes, _ref_edges(refs)


def flow_projection(symbols: DataFrame, flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols a flow touches, and one edge per flow; a sensitive flow weighs 2."""
    from .lookups import flow_nodes

    touched = flow_nodes(flows).select("repo_hash", "symbol_id").distinct()
    nodes = symbols.join(touched, ["repo_hash", "symbol_id"], "left_semi").select(
        "repo_hash", c("symbol_id").alias("id"), F.lit("flow_node").alias("kind"), c("qualified_name").alias("label"), F.lit(2).alias("layer"),
        _metadata(file_path=c("file_path"), line_start=c("line_start"), line_end=c("line_end"), signature=F.coalesce("signature", F.lit("")), symbol_kind=c("kind")).alias("metadata"))
    edges = flows.where("source_symbol_id IS NOT NULL AND sink_symbol_id IS NOT NULL").select(
        "repo_hash", c("source_symbol_id").alias("source"), c("sink_symbol_id").alias("target"), F.lit("flow_call_chain").alias("kind"),
        F.when(c("sensitivity").isNotNull(), 2.0).otherwise(1.0).alias("weight"),
        _metadata(path=F.array_join("path", ","), flow_kind=c("flow_kind"), sensitivity=c("sensitivity")).alias("metadata"))
    return nodes, edges


def architecture_projection(clusters: DataFrame, dependencies: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters with member counts; `allowed` -> `allows` (1), `forbidden` -> `forbids` (2), other kinds as they are."""
    sizes = files.where("cluster_id IS NOT NULL").groupBy("repo_hash", "cluster_id").agg(F.count("*").alias("member_count"))
    role = F.coalesce("role_description", F.lit(""))
    nodes = clusters.join(sizes, ["repo_hash", "cluster_id"], "left").select(
        "repo_hash", c("cluster_id").alias("id"), F.lit("cluster").alias("kind"), F.substring(role, 1, 80).alias("label"), F.lit(3).alias("layer"),
        _metadata(naming_convention=c("naming_convention"), member_count=F.coalesce("member_count", F.lit(0)), role_description=role).alias("metadata"))
    kind = c("kind")
    edges = dependencies.where("source_cluster_id IS NOT NULL AND target_cluster_id IS NOT NULL").select(
        "repo_hash", c("source_cluster_id").alias("source"), c("target_cluster_id").alias("target"),
        F.when(kind == "allowed", "allows").when(kind == "forbidden", "forbids").otherwise(F.coalesce(F.nullif("kind", F.lit("")), F.lit("depends"))).alias("kind"),
        F.when(kind == "forbidden", 2.0).otherwise(1.0).alias("weight"), _metadata(kind=kind).alias("metadata"))
    return nodes, edges


def invariant_projection(invariants: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Constrained symbols and invariants; edges weigh the confidence. Invariants on unknown symbols are left out."""
    names = symbols.select("repo_hash", c("symbol_id").alias("target_symbol_id"), "qualified_name")
    held = invariants.join(names, ["repo_hash", "target_symbol_id"])
    targets = held.select("repo_hash", c("target_symbol_id").alias("symbol_id")).distinct()
    targets = symbols.join(targets, ["repo_hash", "symbol_id"], "left_semi").select(
        "repo_hash", c("symbol_id").alias("id"), F.lit("symbol").alias("kind"), c("qualified_name").alias("label"), F.lit(1).alias("layer"),
        _metadata(file_path=c("file_path"), signature=F.coalesce("signature", F.lit(""))).alias("metadata"))
    own = held.select(
        "repo_hash", c("invariant_id").alias("id"), F.lit("invariant").alias("kind"), F.substring(F.coalesce("text", F.lit("")), 1, 80).alias("label"), F.lit(4).alias("layer"),
        _metadata(source_kind=c("source_kind"), confidence=c("confidence"), source_location=c("source_location"), target_symbol_id=c("target_symbol_id"), target_symbol=c("qualified_name")).alias("metadata"))
    edges = held.select("repo_hash", c("invariant_id").alias("source"), c("target_symbol_id").alias("target"), F.lit("constrains").alias("kind"), c("confidence").alias("weight"),
                        _metadata(source_kind=c("source_kind")).alias("metadata"))
    return targets.unionByName(own), edges


def projection_for(layer: str, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Projection by layer name; an unknown layer gives empty frames."""
    t = tables
    if layer == "symbol":
        return symbol_projection(t["symbols"], t["refs"], t["files"], t["clusters"])
    if layer == "flow":
        return flow_projection(t["symbols"], t["flows"])
    if layer == "architecture":
        return architecture_projection(t["clusters"], t["cluster_dependencies"], t["files"])
    if layer == "invariant":
        return invariant_projection(t["invariants"], t["symbols"])
    spark = t["symbols"].sparkSession
    return spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA)
