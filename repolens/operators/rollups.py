"""Rollups of the projections for the map views. `nodes` are the typed rows of `symbol_nodes`.

Lists of unbounded length (dependencies of a node, members of a class) stay rows instead of arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions import labels, paths, text

from .graphs import longest_path_layers
from .ranked import first_by, top_rows

c = F.col
MIXED_SHARE = 0.6
TOKENS_PER_SYMBOL = 700  # fixed value: tokens one returned symbol saves


def class_members(nodes: DataFrame) -> DataFrame:
    """Function-like nodes owned by a class: `(repo_hash, id, class_label, member, rule)`.

    Rules in order: exact owner class; a class of the same short name; for methods the longest dotted prefix
    that is a class. Prefixes are exploded, so the last rule is an equi-join too.
    """
    classes = nodes.where(labels.node_class(c("symbol_kind")) == "class")
    exact = classes.select("repo_hash", c("label").alias("name"), c("label").alias("class_label")).distinct()
    short = classes.groupBy("repo_hash", text.last_segment(c("label")).alias("name")).agg(F.max_by("label", F.struct("id")).alias("class_label"))
    fns = nodes.where(labels.node_class(c("symbol_kind")) == "function").select("repo_hash", "id", "label", "parent_class", "symbol_kind")
    parts = F.split("label", r"\.")
    prefixes = F.when(
        (F.lower("symbol_kind") == "method") & (F.size(parts) > 1),
        F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")),
    ).otherwise(F.array().cast("array<string>"))
    tries = fns.select(
        "repo_hash", "id", "label", "parent_class",
        F.posexplode(F.concat(F.array("parent_class", text.last_segment(c("parent_class"))), prefixes)).alias("rule", "name")).where("name IS NOT NULL")
    by_name = tries.where("rule <> 1").join(exact, ["repo_hash", "name"])
    by_short = tries.where("rule = 1").join(short, ["repo_hash", "name"])
    hits = by_name.unionByName(by_short.select(*by_name.columns))
    best = first_by(hits.select("repo_hash", "id", "rule", "label", "class_label"), ["repo_hash", "id"], [c("rule")])
    tail = F.substr("label", F.length("class_label") + 2)
    member = F.when((c("rule") != 1) & c("label").startswith(F.concat("class_label", F.lit("."))), tail).when(c("rule") == 1, text.last_segment(c("label"))).otherwise(c("label"))
    return best.select("repo_hash", "id", "class_label", member.alias("member"), "rule")


def visible_nodes(nodes: DataFrame, members: DataFrame) -> DataFrame:
    return nodes.join(members.select("repo_hash", "id"), ["repo_hash", "id"], "left_anti")


def dependency_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per edge leaving a node, with the target's label (its id when unknown)."""
    named = nodes.select("repo_hash", c("id").alias("target"), c("label").alias("_label"))
    inside = edges.join(nodes.select("repo_hash", c("id").alias("source")), ["repo_hash", "source"], "left_semi")
    return inside.join(named, ["repo_hash", "target"], "left").select("repo_hash", c("source").alias("id"), F.coalesce("_label", "target").alias("dependency"))


def file_clusters(nodes: DataFrame) -> DataFrame:
    """Majority cluster of each file; `mixed` when it holds under 60 % of the file and others exist."""
    per = nodes.where("file_path IS NOT NULL").groupBy("repo_hash", "file_path", "cluster_id").agg(F.count("*").alias("n"))
    return per.groupBy("repo_hash", "file_path").agg(
        F.sum("n").alias("size"), F.count("cluster_id").alias("n_clusters"),
        F.min_by(F.struct("cluster_id", "n"), F.when(c("cluster_id").isNotNull(), F.struct(-c("n"), c("cluster_id")))).alias("top"),
    ).select("repo_hash", "file_path", "size", c("top.cluster_id").alias("cluster_id"),
             F.coalesce((c("top.n") / c("size") < MIXED_SHARE) & (c("n_clusters") > 1), F.lit(False)).alias("mixed"))


def ranked_clusters(nodes: DataFrame) -> DataFrame:
    """Clusters of each file by the number of its nodes in them, ties by id, with their short tag and role; `mixed` as in `file_clusters`.

    A file has a few clusters at most, so its rows are ranked in one window.
    """
    named = nodes.where("file_path IS NOT NULL AND cluster_id IS NOT NULL").groupBy("repo_hash", "file_path", "cluster_id").agg(
        F.count("*").alias("n"), F.coalesce(F.min("cluster_short"), F.lit("CLUSTER")).alias("short"), F.coalesce(F.min("cluster_role"), F.lit("")).alias("role"))
    order = Window.partitionBy("repo_hash", "file_path").orderBy(F.desc("n"), "cluster_id")
    mixed = file_clusters(nodes).select("repo_hash", "file_path", "mixed")
    return named.withColumn("rank", F.row_number().over(order)).join(mixed, ["repo_hash", "file_path"])


def file_order(nodes: DataFrame) -> DataFrame:
    """Sort keys of the file view: files by cluster, larger first, unclustered last; inside by type, then label.

    Keys and not positions: sort by them where the rows are shown.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in ("class", "interface", "function", "module")]), labels.node_class(c("symbol_kind")))
    files = file_clusters(nodes).select("repo_hash", "file_path", "size", F.coalesce("cluster_id", F.lit("~")).alias("cluster_key"))
    return nodes.select("repo_hash", "id", "file_path", "label", rank.alias("type_rank")).join(files, ["repo_hash", "file_path"])


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("repo_hash", labels.relation(c("kind")).alias("relation")).agg(F.count("*").alias("n"))


def in_path(nodes: DataFrame, filters: DataFrame) -> DataFrame:
    """Nodes matching each filter `(filter_id, repo_hash, path, kind)`: the file itself or anything below a folder."""
    keys = nodes.where("file_path IS NOT NULL").select(
        "repo_hash", "id", F.explode(F.array_distinct(F.concat(
            F.array(F.struct(F.lit("file").alias("kind"), c("file_path").alias("path")), F.struct(F.lit("folder").alias("kind"), c("file_path").alias("path"))),
            F.transform(paths.ancestor_folders(c("file_path")), lambda p: F.struct(F.lit("folder").alias("kind"), p.alias("path")))))).alias("k")
    ).select("repo_hash", "id", "k.*")
    clean = filters.withColumn("path", F.when(c("kind") == "folder", F.regexp_replace("path", "/$", "")).otherwise(c("path")))
    return clean.join(keys, ["repo_hash", "kind", "path"]).select("filter_id", "repo_hash", "id")


def overlay_edges(layers: dict[str, DataFrame]) -> DataFrame:
    """Edges of the active layers with their source layer (the invariant layer is never overlaid)."""
    out = None
    for name in ("symbol", "flow", "architecture"):
        if name in layers:
            part = layers[name].select("repo_hash", "source", "target", "kind", "weight", F.lit(name).alias("source_layer"))
            out = part if out is None else out.unionByName(part)
    return out


def external_stubs(view: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependencies leaving a view: target, its group and the protocol of a tier crossing."""
    deps = dependency_labels(nodes, edges).join(
        view.select("repo_hash", "id", "label", c("cluster_id").alias("source_cluster"), c("file_path").alias("source_path")), ["repo_hash", "id"])
    outside = deps.join(view.select("repo_hash", c("label").alias("dependency")).distinct(), ["repo_hash", "dependency"], "left_anti")
    known = first_by(nodes.select("repo_hash", c("label").alias("dependency"), c("cluster_id").alias("target_cluster"), c("file_path").alias("target_path"), "id"),
                     ["repo_hash", "dependency"], [c("id")]).drop("id").withColumn("_known", F.lit(True))
    rows = outside.join(known, ["repo_hash", "dependency"], "left")
    group = F.when(c("_known"), F.coalesce("target_cluster", F.lit("Unclustered"))).otherwise("External")
    source_tier = labels.tier_guess(c("label"), F.coalesce("source_cluster", F.lit("Unclustered")), c("source_path"))
    target_tier = labels.tier_guess(c("dependency"), F.when(c("_known"), F.coalesce("target_cluster", F.lit("Unclustered"))), c("target_path"))
    return rows.select("repo_hash", "id", "dependency", group.alias("target_group"), labels.protocol(source_tier, target_tier, c("dependency")).alias("protocol"))


def placeholders(stubs: DataFrame) -> DataFrame:
    return stubs.groupBy("repo_hash", "dependency").agg(F.min("target_group").alias("target_group"))


def focal_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """The most connected nodes of each repository."""
    degree = dependency_labels(nodes, edges).groupBy("repo_hash", "id").agg(F.count("*").alias("degree"))
    rows = nodes.select("repo_hash", "id").join(degree, ["repo_hash", "id"], "left").fillna(0, ["degree"])
    return top_rows(rows, ["repo_hash"], [F.desc("degree"), c("id")], limit)


def _is_class(kind):
    return F.lower(kind).isin("class", "interface", "type")


def packaged(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("package", paths.dirname(F.coalesce("file_path", F.lit("")))).withColumn(
        "context", F.coalesce("cluster_id", F.lit("Unclustered"))).where("package <> ''")


def packages(nodes: DataFrame) -> DataFrame:
    """Directories with class count, count of packages below, and dominant cluster (ties: smaller id)."""
    rows = packaged(nodes)
    per = rows.groupBy("repo_hash", "package", "context").agg(F.count("*").alias("n"), F.count_if(_is_class("symbol_kind")).alias("classes"))
    base = per.groupBy("repo_hash", "package").agg(F.sum("classes").alias("class_count"), F.min_by("context", F.struct(-c("n"), c("context"))).alias("context"))
    below = base.select("repo_hash", F.explode(paths.ancestor_folders(c("package"))).alias("package")).groupBy("repo_hash", "package").agg(F.count("*").alias("sub_packages"))
    return base.join(below, ["repo_hash", "package"], "left").fillna(0, ["sub_packages"]).withColumn("short_name", F.regexp_extract("package", "([^/]*)$", 1))


def package_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between different packages with counts."""
    at = packaged(nodes).select("repo_hash", "id", "package")
    return _grouped_edges(at.withColumnRenamed("package", "part"), edges)


def _grouped_edges(at: DataFrame, edges: DataFrame) -> DataFrame:
    source = at.withColumnsRenamed({"id": "source", "part": "source_part"})
    target = at.withColumnsRenamed({"id": "target", "part": "target_part"})
    return edges.join(source, ["repo_hash", "source"]).join(target, ["repo_hash", "target"]).where("source_part <> target_part").groupBy(
        "repo_hash", "source_part", "target_part").agg(F.count("*").alias("n"))


def package_externals(nodes: DataFrame, edges: DataFrame, context: str) -> DataFrame:
    """Packages of one context -> other contexts they reach."""
    rows = packaged(nodes)
    inside = rows.where(c("context") == context).select("repo_hash", c("id").alias("source"), "package")
    others = rows.where(c("context") != context).select("repo_hash", c("id").alias("target"), c("context").alias("destination"))
    return edges.join(inside, ["repo_hash", "source"]).join(others, ["repo_hash", "target"]).select("repo_hash", "package", "destination").distinct()


def package_level(table: DataFrame, prefix: str | None = None) -> DataFrame:
    """One level of the package tree: packages without an ancestor in the set, or direct children of a prefix."""
    if prefix is not None:
        return table.where(c("package").startswith(prefix + "/") & ~F.substr("package", F.lit(len(prefix) + 2)).contains("/"))
    ancestors = table.select("repo_hash", "package", F.explode(paths.ancestor_folders(c("package"))).alias("above"))
    covered = ancestors.join(table.select("repo_hash", c("package").alias("above")), ["repo_hash", "above"], "left_semi").select("repo_hash", "package")
    return table.join(covered, ["repo_hash", "package"], "left_anti")


def contexts(nodes: DataFrame) -> DataFrame:
    """Clusters with class and directory counts and three terms (classes first when there are any)."""
    rows = nodes.withColumn("context", F.coalesce("cluster_id", F.lit("Unclustered"))).withColumn("dir", F.nullif(paths.dirname(F.coalesce("file_path", F.lit(""))), F.lit("")))
    base = rows.groupBy("repo_hash", "context").agg(F.count_if(_is_class("symbol_kind")).alias("class_count"), F.countDistinct("dir").alias("package_count"))
    first = top_rows(rows.withColumn("_rest", ~_is_class("symbol_kind")).select("repo_hash", "context", "_rest", "id", "label"), ["repo_hash", "context"], [c("_rest"), c("id")], 3)
    usable = first.join(base, ["repo_hash", "context"]).where("NOT _rest OR class_count = 0")
    terms = usable.groupBy("repo_hash", "context").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", text.last_segment(c("label")).alias("t")))), lambda x: x["t"]).alias("terms"))
    return base.join(terms, ["repo_hash", "context"])


def context_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _grouped_edges(nodes.select("repo_hash", "id", F.coalesce("cluster_id", F.lit("Unclustered")).alias("part")), edges)


def context_externals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Contexts with an edge to a node that is not in the view, with the layer of the context."""
    at = nodes.select("repo_hash", c("id").alias("source"), F.coalesce("cluster_id", F.lit("Unclustered")).alias("context"))
    lost = edges.join(nodes.select("repo_hash", c("id").alias("target")), ["repo_hash", "target"], "left_anti")
    return lost.join(at, ["repo_hash", "source"]).select("repo_hash", "context", labels.layer_of_cluster(c("context")).alias("target_group")).distinct()


def graph_layers(nodes: DataFrame, edges: DataFrame, cycles: str = "shared") -> DataFrame:
    """Longest-path layers of a graph of `id` nodes and `source`/`target` edges."""
    return longest_path_layers(nodes.select("repo_hash", c("id").alias("node")), edges.select("repo_hash", c("source").alias("src"), c("target").alias("dst")), cycles)


def band_counts(nodes: DataFrame) -> DataFrame:
    """Nodes per band and per tier of each repository, functions and methods excluded, zeros kept."""
    shown = nodes.where(~F.coalesce(F.lower("symbol_kind").isin("method", "function"), F.lit(False)))
    keyed = shown.select("repo_hash", F.explode(F.array(F.concat(F.lit("band:"), labels.band(c("label"), c("file_path"))), F.concat(F.lit("tier:"), labels.tier(c("file_path"))))).alias("part"))
    counted = keyed.groupBy("repo_hash", "part").agg(F.count("*").alias("n"))
    fixed = F.array(*[F.lit(f"band:{b}") for b in labels.BANDS], *[F.lit(f"tier:{x}") for x in labels.TIERS])
    frame = nodes.select("repo_hash").distinct().select("repo_hash", F.explode(fixed).alias("part"))
    return frame.join(counted, ["repo_hash", "part"], "left").fillna(0, ["n"])


def drill_children(nodes: DataFrame, level: str, tier: str | None = None, band: str | None = None) -> DataFrame:
    """Distinct children at a level (`layers`, `contexts`, `packages`, `classes`) under an optional focus."""
    if level == "layers":
        return nodes.select("repo_hash").distinct().select("repo_hash", F.explode(F.array(*[F.lit(b) for b in labels.BANDS])).alias("name"))
    path = F.coalesce("file_path", F.lit(""))
    rows = nodes
    if tier:
        rows = rows.where(F.try_element_at(paths.split_path(path), F.lit(1)) == tier)
    if band:
        rows = rows.where(labels.drill_band(c("label"), path) == band)
    name = {"contexts": labels.drill_context(path, 1 if tier else 0), "packages": F.nullif(paths.dirname(path), F.lit("")), "classes": c("label")}[level]
    return rows.select("repo_hash", name.alias("name")).where("name IS NOT NULL").distinct()


def layer_entries(projections: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Entries of all layers with the number of their dependencies."""
    out = None
    for layer in ("symbol", "flow", "architecture"):
        nodes, edges = projections[layer]
        n = dependency_labels(nodes, edges).groupBy("repo_hash", "id").agg(F.count("*").alias("n_dependencies"))
        part = nodes.join(n, ["repo_hash", "id"], "left").select(
            "repo_hash", F.concat(F.lit(f"{layer}:"), c("id")).alias("entry"), "label", "kind",
            F.coalesce(c("metadata")["cluster_id"], F.lit("Unclustered")).alias("cluster"), F.coalesce("n_dependencies", F.lit(0)).cast("bigint").alias("n_dependencies"))
        out = part if out is None else out.unionByName(part)
    return out


def in_band(invariants: DataFrame, band: str) -> DataFrame:
    x = c("confidence")
    return invariants.where({"high": x >= 0.9, "medium": (x >= 0.7) & (x < 0.9), "all": F.lit(True)}[band])


def invariant_groups(invariants: DataFrame, band: str = "all") -> DataFrame:
    """Invariants per target in a confidence band (`high` >= 0.9, `medium` 0.7-0.9, `all`)."""
    return in_band(invariants, band).groupBy("repo_hash", "target_symbol_id").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


def grouped_invariants(invariants: DataFrame, band: str = "all") -> DataFrame:
    """The invariants of a confidence band with the size `n` of their target's group; rows stay rows, so a target with very many is no single row."""
    sizes = invariant_groups(invariants, band).select("repo_hash", "target_symbol_id", "n")
    kept = in_band(invariants, band)
    return kept.select("repo_hash", "target_symbol_id", "invariant_id", "text", "source_kind", "source_location", "confidence").join(sizes, ["repo_hash", "target_symbol_id"])


def file_tree(files: DataFrame) -> DataFrame:
    """Every file and folder with its parent; `folder_first` sorts folders before files."""
    leaf = files.select("repo_hash", c("file_path").alias("path"), F.lit("file").alias("kind")).distinct()
    folders = files.select("repo_hash", F.explode(paths.ancestor_folders(c("file_path"))).alias("path")).distinct().withColumn("kind", F.lit("folder"))
    return folders.unionByName(leaf).select("repo_hash", "path", "kind", paths.dirname(c("path")).alias("parent"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"),
                                            F.when(c("kind") == "folder", 0).otherwise(1).alias("folder_first"))


def flattened_tree(tree: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Folders with the folder at the end of their single-child chain: `(repo_hash, path, end_path, display)`.

    Chains are followed by doubling, so a chain of n folders closes in about log2(n) joins.
    """
    from repolens.session import cut_lineage

    only = tree.groupBy("repo_hash", c("parent").alias("path")).agg(F.count("*").alias("n"), F.max("kind").alias("hi"), F.min("kind").alias("lo"), F.max("path").alias("child"))
    single = only.where("n = 1 AND lo = 'folder' AND hi = 'folder'").select("repo_hash", "path", "child")
    state = cut_lineage(tree.where("kind = 'folder'").join(single, ["repo_hash", "path"], "left").select("repo_hash", "path", F.coalesce("child", "path").alias("end_path")))
    for _ in range(max_rounds):
        hop = state.select("repo_hash", c("path").alias("end_path"), c("end_path").alias("next"))
        moved = cut_lineage(state.join(hop, ["repo_hash", "end_path"], "left").select("repo_hash", "path", F.coalesce("next", "end_path").alias("end_path"), (c("next") != c("end_path")).alias("moved")))
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"folder chains did not close in {max_rounds} rounds")
    top = paths.dirname(c("path"))
    return state.withColumn("display", F.substr("end_path", F.length(top) + F.when(top == "", F.when(c("path").startswith("/"), 2).otherwise(1)).otherwise(2)))


def activity_rows(activity: DataFrame) -> DataFrame:
    """Log rows of agent activity with the tokens their symbols save."""
    n = F.coalesce("n_symbols", F.lit(0))
    return activity.select("repo_hash", "activity_id", labels.agent_label(c("query_type")).alias("agent"), n.alias("symbols_returned"), (n * TOKENS_PER_SYMBOL).alias("tokens_saved"))


def activity_totals(rows: DataFrame) -> DataFrame:
    """Queries, symbols and saved tokens of each repository's log."""
    return rows.groupBy("repo_hash").agg(F.count("*").alias("queries"), F.sum("symbols_returned").alias("symbols_returned"), F.sum("tokens_saved").alias("tokens_saved"))


def induced_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends in view."""
    seen = nodes.select("repo_hash", "id").distinct()
    return edges.join(seen.withColumnRenamed("id", "source"), ["repo_hash", "source"], "left_semi").join(seen.withColumnRenamed("id", "target"), ["repo_hash", "target"], "left_semi")


def file_list(nodes: DataFrame) -> DataFrame:
    return nodes.where("file_path IS NOT NULL AND file_path <> ''").select("repo_hash", "file_path").distinct()
