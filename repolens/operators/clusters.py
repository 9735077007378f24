"""Layer 3: file clusters, their conventions and the dependencies between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions import paths, text, vectors
from repolens.session import cut_lineage

from .graphs import connected_components
from .ranked import top_rows

# Pair weights, the cut and the histogram buckets.
WEIGHTS = {"directory": 0.40, "name": 0.20, "imports": 0.25, "structure": 0.15}
CUT = 0.55
KIND_BUCKETS = ("function", "class", "method", "variable", "import")

c = F.col


def _file_edges(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """References between two different files, one row per reference."""
    at = symbols.select("repo_hash", "symbol_id", "file_path")
    source = at.withColumnsRenamed({"symbol_id": "source_symbol_id", "file_path": "source_file"})
    target = at.withColumnsRenamed({"symbol_id": "target_symbol_id", "file_path": "target_file"})
    return (
        refs.join(source, ["repo_hash", "source_symbol_id"])
        .join(target, ["repo_hash", "target_symbol_id"])
        .where("source_file <> target_file")
    )


def file_dependencies(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct `(repo_hash, source_file, target_file)` pairs of import/call/inherit edges."""
    return (
        _file_edges(symbols, refs.where(c("edge_kind").isin("imports", "calls", "inherits")))
        .select("repo_hash", "source_file", "target_file")
        .distinct()
    )


def incoming_refs(files: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """References into each file from other files, any kind, repeats counted."""
    counted = _file_edges(symbols, refs).groupBy("repo_hash", c("target_file").alias("file_path")).agg(F.count("*").alias("n"))
    return files.select("repo_hash", "file_path").join(counted, ["repo_hash", "file_path"], "left").select(
        "repo_hash", "file_path", F.coalesce("n", F.lit(0)).cast("bigint").alias("incoming")
    )


def strategies(files: DataFrame, limit: int | None = None) -> DataFrame:
    """How each repository is clustered: linkage, or per directory above a limit that the caller asks for."""
    within = F.lit(True) if limit is None else c("n_files") <= limit
    return files.groupBy("repo_hash").agg(F.countDistinct("file_path").alias("n_files")).withColumn(
        "strategy",
        F.when(c("n_files") == 1, "singleton").when(within, "pairwise").otherwise("directory"),
    )


def kind_histograms(symbols: DataFrame) -> DataFrame:
    """Share of each symbol kind per file; files without a counted kind are absent."""
    counts = symbols.groupBy("repo_hash", "file_path").agg(*[F.count_if(c("kind") == k).alias(k) for k in KIND_BUCKETS])
    total = sum((c(k) for k in KIND_BUCKETS[1:]), c(KIND_BUCKETS[0]))
    return counts.where(total > 0).select(
        "repo_hash", "file_path", F.array(*[c(k) / total for k in KIND_BUCKETS]).alias("histogram")
    )


def file_features(files: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Everything a pair distance needs, one row per file."""
    imports = file_dependencies(symbols, refs).groupBy("repo_hash", c("source_file").alias("file_path")).agg(
        F.collect_set("target_file").alias("imports")
    )
    rows = files.select("repo_hash", "file_path").distinct().withColumns(
        {"dirs": paths.directory_parts(c("file_path")), "words": paths.name_tokens(c("file_path"))}
    )
    depth = rows.groupBy("repo_hash").agg(F.greatest(F.max(F.size("dirs")), F.lit(1)).alias("max_depth"))
    return (
        rows.join(depth, "repo_hash")
        .join(imports, ["repo_hash", "file_path"], "left")
        .join(kind_histograms(symbols), ["repo_hash", "file_path"], "left")
        .withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))
        .withColumn("histogram", F.coalesce("histogram", F.array().cast("array<double>")))
    )


def directory_distance(a, b, max_depth):
    """1 - shared leading directories / deepest directory of the repository."""
    return 1.0 - vectors.shared_prefix_length(a, b) / max_depth


def structure_distance(a, b):
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), 1.0 - vectors.cosine(a, b))
    )


def candidate_pairs(features: DataFrame) -> DataFrame:
    """Pairs `(repo_hash, a, b)` that can be within the cut; every other pair provably is not.

    Within the cut the weighted similarities reach 0.45. Structure gives at most 0.15, a shared word at
    most 0.20, a shared import at most 0.25 and directories the rest. So a pair shares a word; or an
    import and 1/8 of the deepest directory; or 3/4 of the deepest directory. Each case is one
    equi-join key.
    """

    def prefixed(other_gain: float, tag: str, items):
        share = max(0.0, 1 - CUT - WEIGHTS["structure"] - other_gain) / WEIGHTS["directory"]
        needed = F.greatest(F.ceil(c("max_depth") * share - 1e-9).cast("int"), F.lit(1))
        prefix = F.concat(F.lit(tag), F.array_join(F.slice("dirs", F.lit(1), needed), "/"), F.lit("|"))
        return F.when(F.size("dirs") >= needed, F.transform(items, lambda x: F.concat(prefix, x))).otherwise(
            F.array().cast("array<string>")
        )

    keys = features.select(
        "repo_hash", "file_path",
        F.explode(
            F.concat(
                F.transform("words", lambda w: F.concat(F.lit("w:"), w)),
                prefixed(WEIGHTS["imports"], "i:", c("imports")),
                prefixed(0.0, "d:", F.array(F.lit(""))),
            )
        ).alias("key"),
    )
    left = keys.select("repo_hash", "key", c("file_path").alias("a"))
    right = keys.select("repo_hash", "key", c("file_path").alias("b"))
    return left.join(right, ["repo_hash", "key"]).where("a < b").select("repo_hash", "a", "b").distinct()


def pair_distances(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """The four distances and their weighted sum for the given pairs."""
    names = ("dirs", "words", "imports", "histogram")
    left = features.select("repo_hash", "max_depth", c("file_path").alias("a"), *[c(n).alias(f"a_{n}") for n in names])
    right = features.select("repo_hash", c("file_path").alias("b"), *[c(n).alias(f"b_{n}") for n in names])
    rows = pairs.join(left, ["repo_hash", "a"]).join(right, ["repo_hash", "b"])
    return rows.select(
        "repo_hash", "a", "b",
        directory_distance(c("a_dirs"), c("b_dirs"), c("max_depth")).alias("directory"),
        vectors.set_distance(c("a_words"), c("b_words")).alias("name"),
        vectors.set_distance(c("a_imports"), c("b_imports")).alias("imports"),
        structure_distance(c("a_histogram"), c("b_histogram")).alias("structure"),
    ).withColumn("distance", sum((F.lit(w) * c(n) for n, w in list(WEIGHTS.items())[1:]), F.lit(WEIGHTS["directory"]) * c("directory")))


def pairwise_clusters(files: DataFrame, symbols: DataFrame, refs: DataFrame, inclusive: bool = True) -> DataFrame:
    """Single linkage cut at 0.55: components of the graph of close pairs.

    `inclusive=False` keeps pairs exactly at the cut apart.
    """
    features = cut_lineage(file_features(files, symbols, refs))  # read four times
    close = pair_distances(features, candidate_pairs(features))
    # A distance is a sum of decimals; compare at nine digits so 0.55 means 0.55.
    d = F.round("distance", 9)
    links = close.where(d <= CUT if inclusive else d < CUT)
    parts = connected_components(
        files.select("repo_hash", c("file_path").alias("node")), links.select("repo_hash", "a", "b")
    )
    return parts.select("repo_hash", c("node").alias("file_path"), c("component").alias("cluster_key"))


def directory_clusters(files: DataFrame) -> DataFrame:
    return files.select("repo_hash", "file_path").distinct().withColumn(
        "cluster_key", F.concat(F.lit("dir:"), paths.directory_of(c("file_path")))
    )


def cluster_files(
    files: DataFrame, symbols: DataFrame, refs: DataFrame, limit: int | None = None, inclusive: bool = True
) -> DataFrame:
    """File -> cluster assignment by single linkage; with a limit, repositories of more files go by directory."""
    if limit is None:
        rows = pairwise_clusters(files, symbols, refs, inclusive)
        return rows.select("repo_hash", "file_path", text.row_id(c("repo_hash"), c("cluster_key")).alias("cluster_id"))
    plan = strategies(files, limit)
    small = plan.where("strategy <> 'directory'").select("repo_hash")
    large = plan.where("strategy = 'directory'").select("repo_hash")

    def only(df, repos):
        return df.join(repos, "repo_hash", "left_semi")

    close = pairwise_clusters(only(files, small), only(symbols, small), only(refs, small), inclusive)
    rows = close.unionByName(directory_clusters(only(files, large)))
    return rows.select("repo_hash", "file_path", text.row_id(c("repo_hash"), c("cluster_key")).alias("cluster_id"))


def size_summary(members: DataFrame) -> DataFrame:
    """Clusters per repository with smallest, upper-median and largest size.

    Sizes are counted first, so the ordered part handles distinct sizes, not clusters.
    """
    sizes = members.groupBy("repo_hash", "cluster_id").agg(F.count("*").alias("size"))
    per_size = sizes.groupBy("repo_hash", "size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("repo_hash")
    running = per_size.withColumns(
        {"upto": F.sum("n").over(w.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(w)}
    )
    return running.groupBy("repo_hash").agg(
        F.max("total").alias("clusters"),
        F.min("size").alias("min_size"),
        F.min(F.when(c("upto") > F.floor(c("total") / 2), c("size"))).alias("median_size"),
        F.max("size").alias("max_size"),
    )


def common_directories(members: DataFrame) -> DataFrame:
    """Longest directory shared by all files of a cluster.

    The leading run of the smallest and the largest directory is the run of all of them.
    """
    dirs = members.select("repo_hash", "cluster_id", paths.directory_parts(c("file_path")).alias("dirs"))
    ends = dirs.groupBy("repo_hash", "cluster_id").agg(F.min("dirs").alias("lo"), F.max("dirs").alias("hi"))
    return ends.select(
        "repo_hash", "cluster_id",
        F.array_join(F.slice("lo", F.lit(1), vectors.shared_prefix_length(c("lo"), c("hi"))), "/").alias("directory"),
    )


def common_suffixes(members: DataFrame) -> DataFrame:
    """Most frequent name pattern of a cluster, earliest file first among equals; `*` when nothing repeats."""
    sizes = members.groupBy("repo_hash", "cluster_id").agg(F.count("*").alias("size"))
    counted = (
        members.withColumn("pattern", paths.suffix_pattern(c("file_path")))
        .where("pattern IS NOT NULL")
        .groupBy("repo_hash", "cluster_id", "pattern")
        .agg(F.count("*").alias("n"), F.min("file_path").alias("first_file"))
        .groupBy("repo_hash", "cluster_id")
        .agg(F.min_by(F.struct("pattern", "n"), F.struct(-c("n"), c("first_file"))).alias("top"))
    )
    single = (c("top.n") <= 1) & (c("size") > 2)
    return sizes.join(counted, ["repo_hash", "cluster_id"], "left").select(
        "repo_hash", "cluster_id",
        F.when(c("top").isNull() | single, "*").otherwise(c("top.pattern")).alias("naming_convention"),
    )


def code_shapes(members: DataFrame, symbols: DataFrame) -> DataFrame:
    """The five most frequent symbol kinds of a cluster as `N kinds`, first seen first among equals."""
    inside = symbols.join(members, ["repo_hash", "file_path"]).withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    counted = inside.groupBy("repo_hash", "cluster_id", "kind").agg(
        F.count("*").alias("n"), F.min(F.struct("file_path", "line_start", "symbol_id")).alias("seen")
    )
    top = top_rows(counted, ["repo_hash", "cluster_id"], [F.desc("n"), c("seen")], 5)
    label = F.concat(c("n").cast("string"), F.lit(" "), c("kind"), F.when(c("n") != 1, "s").otherwise(""))
    shapes = top.groupBy("repo_hash", "cluster_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", label.alias("label")))), lambda x: x["label"]).alias("patterns")
    )
    return members.select("repo_hash", "cluster_id").distinct().join(shapes, ["repo_hash", "cluster_id"], "left").select(
        "repo_hash", "cluster_id", F.coalesce("patterns", F.array(F.lit("no extracted symbols"))).alias("patterns")
    )


def heuristic_annotations(members: DataFrame, symbols: DataFrame) -> DataFrame:
    """Role, naming and code shape without a model."""
    place = F.when(c("directory") == "", "<repo root>").otherwise(c("directory"))
    return (
        common_directories(members)
        .join(common_suffixes(members), ["repo_hash", "cluster_id"])
        .join(code_shapes(members, symbols), ["repo_hash", "cluster_id"])
        .select(
            "repo_hash", "cluster_id",
            F.concat(F.lit("files in directory `"), place, F.lit("` (LLM annotation unavailable)")).alias("role_description"),
            "naming_convention", "patterns", F.lit("heuristic").alias("source"),
            F.lit(None).cast("array<string>").alias("forbidden_dependencies"),
        )
    )


def central_files(members: DataFrame, incoming: DataFrame, limit: int = 5) -> DataFrame:
    """The most referenced files of each cluster."""
    rows = members.join(incoming, ["repo_hash", "file_path"], "left").withColumn("incoming", F.coalesce("incoming", F.lit(0)))
    return top_rows(rows, ["repo_hash", "cluster_id"], [F.desc("incoming"), c("file_path")], limit)


def cluster_prompts(members: DataFrame, symbols: DataFrame, incoming: DataFrame) -> DataFrame:
    """One prompt text per cluster: at most 5 files with at most 20 symbols each."""
    sample = central_files(members, incoming).withColumnRenamed("rank", "file_rank")
    inside = sample.join(symbols, ["repo_hash", "file_path"])
    shown = top_rows(inside, ["repo_hash", "cluster_id", "file_path"], [c("line_start"), c("symbol_id")], 20)
    line = F.concat(
        F.lit("    ["), F.coalesce("kind", F.lit("?")), F.lit("] "),
        F.coalesce(F.nullif("signature", F.lit("")), c("qualified_name"), F.lit("")),
    )
    symbol_lines = shown.select("repo_hash", "cluster_id", "file_rank", c("rank").alias("at"), line.alias("line"))
    file_lines = sample.select(
        "repo_hash", "cluster_id", "file_rank", F.lit(0).alias("at"), F.concat(F.lit("\n- "), c("file_path")).alias("line"))
    body = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("file_rank", "at", "line"))), lambda x: x["line"]), "\n")
    return file_lines.unionByName(symbol_lines).groupBy("repo_hash", "cluster_id").agg(
        F.concat(F.lit("Files in this cluster:\n"), body, F.lit("\n\nReturn the JSON description for this cluster.")).alias("prompt")
    )


REPLY_SCHEMA = "role string, naming_convention string, code_shape array<string>, forbidden_dependencies array<string>"


def parse_replies(replies: DataFrame) -> DataFrame:
    """Model replies `(repo_hash, cluster_id, reply)` as typed columns; null `parsed` when unreadable."""
    return replies.withColumn("parsed", F.from_json(text.outer_json(c("reply")), REPLY_SCHEMA))


def annotate(members: DataFrame, symbols: DataFrame, replies: DataFrame) -> DataFrame:
    """Model annotation where a usable reply exists, the heuristic one otherwise."""
    base = heuristic_annotations(members, symbols)
    parsed = parse_replies(replies).select("repo_hash", "cluster_id", "parsed")
    rows = base.join(parsed, ["repo_hash", "cluster_id"], "left")
    usable = F.coalesce(c("parsed.role"), F.lit("")) != ""
    naming = F.nullif(text.strip(c("parsed.naming_convention")), F.lit(""))
    shapes = F.slice(F.filter(c("parsed.code_shape"), lambda s: s.isNotNull() & (s != "")), 1, 5)
    forbidden = F.filter(c("parsed.forbidden_dependencies"), lambda s: s.isNotNull() & (s != ""))
    role = F.coalesce(F.nullif(text.strip(c("parsed.role")), F.lit("")), F.lit("unnamed cluster"))
    return rows.select(
        "repo_hash", "cluster_id",
        F.when(usable, role).otherwise(c("role_description")).alias("role_description"),
        F.when(usable, F.coalesce(naming, c("naming_convention"))).otherwise(c("naming_convention")).alias("naming_convention"),
        F.when(usable & (F.size(shapes) > 0), shapes).otherwise(c("patterns")).alias("patterns"),
        F.when(usable, "llm").otherwise("heuristic").alias("source"),
        F.when(usable & (F.size(forbidden) > 0), forbidden).alias("forbidden_dependencies"),
    )


def cluster_dependencies(members: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Distinct allowed edges between different clusters."""
    at = members.select("repo_hash", "file_path", "cluster_id")
    source = at.withColumnsRenamed({"file_path": "source_file", "cluster_id": "source_cluster_id"})
    target = at.withColumnsRenamed({"file_path": "target_file", "cluster_id": "target_cluster_id"})
    return (
        dependencies.join(source, ["repo_hash", "source_file"])
        .join(target, ["repo_hash", "target_file"])
        .where("source_cluster_id <> target_cluster_id")
        .select("repo_hash", "source_cluster_id", "target_cluster_id")
        .distinct()
        .withColumn("kind", F.lit("allowed"))
    )


def layer_stats(clusters: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Clusters, dependency edges and model-annotated clusters per repository."""
    per_repo = clusters.groupBy("repo_hash").agg(F.count("*").alias("clusters"), F.count_if(c("source") == "llm").alias("annotated"))
    edges = dependencies.groupBy("repo_hash").agg(F.count("*").alias("dependencies"))
    return per_repo.join(edges, "repo_hash", "left").withColumn("dependencies", F.coalesce("dependencies", F.lit(0)).cast("bigint"))
