"""Scopes: restrict requests and results to a slice of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import paths
from repolens.session import cut_lineage

from .ranked import spread_join

c = F.col
KINDS = ("cluster", "folder", "file", "symbols")


def validate(scopes: DataFrame) -> DataFrame:
    """Add `scope_error`: each kind needs exactly its own descriptor (`cluster_id`, `path` or `qnames`)."""
    has_cluster, has_path = F.coalesce("cluster_id", F.lit("")) != "", F.coalesce("path", F.lit("")) != ""
    has_names = F.coalesce(F.size("qnames"), F.lit(0)) > 0
    set_cluster, set_path, set_names = c("cluster_id").isNotNull(), c("path").isNotNull(), c("qnames").isNotNull()
    kind = c("kind")
    return scopes.withColumn(
        "scope_error",
        F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "unknown kind")
        .when((kind == "cluster") & ~has_cluster, "cluster requires cluster_id")
        .when((kind == "cluster") & (set_path | set_names), "cluster must not set path or qnames")
        .when(kind.isin("folder", "file") & ~has_path, F.concat(kind, F.lit(" requires path")))
        .when(kind.isin("folder", "file") & (set_cluster | set_names), F.concat(kind, F.lit(" must not set cluster_id or qnames")))
        .when((kind == "symbols") & ~has_names, "symbols requires a non-empty qnames list")
        .when((kind == "symbols") & (set_cluster | set_path), "symbols must not set cluster_id or path"),
    )


def shared(scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scopes of equal content once, under a hash of it as `scope_id`, and `(scope_id, key)` of every scope.

    Whatever is found for a key holds for all its scopes, so members are listed once and fan out last. A scope id with several
    rows has the content of them all; a null id names no scope.
    """
    content = F.struct("repo_hash", "kind", "cluster_id", "path", "qnames")
    keyed = scopes.where("scope_id IS NOT NULL").groupBy("scope_id").agg(F.sort_array(F.collect_set(content)).alias("content"))
    keyed = cut_lineage(keyed.withColumn("key", F.sha2(F.to_json(F.struct("content")), 256)))
    once = keyed.dropDuplicates(["key"]).select(c("key").alias("scope_id"), F.explode("content").alias("of")).select("scope_id", "of.*")
    return once, keyed.select("scope_id", "key")


def scope_members(scopes: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """`(scope_id, member)`: files and names of every scope."""
    once, askers = shared(scopes)
    in_files = scope_files(once, files, symbols)
    names = scope_names(once, in_files, symbols)
    members = in_files.select(c("scope_id").alias("key"), c("file_path").alias("member")).unionAll(names.select("scope_id", "qualified_name"))
    return spread_join(askers, members, ["key"], ["member"]).select("scope_id", "member")


def scope_files(scopes: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """`(scope_id, repo_hash, file_path)` of every valid scope.

    Folder scopes meet files on the exploded ancestor folders of a file, so there is no prefix comparison
    of every scope with every file.
    """
    base = scopes.select("scope_id", "repo_hash", "kind", "cluster_id", "path", "qnames")
    by_cluster = base.where("kind = 'cluster'").join(files.select("repo_hash", "cluster_id", "file_path"), ["repo_hash", "cluster_id"])
    with_symbols = symbols.select("repo_hash", "file_path").distinct()
    folders = with_symbols.select("repo_hash", "file_path", F.explode(F.array_append(
        F.transform(paths.ancestor_folders(c("file_path")), lambda p: F.concat(p, F.lit("/"))), F.lit("/"))).alias("prefix")).distinct()
    by_folder = base.where("kind = 'folder'").withColumn("prefix", paths.folder_prefix(c("path"))).join(folders, ["repo_hash", "prefix"])
    by_file = base.where("kind = 'file'").withColumn("file_path", c("path"))
    wanted = base.where("kind = 'symbols'").select("scope_id", "repo_hash", F.explode("qnames").alias("qualified_name"))
    by_name = wanted.join(symbols.select("repo_hash", "qualified_name", "file_path"), ["repo_hash", "qualified_name"])
    out = None
    for part in (by_cluster, by_folder, by_file, by_name):
        rows = part.select("scope_id", "repo_hash", "file_path")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def scope_names(scopes: DataFrame, in_files: DataFrame, symbols: DataFrame) -> DataFrame:
    """`(scope_id, repo_hash, qualified_name, found)`; a name list keeps its unknown names with `found` false."""
    listed = scopes.where("kind = 'symbols'").select("scope_id", "repo_hash", F.explode("qnames").alias("qualified_name")).where("qualified_name <> ''").distinct()
    known = symbols.select("repo_hash", "qualified_name").distinct().withColumn("found", F.lit(True))
    by_list = listed.join(known, ["repo_hash", "qualified_name"], "left").fillna(False, ["found"])
    others = scopes.where("kind <> 'symbols'").select("scope_id")
    by_file = in_files.join(others, "scope_id", "left_semi").join(symbols.select("repo_hash", "file_path", "qualified_name"), ["repo_hash", "file_path"])
    return by_file.select("scope_id", "repo_hash", "qualified_name", F.lit(True).alias("found")).distinct().unionByName(
        by_list.select("scope_id", "repo_hash", "qualified_name", "found"))


def scope_summary(scopes: DataFrame, in_files: DataFrame, names: DataFrame) -> DataFrame:
    """Files, names and missing names per scope."""
    n_files = in_files.groupBy("scope_id").agg(F.count("*").alias("n_files"))
    n_names = names.groupBy("scope_id").agg(F.count("*").alias("n_names"), F.count_if(~c("found")).alias("n_missing"))
    return scopes.select("scope_id", "kind").join(n_files, "scope_id", "left").join(n_names, "scope_id", "left").fillna(0, ["n_files", "n_names", "n_missing"])


def scope_counts(scopes: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """`scope_summary` of scopes not yet resolved: equal scopes are counted once."""
    once, askers = shared(scopes)
    in_files = scope_files(once, files, symbols)
    counts = scope_summary(once.select("scope_id", "kind").dropDuplicates(["scope_id"]), in_files, scope_names(once, in_files, symbols))
    rows = scopes.select("scope_id", "kind").join(askers, "scope_id", "left")
    return rows.join(counts.drop("kind").withColumnRenamed("scope_id", "key"), "key", "left").drop("key").fillna(0, ["n_files", "n_names", "n_missing"])


def path_inside(requests: DataFrame, in_files: DataFrame) -> DataFrame:
    """Requests `(query_id, scope_id, path)` whose path is a scope file or a folder above one."""
    covers = in_files.select("scope_id", F.explode(F.array_append(paths.ancestor_folders(c("file_path")), c("file_path"))).alias("clean")).distinct()
    exact = in_files.select("scope_id", c("file_path").alias("path"))
    folder = F.regexp_replace(paths.folder_prefix(c("path")), "/$", "")
    asked = requests.select("query_id", "scope_id", "path")
    return asked.join(exact, ["scope_id", "path"], "left_semi").select("query_id").unionByName(
        asked.withColumn("clean", folder).join(covers, ["scope_id", "clean"], "left_semi").select("query_id")).distinct()


def path_inside_scopes(requests: DataFrame, scopes: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """`path_inside` for scopes not yet resolved: equal scopes are resolved once, and scopes that no request names are not."""
    asked = requests.select("query_id", "scope_id", "path")
    wanted = scopes.join(asked.select("scope_id"), "scope_id", "left_semi")
    parts = ["repo_hash", "kind", "cluster_id", "path", "qnames"]
    keyed = wanted.withColumn("key", F.to_json(F.struct(*parts)))
    once = keyed.select(c("key").alias("scope_id"), *parts).distinct()
    named = asked.join(keyed.select("scope_id", "key"), "scope_id").select("query_id", c("key").alias("scope_id"), "path")
    asks = named.select("scope_id", "path").distinct().withColumn("query_id", F.to_json(F.struct("scope_id", "path")))
    inside = path_inside(asks, scope_files(once, files, symbols)).withColumnRenamed("query_id", "ask")
    return named.withColumn("ask", F.to_json(F.struct("scope_id", "path"))).join(inside, "ask", "left_semi").select("query_id").distinct()


def admit(requests: DataFrame, files: DataFrame, in_files: DataFrame, names: DataFrame) -> DataFrame:
    """Add `admitted` and `reason` to `(query_id, scope_id, repo_hash, query_type, symbol, cluster_id, path)`.

    Invariants need their whole cluster inside the scope; architecture and exemplars need an overlap.
    """
    known = names.select("scope_id", c("qualified_name").alias("symbol"), F.lit(True).alias("_name_in")).distinct()
    sizes = files.where("cluster_id IS NOT NULL").groupBy("repo_hash", "cluster_id").agg(F.count("*").alias("_size"))
    inside = in_files.join(files.where("cluster_id IS NOT NULL").select("repo_hash", "file_path", "cluster_id"), ["repo_hash", "file_path"]).groupBy(
        "scope_id", "repo_hash", "cluster_id").agg(F.count("*").alias("_inside"))
    paths_in = path_inside(requests.where("path IS NOT NULL"), in_files).withColumn("_path_in", F.lit(True))
    rows = (
        requests.join(known, ["scope_id", "symbol"], "left").join(sizes, ["repo_hash", "cluster_id"], "left")
        .join(inside, ["scope_id", "repo_hash", "cluster_id"], "left").join(paths_in, "query_id", "left")
    )
    kind, has_symbol = c("query_type"), F.coalesce("symbol", F.lit("")) != ""
    outside = F.when(kind == "find_relevant_context", F.when(has_symbol & c("_name_in").isNull(), "seed symbol is outside the scope"))
    outside = outside.when(kind == "trace_data_flow", F.when(~has_symbol, "trace_data_flow requires a symbol").when(c("_name_in").isNull(), "symbol is outside the scope"))
    overlap = c("cluster_id").isNotNull() & (F.coalesce("_inside", F.lit(0)) == 0)
    subset = c("cluster_id").isNotNull() & (F.coalesce("_inside", F.lit(0)) < F.coalesce("_size", F.lit(0)))
    outside = outside.when(
        kind == "find_invariants",
        F.when(c("symbol").isNotNull() & c("_name_in").isNull(), "symbol is outside the scope").when(subset, "cluster contains files outside the scope"))
    outside = outside.when(
        kind == "describe_architecture",
        F.when(overlap, "cluster does not intersect the scope").when(c("path").isNotNull() & c("_path_in").isNull(), "path is outside the scope"))
    outside = outside.when(kind == "find_exemplars", F.when(overlap, "cluster does not intersect the scope"))
    return rows.withColumn("reason", outside).withColumn("admitted", c("reason").isNull()).drop("_name_in", "_size", "_inside", "_path_in")


def admit_to_scopes(requests: DataFrame, scopes: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """`admit` for scopes not yet resolved: equal scopes are resolved once, and requests meet them by content."""
    once, askers = shared(scopes)
    in_files = scope_files(once, files, symbols)
    keyed = requests.join(askers, "scope_id", "left").withColumnsRenamed({"scope_id": "_own_id", "key": "scope_id"})
    rows = admit(keyed, files, in_files, scope_names(once, in_files, symbols))
    return rows.drop("scope_id").withColumnRenamed("_own_id", "scope_id")
