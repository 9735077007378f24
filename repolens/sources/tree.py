"""Scan of source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.functions import paths, text


def list_tree(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """Every file below `root`, with its path relative to the root.

    The Hadoop listing does not follow links out of the tree. Without `with_content` the content
    column is pruned, so files are listed and not read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    prefix = root.rstrip("/") + "/"
    out = raw.select(
        path.alias("file_path"),
        F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path).alias("relative_path"),
        F.col("modificationTime").alias("last_modified"),
        F.col("length").alias("n_bytes"),
        *([F.col("content")] if with_content else []),
    )
    return out


def source_files(spark: SparkSession, root: str, git_url: str | None = None) -> DataFrame:
    """Supported source files of one repository: `(repo_hash, root, file_path, last_modified, content)`.

    A file above `spark.sql.sources.binaryFile.maxLength` has null content and becomes an error row when parsed.
    """
    url = F.lit(git_url).cast("string")
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{py,ts,tsx}").load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    # filters on file metadata choose the files of the scan: pruned folders and oversized files are never opened
    listed = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    prefix = root.rstrip("/") + "/"
    inside = F.when(listed.startswith(prefix), F.substr(listed, F.lit(len(prefix) + 1))).otherwise(listed)
    kept = raw.where(~paths.in_pruned_directory(inside) & paths.is_source_file(inside))
    fits = F.col("_metadata.file_size") <= most
    return kept.where(fits).select(path.alias("file_path"), F.col("modificationTime").alias("last_modified"), "content").unionByName(
        kept.where(~fits).select(path.alias("file_path"), F.col("modificationTime").alias("last_modified"), F.lit(None).cast("binary").alias("content"))
    ).select(
        text.repo_id(url, F.lit(root)).alias("repo_hash"),
        F.lit(root).alias("root"),
        "file_path",
        "last_modified",
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def scan_summary(listed: DataFrame) -> DataFrame:
    """Seen, kept and skipped files of a listing (files in pruned directories are not seen)."""
    seen = listed.where(~paths.in_pruned_directory(F.col("relative_path")))
    suffix_ok = F.col("relative_path").rlike(r"\.(py|ts|tsx)$")
    return seen.agg(
        F.count("*").alias("seen"),
        F.count_if(paths.is_source_file(F.col("relative_path"))).alias("kept"),
        F.count_if(~suffix_ok).alias("skipped_suffix"),
        F.count_if(suffix_ok & ~paths.is_source_file(F.col("relative_path"))).alias("skipped_declaration"),
    )
