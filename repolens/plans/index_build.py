"""Build all four layers of many repositories from their source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.operators import clusters, flows, invariants, search, symbols
from repolens.session import cut_lineage
from repolens.sources import facts as fa
from repolens.sources.tables import write_table


def build_index(
    source_files: DataFrame, cluster_replies: DataFrame | None = None, comment_replies: DataFrame | None = None, embed=None
) -> dict[str, DataFrame]:
    """Index tables of every repository in `source_files (repo_hash, root, file_path, last_modified, content)`.

    Facts and symbols are frozen once: all layers read them.
    """
    parsed = cut_lineage(fa.syntax_facts(source_files))
    numbered = cut_lineage(symbols.give_ids(symbols.raw_symbols(parsed)))
    refs = cut_lineage(symbols.resolved_only(symbols.resolve_refs(symbols.raw_refs(parsed), numbered)))
    files = source_files.select("repo_hash", "file_path", "last_modified")
    members = cut_lineage(clusters.cluster_files(files, numbered, refs))
    if cluster_replies is None:
        rows = clusters.heuristic_annotations(members, numbered)
    else:
        rows = clusters.annotate(members, numbered, cluster_replies)
    lookup = search.SearchTables.of(numbered)
    texts = numbered.withColumn("_text", symbols.text.embedding_text(F.col("kind"), F.col("qualified_name"), F.col("signature")))
    return {
        "files": files.join(members, ["repo_hash", "file_path"], "left"),
        "symbols": numbered,
        "refs": refs,
        "symbol_embeddings": symbols.embed_texts(texts, "_text", embed).select("repo_hash", "symbol_id", "embedding"),
        "search_names": lookup.names,
        "search_words": lookup.words,
        "search_grams": lookup.grams,
        "flows": flows.build_flows(numbered, refs),
        "clusters": rows,
        "cluster_dependencies": clusters.cluster_dependencies(members, clusters.file_dependencies(numbered, refs)),
        "invariants": invariants.mine(parsed, numbered, comment_replies),
    }


def write_index(tables: dict[str, DataFrame], root: str) -> None:
    """Replace the written repositories and leave all others as they are."""
    for name, df in tables.items():
        write_table(df, root, name, mode="overwrite")
