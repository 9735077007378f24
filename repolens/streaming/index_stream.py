"""The incremental index as a live job: changed files in, index tables kept up to date."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from repolens.operators import symbols
from repolens.plans.incremental import IndexState, apply_change
from repolens.session import cut_lineage
from repolens.sources import facts as fa
from repolens.sources.tables import read_table, write_table

SOURCE_SCHEMA = "repo_hash string, root string, file_path string, last_modified timestamp, content string"
#: Stored tables and the column that no real row lacks; a repository without rows is stored as one row of nulls.
TABLES = {
    "symbols": ("symbol_id", "repo_hash string, qualified_name string, file_path string, line_start int, line_end int, kind string, signature string, seq bigint, symbol_id string"),
    "named_refs": ("source_qname", "repo_hash string, file_path string, seq bigint, source_qname string, target_qname string, edge_kind string, source_symbol_id string, target_symbol_id string"),
    "flows": ("flow_id", "repo_hash string, flow_id string, source_symbol_id string, sink_symbol_id string, path array<string>, flow_kind string, sensitivity string"),
}


def typed(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[F.col(c.split(" ", 1)[0]).cast(c.split(" ", 1)[1]) for c in schema.split(", ")])


def read_state(spark: SparkSession, root: str) -> IndexState:
    """Stored tables under `root`; a table that is not there yet is empty."""
    out = []
    for name, (key, schema) in TABLES.items():
        try:
            out.append(typed(read_table(spark, root, name).where(F.col(key).isNotNull()), schema))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            out.append(spark.createDataFrame([], schema))
    return IndexState(*out)


def write_state(state: IndexState, repos: DataFrame, root: str) -> None:
    """Replace the rows of `repos`; flows first and symbols last, so that a change that is applied again starts from the old names."""
    for name, df in reversed(list(zip(TABLES, (state.symbols, state.refs, state.flows)))):
        rows = typed(df, TABLES[name][1])
        bare = repos.select("repo_hash").distinct()
        write_table(cut_lineage(rows.unionByName(bare, allowMissingColumns=True)), root, name, mode="overwrite")


def run_incremental_index(spark: SparkSession, folder: str, root: str, checkpoint: str, files_per_trigger: int = 64) -> StreamingQuery:
    """Carry files as they arrive (null content: the file is gone) through symbols, references and flows under `root`."""

    def update(batch: DataFrame, batch_id: int) -> None:
        newest = cut_lineage(batch.groupBy("repo_hash", "root", "file_path").agg(F.max_by(F.struct("content"), "last_modified").alias("c"), F.max("last_modified").alias("last_modified")).select(
            "repo_hash", "root", "file_path", "last_modified", "c.content"))
        if newest.isEmpty():
            return
        parsed = cut_lineage(fa.syntax_facts(newest.where("content IS NOT NULL")))
        rows = cut_lineage(symbols.give_ids(symbols.raw_symbols(parsed)))
        changed = apply_change(read_state(spark, root), newest, typed(rows, TABLES["symbols"][1]), symbols.raw_refs(parsed))
        write_state(changed, newest, root)

    stream = spark.readStream.schema(SOURCE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
