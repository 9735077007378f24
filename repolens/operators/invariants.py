"""Layer 4: invariants mined from tests, guards and commented functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions import paths, text

from .ranked import first_by, top_rows

# Confidence and priority by source kind, distances in lines.
CONFIDENCE = {"test": 0.85, "defensive": 0.60, "comment": 0.35}
PRIORITY = {"test": 0, "defensive": 1, "comment": 2}
COMMENT_DISTANCE = 3
LONG_FUNCTION = 30
LINE_BUCKET = 64

c = F.col


def prior_calls(statements: DataFrame) -> DataFrame:
    """Latest call before each statement of a function; a call inside an assert does not count.

    The window is one function body, so no large group meets in a task.
    """
    before = Window.partitionBy("repo_hash", "file_path", "fn_line").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    usable = F.when(c("kind") != "assert", c("call_text"))
    return statements.withColumn("prior_call", F.last(usable, ignorenulls=True).over(before))


def statements_of(facts: DataFrame) -> DataFrame:
    """Direct statements of Python functions; `line_end` of a statement fact holds its position."""
    return facts.where("fact = 'statement' AND lower(file_path) LIKE '%.py'").select(
        "repo_hash", "file_path", "seq", "fn_line", c("line_end").alias("position"), c("name").alias("kind"), c("text").alias("condition"),
        "line", c("flag").alias("guards"), text.strip(c("extra")).alias("call_text"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call text -> symbol: exact name; else first symbol ending in the text, then in its last part.

    Names are indexed by all their dotted suffixes, so this is an equi-join and not a suffix comparison of
    every call with every name. Of the names that end alike only the first, and the whole name, can be chosen, so the
    index has one row per suffix. `calls` needs `repo_hash` and `call_text`; distinct texts meet the index.
    """
    first = first_by(symbols.select("repo_hash", "qualified_name", "symbol_id", "seq", "file_path"), ["repo_hash", "qualified_name"],
                     [c("file_path"), c("seq"), c("symbol_id")])
    parts = F.split("qualified_name", r"\.")
    suffixes = first.select(
        "repo_hash", "symbol_id", "file_path", "seq",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
            F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("suffix"), (i == 1).alias("whole")))).alias("x"),
    ).select("repo_hash", F.struct("file_path", "seq", "symbol_id").alias("at"), "x.*")
    suffixes = suffixes.groupBy("repo_hash", "suffix").agg(F.min("at").alias("first"), F.min(F.when(c("whole"), c("at"))).alias("exact"))
    asked = calls.select("repo_hash", "call_text").distinct()
    wanted = asked.select(
        "repo_hash", "call_text",
        F.explode(F.array(
            F.struct(F.lit(0).alias("rule"), c("call_text").alias("suffix")),
            F.struct(F.lit(1).alias("rule"), text.last_segment(c("call_text")).alias("suffix")))).alias("w"),
    ).select("repo_hash", "call_text", "w.*").where("suffix <> ''")
    hits = wanted.join(suffixes, ["repo_hash", "suffix"])
    chosen = F.when(c("rule") == 0, F.coalesce("exact", "first")).otherwise(c("first"))
    return hits.groupBy("repo_hash", "call_text").agg(F.min_by(chosen, "rule")["symbol_id"].alias("target_symbol_id"))


def enclosing_functions(points: DataFrame, symbols: DataFrame, line: str = "line") -> DataFrame:
    """Innermost function around each `(repo_hash, file_path, line)`.

    Functions are entered under every 64-line bucket they touch and points look up one bucket, so a long
    file does not compare all its lines with all its functions.
    """
    fns = symbols.where(c("kind").isin("function", "method")).select(
        "repo_hash", "file_path", "symbol_id", "line_start", "line_end",
        F.explode(F.sequence(F.floor(c("line_start") / LINE_BUCKET), F.floor(F.greatest("line_start", "line_end") / LINE_BUCKET))).alias("bucket"))
    keys = points.select("repo_hash", "file_path", c(line).alias("_line")).distinct().withColumn("bucket", F.floor(c("_line") / LINE_BUCKET))
    inside = keys.join(fns, ["repo_hash", "file_path", "bucket"]).where("_line BETWEEN line_start AND line_end")
    return inside.groupBy("repo_hash", "file_path", c("_line").alias(line)).agg(
        F.max_by("symbol_id", F.struct("line_start", -c("line_end"), "symbol_id")).alias("owner_id"))


def _candidate(rows: DataFrame, target: str, body, kind: str) -> DataFrame:
    return rows.select(
        "repo_hash", "file_path", "seq", c(target).alias("target_symbol_id"), body.alias("text"), F.lit(kind).alias("source_kind"),
        F.concat("file_path", F.lit(":"), c("line").cast("string")).alias("source_location"), F.lit(CONFIDENCE[kind]).alias("confidence"))


def mine_tests(facts: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assertions of test files bound to the call before them, and the count of rejected ones."""
    rows = prior_calls(statements_of(facts.where(paths.is_test_path_for_mining(c("file_path"))))).where("kind = 'assert'")
    found = resolve_calls(rows.select("repo_hash", c("prior_call").alias("call_text")).where("call_text IS NOT NULL"), symbols)
    joined = rows.join(found.withColumnRenamed("call_text", "prior_call"), ["repo_hash", "prior_call"], "left")
    usable = c("target_symbol_id").isNotNull() & (text.strip(F.coalesce("condition", F.lit(""))) != "")
    rejected = joined.where(~usable).groupBy("repo_hash").agg(F.count("*").alias("rejected"))
    return _candidate(joined.where(usable), "target_symbol_id", text.strip(c("condition")), "test"), rejected


def mine_guards(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Guarding `if`s and asserts of each function, owned by the innermost function at its first line."""
    rows = statements_of(facts).where("kind = 'assert' OR (kind = 'if' AND guards)")
    owners = enclosing_functions(rows, symbols, "fn_line")
    body = F.when(c("kind") == "if", text.guard_text(c("condition"))).otherwise(F.concat(F.lit("precondition: "), text.strip(c("condition"))))
    owned = rows.join(owners, ["repo_hash", "file_path", "fn_line"]).where(text.strip(F.coalesce("condition", F.lit(""))) != "")
    return _candidate(owned, "owner_id", body, "defensive")


def comment_prompts(facts: DataFrame, symbols: DataFrame, budget: int | None = None) -> DataFrame:
    """Prompts for commented functions with a risky part near the comment, or short functions; with a budget, the first by path."""
    rows = facts.where("fact = 'commented'").where(
        (c("line") <= COMMENT_DISTANCE) | (c("line_end") - c("fn_line") <= LONG_FUNCTION))
    owners = enclosing_functions(rows, symbols, "fn_line")
    named = rows.join(owners, ["repo_hash", "file_path", "fn_line"]).join(
        symbols.select("repo_hash", c("symbol_id").alias("owner_id"), "signature"), ["repo_hash", "owner_id"])
    signature = F.coalesce(F.nullif("signature", F.lit("")), F.element_at(F.split("text", "\n"), 1))
    prompts = named.select(
        "repo_hash", "file_path", "seq", c("owner_id").alias("target_symbol_id"),
        F.concat(F.lit("Function: "), signature, F.lit("\n\nSource:\n```python\n"), c("text"), F.lit("\n```")).alias("prompt"),
        F.concat("file_path", F.lit(":"), c("fn_line").cast("string")).alias("source_location"))
    return prompts if budget is None else top_rows(prompts, ["repo_hash"], [c("file_path"), c("seq")], budget)


def comment_candidates(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies `(repo_hash, source_location, reply)` as candidates; empty replies are dropped."""
    joined = prompts.join(replies, ["repo_hash", "source_location"]).withColumn("text", text.strip(c("reply"))).where("text <> ''")
    return joined.select(
        "repo_hash", "file_path", "seq", "target_symbol_id", "text", F.lit("comment").alias("source_kind"), "source_location",
        F.lit(CONFIDENCE["comment"]).alias("confidence"))


def validate(candidates: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every candidate with cleaned text and its `fate`: `kept`, `invalid_target` or `empty_text`."""
    known = symbols.select("repo_hash", c("symbol_id").alias("target_symbol_id"), F.lit(True).alias("_known"))
    clean = text.collapse_spaces(F.coalesce("text", F.lit("")))
    return candidates.join(known, ["repo_hash", "target_symbol_id"], "left").withColumn("text", clean).withColumn(
        "fate", F.when(c("_known").isNull(), "invalid_target").when(c("text") == "", "empty_text").otherwise("kept")).drop("_known")


def dedupe(valid: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """First row per target, source kind and whole text, in arrival order."""
    return first_by(valid, ["repo_hash", "target_symbol_id", "source_kind", "text"], [c(o) for o in order])


def cap(rows: DataFrame, order: tuple[str, ...], limit: int) -> DataFrame:
    """The first `limit` rows of each repository, for callers that ask for a bound: most certain first, then by source, then arrival."""
    priority = F.lit(99)
    for kind, value in PRIORITY.items():
        priority = F.when(c("source_kind") == kind, value).otherwise(priority)
    return top_rows(rows, ["repo_hash"], [F.desc("confidence"), priority, *[c(o) for o in order]], limit)


def counts(rows: DataFrame) -> DataFrame:
    """Rows by source kind and by confidence bucket."""
    by_kind = [F.count_if(c("source_kind") == k).alias(k) for k in CONFIDENCE]
    high, med = c("confidence") >= 0.75, (c("confidence") >= 0.5) & (c("confidence") < 0.75)
    return rows.groupBy("repo_hash").agg(
        F.count("*").alias("invariants"), *by_kind,
        F.count_if(high).alias("high"), F.count_if(med).alias("med"), F.count_if(c("confidence") < 0.5).alias("low"))


def mine(facts: DataFrame, symbols: DataFrame, replies: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Invariant table of every repository, all rows unless a limit is given. `symbols` needs the extraction order column `seq`."""
    tests, _ = mine_tests(facts, symbols)
    found = tests.withColumn("_part", F.lit(0)).unionByName(mine_guards(facts, symbols).withColumn("_part", F.lit(1)))
    if replies is not None:
        found = found.unionByName(comment_candidates(comment_prompts(facts, symbols), replies).withColumn("_part", F.lit(2)))
    # Per file, test rows come before guards; comment rows come after all files.
    found = found.withColumn("late", F.col("_part") == 2).withColumn("pass", c("_part"))
    order = ("late", "file_path", "pass", "seq")
    kept = dedupe(validate(found, symbols).where("fate = 'kept'"), order)
    if limit is not None:
        kept = cap(kept, order, limit)
    return kept.select(
        "repo_hash", text.row_id(c("repo_hash"), c("target_symbol_id"), c("source_kind"), c("text")).alias("invariant_id"),
        "target_symbol_id", "text", "source_kind", "source_location", "confidence")
