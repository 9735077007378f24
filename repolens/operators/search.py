"""Candidate retrieval for a table of tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.functions import text
from repolens.session import cut_lineage

from .graphs import number_rows
from .ranked import broadcast_small, fan_out, top_rows

# Candidates and results kept per request.
TOP_CANDIDATES = 200
TOP_RESULTS = 12
# Frequent words of a symbol or a search up to which their parts are listed.
MAX_PART = 6
# Lengths of the substrings of names that are listed; a word is looked up by those of the greatest length that it has.
GRAMS = (1, 2, 3, 6)

c = F.col


def decompose(requests: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Task type, keywords and constraints of each request.

    A model reply `(query_id, reply)` is used when it is valid JSON, with its lists cut to 8 and 3;
    otherwise the words of the task decide.
    """
    rows = requests.withColumns(
        {
            "task_type": text.task_type(c("question")),
            "keywords": text.task_keywords(c("question")),
            "constraints": F.array().cast("array<string>"),
        }
    )
    if replies is None:
        return rows
    schema = "task_type string, keywords array<string>, constraints array<string>"
    parsed = replies.select("query_id", F.from_json(text.strip_fences(c("reply")), schema, {"mode": "PERMISSIVE"}).alias("_p"),
                            F.get_json_object(text.strip_fences(c("reply")), "$").alias("_ok"))
    rows = rows.join(parsed, "query_id", "left")
    usable = c("_ok").isNotNull() & (text.strip(F.coalesce("question", F.lit(""))) != "")
    empty = F.array().cast("array<string>")
    valid_type = c("_p.task_type").isin(*text.TASK_TYPES)
    return rows.withColumns(
        {
            "task_type": F.when(usable, F.when(valid_type, c("_p.task_type")).otherwise("modify existing")).otherwise(c("task_type")),
            "keywords": F.when(usable, F.transform(F.slice(F.coalesce("_p.keywords", empty), 1, 8), F.lower)).otherwise(c("keywords")),
            "constraints": F.when(usable, F.slice(F.coalesce("_p.constraints", empty), 1, 3)).otherwise(c("constraints")),
        }
    ).drop("_p", "_ok")


def search_text() -> Column:
    """Text searched for a task: its keywords, or the whole task when there is none."""
    words = F.filter("keywords", lambda k: k != "")
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.coalesce("question", F.lit("")))


def search_terms(tasks: DataFrame) -> DataFrame:
    """`search_text` of each task."""
    return tasks.select("query_id", "repo_hash", search_text().alias("search"))


def numbered_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols with their position in name order, so that searches sort and group on numbers."""
    return number_rows(symbols.select("repo_hash", "qualified_name", "symbol_id", "signature"), "qualified_name", "symbol_id")


def token_table(numbered: DataFrame) -> DataFrame:
    """Words of name and signature per symbol position with their counts."""
    words = numbered.select("repo_hash", "position", F.explode(text.search_tokens(c("qualified_name"), c("signature"))).alias("token"))
    return words.groupBy("repo_hash", "token", "position").agg(F.count("*").alias("hits"))


def _grams(text: Column, lengths) -> Column:
    """Substrings of the given lengths, each once."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.substr(text, i, n)))))


def gram_table(symbols: DataFrame) -> DataFrame:
    """Substrings of the lengths `GRAMS` of each name, any case. Names are dealt first: a row becomes very many."""
    width = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = symbols.select("repo_hash", "symbol_id", "qualified_name").repartition(width, "repo_hash", "symbol_id")
    return names.select("repo_hash", "symbol_id", "qualified_name", F.explode(_grams(F.lower("qualified_name"), GRAMS)).alias("gram"))


def word_grams(word: Column) -> Column:
    """Substrings of a word that every name with the word lists: all of the greatest length in `GRAMS` that it has."""
    out = F.array(word)
    for n in GRAMS:
        whole = F.filter(_grams(word, [n]), lambda g: F.length(g) == n)  # noqa: B023  built at once
        out = F.when(F.length(word) >= n, whole).otherwise(out)
    return out


@dataclass
class SearchTables:
    """Index tables of the search; `build_index` writes them, so a query neither numbers nor cuts the symbols."""

    names: DataFrame
    words: DataFrame
    grams: DataFrame

    @classmethod
    def of(cls, symbols: DataFrame) -> SearchTables:
        names = numbered_symbols(symbols)
        return cls(names, token_table(names), gram_table(symbols))

    def words_kept(self) -> SearchTables:
        """The same with names and words written once for a search that reads them several times."""
        names = cut_lineage(self.names)
        return SearchTables(names, cut_lineage(token_table(names)), self.grams)


def _scores(asked: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Hits of every symbol that holds a word of `(repo_hash, key, token)`."""
    return asked.join(words, ["repo_hash", "token"]).groupBy("repo_hash", key, "position").agg(F.sum("hits").alias("hits"))


def _parts(rows: DataFrame, items: str) -> DataFrame:
    """Every non-empty part of the array `items` as `part`, in its order."""
    masks = rows.withColumn("_mask", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.size(items)).cast("int") - 1)))
    return masks.withColumn("part", F.expr(f"filter({items}, (x, i) -> (shiftright(_mask, i) & 1) = 1)")).drop("_mask")


def best_positions(once: DataFrame, words: DataFrame, limit: int) -> DataFrame:
    """The first `limit` symbol positions of each `(repo_hash, search_id, terms)` by hits, without reading long postings for each search.

    Words of at most `limit` symbols are rare: their symbols are scored in full. The other words of a search form its set.
    A symbol without a rare word of the search that is among its best is among the best of the part of the set it holds, so
    each part of the frequent words of a symbol lists its best symbols once, and a set reads the lists of its parts, down to
    the hits that `limit` symbols of one of them reach. Symbols and sets of more than `MAX_PART` frequent words meet postings.
    """
    counted = words.groupBy("repo_hash", "token").agg(F.count("*").alias("df"))
    known = once.select("repo_hash", "search_id", F.explode("terms").alias("token")).join(counted, ["repo_hash", "token"])
    touched = known.where(c("df") <= limit).join(words, ["repo_hash", "token"]).select("repo_hash", "search_id", "position").distinct()
    rare = (
        touched.join(words, ["repo_hash", "position"]).join(once, ["repo_hash", "search_id"]).where(F.array_contains("terms", c("token")))
        .groupBy("repo_hash", "search_id", "position").agg(F.sum("hits").alias("hits"))
    )
    own = F.sort_array(F.collect_list("token"))
    asked = known.where(c("df") > limit).groupBy("repo_hash", "search_id").agg(own.alias("tokens")).withColumn("set_id", F.concat_ws(" ", "tokens"))
    asked = cut_lineage(asked)
    sets = asked.select("repo_hash", "set_id", "tokens").distinct()
    short, long = (sets.where(x) for x in (F.size("tokens") <= MAX_PART, F.size("tokens") > MAX_PART))
    # frequent words of each symbol
    common = words.join(counted.where(c("df") > limit).select("repo_hash", "token"), ["repo_hash", "token"])
    held = common.groupBy("repo_hash", "position").agg(F.sort_array(F.collect_list(F.struct("token", "hits"))).alias("own"))
    parts = _parts(held.where(F.size("own") <= MAX_PART), "own").select(
        "repo_hash", "position", F.concat_ws(" ", F.transform("part", lambda x: x["token"])).alias("part_id"),
        F.aggregate("part", F.lit(0).cast("bigint"), lambda a, x: a + x["hits"]).alias("hits"))
    lists = cut_lineage(top_rows(parts, ["repo_hash", "part_id"], [F.desc("hits"), c("position")], limit))
    stats = lists.groupBy("repo_hash", "part_id").agg(F.max("hits").alias("top"), F.max(F.when(c("rank") == limit, c("hits"))).alias("reached"))
    asks = _parts(short, "tokens").select("repo_hash", "set_id", F.concat_ws(" ", "part").alias("part_id")).join(stats, ["repo_hash", "part_id"])
    floor = asks.groupBy("repo_hash", "set_id").agg(F.coalesce(F.max("reached"), F.lit(0)).alias("floor"))
    useful = asks.join(floor, ["repo_hash", "set_id"]).where("top >= floor").select("repo_hash", "set_id", "part_id", "floor")
    found = useful.join(lists, ["repo_hash", "part_id"]).where("hits >= floor").groupBy("repo_hash", "set_id", "position").agg(F.max("hits").alias("hits"))
    of_words = ["repo_hash", "set_id", F.explode("tokens").alias("token")]
    wide = common.join(held.where(F.size("own") > MAX_PART).select("repo_hash", "position"), ["repo_hash", "position"], "left_semi")
    found = found.unionByName(_scores(short.select(*of_words), wide, "set_id")).unionByName(_scores(long.select(*of_words), common, "set_id"))
    heads = top_rows(found, ["repo_hash", "set_id"], [F.desc("hits"), c("position")], limit).drop("rank")
    rows = asked.select("repo_hash", "search_id", "set_id").join(heads, ["repo_hash", "set_id"]).drop("set_id").unionByName(rare)
    scored = rows.groupBy("repo_hash", "search_id", "position").agg(F.max("hits").alias("hits"))
    return top_rows(scored, ["repo_hash", "search_id"], [F.desc("hits"), c("position")], limit)


def text_search(searches: DataFrame, symbols: DataFrame, limit: int = TOP_CANDIDATES, tables: SearchTables | None = None) -> DataFrame:
    """Whole-word OR search, best first: `(query_id, repo_hash, symbol_id, hits, rank)`.

    Each distinct set of words that some symbol of the repository holds is answered once, under a hash of the words
    (`best_positions`); only kept rows get their symbol back and fan out last to the requests that asked for them.
    """
    stored = tables or SearchTables.of(symbols).words_kept()
    rows = cut_lineage(searches.select("query_id", "repo_hash", F.array_sort(F.array_distinct(text.search_tokens(c("search")))).alias("said")))
    asked = cut_lineage(_held_words(rows, "said", stored.words).where("terms IS NOT NULL").select(
        "query_id", "repo_hash", "terms", F.xxhash64("repo_hash", "terms").alias("search_id")))
    once = asked.select("repo_hash", "search_id", "terms").distinct()
    best = best_positions(once, stored.words, limit)
    named = best.join(stored.names.select("repo_hash", "position", "symbol_id"), ["repo_hash", "position"])
    return fan_out(asked.select("query_id", "search_id"), named.drop("position"), "search_id").select("query_id", "repo_hash", "symbol_id", "hits", "rank")


def _held_words(rows: DataFrame, said: str, words: DataFrame) -> DataFrame:
    """Rows with `terms`, the words of the array `said` that some symbol of the repository holds, in order; null when there is none."""
    each = rows.select("repo_hash", said).distinct().withColumn("token", F.explode(said))
    held = each.join(words.select("repo_hash", "token").distinct(), ["repo_hash", "token"]).groupBy("repo_hash", said).agg(
        F.sort_array(F.collect_list("token")).alias("terms"))
    return rows.join(held, ["repo_hash", said], "left")


def first_word() -> Column:
    """First word of `search` in lower case, or the empty text."""
    return F.lower(F.coalesce(F.try_element_at(F.split(F.trim("search"), r"\s+"), F.lit(1)), F.lit("")))


def substring_search(searches: DataFrame, symbols: DataFrame, limit: int = TOP_CANDIDATES, tables: SearchTables | None = None) -> DataFrame:
    """Names containing the first word of the search, any case.

    Substrings of names are listed (`gram_table`); a word is looked up by the rarest of its own, so it meets few of the names
    that do not hold it. Only substrings of some word are read.
    """
    asked = searches.select("query_id", "repo_hash", first_word().alias("word")).where("word <> ''")
    once = cut_lineage(asked.select("repo_hash", "word").distinct())
    table = tables.grams if tables else gram_table(symbols)
    pieces = once.withColumn("gram", F.explode(word_grams(c("word"))))
    wanted = broadcast_small(pieces.select("repo_hash", "gram").distinct())
    sizes = table.join(wanted, ["repo_hash", "gram"], "left_semi").groupBy("repo_hash", "gram").agg(F.count("*").alias("n"))
    rarest = pieces.join(sizes, ["repo_hash", "gram"], "left").groupBy("repo_hash", "word").agg(
        F.min_by(F.struct("gram", "n"), F.struct(F.coalesce("n", F.lit(0)), c("gram"))).alias("best")).where("best.n IS NOT NULL")
    rarest = broadcast_small(cut_lineage(rarest.select("repo_hash", "word", c("best.gram").alias("gram"))))
    hits = table.join(rarest, ["repo_hash", "gram"]).where(F.lower("qualified_name").contains(c("word")))
    best = top_rows(hits.select("repo_hash", "word", "symbol_id", "qualified_name"), ["repo_hash", "word"],
                    [c("qualified_name"), c("symbol_id")], limit)
    return asked.join(best, ["repo_hash", "word"]).select("query_id", "repo_hash", "symbol_id", "rank")


def search_with_fallback(searches: DataFrame, symbols: DataFrame, limit: int = TOP_CANDIDATES, tables: SearchTables | None = None) -> DataFrame:
    """Word search; requests it leaves empty are answered by the substring search.

    The hits are frozen: they are read twice here, and a search is the dearest step of a query.
    """
    words = cut_lineage(text_search(searches, symbols, limit, tables).select("query_id", "repo_hash", "symbol_id"))
    missed = searches.join(words.select("query_id").distinct(), "query_id", "left_anti")
    return words.unionByName(substring_search(missed, symbols, limit, tables).drop("rank"))


def effective_searches(tasks: DataFrame, words: DataFrame) -> DataFrame:
    """Id, repository, type, seed and `search` of each task: the words of its text that some symbol holds, or its first word, on which alone a text without such words depends."""
    seed = [x for x in ("task_type", "seed_symbol") if x in tasks.columns]
    rows = tasks.select("query_id", "repo_hash", *seed, search_text().alias("search"))
    rows = cut_lineage(rows.withColumn("_terms", F.array_sort(F.array_distinct(text.search_tokens(c("search"))))))
    rows = _held_words(rows, "_terms", words)
    return cut_lineage(rows.withColumn("search", F.coalesce(F.array_join("terms", " "), first_word())).drop("_terms", "terms"))


def equal_tasks(tasks: DataFrame, columns: list[str], query_vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tasks of one request (`lead`) of each set of requests that agree in all their rows of `columns` and in their vectors,
    and `(query_id, lead)` of every request. Rows without id are left out.
    """
    rows = tasks.where("query_id IS NOT NULL").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("asked"))
    key = ["asked"]
    if query_vectors is not None:
        vector = F.sha2(F.to_json(F.struct("query_vector")), 256)
        own = query_vectors.groupBy("query_id").agg(F.sort_array(F.collect_list(vector)).alias("vectors"))
        rows, key = rows.join(own, "query_id", "left"), ["asked", "vectors"]
    rows = cut_lineage(rows.select("query_id", F.sha2(F.to_json(F.struct(*key)), 256).alias("ask")))
    leads = rows.groupBy("ask").agg(F.min("query_id").alias("lead"))
    first = tasks.join(leads.select(c("lead").alias("query_id")), "query_id", "left_semi")
    return first, rows.join(leads, "ask").select("query_id", "lead")


def _found(tasks: DataFrame, symbols: DataFrame, limit: int, vector_hits: DataFrame | None, tables: SearchTables) -> DataFrame:
    """`candidates` of tasks with their `search`, each by itself."""
    found = search_with_fallback(tasks.select("query_id", "repo_hash", "search"), symbols, limit, tables)
    if "seed_symbol" in tasks.columns:
        seeds = tasks.select("query_id", "repo_hash", c("seed_symbol").alias("qualified_name")).join(
            symbols.select("repo_hash", "qualified_name", "symbol_id"), ["repo_hash", "qualified_name"]
        )
        found = found.unionByName(seeds.drop("qualified_name"))
    if vector_hits is not None:
        found = found.unionByName(vector_hits.select("query_id", "repo_hash", "symbol_id"))
    found = cut_lineage(found.distinct())
    left_over = tasks.select("query_id", "repo_hash").join(found.select("query_id").distinct(), "query_id", "left_anti")
    first = top_rows(symbols.select("repo_hash", "qualified_name", "symbol_id"), ["repo_hash"],
                     [c("qualified_name"), c("symbol_id")], limit)
    return found.unionByName(left_over.join(first, "repo_hash").select("query_id", "repo_hash", "symbol_id"))


def candidates(
    tasks: DataFrame, symbols: DataFrame, limit: int = TOP_CANDIDATES, vector_hits: DataFrame | None = None, tables: SearchTables | None = None
) -> DataFrame:
    """Candidate symbols `(query_id, repo_hash, symbol_id)` of each task.

    Search hits and the seed symbol (and vector hits when given); a task with none gets the first symbols
    of its repository. Tasks of equal effect are searched once and fan out last.
    """
    tables = tables or SearchTables.of(symbols).words_kept()
    seed = [x for x in ("seed_symbol",) if x in tasks.columns]
    rows = effective_searches(tasks, tables.words)
    if vector_hits is not None:
        return _found(rows, symbols, limit, vector_hits, tables)
    first, askers = equal_tasks(rows, ["repo_hash", "search", *seed])
    found = _found(cut_lineage(first), symbols, limit, None, tables)
    out = fan_out(askers, found.withColumnRenamed("query_id", "lead"), "lead").select("query_id", "repo_hash", "symbol_id")
    bare = rows.where("query_id IS NULL")
    return out if bare.isEmpty() else out.unionByName(_found(bare, symbols, limit, None, tables))
