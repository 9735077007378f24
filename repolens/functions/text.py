"""Text, name and tag expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped from a task text.
TASK_STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "to", "of", "in", "on", "for", "with", "by", "is", "are", "be",
    "this", "that", "these", "those", "it", "its", "i", "you", "we", "they", "how", "what", "where",
    "when", "why", "find", "show", "make", "add", "use",
)
# Verbs that set the task type.
ADD_VERBS = ("add ", "create ", "build ", "introduce ", "implement ")
UNDERSTAND_WORDS = ("explain", "understand", "describe", "what does", "how does")
# Task types.
TASK_TYPES = ("add new code", "modify existing", "understand")
# Folder words with a set short tag.
TAG_ABBREVIATIONS = {
    "authentication": "AUTH", "auth": "AUTH", "authorization": "AUTHZ", "database": "DB",
    "persistent": "STORAGE", "persistence": "STORAGE", "storage": "STORAGE", "utility": "UTILS",
    "utilities": "UTILS", "configuration": "CONFIG", "controllers": "CONTROL", "middleware": "MIDDLE",
}
# Words of a role text that never become a tag.
ROLE_STOPWORDS = (
    "the", "a", "an", "this", "that", "these", "those", "manages", "handles", "provides", "implements",
    "contains", "serves", "represents", "defines", "is", "are", "and", "or", "with", "for", "to", "of",
    "in", "on", "by", "as", "cluster", "module", "component", "system", "code", "files",
)
# Sensitivity tags in the order they are tried.
SENSITIVITY_PATTERNS = (
    ("password", r"(?i)password|passwd|(?<![a-zA-Z])pwd(?![a-zA-Z])"),
    ("token", r"(?i)token|api[_-]?key|secret|auth[_-]?token"),
    ("ssn", r"(?i)(?<![a-zA-Z])ssn(?![a-zA-Z])|social[_-]?security|tax[_-]?id"),
)


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def repo_id(git_url: Column, local_path: Column) -> Column:
    """First 12 hex digits of sha256(`git_url|local_path`); null when both are empty."""
    url, path = F.coalesce(git_url, F.lit("")), F.coalesce(local_path, F.lit(""))
    return F.when(
        (url != "") | (path != ""), F.substring(F.sha2(F.concat(url, F.lit("|"), path), 256), 1, 12)
    )


def row_id(*keys: Column) -> Column:
    """Deterministic id of a row from its key columns."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]), 256)


def sensitivity(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for tag, pattern in reversed(SENSITIVITY_PATTERNS):
        out = F.when(name.rlike(pattern), tag).otherwise(out)
    return out


def looks_like_identifier(text: Column) -> Column:
    return F.element_at(F.split(text, r"\."), 1).rlike(r"^[A-Za-z_]\w*$")


def guard_text(condition: Column) -> Column:
    """English form of a guard condition; the raw text when no short form fits."""
    raw = strip(condition)
    negated = strip(F.substr(raw, F.lit(5)))
    compared = strip(F.regexp_replace(raw, r"(?s) is None$", ""))
    return (
        F.when(raw == "", F.lit(None).cast("string"))
        .when(raw.startswith("not ") & looks_like_identifier(negated), F.concat(negated, F.lit(" must not be falsy/None")))
        .when(raw.endswith(" is None") & looks_like_identifier(compared), F.concat(compared, F.lit(" must not be None")))
        .otherwise(F.concat(F.lit("guard: "), raw))
    )


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def short_tag(raw: Column) -> Column:
    """Upper-snake tag of at most 12 characters."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    known = F.create_map(*[F.lit(x) for pair in TAG_ABBREVIATIONS.items() for x in pair])
    return (
        F.when(clean == "", "CLUSTER")
        .otherwise(F.coalesce(F.try_element_at(known, clean), F.substring(F.upper(clean), 1, 12)))
    )


def role_tag(role: Column) -> Column:
    """Tag from the first useful word of a role text."""
    words = F.filter(
        F.regexp_extract_all(F.lower(role), F.lit(r"([a-z]+)"), 1),
        lambda w: (F.length(w) > 2) & ~w.isin(*ROLE_STOPWORDS),
    )
    return F.when(F.size(words) > 0, short_tag(F.element_at(words, 1))).otherwise("CLUSTER")


def task_words(task: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(F.coalesce(task, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_]+)"), 1), F.lower
    )


def task_keywords(task: Column) -> Column:
    """At most eight words; all words when only stopwords are left."""
    words = task_words(task)
    kept = F.filter(words, lambda w: ~w.isin(*TASK_STOPWORDS))
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(words), 1, 8)


def task_type(task: Column) -> Column:
    lowered = F.lower(F.coalesce(task, F.lit("")))

    def any_of(parts):
        out = F.lit(False)
        for part in parts:
            out = out | lowered.contains(part)
        return out

    return (
        F.when(F.size(task_words(task)) == 0, "modify existing")
        .when(any_of(ADD_VERBS), "add new code")
        .when(any_of(UNDERSTAND_WORDS), "understand")
        .otherwise("modify existing")
    )


def strip_fences(text: Column) -> Column:
    """Drop a leading code-fence line and a trailing fence."""
    t = strip(text)
    body = F.when(t.contains("\n"), F.regexp_replace(t, r"(?s)\A[^\n]*\n", "")).otherwise(F.substr(t, F.lit(4)))
    return F.when(t.startswith("```"), strip(F.regexp_replace(body, r"```\z", ""))).otherwise(t)


def outer_json(text: Column) -> Column:
    """Text from the first `{` to the last `}`; null when there is none."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def question_symbol(question: Column) -> Column:
    """First dotted name among the words of a question."""
    words = F.split(F.coalesce(question, F.lit("")), r"\s+")
    return F.try_element_at(
        F.filter(words, lambda w: w.contains(".") & w.rlike(r"^[A-Za-z0-9_.]+$") & w.rlike("[A-Za-z0-9]")), F.lit(1)
    )


# Fixed value: a git address inside a message.
GIT_URL = r"(?i)(https?://[^\s]+?\.git\b|https?://github\.com/[^\s/]+/[^\s/?#]+|git@[^\s:]+:[^\s]+\.git)"


def git_url(message: Column) -> Column:
    found = F.regexp_extract(message, GIT_URL, 1)
    return F.when(found != "", found)


def without_git_url(message: Column) -> Column:
    return collapse_spaces(F.regexp_replace(message, GIT_URL, " "))


def query_type(question: Column) -> Column:
    """Keyword routing of a free question, most specific words first."""
    q = F.lower(F.coalesce(question, F.lit("")))

    def has(*words):
        out = F.lit(False)
        for word in words:
            out = out | q.contains(word)
        return out

    return (
        F.when(has("exemplar", "template"), "find_exemplars")
        .when(has("invariant", "constraint"), "find_invariants")
        .when(
            has("architecture", "convention", "cluster", "region", "how is the codebase organized"),
            "describe_architecture",
        )
        .when(has("flow", "taint", "trace"), "trace_data_flow")
        .otherwise("find_relevant_context")
    )


def token_estimate(n_chars: Column) -> Column:
    """About four characters per token, at least one for any text."""
    return F.when(F.coalesce(n_chars, F.lit(0)) == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.floor(n_chars / 4))
    ).cast("bigint")


def search_tokens(*texts: Column) -> Column:
    """Whole words of the searched text; underscore names stay one word."""
    joined = F.lower(F.concat_ws(" ", *texts))
    return F.filter(F.split(joined, r"[^a-z0-9_]+"), lambda t: t != "")


def parent_class(kind: Column, qualified_name: Column) -> Column:
    return F.when(
        (kind == "method") & qualified_name.contains("."),
        F.regexp_replace(qualified_name, r"\.[^.]*$", ""),
    )


def last_segment(qualified_name: Column) -> Column:
    return F.element_at(F.split(qualified_name, r"\."), -1)


def embedding_text(kind: Column, qualified_name: Column, signature: Column) -> Column:
    return F.trim(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (kind, qualified_name, signature)]))
