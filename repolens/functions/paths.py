"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that are never scanned.
SKIP_DIRS = (
    "__pycache__", ".git", ".venv", "venv", "node_modules", ".next", ".mypy_cache",
    ".pytest_cache", ".tox", "dist", "build", ".idea", ".vscode",
)


def split_path(path: Column) -> Column:
    """Path parts, split on both slashes, empty parts dropped."""
    return F.filter(F.split(path, r"[\\/]"), lambda p: p != "")


def directory_parts(path: Column) -> Column:
    parts = split_path(path)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def directory_of(path: Column) -> Column:
    """Directory without the leading slash, '' for a bare file name."""
    return F.array_join(directory_parts(path), "/")


def dirname(path: Column) -> Column:
    """Everything before the last '/', '' when there is none."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(split_path(path), F.lit(-1)), F.lit(""))


def stem_of(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def name_tokens(path: Column) -> Column:
    """Distinct lower-case words of the base name: split on _ - . and on case changes."""
    stem = stem_of(base_name(path))
    return F.array_distinct(
        F.transform(
            F.filter(F.flatten(F.transform(F.split(stem, r"[_\-.]"), split_camel)), lambda t: t != ""),
            F.lower,
        )
    )


def split_camel(token: Column) -> Column:
    """Cut at lower/digit -> Upper and at ACRONYM -> Word boundaries."""
    return F.filter(F.split(token, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"), lambda t: t != "")


def suffix_pattern(path: Column) -> Column:
    """`*_<last word>.<ext>` of a file name, null when the name has no word."""
    name = base_name(path)
    words = F.filter(F.split(stem_of(name), r"[_\-.]"), lambda t: t != "")
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    return F.when(
        F.size(words) > 0,
        F.concat(F.lit("*_"), F.lower(F.element_at(words, -1)), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise("")),
    )


def language_of(path: Column) -> Column:
    """Parser choice by extension, null when the file is not supported."""
    ext = F.regexp_extract(F.lower(path), r"\.([^.]*)$", 1)
    return (
        F.when(ext == "py", "python").when(ext == "ts", "typescript").when(ext == "tsx", "tsx")
    )


def is_source_file(path: Column) -> Column:
    """Supported suffix, not a declaration file (case-sensitive, as file systems are)."""
    return path.rlike(r"\.(py|ts|tsx)$") & ~path.rlike(r"\.d\.tsx?$")


def in_pruned_directory(relative_path: Column) -> Column:
    """Some directory on the way down is a vendor/cache directory or starts with a dot."""
    return F.exists(
        directory_parts(relative_path), lambda d: d.isin(*SKIP_DIRS) | d.startswith(".")
    )


def module_name(root: Column, path: Column) -> Column:
    """`<root>/pkg/mod.py` -> `pkg.mod`; `__init__` and a TypeScript `index` collapse."""
    prefix = F.concat(F.regexp_replace(root, r"/+$", ""), F.lit("/"))
    inside = F.when(path.startswith(prefix), F.substr(path, F.length(prefix) + 1)).otherwise(base_name(path))
    parts = split_path(F.regexp_replace(inside, r"\.[^./]*$", ""))
    is_ts = F.lower(path).rlike(r"\.tsx?$")
    collapses = (F.element_at(parts, -1) == "__init__") | ((F.element_at(parts, -1) == "index") & is_ts)
    kept = F.when(collapses, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.size(kept) > 0, F.array_join(kept, ".")).otherwise(stem_of(base_name(path)))


def is_test_path_for_ranking(path: Column) -> Column:
    """A part `test`/`tests`, or a base name `test_*` / `*_test.py`."""
    clean = F.regexp_replace(path, r"\\", "/")
    return clean.rlike(r"(^|/)tests?(/|$)") | clean.rlike(r"(^|/)test_[^/]*$") | clean.endswith("_test.py")


def is_test_path_for_mining(path: Column) -> Column:
    """Base name `test_*.py` / `*_test.py`, or any part equal to `tests` in any case."""
    return path.rlike(r"(^|/)test_[^/]*\.py$") | path.endswith("_test.py") | path.rlike(r"(?i)(^|/)tests(/|$)")


def folder_prefix(path: Column) -> Column:
    """Trimmed path ending in exactly one slash."""
    return F.concat(F.regexp_replace(F.trim(path), r"/+$", ""), F.lit("/"))


def in_folder(path: Column, prefix: Column) -> Column:
    return path.startswith(prefix) | (prefix == "/")


def ancestor_folders(path: Column) -> Column:
    """Every folder above a path, with the leading slash kept for absolute paths."""
    parts = split_path(path)
    lead = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.concat(lead, F.array_join(F.slice(parts, F.lit(1), i), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
