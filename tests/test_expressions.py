"""Scalar expressions on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from repolens.functions import labels, paths, text, vectors


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("path,words", [
    ("src/HTTPServer.ts", {"http", "server"}), ("a/user_service.py", {"user", "service"}), ("UserService.ts", {"user", "service"}),
    ("x/my-file.test.py", {"my", "file", "test"}), ("", set()), ("noext", {"noext"}),
])
def test_name_tokens(spark, path, words):
    assert set(one(spark, path, paths.name_tokens)) == words


@pytest.mark.parametrize("path,yes", [("tests/test_foo.py", True), ("pkg/foo_test.py", True), ("src/contest_winner.py", False), ("a\\test\\b.py", True), ("src/testing.py", False)])
def test_test_path(spark, path, yes):
    assert one(spark, path, paths.is_test_path_for_ranking) is yes


@pytest.mark.parametrize("name,tag", [
    ("users.ssn", "ssn"), ("mod.assassin.handler", None), ("check_password", "password"), ("get_pwd", "password"), ("upwd", None),
    ("getApiKey", "token"), ("tax_id_of", "ssn"), ("x.secret.password", "password"),
])
def test_sensitivity(spark, name, tag):
    assert one(spark, name, text.sensitivity) == tag


@pytest.mark.parametrize("question,kind", [
    ("describe the data flow architecture", "describe_architecture"), ("trace taint from login", "trace_data_flow"),
    ("show me an exemplar of the cluster", "find_exemplars"), ("invariants for the user cluster", "find_invariants"), ("add rate limiting", "find_relevant_context"),
])
def test_query_type(spark, question, kind):
    assert one(spark, question, text.query_type) == kind


@pytest.mark.parametrize("task,kind,words", [
    ("Add rate limiting to the API endpoints", "add new code", ["rate", "limiting", "api", "endpoints"]),
    ("explain how login works", "understand", ["explain", "login", "works"]), ("fix the bug", "modify existing", ["fix", "bug"]),
    ("", "modify existing", []), ("the of", "modify existing", ["the", "of"]),
])
def test_decomposition(spark, task, kind, words):
    assert one(spark, task, text.task_type) == kind
    assert one(spark, task, text.task_keywords) == words


def test_repo_id(spark):
    import hashlib

    row = spark.createDataFrame([("https://x/y.git", None), (None, None)], "u string, p string").select(text.repo_id(F.col("u"), F.col("p")).alias("o")).collect()
    assert row[0]["o"] == hashlib.sha256(b"https://x/y.git|").hexdigest()[:12]
    assert row[1]["o"] is None


@pytest.mark.parametrize("cond,out", [
    ("not x", "x must not be falsy/None"), ("a.b is None", "a.b must not be None"), ("x > 3", "guard: x > 3"), ("not f(x)", "guard: not f(x)"), ("x is not None", "guard: x is not None"),
])
def test_guard_text(spark, cond, out):
    assert one(spark, cond, text.guard_text) == out


def test_fences_json_and_url(spark):
    assert one(spark, "```json\n{\"a\": 1}\n```", text.strip_fences) == '{"a": 1}'
    assert one(spark, "so: {\"a\": {}} end", text.outer_json) == '{"a": {}}'
    assert one(spark, "none", text.outer_json) is None
    assert one(spark, "index https://github.com/o/r please", text.git_url) == "https://github.com/o/r"


@pytest.mark.parametrize("kind,relation", [("inherits", "inheritance"), ("class_extends", "inheritance"), ("implements", "realization"), ("owns", "composition"), ("has_a", "aggregation"), ("calls", "association"), ("allows", "dependency")])
def test_relation(spark, kind, relation):
    assert one(spark, kind, labels.relation) == relation


@pytest.mark.parametrize("path,tier", [("db/x.py", "Database"), ("frontend/a.ts", "Frontend"), ("x/react/a.ts", "Frontend"), ("x/a.tsx", "Frontend"), ("x/a.py", "Backend"), ("", "Backend")])
def test_tier(spark, path, tier):
    assert one(spark, path, labels.tier) == tier


def test_vectors(spark):
    row = spark.sql("SELECT array(1f, 0f) a, array(1f, 1f) b, array(1f) s, cast(null as array<float>) n, array(0f, 0f) z")
    got = row.select(*[vectors.cosine(F.col("a"), F.col(x)).alias(x) for x in "bsnz"]).first()
    assert got["b"] == pytest.approx(0.70710678) and got["s"] == got["n"] == got["z"] == 0.0
    run = spark.sql("SELECT array('a','b','c') a, array('a','x','c') b").select(vectors.shared_prefix_length(F.col("a"), F.col("b"))).first()[0]
    assert run == 1
