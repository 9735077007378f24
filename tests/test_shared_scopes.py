"""Equal scopes are resolved once; members, counts and admission equal those of scopes resolved one by one."""

import pytest

from repolens.operators import scopes
from test_extraction import largest_output

N = 120


@pytest.fixture(scope="module")
def given(spark):
    files = [("r", f"/a/f{i}.py", "c" if i % 2 else "d") for i in range(20)] + [("r", "/b/x.py", "c"), ("q", "/a/f1.py", "c"), ("q", None, "c")]
    symbols = [("r", f"n{i}", f"/a/f{i % 20}.py") for i in range(40)] + [("r", "n1", "/b/x.py"), ("q", "n1", "/a/f1.py"), (None, "n2", "/a/f2.py"), ("r", None, "/b/x.py")]
    kinds = [("cluster", "c", None, None), ("folder", None, " /a//", None), ("file", None, "/a/f3.py", None), ("symbols", None, None, ["n1", "gone"])]
    rows = [(f"z{i}", "r" if i % 9 else "q", *kinds[i % 4]) for i in range(N)]
    # an id with two contents, an id twice, rows without an id
    rows += [("z0", "r", *kinds[1]), ("z4", "r", *kinds[3]), ("z5", "r", *kinds[1]), (None, "r", *kinds[0]), (None, "r", *kinds[3])]
    asked = [(i, f"z{i}" if i % 11 else None, "r" if i % 9 else "q", t, s, k, p) for i in range(N) for t, s, k, p in [[
        ("find_invariants", "n1", "c", None), ("describe_architecture", None, "c", "/a/"), ("trace_data_flow", "n5", None, None),
        ("find_exemplars", None, "d", None), ("find_relevant_context", "gone", "c", None), ("describe_architecture", None, "d", "/a/f3.py")][i % 6]]]
    asked += [asked[7], (3, "z5", "r", "describe_architecture", None, "d", "/b")]
    return (
        spark.createDataFrame(rows, "scope_id string, repo_hash string, kind string, cluster_id string, path string, qnames array<string>"),
        spark.createDataFrame(files, "repo_hash string, file_path string, cluster_id string"),
        spark.createDataFrame(symbols, "repo_hash string, qualified_name string, file_path string"),
        spark.createDataFrame(asked, "query_id long, scope_id string, repo_hash string, query_type string, symbol string, cluster_id string, path string"),
    )


def same(a, b):
    columns = sorted(b.columns)
    assert sorted(map(repr, a.select(*columns).collect())) == sorted(map(repr, b.select(*columns).collect()))


def one_by_one(table, files, symbols):
    in_files = scopes.scope_files(table, files, symbols)
    return in_files, scopes.scope_names(table, in_files, symbols)


def test_members_of_equal_scopes_are_listed_once(given):
    table, files, symbols, _ = given
    in_files, names = one_by_one(table, files, symbols)
    each = in_files.selectExpr("scope_id", "file_path AS member").unionAll(names.select("scope_id", "qualified_name"))
    same(scopes.scope_members(table, files, symbols), each.where("scope_id IS NOT NULL"))
    once, askers = scopes.shared(table)
    assert once.select("scope_id").distinct().count() < 12 and askers.count() == N
    folders = table.where("kind = 'folder' AND repo_hash = 'r' AND scope_id IS NOT NULL")
    found = scopes.scope_members(folders, files, symbols)
    assert found.count() > 1000  # the members of all scopes come out of one join and meet no shuffle
    in_once = scopes.scope_files(scopes.shared(folders)[0], files, symbols)
    in_once.collect()
    assert largest_output(in_once._jdf.queryExecution().executedPlan()) <= 200


def test_counts_of_equal_scopes(given):
    table, files, symbols, _ = given
    same(scopes.scope_counts(table, files, symbols), scopes.scope_summary(table, *one_by_one(table, files, symbols)))


def test_admission_to_equal_scopes(given):
    table, files, symbols, asked = given
    same(scopes.admit_to_scopes(asked, table, files, symbols), scopes.admit(asked, files, *one_by_one(table, files, symbols)))
    rows = scopes.admit_to_scopes(asked, table, files, symbols)
    rows.collect()
    assert largest_output(rows._jdf.queryExecution().executedPlan()) <= 5 * N
