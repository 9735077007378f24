"""Facts, symbols, references and invariants of small source files."""

import pytest
from pyspark.sql import functions as F

from repolens.operators import invariants, symbols
from repolens.plans.index_build import build_index, write_index
from repolens.sources import facts as fa
from repolens.sources import tree
from repolens.sources.tables import read_table

PY = '''"""doc"""
import os, sys as system
from pkg.util import helper as h, other
from . import near

LIMIT = 3
a, b = 1, 2

@deco(1)
def top(x, y=(1, 2)):
    """Doc."""
    if not x:
        return None
    h.run(y)
    def inner(z):
        return other(z)
    if y:
        def hidden():
            return top(1)
    return os.path.join(x)

class Base(h.Thing, metaclass=M):
    kind: int = 1
    async def go(self):
        await self.top()
'''

TS = '''import Def, { foo, bar as baz } from './m';
import * as ns from "./n";
// function commented() {}
export interface Shape { a: number }
export type Id = string;
export class Foo extends Def.Base implements Shape {
  private x = 1;
  bar(a: string): void { if (a) { baz(a); } ns.go(); }
}
export const arrow = async (q: number) => { return foo(q); };
const value = 3;
export function plain(a, b) { const s = "foo("; return new Foo(); }
'''


def rows(spark, *files):
    src = spark.createDataFrame([("r", "/w", p, t) for p, t in files], "repo_hash string, root string, file_path string, content string")
    return fa.syntax_facts(src)


def test_python_symbols(spark):
    got = {(r.qualified_name, r.kind, r.line_start, r.line_end, r.signature) for r in symbols.raw_symbols(rows(spark, ("/w/pkg/mod.py", PY))).collect()}
    assert got == {
        ("pkg.mod.LIMIT", "variable", 6, 6, "LIMIT"),
        ("pkg.mod.top", "function", 10, 20, "top(x, y=(1, 2))"),
        ("pkg.mod.top.inner", "method", 15, 16, "inner(z)"),
        ("pkg.mod.Base", "class", 22, 25, "class Base(h.Thing, metaclass=M)"),
        ("pkg.mod.Base.go", "method", 24, 25, "go(self)"),
    }


def test_python_refs(spark):
    got = sorted((r.source_qname, r.target_qname, r.edge_kind) for r in symbols.raw_refs(rows(spark, ("/w/pkg/mod.py", PY))).collect())
    top, inner = "pkg.mod.top", "pkg.mod.top.inner"
    assert got == sorted([
        (top, "pkg.util.helper.run", "calls"), (top, "pkg.util.other", "calls"), (inner, "pkg.util.other", "calls"), (top, "top", "calls"),
        (top, "os.path.join", "calls"), ("pkg.mod.Base.go", "self.top", "calls"),
        ("pkg.mod.Base", "pkg.util.helper", "inherits"), ("pkg.mod.Base", "metaclass=M", "inherits"),
    ])


def test_earliest_import_wins(spark):
    got = symbols.alias_table(rows(spark, ("/w/a.py", "import x.y\nfrom q import x\nimport m.a, m.b\n"))).collect()
    assert {(r.head, r.resolved) for r in got} == {("x", "x.y"), ("m", "m.b")}


def test_typescript(spark):
    facts = rows(spark, ("/w/src/foo.ts", TS))
    got = {(r.qualified_name, r.kind, r.signature) for r in symbols.raw_symbols(facts).collect()}
    assert got == {
        ("src.foo.Shape", "type", "Shape"), ("src.foo.Id", "type", "Id"), ("src.foo.Foo", "class", "class Foo"), ("src.foo.Foo.bar", "method", "bar(a: string)"),
        ("src.foo.arrow", "function", "arrow(q: number)"), ("src.foo.plain", "function", "plain(a, b)"),
    }
    refs = {(r.source_qname, r.target_qname, r.edge_kind) for r in symbols.raw_refs(facts).collect()}
    assert refs == {
        ("src.foo.Foo", "./m.default.Base", "inherits"), ("src.foo.Foo.bar", "./m.bar", "calls"), ("src.foo.Foo.bar", "./n.go", "calls"), ("src.foo.arrow", "./m.foo", "calls"),
    }


def test_bad_file_is_reported(spark):
    facts = rows(spark, ("/w/a.py", "def (:\n"), ("/w/b.py", "x = 1\n"), ("/w/c.txt", "no"))
    assert fa.parse_report(facts).first().asDict() == {"repo_hash": "r", "parsed": 1, "failed": 1}


def test_mining(spark):
    code = "def run(x):\n    if x is None:\n        raise ValueError\n    assert x > 1\n    return x\n"
    test = "def test_a():\n    assert 0\n    r = mod.run(2)\n    assert r == 2, 'm'\n    assert   r\n"
    facts = rows(spark, ("/w/mod.py", code), ("/w/tests/test_mod.py", test))
    known = symbols.give_ids(symbols.raw_symbols(facts))
    names = known.select(F.col("symbol_id").alias("target_symbol_id"), "qualified_name")
    got = {(r.qualified_name, r.text, r.source_kind) for r in invariants.mine(facts, known).join(names, "target_symbol_id").collect()}
    assert got == {
        ("mod.run", "x must not be None", "defensive"), ("mod.run", "precondition: x > 1", "defensive"), ("mod.run", "r == 2", "test"), ("mod.run", "r", "test"),
        ("tests.test_mod.test_a", "precondition: 0", "defensive"), ("tests.test_mod.test_a", "precondition: r == 2", "defensive"), ("tests.test_mod.test_a", "precondition: r", "defensive"),
    }
    assert invariants.mine_tests(facts, known)[1].first()["rejected"] == 1


def test_comment_prompts(spark):
    code = "# must be open\ndef close(h):\n    if h:\n        return None\n\ndef free(h):\n    return None\n"
    facts = rows(spark, ("/w/mod.py", code))
    got = invariants.comment_prompts(facts, symbols.give_ids(symbols.raw_symbols(facts))).collect()
    assert [r.source_location for r in got] == ["/w/mod.py:2"]
    assert got[0].prompt.startswith("Function: close(h)\n\nSource:\n```python\ndef close(h):")


def test_tree_scan_and_index(spark, tmp_path):
    root = tmp_path / "w"
    for path, content in {"pkg/a.py": "from pkg.b import f\ndef g():\n    return f()\n", "pkg/b.py": "def f():\n    return 1\n", "node_modules/x.py": "x = 1\n",
                          "ui/c.ts": "export function h() {}\n", "ui/c.d.ts": "x", "notes.txt": "x", ".hid/z.py": "x = 1\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    listed = tree.list_tree(spark, str(root))
    assert tree.scan_summary(listed).first().asDict() == {"seen": 5, "kept": 3, "skipped_suffix": 1, "skipped_declaration": 1}
    tables = build_index(tree.source_files(spark, str(root)))
    assert {r.qualified_name for r in tables["symbols"].collect()} == {"pkg.a.g", "pkg.b.f", "ui.c.h"}
    assert tables["refs"].count() == 1 and tables["flows"].count() == 1
    store = str(tmp_path / "store")
    write_index(tables, store)
    write_index(tables, store)
    assert read_table(spark, store, "symbols").count() == 3
    assert read_table(spark, store, "symbol_embeddings").count() == 3


def test_embedding_failure_keeps_rows(spark):
    def broken(texts):
        raise RuntimeError("down")

    df = spark.createDataFrame([("a b",), ("c",)], "t string")
    assert [r.embedding for r in symbols.embed_texts(df, "t", broken).collect()] == [None, None]
    ok = symbols.embed_texts(df, "t").collect()
    assert all(len(r.embedding) == 384 and sum(x * x for x in r.embedding) == pytest.approx(1.0) for r in ok)


def test_scan_never_opens_pruned_or_oversized_files(spark, tmp_path):
    for path, size in {"a b/ok.py": 20, "node_modules/huge.py": 5000, ".git/x.py": 5000, "big.py": 5000, "lib/c.d.ts": 5, "x.js": 9000}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n" * (size // 6))
    limit = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "1000")
    try:
        files = tree.source_files(spark, str(tmp_path))
        got = {r.file_path.removeprefix(str(tmp_path)): r.content for r in files.collect()}
        assert set(got) == {"/a b/ok.py", "/big.py"} and got["/big.py"] is None and got["/a b/ok.py"].startswith("x = 1")
        report = fa.parse_report(fa.syntax_facts(files)).first()
        assert (report.parsed, report.failed) == (1, 1)
    finally:
        spark.conf.set(limit, before)


def test_index_of_call_texts_has_one_row_for_names_that_end_alike(spark):
    """A last part that every name shares met every name, once for each call."""
    n = 2000
    names = spark.range(n).select(F.lit("r").alias("repo_hash"), F.format_string("m%05d.fn", "id").alias("qualified_name"),
                                  F.format_string("s%05d", "id").alias("symbol_id"), F.col("id").alias("seq"), F.lit("/a.py").alias("file_path"))
    calls = names.select("repo_hash", F.col("qualified_name").alias("call_text")).unionByName(
        spark.createDataFrame([("r", "x.fn"), ("r", "fn"), ("r", "gone")], "repo_hash string, call_text string"))
    found = invariants.resolve_calls(calls, names)
    got = {r.call_text: r.target_symbol_id for r in found.collect()}
    assert got == {f"m{i:05d}.fn": f"s{i:05d}" for i in range(n)} | {"x.fn": "s00000", "fn": "s00000"}
    plan = found._jdf.queryExecution().executedPlan()
    assert largest_output(plan) <= 4 * n + 10


def largest_output(plan):
    """Most rows that a join of the finished plan gave."""
    found, stack = [0], [plan]
    while stack:
        node = stack.pop()
        if "Adaptive" in node.nodeName():
            stack.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            stack.append(node.plan())
            continue
        if "Join" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return max(found)
