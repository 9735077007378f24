"""Syntax facts of source files.

The only Python-per-row step: a file becomes flat facts (definitions, imports, calls, statements) in
one `mapInArrow` job. Names, kinds, aliases, signatures of symbols and all mining rules are Spark
expressions over these facts (`repolens.operators.symbols`, `repolens.operators.invariants`).

Python files go through the standard parser. TypeScript files go through a scanner that blanks strings
and comments and then finds declarations by pattern and brace depth. Limits of the scanner: calls on
the result of another call, and text inside template literals, give no fact; a syntax error in Python
loses the file (`parse_status = 'error'`).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import paths

FACT_COLUMNS = (
    "fact string, seq int, scope string, owners array<string>, name string, text string, line int, line_end int, "
    "fn_line int, flag boolean, extra string"
)


class _PythonFacts(ast.NodeVisitor):
    """Facts of one parsed Python file. `scope` is null for definitions a scope walk does not reach."""

    def __init__(self, source: str):
        self.lines = re.split(r"(?<=\n)", source.replace("\r\n", "\n").replace("\r", "\n"))
        self.source, self.rows, self.owners = source, [], []

    def add(self, fact, **values):
        self.rows.append({"fact": fact, "seq": len(self.rows), **values})

    def text(self, node):
        """Source text of a node; columns count UTF-8 bytes."""
        part = self.lines[node.lineno - 1 : node.end_lineno]
        if len(part) == 1 and part[0].isascii():
            return part[0][node.col_offset : node.end_col_offset]
        raw = [line.encode() for line in part]
        raw[-1] = raw[-1][: node.end_col_offset]
        raw[0] = raw[0][node.col_offset :]
        return b"".join(raw).decode()

    def brackets(self, node, parts):
        """Source text of the bracket after a definition's name, given the nodes inside it."""
        body = "".join(self.lines[node.lineno - 1 : node.end_lineno])[len(self.lines[node.lineno - 1].encode()[: node.col_offset].decode()) :]
        start = re.match(r"(?:async\s+)?(?:def|class)\s+\w+\s*(?:\[[^\]]*\])?\s*", body).end()
        if start >= len(body) or body[start] != "(":
            return ""
        last = max((self.text(p) for p in parts), key=lambda t: body.find(t, start) + len(t), default="")
        end = body.find(")", max(start, body.find(last, start) + len(last))) if last else body.find(")", start)
        return body[start : end + 1]

    def run(self):
        self.block(ast.parse(self.source).body, "", True)
        return self.rows

    def block(self, statements, scope, direct):
        for node in statements:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(node, scope if direct else None)
            elif isinstance(node, ast.ClassDef):
                self.class_(node, scope if direct else None)
            else:
                if direct and scope == "" and isinstance(node, (ast.Assign, ast.AnnAssign)):
                    target = node.targets[0] if isinstance(node, ast.Assign) else node.target
                    if isinstance(target, ast.Name):
                        self.add("assign", scope=scope, name=target.id, line=node.lineno, line_end=node.end_lineno)
                self.visit(node)

    def inner(self, name, scope):
        return None if scope is None else f"{scope}.{name}" if scope else name

    def function(self, node, scope):
        a = node.args
        parts = [*a.posonlyargs, *a.args, *a.kwonlyargs, *a.defaults, *filter(None, [*a.kw_defaults, a.vararg, a.kwarg])]
        for part in [*node.decorator_list, a]:
            self.visit(part)
        here = self.inner(node.name, scope)
        self.add("function", scope=scope, name=node.name, text=self.brackets(node, parts), line=node.lineno, line_end=node.end_lineno)
        self.statements(node)
        if here is not None:
            self.owners.append(here)
        self.block(node.body, here if here is not None else "", here is not None)
        if here is not None:
            self.owners.pop()

    def class_(self, node, scope):
        bases = [*node.bases, *node.keywords]
        for part in [*node.decorator_list, *bases]:
            self.visit(part)
        self.add("class", scope=scope, name=node.name, text=self.brackets(node, bases), line=node.lineno, line_end=node.end_lineno)
        for base in bases:
            self.add("base", scope=scope, name=node.name, text=self.text(base), line=node.lineno)
        here = self.inner(node.name, scope)
        self.block(node.body, here if here is not None else "", here is not None)

    def visit_FunctionDef(self, node):
        self.function(node, None)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        self.class_(node, None)

    def visit_Import(self, node):
        for at, a in enumerate(node.names):
            self.add("import", name=a.asname or a.name.split(".")[0], text=a.name, line=node.lineno, fn_line=at)

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        for at, a in enumerate(node.names):
            if a.name != "*" and module != "__future__":
                self.add("import", name=a.asname or a.name, text=f"{module}.{a.name}", line=node.lineno, fn_line=at)

    def visit_Call(self, node):
        self.add("call", owners=list(self.owners), text=self.text(node.func), line=node.lineno)
        self.generic_visit(node)

    def statements(self, fn):
        """Direct statements of a function body, and what a reader's comment could be about."""
        for at, s in enumerate(fn.body):
            calls = [n for n in ast.walk(s) if isinstance(n, ast.Call)]
            last = max(calls, key=lambda n: (n.lineno, n.col_offset, -(n.end_lineno * 10**6 + n.end_col_offset)), default=None)
            kind = "assert" if isinstance(s, ast.Assert) else "if" if isinstance(s, ast.If) else "other"
            self.add(
                "statement", name=kind, text=self.text(s.test) if kind != "other" else None, line=s.lineno, fn_line=fn.lineno, line_end=at,
                flag=kind == "if" and isinstance(s.body[0], (ast.Return, ast.Raise)), extra=self.text(last.func) if last else None)
        above = next((x.strip() for x in reversed(self.lines[: fn.lineno - 1]) if x.strip()), "")
        risky = next((n for n in _backwards(fn.body) if isinstance(n, (ast.Raise, ast.Try)) or (
            isinstance(n, ast.Return) and (n.value is None or (isinstance(n.value, ast.Constant) and n.value.value is None)))), None)
        doc = ast.get_docstring(fn, clean=False) is not None
        if risky is not None and (doc or above.startswith("#")):
            comment = fn.body[0].lineno if doc else max(0, fn.lineno - 1)
            snippet = "".join(self.lines[fn.lineno - 1 : fn.end_lineno]).rstrip("\n")
            self.add("commented", text=snippet, line=abs(risky.lineno - comment), line_end=fn.end_lineno, fn_line=fn.lineno)


def _backwards(nodes):
    for node in reversed(nodes):
        yield node
        yield from _backwards(list(ast.iter_child_nodes(node)))


_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
_TS_IMPORT = re.compile(r"^[ \t]*import\s+(?:type\s+)?([^;'\"]*?)\s*from\s*['\"]([^'\"]+)['\"]", re.M)
_TS_DECL = re.compile(
    r"\b(?:(?P<fn>(?:async\s+)?function)\s*\*?\s*(?P<fname>[\w$]+)|(?:abstract\s+)?class\s+(?P<cname>[\w$]+)(?P<head>[^{]*)"
    r"|(?:interface|type|enum)\s+(?P<tname>[\w$]+)|(?:const|let|var)\s+(?P<aname>[\w$]+)[^=;{(]*=\s*(?P<arrow>(?:async\s*)?(?:function\b|(?:<[^>]*>\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{]*)?=>|[\w$]+\s*=>)))")
_TS_METHOD = re.compile(r"(?:^|[;{}\n])[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set|abstract)\s+)*[*#]?(?P<name>[\w$]+)\s*(?:<[^>]*>)?(?=\()", re.M)
_TS_CALL = re.compile(r"(?<![\w$.)\]])(?P<new>new\s+)?(?P<name>[\w$]+(?:\s*\??\.\s*[\w$]+)*)\s*(?:<[\w\s,.\[\]]*>)?\(")
# Words before a bracket that are not calls.
_TS_WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "constructor", "with"}


def _close(text: str, start: int, pair: str = "{}") -> int:
    """Position after the bracket that closes the one at `start`."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(text, start):
        depth += 1 if m.group() == pair[0] else -1
        if depth == 0:
            return m.end()
    return len(text)


def typescript_facts(source: str) -> list[dict]:
    """Facts of one TypeScript file; only module-level declarations and class methods."""
    code = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)
    rows: list[dict] = []
    line = lambda at: source.count("\n", 0, at) + 1

    def add(fact, **values):
        rows.append({"fact": fact, "seq": len(rows), **values})

    def parameters(at, end):
        opened = code.find("(", at, end)
        return source[opened : _close(code, opened, "()")] if opened >= 0 else ""

    def calls(begin, end, owner):
        for m in _TS_CALL.finditer(code, begin, end):
            name = re.sub(r"\s+", "", m["name"])
            if not m["new"] and name.split(".")[0] not in _TS_WORDS:
                add("call", owners=[owner], text=name, line=line(m.start()))

    for m in _TS_IMPORT.finditer(source):
        clause, module = m.group(1), m.group(2)
        named = re.search(r"\{([^}]*)\}", clause)
        spaced = re.search(r"\*\s*as\s+([\w$]+)", clause)
        default = re.match(r"([\w$]+)", clause)
        if default:
            add("import", name=default.group(1), text=f"{module}.default", line=line(m.start()), fn_line=0)
        if spaced:
            add("import", name=spaced.group(1), text=module, line=line(m.start()), fn_line=1)
        for at, part in enumerate(p.split() for p in (named.group(1).split(",") if named else []) if p.strip()):
            part = [w for w in part if w != "type"]
            add("import", name=part[-1], text=f"{module}.{part[0]}", line=line(m.start()), fn_line=at + 2)

    at = 0
    while m := _TS_DECL.search(code, at):
        at = m.end()
        if code.count("{", 0, m.start()) != code.count("}", 0, m.start()):
            continue
        opened = code.find("{", m.end())
        if m["cname"]:
            opened = code.find("{", m.start())
            end = _close(code, opened)
            add("class", scope="", name=m["cname"], line=line(m.start()), line_end=line(end - 1))
            for base in re.findall(r"\bextends\s+([\w$.]+)", m["head"])[:1]:
                add("base", scope="", name=m["cname"], text=base, line=line(m.start()))
            inner = opened + 1
            while (k := _TS_METHOD.search(code, inner - 1, end)) and k["name"] not in _TS_WORDS - {"constructor"}:
                after = _close(code, k.end(), "()")
                body = re.compile(r"[{;]").search(code, after, end)
                if body and body.group() == "{":
                    stop = _close(code, body.start())
                    add("function", scope=m["cname"], name=k["name"], text=source[k.end() : after], line=line(k.start("name")), line_end=line(stop - 1))
                    calls(body.start(), stop, f"{m['cname']}.{k['name']}")
                    inner = stop
                else:
                    inner = max(after, inner + 1)
            at = end
        elif m["tname"]:
            end = _close(code, opened) if re.match(r"(interface|enum)", m.group()) and opened >= 0 else (code.find(";", m.end()) + 1 or m.end())
            add("type", scope="", name=m["tname"], line=line(m.start()), line_end=line(max(m.start(), end - 1)))
            at = max(at, end)
        else:
            name, start = m["fname"] or m["aname"], m.end() if m["fname"] else m.start("arrow")
            after = _close(code, code.find("(", start), "()") if "(" in code[start : start + 200] else m.end()
            body = re.compile(r"\S").search(code, max(after, m.end()))
            if m["fname"]:
                body = re.compile(r"\{").search(code, after)
            if body and body.group() == "{":
                end = _close(code, body.start())
            else:
                end = (code.find("\n", m.end()) + 1 or len(code)) if m["aname"] else m.end()
            add("function", scope="", name=name, text=parameters(start, after), line=line(m.start("aname") if m["aname"] else m.start()), line_end=line(end - 1))
            calls(body.start() if body else m.end(), end, name)
            at = max(at, end)
    return rows


def _file_facts(lang: str, source: str | None) -> list[dict]:
    """Facts of one file; a file that cannot be read or parsed gives one `error` row."""
    try:
        rows = _PythonFacts(source).run() if lang == "python" else typescript_facts(source)
        return [{"fact": "file", "seq": -1, "flag": True}, *rows]
    except Exception as exc:  # one bad file must not stop the job
        return [{"fact": "file", "seq": -1, "flag": False, "extra": f"{type(exc).__name__}: {exc}"}]


def syntax_facts(source_files: DataFrame, keep: tuple[str, ...] = ("repo_hash", "root", "file_path")) -> DataFrame:
    """Facts of every supported file. Whole texts are parsed; files of other languages are skipped.

    Files are parsed where they are read; no text is shuffled. The scan's splits are the tasks.
    """
    strings, ints = pa.string(), pa.int32()
    types = {"seq": ints, "line": ints, "line_end": ints, "fn_line": ints, "flag": pa.bool_(), "owners": pa.list_(strings)}
    names = [*keep, *(x.split()[0] for x in FACT_COLUMNS.split(", "))]
    layout = pa.schema([(n, types.get(n, strings)) for n in names])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for record in batch.to_pylist():
                base = {k: record[k] for k in keep}
                rows += [base | fact for fact in _file_facts(record["lang"], record["content"])]
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=layout)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=layout)

    ready = source_files.withColumn("lang", paths.language_of(F.col("file_path"))).where("lang IS NOT NULL")
    schema = ", ".join(f"{k} string" for k in keep) + ", " + FACT_COLUMNS
    return ready.select(*keep, "lang", "content").mapInArrow(parse, schema)


def parse_report(facts: DataFrame) -> DataFrame:
    """Parsed and failed files per repository."""
    return facts.where("fact = 'file'").groupBy("repo_hash").agg(
        F.count_if("flag").alias("parsed"), F.count_if(~F.col("flag")).alias("failed"))
