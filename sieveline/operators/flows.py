"""Tainted data flows within a source file, and facts on its structure.

Both need a parser, so they run in Python, batch by batch; each document is worked on by itself and gives a few rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import guards as G
from sieveline.functions import rules as R
from sieveline.functions import text as X
from sieveline.operators.scanners import _base, shaped

MODULE = "__module__"
#: How sure a flow from each kind of source is, what a hop takes away, and the bounds.
SURE = {"user_input": 0.85, "request_param": 0.90, "env_var": 0.70, "file_read": 0.75, "external_data": 0.80}
HOP, LOW, HIGH, PASSES = 0.02, 0.70, 0.90, 5
_PY_ASSIGN = re.compile(r"^\s*(\w+)\s*=\s*(.+)$")
_WORD = re.compile(r"\w+")
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*)")
_SOURCES = {lang: [(re.compile(p), k) for p, k in table] for lang, table in (("python", R.PYTHON_SOURCES), ("javascript", R.JS_SOURCES))}
_SINKS = {lang: [(re.compile(r.regex), r) for r in table] for lang, table in (("python", R.PYTHON_SINKS), ("javascript", R.JS_SINKS))}
#: For each regex the strings, in lower case, of which a match has one; only regexes whose strings a text has run on it.
_HINTS = {p: tuple(G.guard(p.pattern).any_of) or ("",) for table in (*_SOURCES.values(), *_SINKS.values()) for p, _ in table}


def _likely(table: list[tuple], low: str) -> list[tuple]:
    """The rows of a table whose regex may match in a text that is given in lower case."""
    return [row for row in table if any(w in low for w in _HINTS[row[0]])]


@dataclass
class Tainted:
    name: str
    scope: str
    kind: str
    line: int
    path: tuple[str, ...]


def parsed(text: str) -> ast.Module | None:
    """The tree of a Python text, or none if it can't be read."""
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None


def _statements(tree: ast.Module) -> list[ast.AST]:
    """The statements of a tree in the order of ``ast.walk``, which expressions, as they hold none, don't change."""
    found = [tree]
    for node in found:
        for name in node._fields:
            if name in _BODIES:
                found += getattr(node, name) if isinstance(getattr(node, name, None), list) else ()
    return found


_BODIES = {"body", "handlers", "orelse", "finalbody", "cases"}


#: The fields of each kind of node that may lead to a statement, a name or a call.
_CHILDREN = {c: tuple(n for n in c._fields if n not in ("id", "ctx", "attr", "arg", "op", "ops", "module", "level", "kind", "type_comment")) for c in vars(ast).values() if isinstance(c, type) and issubclass(c, ast.AST)}
_CHILDREN[ast.Constant] = ()


def _nodes(tree: ast.Module) -> list[ast.AST]:
    """The nodes of a tree in the order of ``ast.walk``, but for operators and the contexts of names."""
    found = [tree]
    for node in found:
        for name in _CHILDREN[type(node)]:
            x = getattr(node, name, None)
            if isinstance(x, list):
                found += [y for y in x if isinstance(y, ast.AST)]
            elif isinstance(x, ast.AST):
                found.append(x)
    return found


def _python_parts(tree: ast.Module | None, lines: list[str]):
    """(target, line, scope) of assignments and the scope of each line."""
    if tree is None:
        return [(m[1], n, MODULE) for n, x in enumerate(lines, 1) if (m := _PY_ASSIGN.match(x))], {}
    walked = _statements(tree)
    spans = sorted(((f.end_lineno - f.lineno, f.lineno, f.end_lineno, f.name) for f in walked if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))), reverse=True)
    scope = {}
    for _, first, last, name in spans:  # the smallest is written last
        scope.update(dict.fromkeys(range(first, last + 1), name))

    found = []
    for node in walked:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) and node.value is not None else []
        for t in targets:
            for leaf in t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]:
                if isinstance(leaf, ast.Name):
                    found.append((leaf.id, node.lineno, scope.get(node.lineno, MODULE)))
    return found, scope


#: What a JavaScript source is made of, as far as scopes, assignments and definitions go.
_JS_TOKEN = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|\s+)|(?P<text>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<name>[\w$]+)|(?P<sign>=>|[=!]==?|[-+*/%&|^<>]=|.)", re.S
)


@dataclass
class Token:
    kind: str
    said: str
    line: int


@dataclass
class Function:
    name: str
    exported: bool
    first: int
    last: int


class JavaScript:
    """Functions with a name, the scope of each line, assignments, and names that are called or exported."""

    def __init__(self, text: str) -> None:
        self.tokens: list[Token] = []
        line = 1
        for m in _JS_TOKEN.finditer(text):
            if m.lastgroup != "skip":
                self.tokens.append(Token(m.lastgroup, m[0], line))
            line += m[0].count("\n")
        self.pair = self._brackets()
        self.functions: list[Function] = []
        self.scope: dict[int, str] = {}
        self.assigned: list[tuple[str, int]] = []
        self.called: set[str] = set()
        self.exported: set[str] = set()
        ends = {t.line: t.said for t in self.tokens}
        for k, t in enumerate(self.tokens):
            if t.kind != "name":
                continue
            before, after = self.said(k - 1), self.said(k + 1)
            if after == "(" and before != "function":
                self.called.add(t.said)
            if t.said == "export" and after == "{":
                self._export_list(k + 1)
            if before == "function":
                self._function(k, self._start(k - 1), k + 1)
            elif after == "=" and before in ("const", "let", "var"):
                self._function(k, self._start(k - 1), k + 2)
            fresh = k == 0 or before in ("const", "let", "var") or self.tokens[k - 1].line < t.line
            # A statement counts if its line's last sign, a semicolon, ends it.
            if after == "=" and fresh and ends[t.line] == ";" and self.said(k + 2) != ";":
                self.assigned.append((t.said, t.line))

    def said(self, k: int) -> str:
        return self.tokens[k].said if 0 <= k < len(self.tokens) else ""

    def _brackets(self) -> dict[int, int]:
        pair, open_ = {}, []
        for k, t in enumerate(self.tokens):
            if t.kind == "sign" and t.said in "({[":
                open_.append(k)
            elif t.kind == "sign" and t.said in ")}]":
                while open_:
                    o = open_.pop()
                    if self.tokens[o].said + t.said in ("()", "{}", "[]"):
                        pair[o] = k
                        break
        return pair

    def _start(self, k: int) -> int:
        """Where the statement starts whose keyword is ``k``."""
        while self.said(k - 1) in ("async", "default", "export"):
            k -= 1
        return k

    def _function(self, name: int, start: int, at: int) -> None:
        """Notes the function of that name whose parameters, or value, begin at token ``at``; its lines are its scope."""
        if self.said(at) == "async":
            at += 1
        if self.said(name - 1) != "function":
            if self.said(at) == "function":
                at += 1
                while self.said(at) != "(" and at < len(self.tokens):
                    at += 1
                body = self.pair.get(at, at) + 1
            else:
                arrow = self.pair.get(at, at) + 1
                if self.said(arrow) != "=>":
                    return
                body = arrow + 1
        else:
            body = self.pair.get(at, at) + 1
        first = self.tokens[name].line
        if self.said(body) != "{":
            last = self.tokens[min(body, len(self.tokens) - 1)].line
        else:
            last = self.tokens[self.pair.get(body, len(self.tokens) - 1)].line
            if self.tokens[body].line == first:
                self.scope.update(dict.fromkeys(range(first, last + 1), self.said(name)))  # an inner function comes later
        self.functions.append(Function(self.said(name), self.said(start) == "export", first, last))

    def _export_list(self, at: int) -> None:
        """The names of ``export { a, b as c }``: those within the module."""
        for k in range(at + 1, self.pair.get(at, at + 1)):
            if self.tokens[k].kind == "name" and self.said(k - 1) in ("{", ","):
                self.exported.add(self.said(k))


def _js_parts(text: str):
    js = JavaScript(text)
    return [(name, n, js.scope.get(n, MODULE)) for name, n in js.assigned], js.scope


def _tainted(lines: list[str], assigned: list[tuple[str, int, str]], sources: list[tuple]) -> list[Tainted]:
    """The tainted variables in the order in which they are reached: a breadth-first walk over what each assignment uses,
    from those whose line holds a source, ``PASSES`` steps deep."""
    at = lambda n: lines[n - 1] if 0 < n <= len(lines) else ""
    uses: dict[str, list[int]] = {}
    known, reached = [], set()
    for k, (name, n, scope) in enumerate(assigned):
        for word in set(_WORD.findall(at(n))):
            uses.setdefault(word, []).append(k)
        kind = next((k for p, k in sources if p.search(at(n))), None)
        if kind:
            known.append(Tainted(name, scope, kind, n, (name,)))
            reached.add((name, scope))
    wave = known
    for _ in range(PASSES):
        origin: dict[int, Tainted] = {}
        for t in wave:
            for k in uses.get(t.name, ()):
                if t.scope in (MODULE, assigned[k][2]):
                    origin.setdefault(k, t)
        wave = []
        for k in sorted(origin):
            name, _, scope = assigned[k]
            if (name, scope) not in reached:
                reached.add((name, scope))
                wave.append(Tainted(name, scope, origin[k].kind, origin[k].line, (*origin[k].path, name)))
        if not wave:
            break
        known = known + wave
    return known


def flows(text: str, language: str, tree: ast.Module | None = None) -> Iterator[dict]:
    """The flows of one document; only Python and JavaScript have any. A Python text that is parsed already brings its tree."""
    if not text or language not in _SINKS:
        return
    low = text.lower()
    sources, sinks = _likely(_SOURCES[language], low), _likely(_SINKS[language], low)
    if not sources or not sinks:
        return
    lines = text.splitlines()
    assigned, scopes = _python_parts(tree or parsed(text), lines) if language == "python" else _js_parts(text)
    visible: dict[str, dict[str, Tainted]] = {}
    for t in _tainted(lines, assigned, sources):
        visible.setdefault(t.scope, {})[t.name] = t
    if not visible:
        return
    for n, line in enumerate(lines, 1):
        seen, told = None, set()
        for pattern, rule in sinks:
            m = pattern.search(line) if rule.name not in told else None
            if not m:
                continue
            if seen is None:
                seen = {} if _COMMENT.match(line) else visible.get(MODULE, {}) | visible.get(scopes.get(n, MODULE), {})
            rest = line[m.end() :]
            words = set(_WORD.findall(rest))
            t = next((t for name, t in seen.items() if name in words), None)
            if t:
                told.add(rule.name)
                yield {
                    "sink": rule.name, "finding_type": rule.finding_type, "severity": rule.severity, "cwe_ids": list(rule.cwe_ids), "line_number": n,
                    "source_line": t.line, "taint_kind": t.kind, "path": list(t.path), "matched_text": rest.strip().rstrip(")"),
                    "confidence": max(LOW, min(HIGH, SURE[t.kind] - HOP * (len(t.path) - 1))), "width": len(line),
                }


#: What a flow is in a batch of Arrow; each with its type in Spark's SQL.
_FLOW = {
    "doc_id": (pa.int64(), "long"), "file_path": (pa.string(), "string"), "sink": (pa.string(), "string"), "finding_type": (pa.string(), "string"), "severity": (pa.string(), "string"),
    "cwe_ids": (pa.list_(pa.string()), "array<string>"), "line_number": (pa.int32(), "int"), "source_line": (pa.int32(), "int"), "taint_kind": (pa.string(), "string"),
    "path": (pa.list_(pa.string()), "array<string>"), "matched_text": (pa.string(), "string"), "confidence": (pa.float64(), "double"), "width": (pa.int32(), "int"), "k": (pa.int64(), "long"),
    "_f": (pa.list_(pa.string()), "array<string>"),
}


def _columns(b: pa.RecordBatch, *names: str) -> zip:
    return zip(*[b.column(b.schema.get_field_index(n)).to_pylist() for n in names], strict=True)


def scan_flows(docs: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """Findings of the flows."""
    return _scanned(docs, sensitivity, False)


def scan_adjusted(docs: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """Findings of the flows, adjusted by the structure around them: ``adjust(scan_flows(docs), facts(docs))``, but each text is
    parsed once and nothing is joined, as a document's facts go along with its flows."""
    return _less(_scanned(docs, sensitivity, True), lambda fact: F.array_contains("_f", fact))


def _scanned(docs: DataFrame, sensitivity: str, with_facts: bool) -> DataFrame:
    least = {"low": 3, "medium": 2}.get(sensitivity.lower(), 0)
    kinds = {n: t for n, t in _FLOW.items() if with_facts or n != "_f"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {n: [] for n in kinds}
            for d, path, lang, text in _columns(b, "doc_id", "file_path", "language", "text"):
                tree = parsed(text) if with_facts and lang == "python" else None
                own = None
                for k, f in enumerate(flows(text, lang, tree)):
                    if R.SEVERITY_RANK[f["severity"]] >= least:
                        if with_facts and own is None:
                            own = list(structure(text, lang, tree))
                        f |= {"doc_id": d, "file_path": path, "k": k, "_f": with_facts and [x for x, i, j in own if i <= f["line_number"] <= j]}
                        for n, values in out.items():
                            values.append(f[n])
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, (t, _) in kinds.items()], names=list(kinds))

    lang = X.language_of(F.col("file_path"), F.col("language"))
    some = _base(docs).select("doc_id", "file_path", lang.alias("language"), "text").where("language in ('python', 'javascript') and length(text) > 0")
    # A document without the name of any sink has no flow and never leaves the JVM.
    words = {lang: sorted({w for p, _ in table for w in _HINTS[p]}) for lang, table in _SINKS.items()}
    has = lambda lang: (F.col("language") == lang) & reduce(or_, [F.lower("text").contains(w) for w in words[lang]])
    some = some.where(reduce(or_, [has(lang) for lang in words]))
    f = some.mapInArrow(run, ", ".join(f"{n} {t}" for n, (_, t) in kinds.items()))
    said = F.concat(F.lit("Data flow: "), "taint_kind", F.lit(" from line "), F.col("source_line").cast("string"), F.lit(" reaches "), "sink", F.lit("() at line "), F.col("line_number").cast("string"), F.lit(" ("), "finding_type", F.lit(")"))
    n = F.col("line_number") - 1
    spot = F.struct(n.alias("start_line"), F.lit(0).alias("start_col"), n.alias("end_line"), F.col("width").alias("end_col"))
    f = f.withColumns({"message": said, "range": spot, "scanner": F.lit("deep_engine"), "engine": F.lit("deep"), "suppressed": F.lit(False), "seq": F.struct(F.col("line_number").cast("long").alias("first"), F.col("k").alias("second"), F.lit(0).cast("long").alias("at")),
        "flow": F.struct("source_line", "taint_kind", F.col("path").alias("hops"), F.col("line_number").alias("sink_line"), "sink")})
    return shaped(f, "_f") if with_facts else shaped(f)


def structure(text: str, language: str, tree: ast.Module | None = None) -> Iterator[tuple[str, int, int]]:
    """(fact, first line, last line): dead_code, except_body, uncalled, unused_import."""
    if language in ("javascript", "typescript"):
        js = JavaScript(text)
        for f in js.functions:
            if not f.exported and f.name not in js.exported and f.name not in js.called:
                yield "uncalled", f.first, f.last
        return
    if language != "python":
        return
    tree = tree or parsed(text)
    if tree is None:
        return
    called, used, defined, imports = set(), set(), [], []
    for node in _nodes(tree):
        kind = type(node)
        if kind is ast.Name:
            used.add(node.id)
        elif kind is ast.Call:
            called.add(node.func.id if isinstance(node.func, ast.Name) else getattr(node.func, "attr", None))
        elif kind is ast.Import or kind is ast.ImportFrom:
            imports += [(a.asname or a.name, node.lineno) for a in node.names if a.name != "*"]
        for name in _LISTS.get(kind, ()):
            body = getattr(node, name)
            if len(body) > 1:
                ends = next((k for k, s in enumerate(body) if isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue))), None)
                if ends is not None and ends + 1 < len(body):
                    yield "dead_code", body[ends + 1].lineno, body[-1].end_lineno
        if kind is ast.Try:
            for h in node.handlers:
                if h.body:
                    yield "except_body", h.body[0].lineno, h.body[-1].end_lineno
        elif kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
            defined.append(node)
    for f in defined:
        if f.name not in called:
            yield "uncalled", f.lineno, f.end_lineno
    for name, n in imports:
        if name not in used:
            yield "unused_import", n, n


#: The lists of statements of each kind of node that has any.
_LISTS = {c: names for c in vars(ast).values() if isinstance(c, type) and issubclass(c, (ast.mod, ast.stmt, ast.excepthandler, ast.match_case)) and (names := [n for n in ("body", "orelse", "finalbody") if n in c._fields])}
#: Fixed values, in the order in which they are taken off.
ADJUSTMENTS = (("test_file", -0.30), ("dead_code", -0.30), ("except_body", -0.15), ("uncalled", -0.20), ("unused_import", -0.25))


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, fact, first, last of every document."""

    names, kinds = ["doc_id", "fact", "first", "last"], [pa.int64(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, *f) for d, lang, text in _columns(b, "doc_id", "language", "text") if text for f in structure(text, lang)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

    lang = X.language_of(F.col("file_path"), F.col("language"))
    return _base(docs).select("doc_id", lang.alias("language"), "text").where("language is not null").mapInArrow(run, "doc_id long, fact string, first int, last int")


def adjust(findings: DataFrame, found: DataFrame) -> DataFrame:
    """Confidence less what the structure around a finding takes away, at least 0.1; adds ``semantic_adjustments``."""
    spans = found.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set(F.struct("fact", "first", "last")).alias("_f"))
    inside = lambda fact: F.coalesce(F.exists("_f", lambda x: (x["fact"] == fact) & F.col("line_number").between(x["first"], x["last"])), F.lit(False))
    return _less(findings.join(spans, F.col("doc_id") == F.col("_d"), "left").drop("_d"), inside)


def _less(f: DataFrame, inside: Callable[[str], Column]) -> DataFrame:
    """The findings with what the facts of their document, in ``_f``, take away; ``inside`` tells which hold."""
    applies = {name: X.is_test_file(F.col("file_path")) if name == "test_file" else inside(name) for name, _ in ADJUSTMENTS}
    sure = F.coalesce("confidence", F.lit(0.5))
    for name, by in ADJUSTMENTS:
        sure = F.when(applies[name], sure + by).otherwise(sure)
    some = F.filter(F.array(*[F.when(applies[n], F.struct(F.lit(n).alias("reason"), F.lit(by).alias("delta"))) for n, by in ADJUSTMENTS]), lambda x: x.isNotNull())
    f = f.withColumn("semantic_adjustments", some)
    return f.withColumn("confidence", F.when(F.size("semantic_adjustments") > 0, F.greatest(F.lit(0.1), sure)).otherwise(F.col("confidence"))).drop("_f")

