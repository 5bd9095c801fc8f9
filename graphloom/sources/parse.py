"""Symbols, imports, exports, routes and errors of source files, by a tolerant scan of their tokens."""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from graphloom.functions.text import CALL
from graphloom.runtime import spread
from graphloom.schema import EXPORT, IMPORT, PARSE_ERROR, ROUTE, SYMBOL

SCHEMA = f"path string, language string, symbols array<{SYMBOL}>, imports array<{IMPORT}>, exports array<{EXPORT}>, errors array<{PARSE_ERROR}>, routes array<{ROUTE}>"

_HIDE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
_CLASS = re.compile(r"\bclass\s+(\w+)[^{;]*\{")
_FUNCTION = re.compile(r"\bfunction\s*\*?\s*(\w+)\s*(?:<[^>]*>)?\s*\(")
_MEMBER = re.compile(r"(?<![\w.$])(?:(?:public|private|protected|static|readonly|override|async|get|set|abstract)\s+)*\*?\s*(#?\w+)\s*(?:<[^<>()]*>)?\s*\(")
_ARROW = re.compile(r"(?<![\w.$)\]])(\w+)\s*=>")
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "function", "new", "typeof", "await", "throw", "super", "else", "do", "with", "in", "of", "yield", "async", "delete", "void", "instanceof", "case"}
_IMPORT = re.compile(r"^[ \t]*import\b[^;'\"]*(['\"])", re.M)
_EXPORT = re.compile(r"^[ \t]*export\s+(default\s+)?(?:abstract\s+)?(?:async\s+)?(?:class|function)\s*\*?\s*(\w+)", re.M)
_CALL = re.compile(CALL)
_DECORATOR = re.compile(r"@([\w.]+(?:\((?:[^()]|\([^()]*\))*\))?)")
_JAVA_METHOD = re.compile(r"(?<![\w.])(?:[\w<>\[\],.?@ ]+[\w>\]]\s+)(\w+)\s*\(([^()]*)\)\s*(?:throws\s+[\w., ]+)?\s*[{;]")
# Names of objects on which routes are declared, and the methods that declare them.
RECEIVERS = {"app", "server", "api", "router", "route", "routes"}
VERBS = {"get", "post", "put", "delete", "patch", "options", "head", "all"}
_ROUTE = re.compile(r"(?<![\w$])([\w$.]+)\.(\w+)\s*\(")


def hidden(text: str) -> str:
    """The text with comments and the insides of literals blanked: same length, same lines."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)

    def one(m: re.Match) -> str:
        s = m[0]
        return blank(s) if s[0] == "/" else s[0] + blank(s[1:-1]) + (s[-1] if len(s) > 1 else "")

    return _HIDE.sub(one, text)


def brackets(text: str) -> tuple[dict[int, int], list[int]]:
    """Partners of brackets, and the offsets of those without one."""
    pair, stack, bad = {}, [], []
    for i, c in ((m.start(), m[0]) for m in re.finditer(r"[()\[\]{}]", text)):
        if c in _OPEN:
            stack.append(i)
        elif stack and text[stack[-1]] == _CLOSE[c]:
            pair[stack[-1]] = i
            pair[i] = stack.pop()
        else:
            bad.append(i)
    return pair, sorted(bad + stack)


class _Lines:
    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def col(self, offset: int) -> int:
        return offset - self.starts[self.at(offset) - 1]


def _symbol(name, kind, path, start, end, decorators=(), parameters=(), parent=None) -> dict:
    qualified = f"{parent}.{name}" if parent else name
    return {
        "name": name, "qualified_name": qualified, "kind": kind, "file_path": path, "line_start": start, "line_end": end,
        "decorators": list(decorators), "parameters": list(parameters), "parent": parent, "calls": [],
    }


def split_arguments(text: str, masked: str, lo: int, hi: int) -> list[tuple[str, int, int]]:
    """Arguments between two offsets, split at commas outside brackets."""
    out, depth, at = [], 0, lo
    for i in range(lo, hi):
        c = masked[i]
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            out.append((at, i))
            at = i + 1
    out.append((at, hi))
    found = []
    for a, b in out:
        raw = text[a:b]
        if raw.strip():
            found.append((raw.strip(), a + len(raw) - len(raw.lstrip()), b - (len(raw) - len(raw.rstrip()))))
    return found


def _parameters(text: str, masked: str, at: int, pair: dict[int, int]) -> list[str]:
    names = []
    for raw, _, _ in split_arguments(text, masked, at + 1, pair.get(at, at + 1)):
        raw = re.sub(r"^(?:@\w+(?:\([^)]*\))?\s*|(?:public|private|protected|readonly)\s+)*", "", raw)
        m = re.match(r"(\.\.\.)?[\w$]+|[\[{].*?[\]}]", raw, re.S)
        if m:
            names.append(m[0])
    return names


def script(text: str, path: str) -> dict:
    """TypeScript and JavaScript: classes, functions, methods and arrow functions of one bare parameter."""
    masked, line = hidden(text), _Lines(text)
    pair, bad = brackets(masked)
    classes = [(m.start(), m.end() - 1, pair.get(m.end() - 1, len(text)), m[1]) for m in _CLASS.finditer(masked)]
    inside = lambda i: max((c for c in classes if c[1] < i < c[2]), default=None)
    symbols = []
    for start, brace, end, name in classes:
        before = text[max(0, text.rfind("}", 0, start), text.rfind(";", 0, start)) : start]
        symbols.append((start, _symbol(name, "class", path, line.at(start), line.at(end), _DECORATOR.findall(before))))
    seen = set()

    def add(at: int, name: str, end: int, parameters: list[str]) -> None:
        if at in seen or name in _NOT_NAMES:
            return
        seen.add(at)
        own = inside(at)
        decorators = _DECORATOR.findall(masked[own[1] : own[2]]) if own else []
        symbols.append((at, _symbol(name, "method" if own else "function", path, line.at(at), line.at(end), decorators, parameters, own[3] if own else None)))

    for m in _FUNCTION.finditer(masked):
        close = pair.get(m.end() - 1, m.end())
        body = masked.find("{", close)
        add(m.start(), m[1], pair.get(body, close), _parameters(text, masked, m.end() - 1, pair))
    for m in _MEMBER.finditer(masked):
        at, close = m.end() - 1, pair.get(m.end() - 1)
        if close is None or m[1] in _NOT_NAMES or re.search(r"\bfunction\s*\*?\s*$", masked[: m.start(1)]):
            continue
        after = re.match(r"\s*(?::\s*[\w<>\[\]|., {}]+?)?\s*\{", masked[close + 1 : close + 200])
        if after and not re.match(r"\s*=>", masked[close + 1 : close + 20]):
            body = close + after.end()
            add(m.start() + len(m[0]) - len(m[0].lstrip()), m[1], pair.get(body, close), _parameters(text, masked, at, pair))
    for m in _ARROW.finditer(masked):
        body = re.match(r"\s*\{", masked[m.end() : m.end() + 20])
        end = pair.get(m.end() + body.end() - 1, m.end()) if body else masked.find("\n", m.end()) if masked.find("\n", m.end()) > 0 else len(text)
        add(m.start(), m[1], end - (0 if body else 1), [])
    imports = []
    for m in _IMPORT.finditer(masked):
        end = masked.find(m[1], m.end())
        if end > 0:
            imports.append({"module": text[m.end() : end], "names": [], "is_default": False, "is_namespace": False, "alias": None, "line": line.at(m.start())})
    exports = [{"name": m[2], "is_default": bool(m[1]), "line": line.at(m.start())} for m in _EXPORT.finditer(masked)]
    errors = [{"message": f"unmatched {text[i]}", "line": line.at(i), "col": line.col(i)} for i in bad]
    return {"symbols": [s for _, s in sorted(symbols, key=lambda x: x[0])], "imports": imports, "exports": exports, "errors": errors, "routes": routes(text, masked, pair, line)}


def unquoted(text: str) -> str | None:
    return text[1:-1] if len(text) >= 2 and text[0] in "'\"`" and text[-1] == text[0] else None


def routes(text: str, masked: str, pair: dict[int, int], line: _Lines) -> list[dict]:
    """Calls on application and router objects that declare a route, a mount or a middleware for all routes.

    ``all`` counts as GET. A route needs a literal path and a handler, which is the last argument; those between are its
    middleware.
    """
    out = []
    for m in _ROUTE.finditer(masked):
        if m[1].rsplit(".", 1)[-1].lower() not in RECEIVERS or m.end() - 1 not in pair:
            continue
        args = split_arguments(text, masked, m.end(), pair[m.end() - 1])
        row = {"kind": None, "method": None, "path": None, "handler": None, "middleware": [], "line_start": line.at(m.start()), "line_end": line.at(pair[m.end() - 1])}
        if m[2] == "use" and args:
            prefix = unquoted(args[0][0]) if len(args) >= 2 else None
            row |= {"line_start": line.at(args[0][1]), "line_end": line.at(args[-1][2] if prefix else args[0][2])}
            row |= {"kind": "mount", "path": prefix, "handler": args[-1][0]} if prefix else {"kind": "middleware", "handler": args[0][0].split("(")[0].strip()}
            out.append(row)
        elif m[2].lower() in VERBS and len(args) >= 2 and unquoted(args[0][0]):
            verb = m[2].upper()
            row |= {"kind": "route", "method": "GET" if verb == "ALL" else verb, "path": unquoted(args[0][0]), "handler": args[-1][0], "middleware": [a[0] for a in args[1:-1]]}
            out.append(row)
    return out


def python(text: str, path: str) -> dict:
    symbols, imports, errors = [], [], []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.removeprefix("\ufeff"))
    except (SyntaxError, ValueError, RecursionError) as e:
        where = {"message": getattr(e, "msg", str(e)), "line": getattr(e, "lineno", 1) or 1, "col": max(0, (getattr(e, "offset", 1) or 1) - 1)}
        return {"symbols": [], "imports": [], "exports": [], "errors": [where], "routes": []}

    def walk(node, parent):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                is_class = isinstance(child, ast.ClassDef)
                decorators = [ast.unparse(d).split("(")[0] for d in child.decorator_list]
                kind = "class" if is_class else "method" if parent else "function"
                symbols.append(_symbol(child.name, kind, path, child.lineno, child.end_lineno, decorators, [], None if is_class else parent))
                walk(child, child.name if is_class else parent)
                continue
            modules = [child.module] if isinstance(child, ast.ImportFrom) and child.module else [child.names[0].name] if isinstance(child, ast.Import) else []
            for module in modules:
                imports.append({"module": module, "names": [module] if isinstance(child, ast.Import) else [], "is_default": False, "is_namespace": False, "alias": None, "line": child.lineno})
            walk(child, parent)

    walk(tree, None)
    return {"symbols": symbols, "imports": imports, "exports": [], "errors": errors, "routes": []}


def java(text: str, path: str) -> dict:
    masked, line = hidden(text), _Lines(text)
    pair, bad = brackets(masked)
    classes = [(m.start(), m.end() - 1, pair.get(m.end() - 1, len(text)), m[1]) for m in _CLASS.finditer(masked)]
    symbols = [(c[0], _symbol(c[3], "class", path, line.at(c[0]), line.at(c[2]))) for c in classes]
    for m in _JAVA_METHOD.finditer(masked):
        head = m[0][: m.start(1) - m.start()]
        if m[1] in _NOT_NAMES or re.search(r"\b(?:new|return|throw|else|case)\b|[=(]", head):
            continue
        own = max((c for c in classes if c[1] < m.start(1) < c[2]), default=None)
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        end = pair.get(m.end() - 1, m.end() - 1)
        symbols.append((m.start(1), _symbol(m[1], "method" if own else "function", path, line.at(start), line.at(end), [], [], own[3] if own else None)))
    errors = [{"message": f"unmatched {text[i]}", "line": line.at(i), "col": line.col(i)} for i in bad]
    return {"symbols": [s for _, s in sorted(symbols, key=lambda x: x[0])], "imports": [], "exports": [], "errors": errors, "routes": []}


NOTHING = {"symbols": [], "imports": [], "exports": [], "errors": [], "routes": []}


def parse(text: str | None, language: str | None, path: str) -> dict:
    """All that one file declares. Go and C# files are known but declare nothing here; unknown languages neither."""
    if not text:
        return NOTHING
    readers = {"typescript": script, "tsx": script, "javascript": script, "python": python, "java": java}
    if language not in readers:
        return NOTHING
    out = readers[language](text, path)
    lines = text.split("\n")
    for s in out["symbols"]:  # receiver.method of each call in the body
        if s["kind"] != "class":
            s["calls"] = [f"{a}.{b}" for a, b in _CALL.findall("\n".join(lines[s["line_start"] - 1 : s["line_end"]]))]
    return out


def parsed(files: DataFrame) -> DataFrame:
    """Files (path, language, text) to one row each with arrays of what they declare; each parsed where it is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"path": p, "language": lang, **parse(t, lang, p)} for p, lang, t in zip(pdf.path, pdf.language, pdf.text, strict=True)]
            yield pd.DataFrame(rows, columns=["path", "language", "symbols", "imports", "exports", "errors", "routes"])

    return spread(files.select("path", "language", "text")).mapInPandas(run, SCHEMA)


def reparsed(files: DataFrame, previous: DataFrame) -> DataFrame:
    """Parsed rows with their content_hash, of which only files (path, language, content_hash, text) with another hash
    than in ``previous`` are parsed again; rows of files that are gone are left out."""
    same = ["path", "content_hash"]
    kept = previous.join(files.select(*same), same, "left_semi")
    changed = files.join(previous.select(*same), same, "left_anti")
    fresh = parsed(changed).join(changed.select(*same), "path")
    return kept.unionByName(fresh.select(*previous.columns))


def register(spark: SparkSession) -> None:
    """``parse_symbols(text, language, path)`` as a table function of SQL."""

    @udtf(returnType="name string, qualified_name string, kind string, line_start int, line_end int, parent string")
    class ParseSymbols:
        def eval(self, text: str, language: str, path: str):
            for s in parse(text, language, path)["symbols"]:
                yield s["name"], s["qualified_name"], s["kind"], s["line_start"], s["line_end"], s["parent"]

    spark.udtf.register("parse_symbols", ParseSymbols)
