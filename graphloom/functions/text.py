"""Source text columns: lines, comments, imports, blank space, method bodies, token counts."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

Counter = Callable[[str], int]
TOKEN = re.compile(r"\w+|[^\w\s]")


def count_tokens_text(text: str | None) -> int:
    """Words and signs. The default counter, which needs no vocabulary; operators take another one as a parameter."""
    return len(TOKEN.findall(text)) if text else 0


def token_count(col: Column) -> Column:
    """``count_tokens_text`` inside the engine."""
    return F.when(col.isNull(), 0).otherwise(F.regexp_count(col, F.lit(r"(?U)\w+|[^\w\s]")))


def lines(col: Column) -> Column:
    """Lines of a text whatever its line ends."""
    return F.split(F.regexp_replace(col, "\r\n?", "\n"), "\n", -1)


def line_slice(col: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, counted from 1 and clamped to the text; empty where none remain or the text is null."""
    first = F.greatest(F.coalesce(start, F.lit(1)), F.lit(1))
    count = F.greatest(F.coalesce(end, F.lit(0)) - first + 1, F.lit(0))
    return F.coalesce(F.array_join(F.slice(lines(col), first, count), "\n"), F.lit(""))


def slices(spans: DataFrame, files: DataFrame) -> DataFrame:
    """``spans`` (file_path, lo, hi and others) of known files with their lines as ``source``.

    The spans of a file are gathered, those of one partition at a time, so that a text is joined once for all of them and
    split into lines once, not moved and split for each; a file's rows are put apart again behind the join.
    """
    rest = [c for c in spans.columns if c not in ("file_path", "lo", "hi")]
    held = spans.where("file_path is not null").withColumn("__part", F.spark_partition_id())
    of_file = held.groupBy("file_path", "__part").agg(F.collect_list(F.struct(*rest, "lo", "hi")).alias("__spans"))
    code = files.select("file_path", F.col("text").alias("__text")).where("__text is not null")
    cut = of_file.join(code, "file_path").select("file_path", "__spans", lines(F.col("__text")).alias("__lines"))

    def one(span):
        first = F.greatest(F.coalesce(span["lo"], F.lit(1)), F.lit(1))
        count = F.greatest(F.coalesce(span["hi"], F.lit(0)) - first + 1, F.lit(0))
        return F.struct(*(span[c].alias(c) for c in rest), F.array_join(F.slice("__lines", first, count), "\n").alias("source"))

    return cut.select("file_path", F.explode(F.transform("__spans", one)).alias("__s")).select("file_path", "__s.*")


def truncate_lines(col: Column, budget: Column) -> Column:
    """As many whole lines from the start as fit the budget of tokens; line ends cost nothing."""
    state = "named_struct('n', cast(0 as int), 'open', true, 'kept', cast(array() as array<string>))"

    def step(acc, line):
        n = acc["n"] + token_count(line)
        fits = acc["open"] & (n <= budget)
        kept = F.when(fits, F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"])
        return F.struct(F.when(fits, n).otherwise(acc["n"]).alias("n"), fits.alias("open"), kept.alias("kept"))

    return F.array_join(F.aggregate(lines(col), F.expr(state), step)["kept"], "\n")


def normalize_whitespace(col: Column) -> Column:
    """No trailing blanks, no two blank lines in a row, no blank lines at either end."""
    trimmed = F.regexp_replace(F.regexp_replace(col, "\r\n?", "\n"), r"[ \t\f\x0B]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(trimmed, "\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def strip_comments(col: Column, keep_docs: bool = True) -> Column:
    """Without block comments (those that begin with two stars stay if asked), lines that are comments (// but not ///,
    # but not #!), and what follows // outside quotes."""
    block = r"(?s)/\*(?!\*).*?\*/" if keep_docs else r"(?s)/\*.*?\*/"
    kept = F.filter(
        F.split(F.regexp_replace(col, block, ""), "\n", -1), lambda x: ~x.rlike(r"^\s*(?://(?!/)|#(?!!))")
    )
    return F.array_join(F.transform(kept, strip_inline), "\n")


def strip_inline(line: Column) -> Column:
    """A line up to the first // outside quotes; escaped characters and quotes inside other quotes count as text."""
    quoted = r""""(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?"""
    head = F.regexp_extract(line, rf"""^((?:{quoted}|\\.|/(?!/)|[^"'`\\/])*+)//""", 1)
    found = line.rlike(rf"""^(?:{quoted}|\\.|/(?!/)|[^"'`\\/])*+//""")
    return F.when(found, F.rtrim(head)).otherwise(line)


def truncate_share(col: Column, tokens: Column, limit: int) -> Column:
    """The first part of a text that has more tokens than the limit, in proportion by characters."""
    part = F.floor(F.length(col) * F.lit(limit) / F.greatest(tokens, F.lit(1))).cast("int")
    return F.when(tokens > limit, F.substring(col, F.lit(1), part)).otherwise(col)


def imported_names(line: str) -> list[str] | None:
    """The names that an import line brings in, under their aliases; None for any other line.

    Read word by word: from MODULE import NAMES, import {NAMES} from "module", import NAME from "module", import NAME.
    """
    words = line.split(None, 1)
    if len(words) < 2 or words[0] not in ("from", "import"):
        return None
    rest = words[1].rstrip()
    if words[0] == "from":
        parts = rest.split(None, 2)
        return _aliases(parts[2]) if len(parts) == 3 and parts[1] == "import" else None
    braced = rest.startswith("{")
    end = rest.find("}") if braced else len(rest) - len(rest.lstrip(_wordlike(rest)))
    inner, after = rest[braced:end], rest[end + braced :]
    source = after.split(None, 1)
    if end > braced and after[:1].isspace() and source[:1] == ["from"] and source[1:] and source[1][0] in "'\"":
        return _aliases(inner)
    return None if braced or "from" in line or not inner else [inner]


def _wordlike(text: str) -> str:
    """The characters of a text of which names are made."""
    return "".join(c for c in set(text) if c.isalnum() or c == "_")


def _aliases(names: str) -> list[str]:
    return [name for part in names.split(",") if (name := part.split(" as ")[-1].strip())]


def prune_imports_text(text: str) -> str:
    """Without the import lines of which no name occurs, as a whole word, outside the import lines."""
    rows = [(line, imported_names(line)) for line in text.split("\n")]
    body = set(re.findall(r"\w+", "\n".join(line for line, names in rows if names is None)))
    whole = "\n".join(line for line, names in rows if names is None)

    def used(name: str) -> bool:
        return name in body if name.isidentifier() else re.search(rf"\b{re.escape(name)}\b", whole) is not None

    return "\n".join(line for line, names in rows if names is None or any(map(used, names)))


# Words that may stand before the name in the head of a method, besides async and function.
ACCESS = {"public", "private", "protected", "static"}


def method_head(line: str) -> tuple[str, int] | None:
    """(name, place of the opening brace) of a line that begins a method, or any block with a head of that form."""
    opening = line.find("(")
    words = line[:opening].split() if opening > 0 else []
    if not words or not all(w.replace("_", "a").isalnum() for w in words):
        return None
    *before, name = words
    before = before[before[:1] == ["async"] :]
    before = before[: len(before) - (before[-1:] == ["function"])]
    closing = line.find(")", opening)
    if closing < 0 or not ACCESS.issuperset(before):
        return None
    at = _visible(line, closing + 1)
    if line[at : at + 1] == ":":
        start = _visible(line, at + 1)
        end = next((i for i in range(start, len(line)) if line[i].isspace()), len(line))
        if end == start:
            return None
        at = _visible(line, end)  # behind the type, or else inside of what looks like one
        at = at if line[at : at + 1] == "{" else line.rfind("{", start + 1, end)
    return (name, at) if at >= 0 and line[at : at + 1] == "{" else None


def _visible(line: str, at: int) -> int:
    return at + len(line[at:]) - len(line[at:].lstrip())


def summarize_methods_text(text: str, relevant: set[str] | None) -> str:
    """Bodies of brace languages replaced by a stub, but for the relevant names; None keeps all."""
    if relevant is None:
        return text
    rows, out, i = text.split("\n"), [], 0
    depth = [0, *accumulate(row.count("{") - row.count("}") for row in rows)]
    while i < len(rows):
        head = method_head(rows[i])
        if head is None or head[0] in relevant:
            out.append(rows[i])
            i += 1
        else:
            out.append(rows[i][: head[1]].rstrip() + " { /* ... */ }")
            i = next((j for j in range(i + 1, len(depth)) if depth[j] <= depth[i]), len(rows))
    return "\n".join(out)


_BLOCK = {True: re.compile(r"/\*(?!\*).*?\*/", re.S), False: re.compile(r"/\*.*?\*/", re.S)}
_CODE = re.compile(r"""(?:"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?|\\.|/(?!/)|[^"'`\\/])*""")


def strip_comments_text(text: str, keep_docs: bool = True) -> str:
    out = []
    for line in _BLOCK[keep_docs].sub("", text).split("\n"):
        if re.match(r"\s*(?://(?!/)|#(?!!))", line):
            continue
        end = _CODE.match(line).end()
        out.append(line[:end].rstrip() if line.startswith("//", end) else line)
    return "\n".join(out)


def normalize_whitespace_text(text: str) -> str:
    out: list[str] = []
    for line in map(str.rstrip, text.split("\n")):
        if line or (out and out[-1]):
            out.append(line)
    while out and not out[-1]:
        out.pop()
    return "\n".join(out)


def compress_text(text: str, budget: int | None = None, relevant: set[str] | None = None, count: Counter = count_tokens_text) -> str:
    """Imports pruned, comments stripped, blanks normalised, methods summarised, in this order, until the budget is met;
    without a budget all four."""
    stages = (prune_imports_text, strip_comments_text, normalize_whitespace_text, lambda t: summarize_methods_text(t, relevant))
    for stage in stages:
        text = stage(text)
        if budget and stage is not stages[-1] and count(text) <= budget:
            break
    return text


def _each(function):
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else function(t) for t in texts], dtype=object)

    return run


def prune_imports(col: Column) -> Column:
    return F.pandas_udf(_each(prune_imports_text), StringType())(col)


def summarize_methods(col: Column, relevant: set[str] | None) -> Column:
    return F.pandas_udf(_each(lambda t: summarize_methods_text(t, relevant)), StringType())(col)


def compress(col: Column, budget: int | None = None, relevant: set[str] | None = None, count: Counter = count_tokens_text) -> Column:
    return F.pandas_udf(_each(lambda t: compress_text(t, budget, relevant, count)), StringType())(col)


def count_tokens(col: Column, count: Counter) -> Column:
    """Tokens by a given counter, batch by batch; null and empty texts have none."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([count(t) if t else 0 for t in texts], dtype="int32")

    return F.pandas_udf(run, IntegerType())(col)


CALL = r"(?:this\.)?(\w+)\.(\w+)\s*\("
# Patterns of the rules on source text. A dot does not match a line end in the first.
INTERPOLATED_SQL = r"(?d)query\s*\(\s*[`\"'].*?\$\{"
LOOPED_QUERY = r"(?s)(?:for\s*\(|\.forEach\s*\(|\.map\s*\().*?(?:\.find|\.query|\.get|\.fetch|\.select)"
PAGINATION = r"(?i)limit|offset|page|skip|take|cursor"
SELECT_STAR = r"(?i)SELECT\s+\*"


def call_sites(body: Column) -> Column:
    """receiver.method of every call in a text, in order."""
    found = F.regexp_extract_all(body, F.lit(CALL), F.lit(0))
    return F.transform(found, lambda c: F.concat_ws(".", F.regexp_extract(c, CALL, 1), F.regexp_extract(c, CALL, 2)))


def register(spark: SparkSession) -> None:
    """The text functions as SQL functions of a session."""
    for name, function in (
        ("count_tokens", count_tokens_text),
        ("prune_imports", prune_imports_text),
        ("strip_comments", strip_comments_text),
        ("normalize_whitespace", normalize_whitespace_text),
        ("summarize_methods", lambda t: summarize_methods_text(t, set())),
        ("compress", compress_text),
    ):
        if name == "count_tokens":
            spark.udf.register(name, F.pandas_udf(lambda s, f=function: pd.Series([f(t) for t in s], dtype="int32"), IntegerType()))
        else:
            spark.udf.register(name, F.pandas_udf(_each(function), StringType()))
