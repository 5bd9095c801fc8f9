"""Identity and classification columns."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import LANGUAGES, SEVERITIES


def short_hash(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def node_id(kind: Column, name: Column, file_path: Column) -> Column:
    return short_hash(kind, name, file_path)


def endpoint_id(method: Column, path: Column, handler: Column, file_path: Column) -> Column:
    return short_hash(method, path, handler, file_path)


def endpoint_name(method: Column, path: Column) -> Column:
    return F.concat_ws(" ", method, path)


def display_name(qualified_name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(qualified_name, ".", -1)


def class_name(qualified_name: Column) -> Column:
    """What stands before the last dot; null without one."""
    return F.when(qualified_name.contains("."), F.regexp_replace(qualified_name, r"(?s)\.[^.]*$", ""))


def content_hash(content: Column) -> Column:
    """Hex SHA-256 of the bytes; empty for what cannot be read."""
    return F.coalesce(F.sha2(content, 256), F.lit(""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(known, extension(path))


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info, 5 for anything else; letter case does not matter."""
    out = F.lit(len(SEVERITIES))
    for rank, name in enumerate(SEVERITIES):
        out = F.when(F.lower(severity) == name, rank).otherwise(out)
    return out


# Words in decorators, then patterns in names, that tell a role; the first that fits decides. A class in
# brackets stands for one character, as it does where these patterns come from.
DECORATOR_ROLES = [("controller", "controller"), ("injectable|service", "service"), ("entity|schema", "entity"), ("middleware|guard", "middleware")]
NAME_ROLES = [
    ("controller", "controller|handler|route[rs]?$"),
    ("service", "service|usecase|manager"),
    ("repository", "repositor[y|ies]|dao|model|store"),
    ("middleware", "middleware|guard|interceptor"),
    ("validator", "validat(?:or|ion|e)|schema|dto"),
    ("config", "config|settings|env"),
    ("entity", "entity|interface|type[s]?$"),
]


def role(name: Column, decorators: Column) -> Column:
    """The role of a symbol by its decorators, else by its unqualified name, else class. Null decorators are none."""
    words = F.lower(F.array_join(F.coalesce(decorators, F.array().cast("array<string>")), " "))
    out = F.lit("class")
    for kind, pattern in reversed(NAME_ROLES):
        out = F.when(name.rlike(f"(?i){pattern}"), kind).otherwise(out)
    for pattern, kind in reversed(DECORATOR_ROLES):
        out = F.when(words.rlike(pattern), kind).otherwise(out)
    return out


def title_case(col: Column) -> Column:
    return F.initcap(col)


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``; a path elsewhere stays as it is."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(path)


def random_id() -> Column:
    """Eight random hex digits. They differ at each evaluation; write rows down before they are used twice."""
    return F.substring(F.uuid(), 1, 8)


def register(spark: SparkSession) -> None:
    """node_id, endpoint_id and severity_rank as SQL functions of a session."""
    text = {"node_id": "kind string, name string, file string", "endpoint_id": "method string, path string, handler string, file string"}
    for name, params in text.items():
        args = ", ".join(p.split()[0] for p in params.split(", "))
        spark.sql(f"create or replace temporary function {name}({params}) returns string return substring(sha2(concat_ws(':', {args}), 256), 1, 16)")
    ranks = " ".join(f"when '{s}' then {i}" for i, s in enumerate(SEVERITIES))
    spark.sql(f"create or replace temporary function severity_rank(s string) returns int return case lower(s) {ranks} else {len(SEVERITIES)} end")
