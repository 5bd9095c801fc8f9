"""Source trees as DataFrames: files, filters, manifests."""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ident import content_hash, extension, language
from graphloom.runtime import Scratch
from graphloom.schema import BINARY_EXTENSIONS, IGNORED


def glob_regex(patterns: list[str]) -> str:
    return "|".join(re.sub(r"\(\?s:(.*)\)\\[zZ]$", r"(?s:\1)", fnmatch.translate(p)) for p in patterns)


def included(path: Column, ignored: list[str] = IGNORED) -> Column:
    """Whether a relative path is scanned: no binary extension, and no part of it fits an ignored name or pattern. Hidden
    parts are only refused if they begin with an ignored name; .env and .env.example are not held to be hidden."""
    hidden = [re.escape(p.rstrip("/")) for p in ignored]
    part_ignored = lambda p: p.rlike(f"^(?:{glob_regex(ignored)})$")
    part_hidden = lambda p: p.startswith(".") & ~p.isin(".env", ".env.example") & p.rlike(f"^(?:{'|'.join(hidden)})")
    parts = F.split(path, "/")
    return ~extension(path).isin(BINARY_EXTENSIONS) & ~F.exists(parts, lambda p: part_ignored(p) | part_hidden(p))


#: Folders a task lists one after the other before it hands the rest back to be spread again.
FOLDERS_A_TASK = 2_000


def listing(spark: SparkSession, root: str, ignored: list[str] = IGNORED) -> DataFrame:
    """(path, uri) of the included files below ``root``, found by tasks that each walk some folders; ignored folders are not
    entered. What a task does not finish is spread over all tasks in the next round, so large trees take a few rounds."""
    scratch = Scratch(spark, "listing")
    top = root.rstrip("/") if re.match(r"[A-Za-z][\w+.-]+:", root) else str(Path(root).resolve())
    walk = _walker(FOLDERS_A_TASK, ignored)
    todo = spark.createDataFrame([(_uri(top), "")], "uri string, path string")
    found = []
    while True:
        rows = scratch.put(todo.mapInPandas(walk, "path string, uri string, folder boolean"))
        own = rows.where(included(F.col("path"), ignored) | (F.col("folder") & included(F.concat("path", F.lit("/x")), ignored)))
        found.append(own.where("not folder").select("path", "uri"))
        rest = own.where("folder")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found)
        todo = rest.select("uri", "path").repartition(spark.sparkContext.defaultParallelism * 4)


def _uri(path: str) -> str:
    return re.sub("^file:/+", "/", path)  # plain paths need no quoting


def _walker(most: int, ignored: list[str]):
    skipped = re.compile("|".join(fnmatch.translate(p) for p in ignored) or "(?!)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            todo, out, done = list(zip(pdf.uri, pdf.path, strict=True)), [], 0
            while todo and done < most:
                uri, path = todo.pop()
                done += 1
                system, folder = FileSystem.from_uri(uri)
                scheme = uri[: len(uri) - len(folder)] if uri.endswith(folder) else ""
                for info in system.get_file_info(FileSelector(folder, allow_not_found=True)):
                    below = f"{path}/{info.base_name}" if path else info.base_name
                    if info.type == FileType.Directory:
                        if not skipped.match(info.base_name):
                            todo.append((scheme + info.path, below))
                    elif info.type == FileType.File:
                        out.append((below, scheme + info.path, False))
            out += [(path, uri, True) for uri, path in todo]
            yield pd.DataFrame(out, columns=["path", "uri", "folder"])

    return run


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        content = []
        for uri in pdf.uri:
            system, place = FileSystem.from_uri(uri)
            try:
                with system.open_input_stream(place) as f:
                    content.append(f.read())
            except OSError:  # gone since it was listed
                content.append(None)
        yield pdf.assign(content=content)[["path", "content"]]


def scan(spark: SparkSession, root: str, known_only: bool = True, ignored: list[str] = IGNORED) -> DataFrame:
    """(path, language, content_hash, text) of the files below ``root`` that are included; with ``known_only`` those of a
    known language. Bytes that are no UTF-8 become replacement characters. The order of files is that of their paths.

    Files are listed and filtered by path first; only what is left is read, by tasks.
    """
    rows = listing(spark, root, ignored)
    if known_only:
        rows = rows.where(language(F.col("path")).isNotNull())
    rows = rows.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(_read, "path string, content binary").where("content is not null")
    rows = rows.withColumn("language", language(F.col("path")))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    return rows.select("path", "language", content_hash(F.col("content")).alias("content_hash"), text.alias("text"))


def manifest(files: DataFrame, name: str = "package.json") -> DataFrame:
    """One row (deps, main) of the manifest at the root; development dependencies win over others. Without a manifest, or
    with one that is no JSON, deps is an empty map."""
    kind = "dependencies map<string,string>, devDependencies map<string,string>, main string"
    none = F.create_map().cast("map<string,string>")
    doc = F.from_json("text", kind)
    read = files.where(F.col("path") == name).select(doc.alias("d")).select(
        F.map_from_entries(
            F.concat(
                F.filter(F.map_entries(F.coalesce("d.dependencies", none)), lambda e: ~F.array_contains(F.map_keys(F.coalesce(F.col("d.devDependencies"), none)), e["key"])),
                F.map_entries(F.coalesce("d.devDependencies", none)),
            )
        ).alias("deps"),
        F.col("d.main").alias("main"),
    )
    return read.agg(F.first("deps").alias("deps"), F.first("main").alias("main")).select(F.coalesce("deps", none).alias("deps"), "main")


# Where an application usually begins.
ENTRIES = [f"{d}{n}.{e}" for d in ("", "src/") for n in ("app", "server", "index") for e in ("ts", "js")]


def detect(files: DataFrame) -> DataFrame:
    """One row (framework, confidence, version, language, entry_files) for the express framework."""
    paths = files.select(F.collect_set(F.when(F.col("path").isin([*ENTRIES, "tsconfig.json"]), F.col("path"))).alias("paths"))
    one = manifest(files).crossJoin(paths)  # one row each; at most a dozen known paths
    found = F.map_contains_key("deps", F.lit("express"))
    typed = F.map_contains_key("deps", F.lit("typescript")) | F.array_contains("paths", "tsconfig.json")
    entries = F.filter(F.array(*(F.lit(e) for e in ENTRIES)), lambda e: F.array_contains("paths", e))
    return one.select(
        F.lit("express").alias("framework"),
        F.when(found, 0.95).otherwise(0.0).alias("confidence"),
        F.when(found, F.try_element_at("deps", F.lit("express"))).alias("version"),
        F.when(found, F.when(typed, "typescript").otherwise("javascript")).alias("language"),
        F.when(found, F.concat(F.when(F.coalesce(F.length("main"), F.lit(0)) > 0, F.array("main")).otherwise(F.array().cast("array<string>")), entries)).alias("entry_files"),
    )


def arbitrate(detections: DataFrame, key: str | None = None) -> DataFrame:
    """The surest detection above 0.5, the first registered (order) among equals; per ``key`` if given."""
    best = F.max_by(F.struct(*detections.columns), F.struct("confidence", -F.col("order"))).alias("d")
    sure = detections.where("confidence > 0.5")
    return (sure.groupBy(key) if key else sure.groupBy()).agg(best).where("d is not null").select("d.*")


def aliases(tsconfig: str | None) -> dict[str, str]:
    """Path prefixes of a tsconfig document; the first target of each counts."""
    try:
        paths = json.loads(tsconfig or "{}").get("compilerOptions", {}).get("paths", {})
    except (ValueError, AttributeError):
        return {}
    return {k.removesuffix("/*"): v[0].removesuffix("/*").removeprefix("./") for k, v in paths.items() if v}


SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"]


def resolve_imports(imports: DataFrame, files: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(file_path, module, resolved) of imports (file_path, module) that name a file: relative ones and those with a known
    prefix. Of seven forms of the name the first that exists counts. Others, such as packages, give no row."""
    target = F.when(
        F.col("module").rlike(r"^\.{1,2}(?:/|$)"), F.concat_ws("/", F.regexp_replace("file_path", r"/?[^/]*$", ""), "module")
    )
    for prefix, to in (prefixes or {}).items():
        target = F.when(F.col("module").startswith(prefix + "/"), F.concat(F.lit(to), F.substring("module", len(prefix) + 1, 4096))).otherwise(target)
    steps = F.filter(F.split(target, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    base = imports.withColumn("base", F.array_join(walked, "/")).where("base is not null")
    forms = F.array(*(F.struct(F.lit(i).alias("rank"), F.concat("base", F.lit(s)).alias("path")) for i, s in enumerate(SUFFIXES)))
    tried = base.withColumn("c", F.explode(forms)).select("file_path", "module", F.col("c.rank").alias("rank"), F.col("c.path").alias("path"))
    there = tried.join(files.select("path").distinct(), "path", "left_semi")
    return there.groupBy("file_path", "module").agg(F.min_by("path", "rank").alias("resolved"))


def whole_source(files: DataFrame, extensions: list[str]) -> DataFrame:
    """One text of all files, in order of their paths, each under a line with its path: the baseline a context is held
    against. It is meant for one project, whose text fits a row."""
    own = files.where(extension(F.col("path")).isin(extensions))
    part = F.struct("path", F.concat(F.lit("// === "), "path", F.lit(" ===\n"), "text").alias("t"))
    return own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("text"))
