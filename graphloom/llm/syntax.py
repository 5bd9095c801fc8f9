"""Source files that do not parse in the language of their extension."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import grammar
from graphloom.runtime import spread

# The language each file name extension stands for.
LANGUAGE = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript",
    "mts": "typescript", "cts": "typescript", "tsx": "tsx", "java": "java", "go": "go", "cs": "c_sharp",
}
NAMED = {"tsx": "typescript"}

# Strings that are typical of one language.
TYPICAL = {
    "python": ("def ", "self.", "elif ", " None", "\nfrom ", "except ", "):\n", "else:\n", "__init__", " not "),
    "javascript": ("require(", "module.exports", "const ", "function ", "=>", "===", "console.", "let "),
    "typescript": ("interface ", ": string", ": number", ": boolean", ": void", "private readonly", "export class", "export const", "export type", "Promise<", "=>"),
    "java": ("package ", "import java", "public class", "public long", "public void", "private final", "final ", " new ", "->", "throws ", "@Override"),
    "go": ("package ", "func ", ":=", "err != nil", "defer ", "struct {", "range ", "import (", "map["),
    "c_sharp": ("using ", "namespace ", "async Task", "string ", "foreach ", "get;", "=>", "var ", "readonly ", "public class"),
}


def extension_language(path: str | None) -> str | None:
    return LANGUAGE.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path.rsplit("/", 1)[-1] else None


def ranked(text: str) -> list[str]:
    """All languages, the likeliest first, by the number of their typical strings."""
    return sorted(TYPICAL, key=lambda k: -sum(map(text.count, TYPICAL[k])))


def outcomes(path: str | None, text: str) -> dict[str, str | None]:
    """What each grammar says of a text, the likeliest language first: None where it parses, else the message. The grammar of
    the extension stands for its language."""
    own = extension_language(path)
    named = NAMED.get(own, own)
    return {lang: grammar.error(text, own if lang == named else lang, likely=lang == named) for lang in ranked(text)}


def examine(path: str | None, text: str | None) -> tuple[str, str | None, str | None] | None:
    """(kind, language, message) of a text that is invalid in the language of its extension, else None.

    The text is parsed by all grammars. kind is wrong_extension if it parses in another language, the likeliest of which
    is given, and corrupt if it parses in none. Null and empty texts, and paths whose extension stands for no known
    language, are not judged.
    """
    lang = extension_language(path)
    if lang is None or not text:
        return None
    said = outcomes(path, text)
    message = said.pop(NAMED.get(lang, lang))
    if message is None:
        return None
    other = next((name for name, error in said.items() if error is None and text.strip()), None)
    return ("wrong_extension" if other else "corrupt"), other, message


SCHEMA = "file_id string, project_id string, language string, kind string, parses_as string, message string"


def invalid(files: DataFrame) -> DataFrame:
    """Rows (file_id, project_id, language, kind, parses_as, message) of the files that do not parse.

    ``files`` has file_id, project_id, file_path and text; columns beyond these, such as errors and language, play no
    part. Each text is parsed in the task that reads it, by all grammars; nothing is shuffled. No files give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                bad = examine(r["file_path"], r["text"])
                if bad:
                    lang = extension_language(r["file_path"])
                    out.append((r["file_id"], r["project_id"], NAMED.get(lang, lang), *bad))
            cols = zip(*out, strict=True) if out else [[]] * 6
            names = ("file_id", "project_id", "language", "kind", "parses_as", "message")
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], list(names))

    return spread(files.select("file_id", "project_id", "file_path", "text")).mapInArrow(run, SCHEMA)


def rates(files: DataFrame) -> DataFrame:
    """Per project and language of the extension: files with text, invalid ones by kind, and their share."""
    ext = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    by_ext = F.create_map(*(F.lit(x) for k, v in LANGUAGE.items() for x in (k, NAMED.get(v, v))))
    total = (
        files.where("text is not null and text <> ''")
        .withColumn("language", F.try_element_at(by_ext, ext))
        .where("language is not null")
        .groupBy("project_id", "language")
        .agg(F.count("*").alias("files"))
    )
    bad = invalid(files).groupBy("project_id", "language").agg(
        F.count("*").alias("invalid"), F.count_if(F.col("kind") == "wrong_extension").alias("wrong_extension")
    )
    same = F.col("t.project_id").eqNullSafe(F.col("b.project_id")) & (F.col("t.language") == F.col("b.language"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return total.alias("t").join(bad.alias("b"), same, "left").select(
        "t.project_id", "t.language", "files", zero("invalid").alias("invalid"), zero("wrong_extension").alias("wrong_extension"),
        (zero("invalid") / F.col("files")).alias("rate"),
    )
