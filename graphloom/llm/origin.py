"""Where a source file comes from: written by hand, generated, minified, a third-party copy, or data saved as code."""

from __future__ import annotations

import math
import re
import string
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import syntax
from graphloom.runtime import spread

# File name extensions by the language whose names they hold.
FAMILY = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "cs": "c_sharp",
}
NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
#: Characters of names; with the marks of beginning and end there are at most SYMBOLS ** 3 n-grams a language.
SYMBOLS = 66
SMOOTHING = 0.1

#: A file's names are mangled if they cost this many times the bits a character that names of its language cost,
MANGLED_BITS = 1.3
#: and are on average shorter than this.
MANGLED_LENGTH = 5.0
#: or if so many of them have one or two characters, as where a language has hardly any other files.
TINY_SHARE = 0.6
#: Data saved as code: at least so many literals, making up this share of the visible characters, and no more than so
#: many different names around them.
DATA_LITERALS, DATA_SHARE, DATA_NAMES = 6, 0.6, 12
#: Template-like: of so many trigrams of names at least, so many standard deviations fewer are different than in files of
#: that size and language, of which there have to be so many.
TEMPLATE_TRIGRAMS, TEMPLATE_DEVIATIONS, TEMPLATE_FILES = 400, -6.0, 100
#: A naming style is foreign to a language if it makes up less of its compound names than this, and a file is if most of
#: its compound names are of such a style, with so much log-likelihood against the styles of its language; half of it will do under a version or licence.
FOREIGN_STYLE, FOREIGN_EVIDENCE = 0.05, 20.0

# What generators and copied libraries write at the top of a file.
GENERATED = re.compile(
    r"@generated\b|<auto-?generated\b|\bauto(?:matically|-|\s)?\s?generated\b|\bcode generated\b|\bgenerated (?:by|from|code|file)\b|\bmachine[- ](?:output|generated|made)\b"
    r"|\bdo not (?:edit|modify)(?: (?:this file|by hand|manually)|[.!*/ ]*$)|\b(?:manual )?changes (?:will|may) be (?:overwritten|lost)|\bregenerate (?:with|using|by)\b|\bthis file (?:is|was) (?:produced|created|written) by\b",
    re.I | re.M,
)
NEGATED = re.compile(r"\b(?:not|never|no longer|isn't|wasn't)\s+(?:auto(?:matically|-)?\s?)?generated\b", re.I)
LICENSE = re.compile(
    r"licen[cs]ed under|released under|\bSPDX-License-Identifier\b|\b(?:MIT|BSD|ISC|Apache|GPL|LGPL|MPL)\b[^\n]{0,20}\blicen[cs]e|redistribution in source|permission is hereby granted|\((?:MIT|BSD-\d-Clause|ISC|Apache-2\.0|[AL]?GPL[^)]*|MPL[^)]*)\)",
    re.I,
)
ORIGIN = re.compile(
    r"\bupstream\s*:|\b(?:copied|vendored|taken|adapted|imported|backported) from\b|\(c\)[^\n]*\b(?:contributors|authors)\b|^\W*[\w.@/-]+\s+v?\d+\.\d+(?:\.\d+)\b|\blocal patches\b",
    re.I | re.M,
)

VERSION = re.compile(r"\b[vV@]?\s?\d+\.\d+\.\d+\b")

_NAMES = r"node_modules|bower_components|jspm_packages|third[_-]?party|_vendor|vendored|external|extern|Pods|Carthage"
#: Folders of copied packages; vendor counts only outside a source folder, where it may be a word of the domain.
VENDORED_PATH = (
    rf"(?i)(?:^|/)(?:{_NAMES})/[^/]+/"
    r"|^(?:(?!(?:src|lib|libs|app|apps|cmd|pkg|internal|services?|server|packages|modules|core|main)/)[^/]+/){0,2}vendor/[^/]+/"
)
GENERATED_PATH = (
    r"(?i)(?:^|/)(?:gen|__generated__|generated-sources|generated_sources|autogen)/|(?:^|/)(?:build|target|out|dist|obj)/generated/|(?:^|/)src/generated/"
    r"|[._](?:generated|gen|pb|g|designer)\.[a-z]+$|_pb\.[a-z]+$|_pb2(?:_grpc)?\.pyi?$|_grpc\.pb\.go$"
    r"|(?-i:[a-z0-9]Grpc\.java$)"
)
VENDORED, GENERATED_AT = re.compile(VENDORED_PATH), re.compile(GENERATED_PATH)

COMMENT_LINE = re.compile(r"\s*(?://|#|\*|/\*|<!--|--|\"\"\"|'''|;)")
LITERAL = re.compile(r'"[^"\n]*"|\'[^\'\n]*\'|(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[A-Za-z]?(?!\w)')
COMPOUND = re.compile(r"(?P<snake>^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$)|(?P<camel>^[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+$)|(?P<pascal>^(?:[A-Z][a-z0-9]+){2,}$)")


def family(path: str | None) -> str | None:
    return FAMILY.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path else None


def names(text: str) -> set[str]:
    return set(NAME.findall(text))


@lru_cache(maxsize=1 << 16)
def style(name: str) -> str | None:
    m = COMPOUND.match(name)
    return m.lastgroup if m else None


def top(text: str) -> str:
    """The comments at the head of a text."""
    out, close = [], ""
    for line in text.lstrip("\ufeff").split("\n"):
        s = line.strip()
        if not (close or not s or COMMENT_LINE.match(s)):
            break
        out.append(s)
        if not close:
            close = "*/" if s.startswith("/*") else "-->" if s.startswith("<!--") else ""
        if close in s:
            close = ""
    return "\n".join(out)


@lru_cache(maxsize=1 << 16)
def _indexes(name: str) -> tuple[int, ...]:
    """The trigrams of a name, as numbers below SYMBOLS ** 3. Most names occur in many files."""
    codes = [0, 0, *map(_CODE.__getitem__, name), 1]
    return tuple([(a * SYMBOLS + b) * SYMBOLS + c for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)])


_CODE = {c: i for i, c in enumerate("^\n$_" + string.digits + string.ascii_letters)}


def diversity(found: list[str], own: set[str]) -> tuple[int, int]:
    """Trigrams of all names ``found`` in a text, repeated ones too, and how many of them are different."""
    return len("".join(found)) + len(found), len(set().union(*map(_indexes, own)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, text) to counts (family, item, n) of one partition, over the files that no other sign tells and whose names are
    not all short: trigrams of their names, and, below 0, styles and the sums for the usual diversity."""
    words: dict[str, Counter] = {}
    sums: dict[str, Counter] = {}
    for batch in batches:
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lang = family(path)
            found = NAME.findall(text) if lang and text else []
            own = set(found)
            if own and not (told_by_path(path) or told_by_head(text) or short_names(found, own) or is_data(text)):
                words.setdefault(lang, Counter()).update(own)
                n, different = diversity(found, own)
                if n >= TEMPLATE_TRIGRAMS:
                    x, y = math.log(n), math.log(different)
                    sums.setdefault(lang, Counter()).update(dict(zip(SUMS, (round(v * SCALE) for v in (1, x, y, x * x, x * y, y * y)), strict=True)))
    for lang, counter in words.items():
        items = Counter()
        for w, n in counter.items():
            for i in _indexes(w):
                items[i] += n
            if s := style(w):
                items[STYLES[s]] += n
        items.update(sums.get(lang, {}))
        yield pa.RecordBatch.from_pydict(
            {"family": [lang] * len(items), "item": pa.array(list(items), pa.int64()), "n": pa.array(list(items.values()), pa.int64())}
        )


STYLES = {"snake": -1, "camel": -2, "pascal": -3}
SUMS, SCALE = range(-9, -3), 1 << 20


class Names:
    """Character trigram models of the names of each language: bits of each trigram, how often each style occurs, and how
    the number of different trigrams grows with the size of a file."""

    def __init__(self, counts: dict[str, dict[int, int]]):
        self.costs: dict[str, array] = {}
        self.typical: dict[str, float] = {}
        self.styles: dict[str, dict[str, int]] = {}
        self.usual: dict[str, tuple[float, float, float] | None] = {}
        for lang, items in counts.items():
            n = np.zeros(SYMBOLS**3)
            at = [i for i in items if i >= 0]
            n[at] = [items[i] for i in at]
            pairs = n.reshape(-1, SYMBOLS)
            bits = -np.log2((pairs + SMOOTHING) / (pairs.sum(1, keepdims=True) + SMOOTHING * SYMBOLS)).ravel()
            self.typical[lang] = float((n * bits).sum() / max(1.0, n.sum()))
            self.costs[lang] = array("f", bits.astype(np.float32).tobytes())
            self.styles[lang] = {s: items.get(i, 0) for s, i in STYLES.items()}
            self.usual[lang] = self._line([items.get(i, 0) / SCALE for i in SUMS])
        self._wrap()

    @staticmethod
    def _line(sums: list[float]) -> tuple[float, float, float] | None:
        """Level, slope and deviation of log different trigrams by log trigrams."""
        n, x, y, xx, xy, yy = sums
        spread_x = xx - x * x / n if n else 0.0
        if n < TEMPLATE_FILES or spread_x <= 0:
            return None
        slope = (xy - x * y / n) / spread_x
        left = max(0.0, yy - y * y / n - slope * (xy - x * y / n))
        return (y - slope * x) / n, slope, max(1e-3, math.sqrt(left / n))

    def _wrap(self) -> None:
        self.bits = lru_cache(maxsize=1 << 17)(self._bits)

    def _bits(self, lang: str, name: str) -> float:
        cost, at = self.costs[lang], _indexes(name)
        return sum(cost[i] for i in at) / len(at)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "bits"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._wrap()


def train(files: DataFrame) -> Names:
    """Models of the files (file_path, text) that no header, path or share of literals tells, each counting a name once.

    Counts are summed in each partition before the shuffle. What reaches the driver, and the executors as models, is
    bounded: SYMBOLS ** 3 numbers, three styles and six sums for each of the known languages.
    """
    sums = (
        spread(files.select("file_path", "text"))
        .mapInArrow(_count, "family string, item bigint, n bigint")
        .groupBy("family", "item")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts: dict[str, dict[int, int]] = {}
    for lang, item, n in zip(*(sums.column(i).to_pylist() for i in range(3)), strict=True):
        counts.setdefault(lang, {})[item] = n
    return Names(counts)


def is_data(text: str) -> bool:
    if text.count(",") < DATA_LITERALS:
        return False
    literals = LITERAL.findall(text)
    n, size = len(literals), len("".join(literals))
    visible = len(text) - text.count(" ") - text.count("\n") - text.count(",") - text.count("\r")
    if n < DATA_LITERALS or size < DATA_SHARE * visible:
        return False
    return len(names(LITERAL.sub("", text))) <= DATA_NAMES


def short_names(found: list[str], own: set[str]) -> bool:
    """Names that are short on average and repeat over and over, as those of a minifier do: prose or another language does
    not."""
    return len(own) >= 8 and len("".join(own)) < MANGLED_LENGTH * len(own) and len(own) < 0.6 * len(found)


def mangled(lang: str, found: list[str], own: set[str], model: Names) -> bool:
    """Short names, used over and over, that cost many bits under the model of their language or are mostly tiny."""
    if not short_names(found, own):
        return False
    if sum(len(w) < 3 for w in own) > TINY_SHARE * len(own):
        return True
    return lang in model.costs and sum(model.bits(lang, w) for w in own) > MANGLED_BITS * model.typical[lang] * len(own)


def is_template(lang: str, found: list[str], own: set[str], model: Names) -> bool:
    """Whether the names of a text have far fewer different trigrams than other texts of its size."""
    usual = model.usual.get(lang)
    if usual is None:
        return False
    n, different = diversity(found, own)
    level, slope, deviation = usual
    return n >= TEMPLATE_TRIGRAMS and math.log(different) - level - slope * math.log(n) < TEMPLATE_DEVIATIONS * deviation


def foreign(lang: str, text: str, own: set[str], styles: dict[str, dict[str, int]]) -> bool:
    """Whether the compound names of a file are mostly of a style that its language hardly uses, though it is written in
    that language by its typical tokens."""
    count = Counter(s for w in own if (s := style(w)))
    known, n = styles.get(lang, {}), sum(count.values())
    total = sum(known.values())
    if not n or not total:
        return False
    s, most = count.most_common(1)[0]
    evidence = sum(c * math.log(c / n * (total + len(STYLES)) / (known.get(k, 0) + 1)) for k, c in count.items())
    if most <= 0.5 * n or known.get(s, 0) >= FOREIGN_STYLE * total or evidence < FOREIGN_EVIDENCE / 2:
        return False
    if evidence < FOREIGN_EVIDENCE and not ((head := top(text)) and (VERSION.search(head) or LICENSE.search(head))):
        return False
    return syntax.ranked(text)[0] == lang


def told_by_head(text: str) -> str | None:
    head = top(text)
    if head:
        if GENERATED.search(NEGATED.sub("", head)):
            return "generated"
        if LICENSE.search(head) and ORIGIN.search(head):
            return "vendored"
    return None


def told_by_path(path: str | None) -> str | None:
    if path:
        unix = path.replace("\\", "/")
        if VENDORED.search(unix):
            return "vendored"
        if GENERATED_AT.search(unix):
            return "generated"
    return None


def signs(path: str | None, text: str | None, model: Names) -> Iterator[tuple[str, str]]:
    """(sign, origin) of all that speaks for an origin, the names first: mangled, template, foreign; literals, head, path."""
    lang = family(path)
    if text:
        found = NAME.findall(text)
        own = set(found)
        data = is_data(text)
        if data:
            yield "literals", "data"
        elif lang:
            if mangled(lang, found, own, model):
                yield "mangled", "minified"
            if is_template(lang, found, own, model):
                yield "template", "generated"
            if foreign(lang, text, own, model.styles):
                yield "foreign", "vendored"
        if told := told_by_head(text):
            yield "head", told
    if told := told_by_path(path):
        yield "path", told


def judge(path: str | None, text: str | None, model: Names) -> str | None:
    """generated, vendored, data, minified, or None for a file written by hand: what the first of the ``signs`` says.

    A file that merely mentions such things in its code, or is named like them, is written by hand. Null and empty texts
    are judged by their path alone; a null path by the text alone, without the models of names.
    """
    return next((origin for _, origin in signs(path, text, model)), None)


def classify(files: DataFrame, model: Names) -> DataFrame:
    """Rows (file_id, origin) of the files (file_id, file_path, text) that are not written by hand."""
    shared = files.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths, texts = (batch.column(i).to_pylist() for i in range(3))
            origin = [judge(p, t, shared.value) for p, t in zip(paths, texts, strict=True)]
            keep = [i for i, o in enumerate(origin) if o]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in keep], pa.string()), pa.array([origin[i] for i in keep], pa.string())],
                ["file_id", "origin"],
            )

    return spread(files.select("file_id", "file_path", "text")).mapInArrow(run, "file_id string, origin string")


def origins(index: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (file_id, origin) of the files of ``index`` (id, file_path) not written by hand, their text in ``texts``.

    Texts are judged where they are read and only verdicts are joined. A file of the index without a text is judged by
    the path alone. Repeated rows count once; no files give no rows.
    """
    listed = index.where(F.col("id").isNotNull()).select(F.col("id").alias("file_id"), "file_path").distinct()
    held = texts.where("text is not null and text <> ''")
    by_text = classify(held, train(held)).join(listed.select("file_id"), "file_id", "left_semi")
    path = F.replace("file_path", F.lit("\\"), F.lit("/"))
    by_path = (
        listed.withColumn("origin", F.when(path.rlike(VENDORED_PATH), "vendored").when(path.rlike(GENERATED_PATH), "generated"))
        .where("origin is not null")
        .join(held.select("file_id"), "file_id", "left_anti")
        .select("file_id", "origin")
    )
    return by_text.unionByName(by_path).distinct()
