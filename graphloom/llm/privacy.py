"""Personal information in free text: found, replaced by typed placeholders."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import join_on_unique
from graphloom.runtime import Scratch, spread

#: Bits by which seeing a word must raise the odds of a person being named for the word to count as part of a name.
DISCLOSURE_BITS = 3.5
#: and the log-likelihood that must speak for it, its own and that of the best word it is named together with (an initial has
#: enough): two places of a word alone, or one place of two words that occur nowhere else. Further words of a town must follow it as many bits more often than chance has it.
EVIDENCE = 9.2
#: How near a person is named (as a place of a name or an email) for a number's context to speak of persons.
NEAR = 150
#: A value in so many documents, and of less self-information in bits, is a shared contact: it is generalised, not removed.
SHARED_DOCUMENTS, SHARED_BITS = 20, 6.0
#: A role (given or family name) a word has in at least this share of the names it is in.
ROLE_SHARE = 0.2

#: Filters have so many bits a term (one other term in ten million passes), up to 32 MB a role.
BITS_PER_TERM, MAX_FILTER_BITS, FILTER_HASHES = 32, 1 << 28, 11

_LETTER = "[^\\W\\d_][\u0300-\u036f]*"
WORD = re.compile(f"(?:{_LETTER})+(?:['\u2019\u2011-](?:{_LETTER})+)*")
GAP = "[ \u00a0\u2009\u202f\u3000]{1,2}"
PARTICLES = {"van", "der", "den", "de", "von", "vom", "zu", "zur", "del", "della", "di", "da", "dos", "das", "du", "des", "la", "le", "las", "los", "ten", "ter", "te", "bin", "ibn", "al", "el", "af", "av"}

EMAIL = re.compile(
    r"(?<![\w.+/:@%-])(?P<local>[\w%+-]+(?:\.[\w%+-]+)*)"
    r"(?:@|\s?[\[({<]\s?(?:at|AT|At|ät|chez|arroba)\s?[\])}>]\s?)"
    r"(?P<domain>(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.|\s?[\[({<]\s?(?:dot|DOT|Dot|punkt|point|punto)\s?[\])}>]\s?))+[A-Za-z]{2,})(?![\w@]|-\w|:[\w/~]|\.\d)"
    r"|(?<![\w.+/:@%-])[\w%+-]+(?:(?:\.| dot )[\w%+-]+)* (?:at|AT) [A-Za-z0-9-]+(?: (?:dot|DOT) [A-Za-z0-9-]+)* (?:dot|DOT) [A-Za-z]{2,}(?!\w)"
)

_NUMBERED = re.compile(
    r"(?:\b(?:build|run|row|rows|ticket|version|order|ref|sha|commit|port|case|release|request|issue|job|seq|section|bump|pin|reverts?|error|code|line|step|page|batch|revision)(?:[ _-]?(?:id|no|nr|number))?|(?<![\w-])id|[#@])[\s=:#.]*$",
    re.I,
)
ID_NUMBER = re.compile(
    r"(?<![\w.+/-])(?:"
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"  # two letters, six digits, a letter
    r"|\d{3}-\d{2}-\d{4}"
    r"|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{3}\.\d{3}\.\d{3}/\d{2}"
    r"|[XYZ]-?\d{7,8}-?[A-Z]|\d{8}-?[A-HJ-NP-TV-Z]"
    r"|\d{2} ?\d{4,6} ?[A-Z] ?\d{2,3}"
    r"|(?:19|20)?(?P<date>\d{6})[-+]\d{4}"
    r"|756\.\d{4}\.\d{4}\.\d{2}"
    r"|[12] \d{2} (?:0[1-9]|1[0-2]|[2-9]\d) \d{2,3} \d{3} \d{3}(?: \d{2})?"
    r")(?![\w/]|-\w|\.\d)"
)
ID_LABEL = re.compile(
    r"\b(?:passport|passnummer|reisepass|pasaporte|passeport|ausweis(?:nummer)?|id card|identity (?:card|number)|personal id|tax id|steuer-?id(?:nummer)?|national insurance(?: number)?|social security(?: number)?|ssn|nino|nie|dni|nif|cpf|curp|sozialversicherungsnummer|versicherungsnummer)\b"
    r"(?:[ \t]+(?:or id card|number|no\.?|nr\.?|nummer|is|ist))*[ \t]*[:=#]?[ \t]*",
    re.I,
)
LABELLED = re.compile(r"(?=[A-Z0-9 .-]*\d{3})[A-Z0-9]+(?:[ .-]?[A-Z0-9]+){0,5}(?![\w/]|-\w|\.\d)")
PHONE = re.compile(
    r"(?<![\w.+/@-])(?:"
    r"(?:\+|00)\d{1,3}[ .\-/]?(?:\(\d{1,5}\)[ .\-/]?)?\d{1,5}(?:[ .\-/]?\d{2,8}){0,6}"
    r"|\(0\d{1,5}\)[ ]?\d{2,8}(?:[ -]?\d{2,5}){0,3}|\(\d{3}\)[ ]?\d{3}[-. ]\d{4}"
    r"|0\d(?:[. ]\d{2}){4}"
    r"|0\d{1,5}/\d{3,9}(?:[ -]\d{1,5})*"
    r"|0\d{2,5}[ -]\d{3,8}(?:[ -]\d{2,5}){0,2}"
    r"|0\d{9,11}"
    r"|(?:1[-. ])?[2-9]\d{2}(?P<sep>[-. ])[2-9]\d{2}(?P=sep)\d{4}"
    r"|[6789]\d{2} \d{2} \d{2} \d{2}|[6789]\d{2} \d{3} \d{3}"
    r")(?:[ ]?(?:ext|x|Durchwahl)\.?[ ]?\d{1,5})?(?![\w/@]|[-.:]\d|-\w)"
)

_CAP = r"[A-ZÀ-ÞŁŚŻŽŠĐĆČŐŰ][\w'’-]*"
_UNIT = r"(?i:flat|apt|apartment|unit|suite|room|floor|studio|wohnung|piso|appt)\.? ?#?\d+[A-Za-z]?"
_STREET_EN = r"(?i:street|str|st|road|rd|lane|ln|avenue|ave|drive|dr|court|ct|way|place|pl|close|crescent|cres|square|sq|terrace|boulevard|blvd|hill|row|mews|gardens|grove|park|parkway|pkwy|highway|hwy|walk|wharf|quay|green|rise)\b\.?"
_ZIP = r"(?:\d{4,6}(?:-\d{3,4})?|[A-Z]{1,2}\d[\dA-Z]? ?\d[A-Z]{2})"
_TOWN = rf"(?P<town>{_CAP})(?P<rest>(?:[ -]{_CAP}){{0,2}})"
ADDRESS = [
    re.compile(rf"(?<![\w.])(?:{_UNIT},? )?\d{{1,5}}[A-Za-z]?,? (?:{_CAP}\.? ){{1,4}}?{_STREET_EN}(?:,? {_UNIT})?, {_TOWN}(?P<zip>(?:,? [A-Z]{{2}})?,? {_ZIP})?(?!\w)"),
    re.compile(rf"(?<![\w.])(?:{_UNIT},? )?\d{{1,4}}(?: ?(?i:bis|ter))?,? (?i:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|cours|route|passage|square)(?: [\w'’-]+){{1,6}}?,? {_ZIP} {_TOWN}"),
    re.compile(rf"(?<![\w.])(?i:calle|c/|avenida|avda\.?|av\.|plaza|paseo|camino|carretera|ronda|via|viale|piazza|corso|rua)(?: [\w'’-]+){{1,6}}?,? \d{{1,4}}[A-Za-z]?(?:,? \d+º ?\w?)?,? {_ZIP} {_TOWN}"),
    re.compile(rf"(?<!\w)(?:{_CAP} ){{0,2}}{_CAP[:-1]}*?(?i:straße|strasse|str\.|gasse|allee|weg|platz|ring|damm|ufer|steig|hof|graben|laan|straat|plein|gracht) ?\d{{1,4}}[A-Za-z]?(?:, {_UNIT})?, {_ZIP} {_TOWN}"),
    re.compile(rf"(?<!\w)(?:{_CAP} ){{1,4}}\d{{1,4}}[A-Za-z]?, \d{{4,5}} {_TOWN}"),
]

_N = rf"(?:{WORD.pattern})"
_P = r"(?i:" + "|".join(sorted(PARTICLES)) + r")"
_INITIAL = rf"(?:{_LETTER}\.)"
#: A span that may be a name: given and family name, family and given name, or an initial in place of the given name.
SPAN = rf"(?:(?P<f1>(?:{_P}{GAP})*{_N}),{GAP}(?P<g1>{_N}|{_INITIAL})(?!\.)|(?P<g2>{_INITIAL}(?:{GAP}?{_INITIAL})?|{_N}){GAP}(?P<f2>(?:{_P}{GAP})*{_N}))"
#: Places where a person is named, as forms of letters, logs, code and records have them.
ANCHORS = [
    re.compile(rf"(?i:\b(?:reviewed|signed-off|acked|co-authored|authored|reported|tested|suggested|approved|written|opened|closed|assigned)-by:|@author|\b(?:assignee|author|owner|reviewer|reporter|contact|customer|caller|name|from|attn|cc|user)\b ?[:=;])[ \t]*[\"'<]?{SPAN}(?!\.\w|\()"),
    re.compile(rf"(?<!\d )(?<!\w)(?:Mrs?|MRS?|Ms|Mx|Dr|DR|Prof|PROF|Herrn?|HERRN?|Frau|FRAU|Mme|Mlle|Sra?|Señora?|Señor|Monsieur|Madame)\b\.?[ \t]+{SPAN}"),
    re.compile(rf"(?i:(?:(?:kind|best|warm|many) regards|best|thanks|cheers|yours(?: sincerely)?|sincerely|mit freundlichen grüßen|viele grüße|cordialement|bien à vous|saludos|un saludo|atentamente),)\s+{SPAN}"),
    re.compile(rf"(?i:\b(?:cc|caller|spoke with|talked to|spoken with|met with|attn))[ \t]+{SPAN}"),
    re.compile(rf"(?i:\b(?:as|per|ask|asked))[ \t]+{SPAN}(?=[ \t]+(?i:said|wrote|reported|confirmed|mentioned|explained)\b)"),
]
#: What follows a person's name: an email in brackets or in the next field, or what persons do.
AFTER = re.compile(rf"[ \t]*<(?P<in>[^<>\n]{{3,80}})>|;(?P<next>[^;\n]{{3,80}});|[ \t]+(?i:asked (?:for|about|whether)|owns the|wrote:|said on|said:)")
BEFORE = re.compile(rf"(?<![\w'.-]){SPAN}\Z")
AT = re.compile(r"@|[\[({<]\s?(?:at|ät|chez|arroba)\s?[\])}>]", re.I)
CUE = re.compile(r"([^\W\d_]+)[\W\d_]*\Z")


#: What a text must hold, in lower case, for each pattern above to be tried on it.
ANCHOR_WORDS = [
    ("-by:", "@author", "assignee", "author", "owner", "reviewer", "reporter", "contact", "customer", "caller", "name", "from", "attn", "cc", "user"),
    ("mr", "ms", "mx", "dr", "prof", "herr", "frau", "mme", "mlle", "sr", "señor", "monsieur", "madame"),
    ("regards,", "best,", "thanks,", "cheers,", "yours,", "sincerely,", "grüßen,", "grüße,", "cordialement,", "à vous,", "saludos,", "saludo,", "atentamente,"),
    ("cc", "caller", "spoke", "talked", "met with", "attn"),
    ("as ", "per ", "ask"),
]
ID_WORDS = (
    "passport", "passnummer", "reisepass", "pasaporte", "passeport", "ausweis", "id card", "identity", "personal id", "tax id", "steuer",
    "national insurance", "social security", "ssn", "nino", "nie", "dni", "nif", "cpf", "curp", "versicherungsnummer",
)
ADDRESS_WORDS = [
    ("street", "str", "st", "road", "rd", "lane", "ln", "avenue", "ave", "drive", "dr", "court", "ct", "way", "place", "pl", "close", "cres", "sq", "ter", "boulevard", "blvd", "hill", "row", "mews", "garden", "grove", "park", "pk", "highway", "hwy", "walk", "wharf", "quay", "green", "rise"),
    ("rue", "avenue", "av.", "boulevard", "bd", "place", "chemin", "impasse", "allée", "quai", "cours", "route", "passage", "square"),
    ("calle", "c/", "avenida", "avda", "av.", "plaza", "paseo", "camino", "carretera", "ronda", "via", "piazza", "corso", "rua"),
    ("straße", "strasse", "str.", "gasse", "allee", "weg", "platz", "ring", "damm", "ufer", "steig", "hof", "graben", "laan", "straat", "plein", "gracht"),
    (", ",),
]
#: What the address patterns but the first cannot do without: the end of a post code before a town; what the first cannot.
_TOWN_CODE = re.compile(rf"(?:\d{{3}}|\d[A-Z]{{2}}) {_CAP[:_CAP.index(']') + 1]}")
_NUMBER_STREET = re.compile(rf"\d[A-Za-z]?,? {_CAP[:_CAP.index(']') + 1]}")


def folded(text: str) -> str:
    """Lower case as patterns without letter case take it."""
    return text.lower().replace("ſ", "s").replace("ı", "i")


def holds(low: str, words: tuple[str, ...]) -> bool:
    return any(w in low for w in words)


@lru_cache(maxsize=1 << 17)
def norm(word: str) -> str:
    return unicodedata.normalize("NFC", word).lower().replace("\u2019", "'").replace("\u2011", "-")


@dataclass(frozen=True)
class Pii:
    start: int
    end: int
    kind: str


def _candidates(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, cue) of what has the form of an email, identity number or phone number. The cue is the word before
    a number that no label explains; numbers behind words of _NUMBERED are none."""
    low = folded(text)
    if AT.search(text) or " dot " in low:
        for m in EMAIL.finditer(text):
            yield m.start(), m.end(), "email", ""
    if not any(c.isdigit() for c in text):
        return
    for m in ID_LABEL.finditer(text) if holds(low, ID_WORDS) else ():
        value = ID_NUMBER.match(text, m.end()) or LABELLED.match(text, m.end())
        if value and len(re.sub(r"\W", "", value[0])) >= 6 and not re.fullmatch(r"\d{4}-\d\d-\d\d.*", value[0]):
            yield value.start(), value.end(), "id_number", ""
    for m in ID_NUMBER.finditer(text):
        if (d := m["date"]) and not ("01" <= d[2:4] <= "12" and "01" <= d[4:6] <= "91"):
            continue
        before = text[max(0, m.start() - 24) : m.start()]
        if not _NUMBERED.search(before):
            yield m.start(), m.end(), "id_number", _cue(before)
    for m in PHONE.finditer(text):
        digits = re.sub(r"\D", "", re.split(r"ext|x|D", m[0])[0])
        before = text[max(0, m.start() - 24) : m.start()]
        if 8 <= len(digits) <= 15 and len(set(digits)) > 2 and not _NUMBERED.search(before):
            yield m.start(), m.end(), "phone", _cue(before)


def _cue(before: str) -> str:
    m = CUE.search(before.rsplit("\n", 1)[-1])
    return norm(m[1]) if m else ""


def _structured(text: str, known) -> list[Pii]:
    """Emails, identity numbers and phone numbers, but for numbers behind a cue that speaks of no person in the corpus."""
    out: list[Pii] = []
    for lo, hi, kind, cue in _candidates(text):
        if all(hi <= p.start or lo >= p.end for p in out) and not (cue and known.has("cue", f"{kind}\t{cue}")):
            out.append(Pii(lo, hi, kind))
    return out


def _addresses(text: str, pairs) -> Iterator[tuple[int, int, str, list[str], bool]]:
    """(start, end, town, further words, whether a post code follows them) of the addresses in a text; ``pairs`` says
    which words belong to a town that begins like this."""
    low = folded(text)
    coded, numbered = _TOWN_CODE.search(text), ", " in text and _NUMBER_STREET.search(text)
    for i, pattern in enumerate(ADDRESS):
        if not (coded if i else numbered) or not holds(low, ADDRESS_WORDS[i]):
            continue
        for m in pattern.finditer(text):
            groups = m.groupdict()
            rest = list(re.finditer(r"[^ -]+", m["rest"]))
            words = [norm(w[0]) for w in rest]
            end, town = m.end("town"), norm(m["town"])
            if groups.get("zip"):
                yield m.start(), m.end(), town, [w for w, x in zip(words, rest, strict=True) if not re.fullmatch("[A-Z]{2}", x[0])], True
                continue
            if pairs is not None:
                for w, x in zip(words, rest, strict=True):
                    if not pairs(town, w):
                        break
                    town, end = f"{town} {w}", m.start("rest") + x.end()
                if (z := re.compile(rf",? {_ZIP}(?!\w)").match(text, end)) and len(groups) == 3:
                    end = z.end()
            yield m.start(), end, town, words, False


def _head(span: str) -> str:
    """The last word of a family name without its particles."""
    return norm(WORD.findall(span)[-1])


def _anchored(text: str) -> Iterator[tuple[int, str | None, str]]:
    """(place, given name or None for an initial, family name) of the spans in places where a person is named."""
    seen = set()
    low = folded(text)
    for pattern, needed in zip(ANCHORS, ANCHOR_WORDS, strict=True):
        for m in pattern.finditer(text) if holds(low, needed) else ():
            which = "1" if m["f1"] else "2"
            at = m.start("f" + which)
            if at in seen:
                continue
            seen.add(at)
            yield at, *_parts(m, which)
    for after in AFTER.finditer(text):
        inside = after["in"] or after["next"]
        if inside and not AT.search(inside):
            continue
        lo = max(0, after.start() - 60)
        m = BEFORE.search(text[lo : after.start()])
        if m:
            which = "1" if m["f1"] else "2"
            at = lo + m.start("f" + which)
            if at not in seen:
                seen.add(at)
                yield at, *_parts(m, which)


def _parts(m: re.Match, which: str) -> tuple[str | None, str]:
    given = m["g" + which]
    return None if given.endswith(".") else norm(given), _head(m["f" + which])


INITIAL = "."  # stands for any initial in pairs
COUNTS = "kind string, term string, n bigint, a bigint, b bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to counts (kind, term, n, a, b) of one partition.

    word: how often a word occurs, and how often as given and as family name in places where a person is named. pair: a
    given and a family name there, with a tab between. town: what begins like a town, with and without a further word,
    and how often a post code follows. cue: a kind of number and the word before it, and how often a person is near.
    value: what has the form of personal data, and in how many documents. docs: their number.
    """
    raw, n, given, family = Counter(), Counter(), Counter(), Counter()
    pairs, towns, coded_towns, cues, near, values, docs = Counter(), Counter(), Counter(), Counter(), Counter(), Counter(), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            docs += 1
            raw.update(WORD.findall(EMAIL.sub(" ", text) if AT.search(text) or " dot " in folded(text) else text))
            places = []
            for at, g, f in _anchored(text):
                places.append(at)
                family[f] += 1
                pairs[f"{g or INITIAL}\t{f}"] += 1
                if g:
                    given[g] += 1
            found = list(_candidates(text))
            places += [lo for lo, _, kind, _ in found if kind == "email"]
            places.sort()
            for lo, _, kind, cue in found:
                if cue:
                    cues[f"{kind}\t{cue}"] += 1
                    i = bisect_left(places, lo - NEAR)
                    near[f"{kind}\t{cue}"] += i < len(places) and places[i] <= lo + NEAR
            addresses = list(_addresses(text, None))
            values.update({_value(kind, text[lo:hi]) for lo, hi, kind, _ in found} | {_value("address", text[lo:hi]) for lo, hi, *_ in addresses})
            for _, _, town, more, coded in addresses:
                towns[town + "\t"] += 1
                for w in more:
                    towns[f"{town}\t{w}"] += 1
                    coded_towns[f"{town}\t{w}"] += coded
                    town = f"{town} {w}"
                    towns[town + "\t"] += 1
    for word, k in raw.items():
        n[norm(word)] += k
    none = Counter()
    for kind, all_of, a, b in (
        ("word", n, given, family), ("pair", pairs, none, none), ("town", towns, coded_towns, none), ("cue", cues, near, none), ("value", values, none, none), ("docs", Counter({"": docs}), none, none),
    ):
        terms = list(all_of)
        columns = [pa.array([c[t] for t in terms], pa.int64()) for c in (all_of, a, b)]
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(terms), pa.string()), pa.array(terms, pa.string()), *columns], ["kind", "term", "n", "a", "b"])


def _value(kind: str, value: str) -> str:
    return f"{kind}\t{norm(value)}"


def terms(docs: DataFrame) -> DataFrame:
    """Corpus-wide counts of all terms, partial sums before the shuffle."""
    sums = (F.sum(c).alias(c) for c in ("n", "a", "b"))
    return spread(docs).mapInArrow(_count, COUNTS).groupBy("kind", "term").agg(*sums)


def _evidence(k: Column, chance: Column) -> Column:
    """Log-likelihood of k events against the number that chance has, for more as for less of them."""
    return F.when(k > 0, k * F.ln(k / chance)).otherwise(0.0) - k + chance


def disclosing(counts: DataFrame) -> DataFrame:
    """Rows (role, term), each once, of the terms that reveal a person, belong to a town, deny a person or are shared.

    How strongly a word reveals a person is its pointwise mutual information with the places where a person is named:
    log2 of P(person | word) / P(person). A name occurs there far more often than chance, any other word does not. Words
    seen too little for that count if what they are named together with has the evidence they lack. A cue denies
    a person (role cue) if persons are named near numbers behind it as many bits less often than near others; a value
    that many documents hold says little about anybody (role shared).
    """
    of = lambda kind: counts.where(F.col("kind") == kind).drop("kind")
    words = of("word").select("term", "n", F.col("a").alias("given"), F.col("b").alias("family"))
    both = F.col("given") + F.col("family")
    base = words.agg((F.sum(both) / F.sum("n")).alias("base"))
    bits = F.log2(both / F.col("n") / F.col("base"))
    named = words.where(both > 0).crossJoin(F.broadcast(base)).where(bits >= DISCLOSURE_BITS)  # one row
    named = named.withColumn("own", _evidence(both, F.col("n") * F.col("base")))
    pair = of("pair").select(F.substring_index("term", "\t", 1).alias("g"), F.substring_index("term", "\t", -1).alias("f"))
    other = named.select(F.col("term").alias("other"), F.col("own").alias("more")).unionByName(
        docs_of(counts).select(F.lit(INITIAL).alias("other"), F.lit(EVIDENCE).alias("more"))
    )
    partner = (
        pair.select(F.col("f").alias("term"), F.col("g").alias("other")).unionByName(pair.select(F.col("g").alias("term"), F.col("f").alias("other")))
        .join(named.where(F.col("own") < EVIDENCE).select("term"), "term", "left_semi")  # few pairs each
        .join(other, "other")
        .groupBy("term")
        .agg(F.max("more").alias("more"))
    )
    named = named.join(partner, "term", "left").where(F.col("own") + F.coalesce("more", F.lit(0.0)) >= EVIDENCE)
    pairs = of("town").select("term", "n", "a", F.substring_index("term", "\t", 1).alias("town"), F.substring_index("term", "\t", -1).alias("word"))
    ends, pairs = pairs.where("word = ''"), pairs.where("word <> ''")
    of_town = ends.select("town", F.col("n").alias("all"))
    of_word = pairs.groupBy("word").agg(F.sum("n").alias("after"))
    sums = ends.agg(F.sum("n").alias("towns")).crossJoin(words.agg(F.sum("n").alias("words")))
    k, elsewhere = F.col("n"), F.coalesce("anywhere", F.lit(0)) - F.col("after")
    chance = F.greatest((F.col("after") - k) / F.greatest(F.col("towns") - F.col("all"), F.lit(1)), (F.greatest(elsewhere, F.lit(0)) + 1) / F.col("words"))
    by_chance = F.col("all") * chance
    likely = (k >= by_chance * 2**DISCLOSURE_BITS) & (_evidence(k, by_chance) >= EVIDENCE)
    second = (
        pairs.join(of_town, "town")
        .join(of_word, "word")
        .join(words.select(F.col("term").alias("word"), F.col("n").alias("anywhere")), "word", "left")
        .crossJoin(F.broadcast(sums))  # one row
        .where((F.col("a") > 0) | likely)
        .select(F.lit("town").alias("role"), "term")
    )
    cues = of("cue")
    usual = cues.groupBy(F.substring_index("term", "\t", 1).alias("what")).agg((F.sum("a") / F.sum("n")).alias("usual"))
    expected = F.col("n") * F.col("usual")
    fewer = F.log2((F.col("a") + 0.5) / (expected + 0.5)) <= -DISCLOSURE_BITS
    denying = cues.withColumn("what", F.substring_index("term", "\t", 1)).join(F.broadcast(usual), "what").where(fewer & (_evidence(F.col("a"), expected) >= EVIDENCE))  # two rows
    shared = of("value").where(F.col("n") >= SHARED_DOCUMENTS).crossJoin(F.broadcast(docs_of(counts)))  # one row
    return (
        named.where(F.col("given") >= ROLE_SHARE * both).select(F.lit("given").alias("role"), "term")
        .unionByName(named.where(F.col("family") >= ROLE_SHARE * both).select(F.lit("family").alias("role"), "term"))
        .unionByName(second)
        .unionByName(denying.select(F.lit("cue").alias("role"), "term"))
        .unionByName(shared.where(F.log2(F.col("docs") / F.col("n")) < SHARED_BITS).select(F.lit("shared").alias("role"), "term"))
    )


def docs_of(counts: DataFrame) -> DataFrame:
    return counts.where("kind = 'docs'").agg(F.sum("n").alias("docs"))


class Terms:
    """Sets of terms by role: ``table`` (role, term) has them exactly; the filters, which travel to the tasks, tell at once
    that a term is none of them, and are sized by their number up to MAX_FILTER_BITS a role. What a filter lets through
    wrongly is found out by joining with the table, see ``_exactly``."""

    def __init__(self, bits: dict[str, np.ndarray], table: DataFrame | None = None):
        self.bits, self.table = bits, table
        self._wrap()

    def _wrap(self) -> None:
        self.has = lru_cache(maxsize=1 << 18)(self._has)

    def _has(self, role: str, term: str) -> bool:
        data = self.bits.get(role)
        return data is not None and all(data[p >> 3] >> (p & 7) & 1 for p in positions(term, len(data) * 8))

    def __getstate__(self):
        return {"bits": self.bits, "table": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._wrap()


class Asked:
    """Terms that note which of them a text was found to hold."""

    def __init__(self, known: Terms):
        self.known, self.seen = known, set()

    def has(self, role: str, term: str) -> bool:
        hit = self.known.has(role, term)
        if hit:
            self.seen.add(f"{role}\t{term}")
        return hit


class Exact:
    def __init__(self, terms):
        self.terms = set(terms)

    def has(self, role: str, term: str) -> bool:
        return f"{role}\t{term}" in self.terms


def positions(term: str, bits: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(term.encode())
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(FILTER_HASHES)]


def _filters(sizes: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[str, np.ndarray] = {}
        for batch in batches:
            for role, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = bits.setdefault(role, np.zeros(sizes[role] // 8, np.uint8))
                for p in positions(term, sizes[role]):
                    data[p >> 3] |= 1 << (p & 7)
        for role, data in bits.items():
            yield pa.RecordBatch.from_pydict({"role": [role], "bits": [data.tobytes()]})

    return run


def learn(docs: DataFrame) -> Terms:
    """The disclosing terms of a corpus (one column, text). Two filters a role reach the driver."""
    scratch = Scratch(docs.sparkSession, "terms")
    counted = scratch.put(terms(docs))
    found = scratch.put(disclosing(counted))
    scratch.drop(counted)
    sizes = {r.role: min(MAX_FILTER_BITS, 1 << max(10, (r["count"] * BITS_PER_TERM - 1).bit_length())) for r in found.groupBy("role").count().collect()}
    out: dict[str, np.ndarray] = {}
    for row in found.repartition(2).mapInArrow(_filters(sizes), "role string, bits binary").collect():
        data = np.frombuffer(row.bits, np.uint8)
        out[row.role] = out[row.role] | data if row.role in out else data
    return Terms(out, found)


_SEP = re.compile(rf"(?:,)?{GAP}|\.{GAP}?")


def _names(text: str, known, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of full names: disclosing words in the order and with the signs of a name."""
    if not any(known.has("family", norm(w)) for w in set(WORD.findall(text))):
        return
    words = [(m.start(), m.end(), norm(m[0])) for m in WORD.finditer(text)]
    family = [known.has("family", w) for _, _, w in words]
    given = [known.has("given", w) for _, _, w in words]
    i, n = 0, len(words)

    def between(a: int, b: int) -> str:
        return text[words[a][1] : words[b][0]]

    def surname(j: int) -> int | None:
        """The last word of the family name that begins at j."""
        k = j
        while k < n and words[k][2] in PARTICLES and k + 1 < n and _blank(between(k, k + 1)):
            k += 1
        return k if k < n and family[k] else None

    def initial(j: int) -> bool:
        return j < n and words[j][1] - words[j][0] == 1 and text[words[j][1] : words[j][1] + 1] == "."

    while i < n:
        end = None
        if given[i] and i + 1 < n and _blank(between(i, i + 1)):
            k = surname(i + 1)
            if k is None and given[i + 1] and i + 2 < n and _blank(between(i + 1, i + 2)):
                k = surname(i + 2)
            end = words[k][1] if k is not None else None
        if end is None and initial(i) and i + 1 < n and text[words[i][0]].isupper():
            j = i + 1
            while initial(j) and re.fullmatch(r"\.\s?", between(j - 1, j)) and j + 1 < n:
                j += 1
            if re.fullmatch(rf"\.{GAP}", between(j - 1, j)):
                k = surname(j)
                end = words[k][1] if k is not None else None
        if end is None and (k := surname(i)) is not None and k + 1 < n:
            gap = between(k, k + 1)
            if re.fullmatch(rf",{GAP}", gap) and given[k + 1]:
                end = words[k + 1][1]
            elif re.fullmatch(rf",?{GAP}", gap) and initial(k + 1) and text[words[k + 1][0]].isupper() and text[words[k + 1][1] : words[k + 1][1] + 1] == ".":
                end = words[k + 1][1] + 1
            elif _blank(gap) and given[k + 1] and not family[k + 1] and not given[i]:
                end = words[k + 1][1]
        if end is not None and all(end <= a or words[i][0] >= b for a, b in taken):
            yield words[i][0], end
            while i < n and words[i][0] < end:
                i += 1
        else:
            i += 1


def _blank(gap: str) -> bool:
    return re.fullmatch(GAP, gap) is not None


def find(text: str | None, known) -> list[Pii]:
    """Personal information of one text, in order, without overlaps. Null and empty texts have none."""
    if not text:
        return []
    out = _structured(text, known)
    taken = [(p.start, p.end) for p in out]
    for lo, hi, *_ in _addresses(text, lambda a, b: known.has("town", f"{a}\t{b}")):
        if all(hi <= a or lo >= b for a, b in taken):
            out.append(Pii(lo, hi, "address"))
            taken.append((lo, hi))
    out += [Pii(lo, hi, "name") for lo, hi in _names(text, known, taken)]
    return sorted(out, key=lambda p: p.start)


def _general(kind: str, value: str) -> str:
    """The part of a shared value that may stay: where an email is kept, the country of a phone."""
    part = value.rsplit("@", 1)[1] if kind == "email" and "@" in value else (re.match(r"\+\d{1,3}(?=\D)", value) or [""])[0] if kind == "phone" else ""
    return f" {part}" if part else ""


def sanitise(text: str | None, known) -> str | None:
    """The text with a typed placeholder for all that was found, and for the parts of a found name where they stand
    alone in the same text. Values that many documents share are generalised: the placeholder keeps their domain or
    country."""
    if not text:
        return text
    found = find(text, known)
    parts = {norm(w) for p in found if p.kind == "name" for w in WORD.findall(text[p.start : p.end]) if len(w) > 2}
    parts = {w for w in parts - PARTICLES if known.has("family", w) or known.has("given", w)}
    out, at = [], 0
    for p in [*found, None]:
        plain = text[at : p.start if p else len(text)]
        out.append(WORD.sub(lambda m: "[NAME]" if norm(m[0]) in parts else m[0], plain) if parts else plain)
        if p:
            value = text[p.start : p.end]
            out.append(f"[{p.kind.upper()}{_general(p.kind, value) if known.has('shared', _value(p.kind, value)) else ''}]")
            at = p.end
    return "".join(out)


def _exactly(docs: DataFrame, known: Terms, doc_id: str, text: str, work: Callable, kind: str, arrow: pa.DataType) -> DataFrame:
    """Rows (doc_id, out): ``work`` (text, terms) of every row; rows whose result is None are left out.

    Each text is worked on where it is read, with the filters in place of the terms, and says which terms it relied on.
    Those pairs of a document and a term, and no text, are joined with the table of terms. Documents that relied on a
    term that is none, one in many thousands or, beyond the size of the filters, more, are worked on again with the
    exact terms of their own; only they are moved.
    """
    scratch = Scratch(docs.sparkSession, "privacy")
    shared = docs.sparkSession.sparkContext.broadcast(known)
    id_type = docs.schema[doc_id].dataType.simpleString()
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    cols = docs.select(F.col(doc_id).alias("doc_id"), key.alias("key"), F.col(text).alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out, asked = [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                noted = Asked(shared.value)
                result = work(t, noted)
                if result is not None or noted.seen or t is None:
                    keep.append(i)
                    out.append(result)
                    asked.append(sorted(noted.seen))
            ids = batch.select([0, 1]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), pa.array(out, arrow), pa.array(asked, pa.list_(pa.string()))], ["doc_id", "key", "out", "asked"])

    done = scratch.put(spread(cols).mapInArrow(first, f"doc_id {id_type}, key string, out {kind}, asked array<string>"))
    relied = done.select("key", F.explode("asked").alias("term"))
    table = known.table.select(F.concat_ws("\t", "role", "term").alias("term"))
    wrong = scratch.put(join_on_unique(relied, table, "term", "left_anti", scratch).select("key").distinct())
    if wrong.isEmpty():
        return done.select("doc_id", "out")
    sound = join_on_unique(relied.join(wrong, "key", "left_semi"), table, "term", "inner", scratch)
    own = sound.groupBy("key").agg(F.collect_set("term").alias("terms"))  # the words of one document

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [work(t, Exact(x or ())) for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, arrow)], ["doc_id", "out"])

    redone = cols.join(wrong, "key", "left_semi").join(own, "key", "left").select("doc_id", "text", "terms").mapInArrow(again, f"doc_id {id_type}, out {kind}")
    return done.join(wrong, "key", "left_anti").select("doc_id", "out").unionByName(redone)


def _found(text: str | None, known) -> list[dict] | None:
    rows = {(p.kind, text[p.start : p.end]): 0 for p in find(text, known)}
    return [{"pii_type": k, "value": v} for k, v in rows] or None


def scan(docs: DataFrame, known: Terms, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, pii_type, value), the value as it stands in the text; repeated ones of a document once."""
    pii = pa.list_(pa.struct([("pii_type", pa.string()), ("value", pa.string())]))
    held = docs.where(F.col(text).isNotNull() & (F.col(text) != ""))
    rows = _exactly(held, known, doc_id, text, _found, "array<struct<pii_type:string,value:string>>", pii)
    return rows.select("doc_id", F.inline("out")).distinct()


def sanitised(docs: DataFrame, known: Terms, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text) with placeholders. Null and empty texts stay as they are."""
    return _exactly(docs, known, doc_id, text, sanitise, "string", pa.string()).select("doc_id", F.col("out").alias("text"))
