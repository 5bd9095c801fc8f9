"""Credentials in source and configuration code: where they start, and their redaction in place."""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.llm.tokenizer import encoder
from graphloom.runtime import spread

#: Characters per subword below which a string is unnatural: prose and identifiers have 3 to 6, random strings 1 to 2.
NATURAL = 2.6
#: Characters per subword up to which so many subwords in a row are.
ODD, ODD_SUBWORDS = 2.0, 3
#: Strings so unnatural, so long and so mixed are taken for keys wherever their place does not speak against it.
RANDOM, RANDOM_LENGTH = 1.8, 20

# Forms of tokens that services document for their keys.
TOKEN = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"(?:AKIA|ASIA|AGPA|AROA)[A-Z0-9]{16}"
    r"|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|whsec_[A-Za-z0-9+/=]{16,}"
    r"|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}"
    r"|glpat-[A-Za-z0-9_-]{18,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{12,}"
    r"|AIza[A-Za-z0-9_-]{30,}"
    r"|ya29\.[A-Za-z0-9_-]{20,}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
    r"|npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{30,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{40,}"
    r"|sk-(?:ant-|proj-)?[A-Za-z0-9_-]{20,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"
    r")(?![A-Za-z0-9_])"
)
PRIVATE_KEY = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>.*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)",
    re.S,
)
USERINFO = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'`<>]*:(?P<secret>[^\s/\"'`<>]+)@[A-Za-z0-9\[]")
HEADER = re.compile(r"^(?:Basic|Bearer|Token|ApiKey|Digest)\s+(?P<secret>\S+)$", re.I)
SCHEME_VALUE = re.compile(r"\b(?:Authorization\s*[:=]\s*)?(?P<kind>Basic|Bearer)\s+(?P<secret>[A-Za-z0-9+/_.=~-]{12,})")
FLAG = re.compile(
    r"(?:^|\s)(?:-u|--user)[ =]+[\"']?[^\s:\"']+:(?P<a>[^\s\"'@]+)"
    r"|(?:^|[\s\"'])--?(?:password|passwd|pass|token|api-?key|secret|auth-?token)[ =]+[\"']?(?P<b>[^\s\"']+)",
    re.I | re.M,
)

LITERAL = re.compile(r'"""(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`', re.S)
JOINT = re.compile(r"\s*(?:\+|\.(?=\s*[\"'`])|\\\n|&|\n)?\s*(?:\\\n)?\s*")
JOINING, NONBLANK = tuple("\"'`+.&\\"), re.compile(r"\S")
BRACKET = re.compile(rf"{LITERAL.pattern}|[()\[\]{{}}]", re.S)
NAMED = re.compile(
    r"(?P<name>[\w.$-]+(?:\(\s*\))?)[\"'`]?\s*\]?\s*\??(?:\s*:\s*[A-Za-z_][\w<>\[\]|?., ]{0,40}?)?\s*(?:\?\?=?|\|\|=?|:=|=>|=|:|\bor\b|\belse\b)\s*[(\[{]?\s*(?:[rbfuRBFU$@]{1,2})?$"
)
#: A literal name with a value after it: set("name", value), get("name") ?? value, get("name").orElse(value).
AFTER_NAME = re.compile(r"[\"'`]\s*(?:,|[)\]]\s*(?:\?\?|\|\||\?:|:|or\b|\.\w+\())\s*$")
PLAIN_LINE = re.compile(
    r"^(?P<lead>[ \t]*(?:(?:#+|//+|--|;|\*|/\*)[ \t]*)?(?:export[ \t]+|set[ \t]+|-[ \t]+)?)(?P<name>[\w.-]+)[ \t]*(?:=|:)[ \t]*(?P<value>[^\s\"'`{\[|>&][^\n]*?)[ \t]*\r?$",
    re.M,
)
COMMENT = re.compile(r"(?:(?<![:\w])//+|(?<!\S)#+|/\*+|^[ \t]*\*|<!--|(?<!\S)--)(?P<text>[^\n]*)", re.M)
SPOKEN = re.compile(
    r"\b(?:cred(?:ential)?s?|log-?ins?|passwor[dt]|passwd|pwd|pw|pass|secret|token|api[ _-]?key|auth|until rotation|zugang|acceso|accès)\b"
    r".*?(?:\b(?:with|pw|pwd|pass|password|is|ist|es|est|mit|con|avec)\b|->|=>|=|:|/|,)\s*(?P<secret>\S+)\s*(?:\*/)?\s*$",
    re.I,
)

WORDS = re.compile(r"[A-Z]+(?![a-zà-ÿ])|[A-ZÀ-Þ]?[a-zà-ÿ]+|\d+")
# Words that name a secret, in the languages of the code's authors.
SECRET_WORDS = {
    "password", "passwd", "passwort", "passphrase", "pwd", "pass", "passcode", "kennwort", "mdp", "contrasena", "contraseña",
    "clave", "senha", "wachtwoord", "parola", "haslo", "secret", "secrets", "token", "credential", "credentials", "cred",
    "creds", "authorization", "bearer", "apikey", "jwt", "pgpassword", "geheimnis", "secreto", "jeton", "pin",
}
SECRET_JOINED = re.compile(
    r"password|passwd|passwort|kennwort|passphrase|motdepasse|contrase[nñ]a|secret|apikey|accesskey|privatekey|signingkey|encryptionkey|credential"
    r"|(?:auth|access|api|refresh|session|bearer|bot|deploy)token|(?:db|smtp|mail|pg|mysql|redis|ftp|ldap|user|admin|root)(?:pass|pwd)$|pwd$"
)
KEY_KINDS = {
    "api", "access", "secret", "private", "signing", "sign", "encryption", "encrypt", "auth", "account", "master", "shared",
    "service", "deploy", "ssh", "storage", "hmac", "jwt", "license", "app", "application", "client", "webhook", "stripe",
}
# Words behind which a name means something about a secret, not the secret.
ABOUT = {
    "length", "len", "min", "max", "hint", "field", "name", "names", "ref", "reference", "path", "ttl", "url", "uri", "id", "ids",
    "scheme", "header", "type", "policy", "label", "placeholder", "prompt", "count", "size", "expiry", "expires", "expiration",
    "timeout", "enabled", "rotation", "index", "format", "regex", "pattern", "error", "message", "msg", "days", "hours", "minutes",
    "seconds", "ms", "file", "env", "algorithm", "alg", "algo", "version", "prefix", "suffix", "param", "column", "hash", "hashed",
    "digest", "fingerprint", "checksum", "store", "manager", "provider", "service", "validator", "strength", "required",
    "title", "text", "description", "lifetime", "limit", "usage", "kind", "status", "state", "endpoint", "host", "form", "input",
    "page", "link", "button", "email", "template", "reset", "var", "variable", "location", "dir", "folder", "arn", "issuer",
}
NOT_SECRET_KINDS = {"public", "page", "next", "cursor", "sort", "cache", "continuation", "cancellation", "csrf", "primary", "foreign", "partition", "routing", "idempotency", "lookup"}
PASSWORDISH = {"password", "passwd", "passwort", "passphrase", "pwd", "pass", "kennwort", "mdp", "contrasena", "contraseña", "clave", "senha", "wachtwoord", "passcode", "pgpassword", "pw"}

# How people write that a secret is still to be filled in.
PLACEHOLDER = re.compile(
    r"^(?:[*x.•#?_-]{3,}|\d?(?:x{3,}|\*{3,}).*|<.*>|\[.*\]|\{.*\}|%.*%|__.*__|n/?a|nil|none|null|undefined|true|false|todo.*|fixme.*|tbd|string|text|hidden|required|optional|secret|password|token|key|value)$"
    r"|change[-_ ]?(?:it|me)|your[-_ ]|[-_ ]here$|replace|placeholder|example(?!\.(?:com|org|net)\b)|dummy|sample|redacted|insert[-_ ]|put[-_ ]|enter[-_ ]|set[-_ ]?(?:in|via|by|from|me)[-_ ]?|fill[-_ ]|not[-_]?(?:set|used|real)|fake|masked|removed|to[-_]?be[-_]|my[-_](?:secret|password|token|key)",
    re.I,
)
REFERENCE = re.compile(
    r"^(?:vault|ssm|op|secretsmanager|awssm|gcpsm|keyvault|akv|kms|env|file|secret|sops|bitwarden|doppler|ref)(?::|\+?://)|^arn:|^(?:secrets?|env|vars?|process|config|settings|params)[.\[]"
    r"|\$\{|\$\(|\{\{|#\{|%\(|^\$[A-Za-z_]|^%[A-Za-z_]+%?$|^@[A-Za-z]|\{[A-Za-z_][\w.]*\}|^%[sdv]$",
    re.I,
)
PATHLIKE = re.compile(r"^(?:~|\.{0,2})/|^[A-Za-z]:\\|\.(?:pem|pub|key|crt|cer|json|ya?ml|txt|env|p12|jks|pfx|conf|cfg|ini|py|js|ts|go|java|cs)$|^https?://[^@]*$")
KNOWN_TERM = re.compile(
    r"^(?:(?:HS|RS|ES|PS)\d{3}|SHA-?\d+|MD5|AES-?\d*.*|RSA.*|(?:hmac-)?sha\d+|utf-?\d+|base\d+|bcrypt|argon2\w*|v?\d+(?:\.\d+)+|\d{4}-\d\d-\d\d.*|\d+(?:ms|s|m|h|d|min|hours?|days?|kb|mb|gb)?|oauth2?|ed25519|es\d{4})$",
    re.I,
)
IDENTIFIER = re.compile(r"^(?:[a-z]+(?:[-_./: ][a-z]+)*|[A-Z]+(?:[-_][A-Z]+)*|[a-z]+(?:[A-Z][a-z]+)*|(?:[A-Z][a-z]+)+|[A-Z][a-z]+(?:[-_ ][A-Za-z]+)*)$")
#: Natural words may make a secret, with numbers behind them.
PASSPHRASE = re.compile(r"^(?:[^\W\d_]{3,}[^\w\s]?|[^\W\d_]{3,}_)+\d+$")
UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
HEX_DIGEST = re.compile(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$", re.I)
LOGIN_CALL = re.compile(r"(?:^|\.|_)(?:authenticate|log_?in|sign_?in|set_?passwo?r?d|set_?token|basic_?auth|auth|use?r?_?credentials?|networkcredential|usernamepassword\w*|connect|bind|open_?session)$", re.I)
CODE_FILE = re.compile(r"\.(?:tsx?|jsx?|mjs|cjs|py|java|go|cs|rb|php|kt|scala|swift|rs|cc?|cpp|h|hpp)$", re.I)

# What every line that a credential starts on, or the line before it, holds in lower case.
KEYWORDS = (
    "pass", "pwd", "pw", "mdp", "kennwort", "contrase", "clave", "senha", "wachtwoord", "haslo", "parola", "secret", "geheim", "token",
    "jeton", "cred", "key", "schl\u00fcssel", "auth", "login", "log_in", "log in", "signin", "sign_in", "sign in", "bearer", "basic ", "jwt", "pin", "dsn", "zugang",
    "acceso", "acc\u00e8s", "until rotation", "-u ", "--user", "://", "bind", "connect", "opensession", "open_session", "eyj", "akia", "asia", "agpa", "aroa",
    "aiza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat", "glpat-", "xox", "_live_", "_test_", "whsec_", "ya29.", "sg.",
    "npm_", "pypi-", "hf_", "dop_v1", "sk-",
)
MANIFEST = "kind: secret"  # every line of such a text may hold one


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for word in KEYWORDS:
        out.add_word(word, len(word))
    out.make_automaton()
    return out


#: Runs of characters that may be such a string, and what a place has that holds one which is no credential.
RUN = re.compile(r"[A-Za-z0-9+/=_.~-]{20,}")
BENIGN = re.compile(
    r"integrity|digest|hash|sha\d*|md5|checksum|fingerprint|etag|(?<![a-z])ids?(?![a-z])|[a-z]Ids?(?![a-z])|uuid|guid|revision|commit|build|version|public|cert|cursor|image|icon|base64|data|blob|content|payload|signature|nonce|salt|etag|url|path|src|sample|fixture|example|trace|span|request|session_?name|cache",
    re.I,
)
UNIT_LINES = 4
#: Characters that are encoded at once; nobody writes placeholders or references of more.
LONG = 4096


@dataclass(frozen=True)
class Found:
    line: int
    kind: str
    spans: tuple[tuple[int, int], ...]  # what to mask


@lru_cache(maxsize=1 << 16)
def chars_per_subword(text: str) -> float:
    """Of the whole text, or of its first LONG characters' worth at a time."""
    n = sum(len(encoder().encode_ordinary(text[i : i + LONG])) for i in range(0, len(text), LONG))
    return len(text) / n if n else 0.0


@lru_cache(maxsize=1 << 16)
def odd_part(text: str) -> bool:
    """Whether a few subwords in a row are as short as those of random strings, behind whatever words."""
    sizes = [len(encoder().decode_single_token_bytes(i)) for i in encoder().encode_ordinary(text[:LONG])]
    return any(sum(sizes[i : i + ODD_SUBWORDS]) <= ODD * ODD_SUBWORDS for i in range(len(sizes) - ODD_SUBWORDS + 1))


def unnatural(text: str) -> bool:
    """Whether a string is unlike words, in whole or in a part of it."""
    return len(text) >= 8 and (chars_per_subword(text) < NATURAL or odd_part(text))


@lru_cache(maxsize=1 << 14)
def names_secret(name: str) -> int:
    """0: no; 1: a secret of some kind; 2: a password."""
    words = [w.lower() for w in WORDS.findall(name.rstrip("()"))]
    if not words or words[-1] in ABOUT or set(words) & NOT_SECRET_KINDS:
        return 0
    if words[-1] in {"hash", "sha"}:
        return 0
    joined = "".join(words)
    if set(words) & PASSWORDISH or ("mot" in words and "passe" in words) or re.search("passw|kennwort|motdepasse|pwd$|passphrase", joined):
        return 2
    if set(words) & SECRET_WORDS or SECRET_JOINED.search(joined):
        return 1
    if words[-1] in {"key", "keys", "schluessel", "schlüssel"} and len(words) > 1 and words[-2] in KEY_KINDS:
        return 1
    return 1 if words[-1] in {"auth", "dsn"} else 0


def decoded(text: str) -> str | None:
    """The printable text that ``text`` is the base64 of, if it is."""
    if len(text) < 8 or len(text) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", text):
        return None
    try:
        out = base64.b64decode(text, validate=True).decode("ascii")
    except (binascii.Error, ValueError):
        return None
    return out if out.isprintable() and len(out) >= 4 else None


def usable(value: str, strength: int) -> bool:
    """Whether a literal under a name that asks for a secret of this strength is one."""
    if len(value) <= LONG and (PLACEHOLDER.search(value) or REFERENCE.search(value)) or KNOWN_TERM.match(value) and strength < 2:
        return False
    if (m := USERINFO.search(value)) is not None:
        return usable(m["secret"], 2)
    if (m := HEADER.match(value)) is not None:
        return usable_header(m["secret"])
    if re.search(r"\s", value) or "://" in value or PATHLIKE.search(value) or len(value) < 5 or len(set(value)) < 4:
        return False
    if "(" in value and value.endswith(")"):
        return False
    if (inner := decoded(value)) is not None and (":" in inner or unnatural(value)):
        if len(inner) <= LONG and (PLACEHOLDER.search(inner) or REFERENCE.search(inner)):
            return False
        if ":" in inner and "://" not in inner:
            return usable(inner.split(":", 1)[1], 2)
        return True
    if ":" in value and re.fullmatch(r"[\w.@-]+:[^:]+", value) and strength:
        return usable(value.split(":", 1)[1], 2)
    if re.fullmatch(r"\d+", value):
        return strength == 2 and len(value) >= 6
    if IDENTIFIER.match(value):
        return len(value) >= 16 and chars_per_subword(value) < 1.9
    if re.fullmatch(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+", value):  # a host, a dotted name
        return False
    if re.fullmatch(r"[a-z]+(?:[-_.:/][a-z0-9]+)+", value) and not unnatural(value) and not re.search(r"\d", value):
        return False
    if UUID.match(value) and strength < 1:
        return False
    if unnatural(value) or PASSPHRASE.match(value):
        return True
    return strength == 2 and len(value) < 8 and bool(re.search(r"\d|[^\w.:/-]", value))


def random_key(value: str) -> bool:
    """Whether a string is a key by itself: long, of capitals, small letters and digits, and far from any words."""
    return (
        len(value) >= RANDOM_LENGTH
        and RUN.fullmatch(value) is not None
        and all(re.search(c, value) for c in ("[A-Z]", "[a-z]", r"\d"))
        and not (UUID.match(value) or PATHLIKE.search(value) or REFERENCE.search(value) or PLACEHOLDER.search(value) or re.match(r"(?:sha\d+|md5)[-:]|data:", value))
        and decoded(value) is None
        and chars_per_subword(value) < RANDOM
    )


def usable_header(value: str) -> bool:
    inner = decoded(value)
    if inner and ":" in inner:
        return usable(inner.split(":", 1)[1], 2)
    return usable(value, 1) and unnatural(value)


def _literals(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """String literals as (value, spans of its pieces); literals that are joined count as one."""
    value, spans, last = "", [], None
    for m in LITERAL.finditer(text):
        n = 3 if m[0].startswith('"""') else 1
        lo, hi = m.start() + n, m.end() - n
        gap = text[last.end() : m.start()] if last else ""
        if gap and JOINT.fullmatch(gap) and (gap.strip() or "\n" in gap):
            value += text[lo:hi]
            spans.append((lo, hi))
        else:
            if spans:
                yield value, spans
            value, spans = text[lo:hi], [(lo, hi)]
        last = m
    if spans:
        yield value, spans


def _call_before(before: str) -> str:
    """The name of the innermost call that is open at the end of ``before``."""
    depth = 0
    for i in range(len(before) - 1, -1, -1):
        if before[i] in ")]}":
            depth += 1
        elif before[i] in "([{":
            if depth == 0:
                m = re.search(r"([\w.$]+)\s*$", before[:i])
                return m[1] if m and before[i] == "(" else ""
            depth -= 1
    return ""


def _login_call(line: str) -> bool:
    """Whether a call that takes credentials is open at the end of a line."""
    return "(" in line and bool(LOGIN_CALL.search(_call_before(line)))


def _unit_end(text: str, at: int, end: int) -> int:
    """Where the lines end that belong to the one at ``at``: with what is joined to the literals before ``end``, and with
    the login call that is open at the end of the first line."""
    past = lambda i: text.find("\n", i) + 1 or len(text)
    first = text.find("\n", at)
    if 0 <= first < end and _login_call(text[at:first]):
        depth = 0
        for m in BRACKET.finditer(text, first):
            depth += (m[0] in "([{") - (m[0] in ")]}")
            if depth < 0:
                end = max(end, past(m.start()))
                break
    if text[at:end].rstrip()[-1:] not in JOINING or not (m := NONBLANK.search(text, end)) or m[0] not in JOINING:
        return end
    last = None
    for m in LITERAL.finditer(text, at):
        gap = text[last : m.start()] if last is not None else ""
        if m.start() >= end and not (gap.strip() or "\n" in gap) or m.start() >= end and not JOINT.fullmatch(gap):
            break
        if m.start() >= end:
            end = past(m.end())
        last = m.end()
    return end


def find(text: str, path: str | None = None) -> list[Found]:
    """Credentials of one text, at most one a line, in order of their lines.

    Lines are looked at that hold a run of characters unlike any words (by characters per subword), and those that one
    pass of an automaton finds to speak of a secret. On these every literal and setting is measured: unnatural ones are
    credentials if name and surroundings ask for a secret, and, if they are as good as random, unless these speak
    against it; natural ones only as passwords. ``path`` tells code from configuration, where values stand without quotes; with no path the
    text is taken for configuration. Empty texts have none.
    """
    low = text.lower()
    code = bool(path and CODE_FILE.search(path))
    starts: list[int] = []
    if len(low) != len(text) or MANIFEST in low:  # a letter that changes its length: offsets would not hold
        starts = _starts(text)
    else:
        done = -1
        for end, _ in _automaton().iter(low):
            if end > done:
                starts.append(text.rfind("\n", 0, end + 1) + 1 if text[end] != "\n" else text.rfind("\n", 0, end) + 1)
                done = text.find("\n", end)
                if done < 0:
                    break
        random = {text.rfind("\n", 0, m.start()) + 1 for m in RUN.finditer(text) if random_key(m[0])}
        starts = sorted(random.union(starts)) if random else starts
    spots: list[tuple[int, str, list[tuple[int, int]]]] = []
    for at in starts:
        end = at
        for _ in range(UNIT_LINES):
            end = text.find("\n", end) + 1
            if not end:
                end = len(text)
                break
        end = _unit_end(text, at, end)
        for rel, kind, spans in _unit(text[at:end], code):
            if kind == "private_key":
                m = PRIVATE_KEY.match(text, at + rel)
                spots.append((at + rel, kind, [m.span("body")]))
            else:
                spots.append((at + rel, kind, [(at + lo, at + hi) for lo, hi in spans]))
    return _by_line(text, spots)


@lru_cache(maxsize=1 << 16)
def _unit(text: str, code: bool) -> tuple[tuple[int, str, tuple[tuple[int, int], ...]], ...]:
    """What starts on the first line of a few lines, or on the second with its name on the first."""
    spots: list[tuple[int, str, tuple[tuple[int, int], ...]]] = []
    first = text.find("\n")
    first = len(text) if first < 0 else first
    line = text[:first]
    if "PRIVATE KEY" in line:
        for m in PRIVATE_KEY.finditer(text):
            body = re.sub(r"\\[nr]|\s|[\"'+`,|>]", "", m["body"])
            if m.start() < first and len(re.sub(r"[^A-Za-z0-9+/=]", "", body)) >= 24 and unnatural(body) and not PLACEHOLDER.search(body[:200]):
                spots.append((m.start(), "private_key", ()))
    for m in TOKEN.finditer(line):
        if unnatural(m[0]) and not PLACEHOLDER.search(m[0]):
            spots.append((m.start(), "token", (m.span(),)))
    if "://" in line:
        for m in USERINFO.finditer(line):
            if usable(m["secret"], 2) or _weak(m["secret"]):
                spots.append((m.start("secret"), "url", (m.span("secret"),)))
    for m in SCHEME_VALUE.finditer(line):
        if usable_header(m["secret"]):
            spots.append((m.start("secret"), "header", (m.span("secret"),)))
    if "-" in line:
        for m in FLAG.finditer(line):
            g = "a" if m["a"] else "b"
            if usable(m[g], 2):
                spots.append((m.start(g), "flag", (m.span(g),)))
    previous: tuple[int, str] | None = None
    login = _login_call(line)
    for value, spans in _literals(text):
        lo = spans[0][0]
        quotes = 3 if text[max(0, lo - 3) : lo] == '"""' else 1
        before = text[: lo - quotes]
        if lo > first and (before[first:].strip() or line.rstrip().endswith(("\"", "'", "`", ";", ","))):
            if not login:
                break
            call = _call_before(before)
            if LOGIN_CALL.search(call) and _argument(value):
                spots.append((lo, "argument", tuple(spans)))
            previous = (spans[-1][1], value)
            continue
        kind = _literal_kind(value, _tail(before), previous, line)
        if kind:
            spots.append((lo, kind, tuple(spans)))
        previous = (spans[-1][1], value)
    if (m := PLAIN_LINE.match(line)) and (not code or m["lead"].strip(" \texpors-")):
        value = (m["value"] if code else re.split(r"\s+#", m["value"])[0]).rstrip(",;")
        named = names_secret(m["name"]) and usable(value, names_secret(m["name"]))
        if named or _hidden(value) or random_key(value) and not BENIGN.search(line.replace(value, "")):
            spots.append((m.start("value"), "setting", ((m.start("value"), m.start("value") + len(value)),)))
    if (m := COMMENT.search(line)) and (s := SPOKEN.search(m["text"])) and _spoken(s["secret"].strip("\"'`.,;")):
        at = m.start("text") + s.start("secret")
        spots.append((at, "comment", ((at, at + len(s["secret"])),)))
    return tuple(spots)


def _weak(secret: str) -> bool:
    """A password in a URL may be an ordinary word."""
    return bool(re.fullmatch(r"[A-Za-z]{4,}", secret)) and not PLACEHOLDER.search(secret) and secret.lower() not in {"pass", "password", "pwd", "user", "secret", "token"}


def _hidden(value: str) -> bool:
    inner = decoded(value)
    return bool(inner) and bool(((m := USERINFO.search(inner)) and usable(m["secret"], 2)) or TOKEN.search(inner))


def _spoken(value: str) -> bool:
    if not (len(value) >= 8 and usable(value, 2)):
        return False
    if re.fullmatch(r"[A-Z]+-\d+|[\w-]+\([^)]*\)|#\d+|[\w.-]+:\d+", value):
        return False
    return bool(re.search(r"\d", value)) and bool(re.search(r"[A-Za-z]", value)) or bool(re.search(r"[^\w./:-]", value))


def _tail(before: str, enough: int = 200) -> str:
    """The end of what stands before a literal, blanks taken together, with the whole of the name it begins with."""
    n = 2 * enough
    while True:
        tail = re.sub(r"\s+", " ", before[-n:])
        start = max(0, len(tail) - enough)
        while start and (tail[start - 1].isalnum() or tail[start - 1] in "_.$-"):
            start -= 1
        if start or n >= len(before):
            return tail[start:].rstrip()
        n *= 4


def _argument(value: str) -> bool:
    return bool(value) and not HEX_DIGEST.match(value) and usable(value, 2) and bool(unnatural(value) or re.search(r"\d", value))


def _literal_kind(value: str, before: str, previous: tuple[int, str] | None, line: str) -> str | None:
    if not value:
        return None
    m = NAMED.search(before)
    if m is not None:
        strength = names_secret(m["name"])
        if strength and usable(value, strength):
            return "literal"
    elif previous is not None and AFTER_NAME.search(before) and re.fullmatch(r"[\w.-]+", previous[1]):
        strength = names_secret(previous[1])
        if strength and usable(value, strength):
            return "literal"
    if m is None:
        call = _call_before(before)
        if call and LOGIN_CALL.search(call) and _argument(value):
            return "argument"
    if TOKEN.fullmatch(value) and unnatural(value):
        return "token"
    if _hidden(value):
        return "setting"
    return "string" if random_key(value) and not BENIGN.search(line.replace(value, "")) else None


def _starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def _by_line(text: str, spots: list[tuple[int, str, list[tuple[int, int]]]]) -> list[Found]:
    out: dict[int, tuple[str, list[tuple[int, int]]]] = {}
    covered: list[tuple[int, int]] = []  # apart from each other, in order
    starts = _starts(text) if spots else []
    for at, kind, spans in sorted(spots):
        i = bisect_right(covered, (at, len(text)))
        if i and at < covered[i - 1][1]:
            continue
        for span in spans:
            insort(covered, span)
        line = bisect_right(starts, at)
        if line in out:
            out[line][1].extend(spans)
        else:
            out[line] = (kind, list(spans))
    return [Found(line, kind, tuple(sorted(set(spans)))) for line, (kind, spans) in sorted(out.items())]


def redact(text: str, found: list[Found], mask: str = "x") -> str:
    """The text with every credential masked in place: same length, same lines, quotes and delimiters untouched."""
    chars = list(text)
    for f in found:
        for lo, hi in f.spans:
            i = lo
            while i < hi:
                if chars[i] == "\\" and i + 1 < hi:  # keep escapes such as \n
                    i += 2
                    continue
                if not chars[i].isspace():
                    chars[i] = mask
                i += 1
    return "".join(chars)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row_id, file_path, source_code) to (row_id, line_no, kind)."""
    for batch in batches:
        rows, lines, kinds = [], [], []
        for row, path, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for f in find(text, path) if text else ():
                rows.append(row)
                lines.append(f.line)
                kinds.append(f.kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.string()), pa.array(lines, pa.int32()), pa.array(kinds, pa.string())], ["row_id", "line_no", "kind"]
        )


def scan(code: DataFrame, row_id: str, path: str = "file_path", text: str = "source_code") -> DataFrame:
    """Rows (row_id, line_no, kind): one for each line on which a credential starts.

    Each text is searched in the task that reads it; nothing but the findings is shuffled, to take repeated rows
    together. Null and empty texts have no findings; a null path stands for configuration.
    """
    cols = code.select(F.col(row_id).cast("string").alias("row_id"), F.col(path).alias("path"), F.col(text).alias("text"))
    return spread(cols.where("text is not null")).mapInArrow(_batches, "row_id string, line_no int, kind string").distinct()


@F.pandas_udf(StringType())
def _redacted(text: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([t if t is None else redact(t, find(t, p)) for t, p in zip(text, path, strict=True)], dtype=object)


def redacted(code: DataFrame, path: str = "file_path", text: str = "source_code") -> DataFrame:
    """The same rows with the credentials in ``text`` masked in place: its length and lines stay as they are."""
    return code.withColumn(text, _redacted(F.col(text), F.col(path)))
