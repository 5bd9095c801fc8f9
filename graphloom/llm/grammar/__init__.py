"""Syntax checkers for the languages of the corpus: a text is parsed whole, names and types are not resolved."""

from __future__ import annotations

import ast
import sys
import warnings

from graphloom.llm.grammar.base import Bad, Enough
from graphloom.llm.grammar.csharp import CSharp
from graphloom.llm.grammar.golang import Go
from graphloom.llm.grammar.java import Java
from graphloom.llm.grammar.script import Script

PROBE = 24
#: Calls that a character may open at most, as an opening bracket does in the longest chain of rules.
FRAMES = 60
LANGUAGES = ("python", "javascript", "typescript", "java", "go", "c_sharp")


def _python(text: str, limit: int | None) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        ast.parse(text)


PARSERS = {
    "python": _python,
    "javascript": lambda text, n: Script(text, types=False, jsx=True, limit=n).parse(),
    "typescript": lambda text, n: Script(text, types=True, jsx=False, limit=n).parse(),
    "tsx": lambda text, n: Script(text, types=True, jsx=True, limit=n).parse(),
    "java": lambda text, n: Java(text, n).parse(),
    "go": lambda text, n: Go(text, n).parse(),
    "c_sharp": lambda text, n: CSharp(text, n).parse(),
}


def error(text: str, language: str, likely: bool = True) -> str | None:
    """What is wrong with a text in a language, or None. A byte order mark at the start is no part of the text.

    The parsers recurse in Python alone, which takes no machine stack, so the depth they may reach grows with the text:
    nesting is followed down to MAX_DEPTH brackets. Python's own parser has limits, as its users know; what it refuses is not valid to it. A language
    that is not ``likely`` is first tried on the first PROBE tokens, where a text of another language fails; only if that
    does not decide, as parsing went beyond them, the whole text is read.
    """
    text = text.removeprefix("\ufeff")
    depth = sys.getrecursionlimit()
    sys.setrecursionlimit(max(depth, 6000 + FRAMES * len(text)))
    try:
        try:
            PARSERS[language](text, None if likely else PROBE)
        except Enough:
            PARSERS[language](text, None)
    except (Bad, SyntaxError, ValueError) as e:
        return str(getattr(e, "msg", None) or e) or type(e).__name__
    except (RecursionError, MemoryError):
        return "nested too deeply"
    finally:
        sys.setrecursionlimit(depth)
    return None
