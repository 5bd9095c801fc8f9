"""Token streams and what the parsers share."""

from __future__ import annotations

import re


class Bad(Exception):
    """The text is not valid; the message names the line and what stands there."""


#: Brackets within each other that are followed. Deeper texts count as invalid: the languages' own compilers give up on
#: them at some thousands of levels too.
MAX_DEPTH = 5000
WORD = r"[^\W\d]\w*"


class Enough(Exception):
    """The first tokens do not tell whether the text is valid."""


class Cut(list):
    """The first of many tokens: whoever looks further gets no answer."""

    def __getitem__(self, i):
        if isinstance(i, slice) or i >= list.__len__(self):
            raise Enough
        return list.__getitem__(self, i)

    def __len__(self) -> int:
        return 1 << 60


class CutPairs(dict):
    """Partners of brackets; of those that close behind the first tokens there is no answer."""

    def __init__(self, pair: dict[int, int], opened: list[int]):
        super().__init__(pair)
        self.opened = set(opened)

    def __missing__(self, i: int):
        if i in self.opened:
            raise Enough
        raise KeyError(i)

    def get(self, i: int, default=None):
        if i in self.opened:
            raise Enough
        return super().get(i, default)


class Tokens:
    """A cursor over tokens. ``t`` holds texts (strings, numbers and other literals under one mark for their kind),
    ``k`` kinds, ``nl`` whether a line break stands before, ``at`` offsets, ``pair`` the partner of each bracket."""

    RESERVED: frozenset[str] = frozenset()

    #: Tokens to read at most. A rule that fails within them fails in the whole text too, as it has seen nothing else.
    limit: int | None = None

    def __init__(self, text: str, limit: int | None = None):
        self.text, self.limit = text, limit
        self.t: list[str] = []
        self.k: list[str] = []
        self.nl: list[bool] = []
        self.at: list[int] = []
        self.i = 0
        try:
            self.lex()
        except Enough:
            pair, opened = self._matched()
            self.pair = CutPairs(pair, opened)
            self.t, self.k, self.nl, self.at = Cut(self.t), Cut(self.k), Cut(self.nl), Cut(self.at)
            return
        self.limit = None
        self.add("", "eof", len(text), True)
        self.pair = self._pairs()

    def lex(self) -> None:
        raise NotImplementedError

    def add(self, text: str, kind: str, at: int, nl: bool) -> None:
        if self.limit is not None and len(self.t) >= self.limit:
            raise Enough
        self.t.append(text)
        self.k.append(kind)
        self.at.append(at)
        self.nl.append(nl)

    def scan(self, pattern: re.Pattern, kinds: dict[str, str], mark: dict[str, str]) -> None:
        """Lex by one pattern whose groups name the kinds; groups of white space and comments are skipped."""
        at, nl, n, match = 0, False, len(self.text), pattern.match
        while at < n:
            m = match(self.text, at)
            if m is None:
                raise self.bad_at(at)
            g = m.lastgroup
            if g == "nl":
                nl = True
            elif g == "skip":
                pass
            elif g == "comment":
                nl = nl or "\n" in m[0]
            else:
                self.add(mark.get(g) or m[0], kinds[g], at, nl)
                nl = False
            at = m.end()

    def _pairs(self) -> dict[int, int]:
        pair, opened = self._matched()
        if opened:
            raise self.bad_at(self.at[opened[-1]], "never closed:")
        return pair

    def _matched(self) -> tuple[dict[int, int], list[int]]:
        """Partners of brackets, and the brackets that nothing closes."""
        pair, stack = {}, []
        close = {")": "(", "]": "[", "}": "{"}
        for i, (t, k) in enumerate(zip(self.t, self.k, strict=True)):
            if k != "p":
                continue
            if t in "([{" and t:
                stack.append(i)
                if len(stack) > MAX_DEPTH:
                    raise self.bad_at(self.at[i], "nested too deeply:")
            elif t in close:
                if not stack or self.t[stack[-1]] != close[t]:
                    raise self.bad_at(self.at[i])
                pair[stack[-1]] = i
                pair[i] = stack.pop()
        return pair, stack

    def bad_at(self, at: int, why: str = "unexpected") -> Bad:
        line = self.text.count("\n", 0, at) + 1
        return Bad(f"line {line}: {why} {self.text[at : at + 20]!r}")

    def bad(self, why: str = "unexpected") -> Bad:
        return self.bad_at(self.at[min(self.i, len(self.at) - 1)], why)

    # cursor

    def is_(self, *texts: str) -> bool:
        return self.k[self.i] in "pi" and self.t[self.i] in texts

    def next_is(self, n: int, *texts: str) -> bool:
        j = self.i + n
        return j < len(self.t) and self.k[j] in "pi" and self.t[j] in texts

    def eat(self, *texts: str) -> bool:
        if self.k[self.i] in "pi" and self.t[self.i] in texts:
            self.i += 1
            return True
        return False

    def need(self, *texts: str) -> None:
        if not self.eat(*texts):
            raise self.bad()

    def name(self, n: int = 0) -> bool:
        """Whether an identifier stands n tokens ahead."""
        j = self.i + n
        return j < len(self.t) and self.k[j] == "i" and self.t[j] not in self.RESERVED

    def need_name(self) -> None:
        if not self.name():
            raise self.bad()
        self.i += 1

    def kind(self, *kinds: str) -> bool:
        return self.k[self.i] in kinds

    def tried(self, rule, *args) -> bool:
        """Run a rule; on failure go back and return False. Calls with unpacked arguments would take machine stack."""
        at = self.i
        try:
            if not args:
                rule()
            elif len(args) == 1:
                rule(args[0])
            else:
                rule(args[0], args[1])
        except Bad:
            self.i = at
            return False
        return True

    def end(self) -> bool:
        return self.k[self.i] == "eof"

    def split(self, first: str) -> bool:
        """Take ``first`` off an operator token such as >> or >>=."""
        t = self.t[self.i]
        if self.k[self.i] != "p" or not t.startswith(first):
            return False
        if t == first:
            self.i += 1
        else:
            self.t[self.i] = t[len(first) :]
        return True

    def listed(self, rule, close: str, sep: str = ",", trailing: bool = False) -> None:
        """Rules set apart by ``sep`` up to ``close``, which is taken."""
        if self.eat(close):
            return
        while True:
            rule()
            if self.eat(close):
                return
            self.need(sep)
            if trailing and self.eat(close):
                return
