"""Go."""

from __future__ import annotations

import re

from graphloom.llm.grammar.base import WORD, Enough, Tokens

LEX = re.compile(
    rf"(?P<nl>\n)|(?P<skip>[ \t\r\f]+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<id>{WORD})"
    r"|(?P<num>0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?)(?!\w)"
    r"|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))')"
    r"|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])",
    re.S,
)
RESERVED = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
ENDS = frozenset(") ] } ++ --".split())


class Go(Tokens):
    RESERVED = RESERVED

    def lex(self) -> None:
        cut = False
        try:
            self.scan(LEX, {"id": "i", "num": "n", "str": "s", "op": "p"}, {"num": "0", "str": '"'})
        except Enough:
            cut = True
        # a line break after a token that can end a statement is a semicolon
        t, k, at, nl = self.t, self.k, self.at, self.nl
        self.t, self.k, self.at, self.nl = [], [], [], []
        for i in range(len(t) - cut):
            self.add(t[i], k[i], at[i], nl[i])
            last = i + 1 == len(t)
            if (last or nl[i + 1]) and (
                k[i] in "ns" or k[i] == "i" and (t[i] not in RESERVED or t[i] in ("break", "continue", "fallthrough", "return")) or k[i] == "p" and t[i] in ENDS
            ):
                self.add(";", "p", at[i] + len(t[i]), False)
        if cut:
            raise Enough

    def parse(self) -> None:
        self.need("package")
        self.need_name()
        self.semi()
        while self.eat("import"):
            self.group(self.import_spec)
        while not self.end():
            self.top()

    def semi(self) -> None:
        if not (self.eat(";") or self.is_(")", "}")):
            raise self.bad()

    def group(self, rule) -> None:
        if self.eat("("):
            while not self.eat(")"):
                rule()
                self.semi()
        else:
            rule()
        self.semi()

    def import_spec(self) -> None:
        if not self.eat("."):
            if self.name():
                self.i += 1
        if not self.kind("s"):
            raise self.bad()
        self.i += 1

    def top(self) -> None:
        if self.eat("func"):
            if self.is_("("):
                self.params()
            self.need_name()
            if self.is_("["):
                self.type_params()
            self.signature()
            if self.is_("{"):
                self.block()
            self.semi()
        elif not self.declaration():
            raise self.bad()

    def declaration(self) -> bool:
        if self.eat("var", "const"):
            const = self.t[self.i - 1] == "const"
            self.group(lambda: self.value_spec(const))
        elif self.eat("type"):
            self.group(self.type_spec)
        else:
            return False
        return True

    def value_spec(self, const: bool) -> None:
        self.need_name()
        while self.eat(","):
            self.need_name()
        if not self.is_("=", ";", ")"):
            self.type_()
        if self.eat("="):
            self.exprs()
        elif self.t[self.i - 1] in (",",):
            raise self.bad()

    def type_spec(self) -> None:
        self.need_name()
        if self.is_("[") and not self.tried(self.type_params):
            pass
        self.eat("=")
        self.type_()

    def type_params(self) -> None:
        self.need("[")
        if self.is_("]") or not self.name():
            raise self.bad()

        def one() -> None:
            self.need_name()
            while self.eat(","):
                if self.is_("]"):
                    return
                self.need_name()
            self.constraint()

        self.listed(one, "]", trailing=True)

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type_()
            if not self.eat("|"):
                return

    def type_(self) -> None:
        if self.eat("*"):
            self.type_()
        elif self.eat("("):
            self.type_()
            self.need(")")
        elif self.eat("["):
            if not self.eat("]"):
                if not self.eat("..."):
                    self.expr()
                self.need("]")
            self.type_()
        elif self.eat("map"):
            self.need("[")
            self.type_()
            self.need("]")
            self.type_()
        elif self.eat("chan"):
            self.eat("<-")
            self.type_()
        elif self.eat("<-"):
            self.need("chan")
            self.type_()
        elif self.eat("func"):
            self.signature()
        elif self.eat("struct"):
            self.need("{")
            while not self.eat("}"):
                self.field()
                self.semi()
        elif self.eat("interface"):
            self.need("{")
            while not self.eat("}"):
                if self.name() and self.next_is(1, "("):
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.semi()
        else:
            self.need_name()
            while self.eat("."):
                self.need_name()
            if self.is_("[") and not self.next_is(1, "]"):
                self.tried(self.type_args)

    def type_args(self) -> None:
        self.need("[")
        self.type_()
        while self.eat(","):
            if self.is_("]"):
                break
            self.type_()
        self.need("]")

    def field(self) -> None:
        if self.is_("*") or self.name() and self.next_is(1, ".", ";", "}") or self.name() and self.k[self.i + 1] == "s":
            self.type_()
        else:
            self.need_name()
            while self.eat(","):
                self.need_name()
            self.type_()
        if self.kind("s"):
            self.i += 1

    def params(self) -> None:
        self.need("(")

        def one() -> None:
            if self.eat("..."):
                self.type_()
                return
            self.type_()
            if not self.is_(",", ")"):
                self.eat("...")
                self.type_()

        self.listed(one, ")", trailing=True)

    def signature(self) -> None:
        self.params()
        if self.is_("("):
            self.params()
        elif not self.is_("{", ";", ",", ")", "]", "}", "=", ":=", ":", ".") and not self.kind("s", "eof"):
            self.tried(self.type_)

    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement()

    def statement(self) -> None:
        if self.eat(";"):
            return
        if self.is_("{"):
            self.block()
            self.semi()
        elif self.declaration():
            pass
        elif self.eat("return"):
            if not self.is_(";", "}"):
                self.exprs()
            self.semi()
        elif self.eat("break", "continue"):
            if self.name():
                self.i += 1
            self.semi()
        elif self.eat("goto"):
            self.need_name()
            self.semi()
        elif self.eat("fallthrough"):
            self.semi()
        elif self.eat("go", "defer"):
            self.expr()
            if self.t[self.i - 1] != ")":
                raise self.bad()
            self.semi()
        elif self.is_("if"):
            self.if_()
            self.semi()
        elif self.eat("for"):
            self.clauses(loop=True)
            self.block()
            self.semi()
        elif self.eat("switch"):
            self.clauses()
            self.cases()
            self.semi()
        elif self.eat("select"):
            self.cases()
            self.semi()
        elif self.name() and self.next_is(1, ":") :
            self.i += 2
            if not self.is_("}"):
                self.statement()
        else:
            self.simple()
            self.semi()

    def if_(self) -> None:
        self.need("if")
        if self.is_("{"):
            raise self.bad()
        self.clauses()
        self.block()
        if self.eat("else"):
            if self.is_("if"):
                self.if_()
            else:
                self.block()

    def clauses(self, loop: bool = False) -> None:
        """What stands between the keyword and the block; composite literals need parentheses there."""
        n = 0
        while not self.is_("{"):
            if self.eat(";"):
                n += 1
                continue
            if self.eat("range"):
                self.expr(False)
            else:
                self.simple(False)
            if not self.is_("{", ";"):
                raise self.bad()
        if n > (2 if loop else 1):
            raise self.bad()

    def cases(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.eat("case"):
                if not self.tried(self.case_types):
                    self.simple()
            else:
                self.need("default")
            self.need(":")
            while not self.is_("case", "default", "}"):
                self.statement()

    def case_types(self) -> None:
        self.type_()
        while self.eat(","):
            self.type_()
        if not self.is_(":"):
            raise self.bad()

    def simple(self, lit: bool = True) -> None:
        start = self.i
        self.exprs(lit)
        if self.eat("++", "--"):
            return
        if self.eat("<-"):
            self.expr(lit)
        elif self.k[self.i] == "p" and self.t[self.i] in ASSIGN:
            define = self.eat(":=")
            if define and self.k[start] != "i":
                raise self.bad()
            if not define:
                self.i += 1
            if self.eat("range"):
                self.expr(lit)
            else:
                self.exprs(lit)
        # else: an expression; only calls and receptions are statements
        elif lit and self.is_(";", "}") and self.t[self.i - 1] != ")" and self.t[start] != "<-":
            raise self.bad()

    def exprs(self, lit: bool = True) -> None:
        self.expr(lit)
        while self.eat(","):
            self.expr(lit)

    def expr(self, lit: bool = True) -> None:
        while True:
            while self.eat("+", "-", "!", "^", "*", "&", "<-"):
                pass
            self.primary(lit)
            if self.k[self.i] == "p" and self.t[self.i] in BINARY:
                self.i += 1
                continue
            return

    def primary(self, lit: bool) -> None:
        typed = explicit = False
        if self.kind("n", "s"):
            self.i += 1
        elif self.eat("func"):
            self.signature()
            if self.is_("{"):
                self.block()
        elif self.is_("[", "map", "chan", "struct", "interface"):
            self.type_()
            typed = explicit = True
        elif self.eat("("):
            if not self.tried(self.paren):
                self.type_()
                self.need(")")
        else:
            self.need_name()
            typed = True
        while True:
            if self.eat("."):
                if self.eat("("):
                    if not self.eat("type"):
                        self.type_()
                    self.need(")")
                else:
                    self.need_name()
                    continue
            elif self.is_("["):
                if not self.tried(self.index):
                    self.type_args()
            elif self.eat("("):
                self.listed(self.argument, ")", trailing=True)
            elif self.is_("{") and typed and (lit or explicit):
                self.literal()
            else:
                return
            typed, explicit = self.t[self.i - 1] == "]", False

    def paren(self) -> None:
        self.expr()
        self.need(")")

    def argument(self) -> None:
        if not (self.is_("[", "map", "chan", "*", "struct", "interface", "func") and self.tried(self.type_argument)):
            self.expr()
            self.eat("...")

    def type_argument(self) -> None:
        self.type_()
        if not self.is_(",", ")"):
            raise self.bad()

    def index(self) -> None:
        self.need("[")
        parts = 0
        while not self.is_("]"):
            if self.eat(":"):
                parts += 1
                continue
            self.expr()
            if not self.is_(":", "]"):
                raise self.bad()
        if parts == 0 and self.t[self.i - 1] == "[" or parts > 2:
            raise self.bad()
        self.need("]")

    def literal(self) -> None:
        self.need("{")
        self.listed(self.element, "}", trailing=True)

    def element(self) -> None:
        self.item()
        if self.eat(":"):
            self.item()

    def item(self) -> None:
        if self.is_("{"):
            self.literal()
        else:
            self.expr()
