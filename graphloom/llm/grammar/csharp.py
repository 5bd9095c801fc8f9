"""C#."""

from __future__ import annotations

import re

from graphloom.llm.grammar.base import Bad, Tokens

SKIP = re.compile(r"(?P<nl>\n)|[ \t\r\f\v \x1a]+|//[^\n]*|/\*.*?\*/|(?:(?<=\n)|\A)[ \t]*#[^\n]*", re.S)
WORD = re.compile(r"@?[^\W\d]\w*")
NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)(?:[uU]?[lL]?|[lL][uU]|[fFdDmM])(?!\w)")
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"(?:u8)?|'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{1,4}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.))'")
VERBATIM = re.compile(r"@\"(?:[^\"]|\"\")*\"")
RAW = re.compile(r"\"{3,}")
OPERATOR = re.compile(
    r"\?\?=|<<=|>>=|>>>=|\.\.|=>|->|::|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\?\[|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^<>=!()\[\]{},;.:?~]"
)
RESERVED = frozenset(
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()
)
BUILTIN = frozenset("bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split())
MODIFIERS = frozenset("public private protected internal static abstract sealed virtual override readonly extern unsafe volatile async partial new required file const ref scoped".split())
BINARY = frozenset("|| && ?? == != < > <= >= + - * / % & | ^ << ..".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>= ??=".split())
OVERLOADED = frozenset("+ - ! ~ ++ -- true false * / % & | ^ << > < == != >= <=".split())


class CSharp(Tokens):
    RESERVED = RESERVED
    declared_any = False

    def lex(self) -> None:
        self.lex_until(0, None)

    def lex_until(self, at: int, close: str | None) -> int:
        text, n, nl, depth = self.text, len(self.text), False, 0
        while at < n:
            m = SKIP.match(text, at)
            if m is not None:
                nl = nl or m.lastgroup == "nl"
                at = m.end()
                continue
            c = text[at]
            if close and depth == 0 and (c == "}" or c == ":" and text[at + 1 : at + 2] != ":"):
                return at
            m = re.compile(r"(?:\$+@?|@\$)\"+").match(text, at) if c in "$@" else None
            if m is not None:
                self.add('"', "s", at, nl)
                at = self.interpolated(at, m[0])
            elif c == "@" and (m := VERBATIM.match(text, at)):
                self.add('"', "s", at, nl)
                at = m.end()
            elif text.startswith('"""', at):
                quotes = RAW.match(text, at)[0]
                end = text.find(quotes, at + len(quotes))
                if end < 0:
                    raise self.bad_at(at, "unterminated")
                while text.startswith('"', end + len(quotes)):
                    end += 1
                self.add('"', "s", at, nl)
                at = end + len(quotes)
            elif c in "\"'":
                m = STRING.match(text, at)
                if m is None:
                    raise self.bad_at(at, "unterminated")
                self.add('"', "s", at, nl)
                at = m.end()
            elif (m := WORD.match(text, at)) is not None:
                self.add(m[0].lstrip("@") if m[0][0] != "@" else "@" + m[0][1:], "i", at, nl)
                at = m.end()
            elif c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit() and not (self.t and self.at[-1] == at - 1 and self.t[-1] == "."):
                m = NUMBER.match(text, at)
                if m is None:
                    raise self.bad_at(at)
                self.add("0", "n", at, nl)
                at = m.end()
            else:
                m = OPERATOR.match(text, at)
                if m is None:
                    raise self.bad_at(at)
                op = m[0]
                if op == "?[":
                    self.add("?", "p", at, nl)
                    op = "["
                    self.add("[", "p", at + 1, False)
                else:
                    self.add(op, "p", at, nl)
                depth += (op in "([{") - (op in ")]}")
                at = m.end()
            nl = False
        if close:
            raise self.bad_at(n - 1, "unterminated")
        return at

    def interpolated(self, at: int, head: str) -> int:
        text = self.text
        dollars, verbatim, quotes = head.count("$"), "@" in head, head.count('"')
        start = at
        at += len(head)
        if quotes == 2:
            return at
        raw = quotes >= 3
        while at < len(text):
            c = text[at]
            if raw and text.startswith('"' * quotes, at):
                return at + quotes
            if not raw and c == '"':
                if verbatim and text.startswith('""', at):
                    at += 2
                    continue
                return at + 1
            if c == "\n" and not (raw or verbatim):
                break
            if c == "\\" and not (raw or verbatim):
                at += 2
            elif c == "{":
                run = len(text[at:]) - len(text[at:].lstrip("{")) if text.startswith("{{", at) else 1
                if not raw and run >= 2:
                    at += 2
                elif raw and run < dollars:
                    at += run
                else:
                    at = self.hole(at + run, dollars if raw else 1, verbatim or raw)
            elif c == "}" and not raw:
                if not text.startswith("}}", at):
                    break
                at += 2
            else:
                at += 1
        raise self.bad_at(min(start, len(text) - 1), "unterminated")

    def hole(self, at: int, closing: int, lines: bool) -> int:
        inner = object.__new__(type(self))
        inner.text, inner.t, inner.k, inner.nl, inner.at, inner.i = self.text, [], [], [], [], 0
        end = inner.lex_until(at, "}")
        inner.add("", "eof", end, True)
        inner.pair = inner._pairs()
        inner.expression()
        if inner.eat(","):
            inner.expression()
        if not inner.end():
            raise inner.bad()
        if self.text[end] == ":":
            end = self.text.find("}", end)
            if end < 0:
                raise self.bad_at(at, "unterminated")
        return end + closing

    # declarations

    def parse(self) -> None:
        while self.is_("extern") and self.next_is(1, "alias"):
            self.i += 2
            self.need_name()
            self.need(";")
        self.usings()
        while not self.end():
            self.top()

    def usings(self) -> None:
        while self.is_("using") and not self.next_is(1, "(", "var") or self.is_("global") and self.next_is(1, "using"):
            if not self.tried(self.using):
                return

    def using(self) -> None:
        self.eat("global")
        self.need("using")
        self.eat("static")
        self.eat("unsafe")
        if self.name() and self.next_is(1, "="):
            self.i += 2
            self.type_()
        else:
            self.qualified()
        self.need(";")

    def qualified(self) -> None:
        self.need_name()
        while self.eat(".", "::"):
            self.need_name()
            if self.is_("<"):
                self.type_arguments()

    def top(self) -> None:
        if self.is_("[") and self.next_is(1, "assembly", "module") and self.next_is(2, ":"):
            self.attributes()
        elif self.is_("namespace"):
            self.i += 1
            self.declared_any = True
            self.qualified()
            if self.eat(";"):
                self.usings()
                return
            self.need("{")
            self.usings()
            while not self.eat("}"):
                self.declaration()
            self.eat(";")
        elif self.tried(self.declaration):
            self.declared_any = True
        elif self.declared_any:
            raise self.bad("a statement after declarations:")
        else:
            self.statement()

    def attributes(self) -> None:
        while self.eat("["):
            if self.k[self.i] == "i" and self.next_is(1, ":"):
                self.i += 2

            def one() -> None:
                self.qualified()
                if self.is_("<"):
                    self.type_arguments()
                if self.is_("("):
                    self.arguments()

            if self.is_("]"):
                raise self.bad()
            self.listed(one, "]", trailing=True)

    def modifiers(self) -> None:
        while self.k[self.i] == "i" and self.t[self.i] in MODIFIERS:
            if self.t[self.i] not in RESERVED and not self.k[self.i + 1] == "i" and not self.next_is(1, "("):
                return
            if self.is_("partial", "required", "file", "scoped", "async") and self.next_is(1, "(", "=", ";", ",", ")", "."):
                return
            if self.is_("ref") and self.next_is(1, "struct"):
                self.i += 1
                continue
            if self.is_("new") and self.next_is(1, "("):
                return
            self.i += 1

    def declaration(self) -> None:
        """A type, a namespace inside a namespace, or a delegate."""
        if self.is_("namespace"):
            self.top()
            return
        self.attributes()
        self.modifiers()
        if not self.type_declaration():
            raise self.bad()

    def type_declaration(self) -> bool:
        if self.is_("class", "struct", "interface") or self.is_("record") and (self.k[self.i + 1] == "i"):
            record = self.eat("record")
            if not record or self.is_("class", "struct"):
                self.i += 1
            self.need_name()
            self.type_parameters()
            if self.is_("("):
                self.parameters()
            if self.eat(":"):
                self.type_()
                if self.is_("("):
                    self.arguments()
                while self.eat(","):
                    self.type_()
            self.constraints()
            if self.eat(";"):
                return True
            self.need("{")
            while not self.eat("}"):
                self.member()
            self.eat(";")
        elif self.eat("enum"):
            self.need_name()
            if self.eat(":"):
                self.type_()

            def one() -> None:
                self.attributes()
                self.need_name()
                if self.eat("="):
                    self.expression()

            self.need("{")
            self.listed(one, "}", trailing=True)
            self.eat(";")
        elif self.is_("delegate") and not self.next_is(1, "*", "(", "{"):
            self.i += 1
            self.return_type()
            self.need_name()
            self.type_parameters()
            self.parameters()
            self.constraints()
            self.need(";")
        else:
            return False
        return True

    def type_parameters(self) -> None:
        if self.eat("<"):
            while True:
                self.attributes()
                self.eat("in", "out")
                self.need_name()
                if self.eat(">"):
                    return
                self.need(",")

    def constraints(self) -> None:
        while self.is_("where") and self.name(1) and self.next_is(2, ":"):
            self.i += 3
            while True:
                if self.eat("new"):
                    self.need("(")
                    self.need(")")
                elif self.eat("class", "struct"):
                    self.eat("?")
                elif self.eat("default"):
                    pass
                elif self.is_("allows") and self.next_is(1, "ref"):
                    self.i += 3
                else:
                    self.type_()
                if not self.eat(","):
                    break

    def return_type(self) -> None:
        self.eat("ref")
        self.eat("readonly")
        self.type_()

    def member(self) -> None:
        self.attributes()
        self.modifiers()
        if self.type_declaration():
            return
        if self.eat("event"):
            self.type_()
            self.member_name()
            if self.is_("{"):
                self.accessors("add", "remove")
            else:
                self.declarators()
                self.need(";")
            return
        if self.eat("~"):
            self.need_name()
            self.parameters()
            self.body()
            return
        if self.eat("implicit", "explicit"):
            self.need("operator")
            self.eat("checked")
            self.type_()
            self.parameters()
            self.body()
            return
        if self.eat("fixed"):
            self.type_()
            self.need_name()
            self.need("[")
            self.expression()
            self.need("]")
            self.need(";")
            return
        if self.name() and self.next_is(1, "(") and not self.is_("extension"):  # constructor
            self.i += 1
            self.parameters()
            if self.eat(":"):
                if not self.eat("base", "this"):
                    raise self.bad()
                self.arguments()
            self.body()
            return
        if self.is_("extension") and self.next_is(1, "(", "<"):
            self.i += 1
            self.type_parameters()
            self.need("(")
            self.attributes()
            self.type_()
            if self.name():
                self.i += 1
            self.need(")")
            self.constraints()
            self.need("{")
            while not self.eat("}"):
                self.member()
            return
        self.return_type()
        if self.eat("operator"):
            self.eat("checked")
            if self.t[self.i] not in OVERLOADED:
                raise self.bad()
            self.i += 1
            while self.is_(">"):
                self.i += 1
            self.parameters()
            self.body()
            return
        self.member_name()
        if self.is_("(", "<"):
            self.type_parameters()
            self.parameters()
            self.constraints()
            self.body()
        elif self.is_("["):
            self.i += 1
            self.listed(self.parameter, "]")
            self.property()
        elif self.is_("{", "=>"):
            self.property()
        else:
            self.declarators()
            self.need(";")

    def member_name(self) -> None:
        """A name, with the interface it belongs to before it at times."""
        if self.eat("this"):
            return
        self.need_name()
        while True:
            if self.is_("<") and self.tried(self.interface_part):
                continue
            if not self.eat("."):
                return
            if self.eat("this"):
                return
            self.need_name()

    def interface_part(self) -> None:
        self.type_arguments()
        if not self.is_("."):
            raise self.bad()

    def property(self) -> None:
        if self.is_("=>"):
            self.body()
            return
        self.accessors("get", "set", "init")
        if self.eat("="):
            self.expression()
            self.need(";")

    def accessors(self, *names: str) -> None:
        self.need("{")
        n = 0
        while not self.eat("}"):
            self.attributes()
            while self.eat("public", "private", "protected", "internal", "readonly"):
                pass
            self.need(*names)
            self.body()
            n += 1
        if not n:
            raise self.bad()

    def body(self) -> None:
        if self.eat("=>"):
            self.eat("ref")
            self.expression()
            self.need(";")
        elif not self.eat(";"):
            self.block()

    def declarators(self) -> None:
        """What follows the first declared name."""
        while True:
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return
            self.need_name()

    def initializer(self) -> None:
        if self.is_("{"):
            self.collection()
        else:
            self.eat("ref")
            self.expression()

    def collection(self) -> None:
        """The braces of an object, a collection or an array."""

        def one() -> None:
            if self.is_("{"):
                self.collection()
            elif self.is_("["):
                if not self.tried(self.indexed):
                    self.expression()
            elif self.name() and self.next_is(1, "="):
                self.i += 2
                self.initializer()
            else:
                self.expression()

        self.need("{")
        self.listed(one, "}", trailing=True)

    def indexed(self) -> None:
        self.need("[")
        self.listed(self.argument, "]")
        self.need("=")
        self.initializer()

    def parameters(self) -> None:
        self.need("(")
        self.listed(self.parameter, ")")

    def parameter(self) -> None:
        self.attributes()
        while self.is_("ref", "out", "in", "params", "this", "readonly", "scoped") and self.k[self.i + 1] in "ip" and not self.next_is(1, ")", ",", "="):
            self.i += 1
        self.type_()
        self.need_name()
        if self.eat("="):
            self.expression()

    # types

    def type_(self, nullable: bool = True) -> None:
        if self.eat("("):
            n = 0
            while True:
                self.type_()
                if self.name():
                    self.i += 1
                n += 1
                if self.eat(")"):
                    break
                self.need(",")
            if n < 2:
                raise self.bad()
        elif self.is_("delegate") and self.next_is(1, "*"):
            self.i += 2
            self.need("<")
            self.type_()
            while self.eat(","):
                self.type_()
            if not self.split(">"):
                raise self.bad()
        elif self.k[self.i] == "i" and self.t[self.i] in BUILTIN:
            self.i += 1
        else:
            while True:
                self.need_name()
                if self.is_("<"):
                    self.type_arguments()
                if not self.eat(".", "::"):
                    break
        while True:
            if nullable and self.is_("?"):
                self.i += 1
            elif self.is_("[") and self.next_is(1, "]", ","):
                self.i += 1
                while self.eat(","):
                    pass
                self.need("]")
            elif self.is_("*"):
                self.i += 1
            else:
                return

    def type_arguments(self) -> None:
        self.need("<")
        if self.is_(",", ">"):
            while self.eat(","):
                pass
            self.need(">")
            return
        while True:
            self.attributes()
            self.type_()
            if self.split(">"):
                return
            self.need(",")

    # statements

    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.statement()

    def statement(self) -> None:
        t = self.t[self.i] if self.k[self.i] in "ip" else ""
        rule = STATEMENTS.get(t)
        if rule is not None:
            rule(self)
        elif t == "{":
            self.block()
        elif t == ";":
            self.i += 1
        elif t == "await" and self.next_is(1, "foreach", "using"):
            self.i += 1
            self.statement()
        elif t == "yield" and self.next_is(1, "return", "break"):
            self.i += 1
            self.statement()
        elif self.name() and self.next_is(1, ":"):
            self.i += 2
            self.statement()
        elif t in ("checked", "unchecked", "unsafe") and self.next_is(1, "{"):
            self.i += 1
            self.block()
        elif self.tried(self.local_function) or self.tried(self.local_statement):
            pass
        else:
            self.expression_statement()
            self.need(";")

    def local_function(self) -> None:
        self.attributes()
        while self.eat("static", "async", "unsafe", "extern"):
            pass
        self.return_type()
        self.need_name()
        self.type_parameters()
        self.parameters()
        self.constraints()
        if not self.is_("{", "=>"):
            raise self.bad()
        self.body()

    def local_statement(self) -> None:
        self.eat("const")
        self.local()
        self.need(";")

    def local(self) -> None:
        self.eat("scoped")
        self.eat("ref")
        self.eat("readonly")
        self.type_()
        self.need_name()
        self.declarators()

    def expression_statement(self) -> None:
        start = self.i
        self.expression()
        i, assigned = start, False
        while i < self.i:
            if self.k[i] == "p":
                assigned = assigned or self.t[i] in ASSIGN
                if self.t[i] in "([{":
                    i = self.pair.get(i, i)
            i += 1
        if not (assigned or self.t[self.i - 1] in (")", "++", "--", "}", "!") or self.t[start] in ("++", "--", "await", "new")):
            raise self.bad("no statement before")

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def if_(self) -> None:
        self.i += 1
        self.condition()
        self.statement()
        if self.eat("else"):
            self.statement()

    def while_(self) -> None:
        self.i += 1
        self.condition()
        self.statement()

    def do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.condition()
        self.need(";")

    def for_(self) -> None:
        self.i += 1
        self.need("(")
        if not self.is_(";"):
            if not self.tried(self.for_local):
                self.several()
        self.need(";")
        if not self.is_(";"):
            self.expression()
        self.need(";")
        if not self.is_(")"):
            self.several()
        self.need(")")
        self.statement()

    def for_local(self) -> None:
        self.local()
        if not self.is_(";"):
            raise self.bad()

    def several(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()

    def foreach(self) -> None:
        self.i += 1
        self.need("(")
        if not self.tried(self.each):
            self.expression()
            self.need("in")
            self.expression()
        self.need(")")
        self.statement()

    def each(self) -> None:
        self.eat("ref")
        self.eat("readonly")
        self.type_()
        if self.is_("("):
            self.designation()
        else:
            self.need_name()
        self.need("in")
        self.expression()

    def switch(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        while not self.eat("}"):
            if self.eat("case"):
                self.pattern()
                if self.eat("when"):
                    self.expression()
            else:
                self.need("default")
            self.need(":")
            while not self.is_("case", "}") and not (self.is_("default") and self.next_is(1, ":")):
                self.statement()

    def try_(self) -> None:
        self.i += 1
        self.block()
        n = 0
        while self.eat("catch"):
            n += 1
            if self.eat("("):
                self.type_()
                if self.name():
                    self.i += 1
                self.need(")")
            if self.eat("when"):
                self.condition()
            self.block()
        if self.eat("finally"):
            n += 1
            self.block()
        if not n:
            raise self.bad()

    def using_statement(self) -> None:
        self.i += 1
        if self.eat("("):
            if not self.tried(self.local_closed):
                self.expression()
                self.need(")")
            self.statement()
        else:
            self.local()
            self.need(";")

    def local_closed(self) -> None:
        self.local()
        self.need(")")

    def lock(self) -> None:
        self.i += 1
        self.condition()
        self.statement()

    def fixed(self) -> None:
        self.i += 1
        self.need("(")
        self.local()
        self.need(")")
        self.statement()

    def goto(self) -> None:
        self.i += 1
        if self.eat("case"):
            self.expression()
        elif not self.eat("default"):
            self.need_name()
        self.need(";")

    def jump(self) -> None:
        self.i += 1
        self.need(";")

    def return_(self) -> None:
        self.i += 1
        if not self.is_(";"):
            self.eat("ref")
            self.expression()
        self.need(";")

    # expressions

    def expression(self) -> None:
        if self.eat("throw"):
            self.expression()
            return
        if self.is_("from") and self.k[self.i + 1] == "i" and self.tried(self.query):
            return
        if self.lambda_():
            return
        start = self.i
        self.binary()
        if self.eat("?"):
            self.expression()
            self.need(":")
            self.eat("ref")
            self.expression()
        elif self.k[self.i] == "p" and self.t[self.i] in ASSIGN:
            if self.k[self.i - 1] in "ns" or self.i - start == 1 and self.t[start] in ("null", "true", "false"):
                raise self.bad()
            self.i += 1
            self.eat("ref")
            self.expression()

    def lambda_(self) -> bool:
        at = self.i
        if self.is_("[") and not self.tried(self.attributes):
            return False
        while self.is_("static", "async") and (self.k[self.i + 1] == "i" or self.next_is(1, "(")):
            self.i += 1
        if self.name() and self.next_is(1, "=>"):
            self.i += 2
            self.lambda_body()
            return True
        if self.is_("delegate"):
            self.i += 1
            if self.is_("("):
                self.parameters()
            self.block()
            return True
        if self.is_("("):
            after = self.pair[self.i] + 1
            if self.t[after] == "=>" and self.k[after] == "p" and (self.tried(self.untyped) or self.tried(self.typed)):
                self.need("=>")
                self.lambda_body()
                return True
        elif self.k[self.i] == "i" and (self.name() or self.t[self.i] in BUILTIN) and self.tried(self.typed_return):
            self.need("=>")
            self.lambda_body()
            return True
        self.i = at
        return False

    def typed_return(self) -> None:
        self.type_()
        self.parameters()
        if not self.is_("=>"):
            raise self.bad()

    def untyped(self) -> None:
        def one() -> None:
            while self.eat("ref", "out", "in"):
                pass
            self.need_name()

        self.need("(")
        self.listed(one, ")")

    def typed(self) -> None:
        self.parameters()

    def lambda_body(self) -> None:
        if self.is_("{"):
            self.block()
        else:
            self.eat("ref")
            self.expression()

    def query(self) -> None:
        self.from_()
        while not self.is_("select", "group"):
            if self.is_("from"):
                self.from_()
            elif self.eat("let"):
                self.need_name()
                self.need("=")
                self.expression()
            elif self.eat("where"):
                self.expression()
            elif self.eat("join"):
                if not self.next_is(1, "in"):
                    self.type_()
                self.need_name()
                self.need("in")
                self.expression()
                self.need("on")
                self.expression()
                self.need("equals")
                self.expression()
                if self.eat("into"):
                    self.need_name()
            elif self.eat("orderby"):
                while True:
                    self.expression()
                    self.eat("ascending", "descending")
                    if not self.eat(","):
                        break
            else:
                raise self.bad()
        if self.eat("group"):
            self.expression()
            self.need("by")
            self.expression()
        else:
            self.need("select")
            self.expression()
        if self.eat("into"):
            self.need_name()
            while not self.is_("select", "group"):
                self.need("where", "orderby", "let")
                self.expression()
            self.i += 1
            self.expression()

    def from_(self) -> None:
        self.need("from")
        if not self.next_is(1, "in"):
            self.type_()
        self.need_name()
        self.need("in")
        self.expression()

    def binary(self) -> None:
        while True:
            if not (self.is_("..") and not self.operand(1)):
                self.unary()
            while True:
                if self.eat("is"):
                    self.pattern()
                elif self.eat("as"):
                    self.type_(nullable=False)
                    if self.is_("?") and self.next_is(1, ")", ";", ",", "]", "}", "??"):
                        self.i += 1
                elif self.is_("switch") and self.next_is(1, "{"):
                    self.switch_expression()
                elif self.is_("with") and self.next_is(1, "{"):
                    self.i += 1
                    self.collection()
                else:
                    break
            if self.k[self.i] == "p" and self.t[self.i] in BINARY:
                dots = self.is_("..")
                if self.eat(">"):
                    while self.is_(">", ">=") and self.at[self.i] == self.at[self.i - 1] + 1:
                        self.i += 1
                        if self.t[self.i - 1] == ">=":
                            self.expression()
                            return
                else:
                    self.i += 1
                if dots and not self.operand(0):
                    return
                if self.is_("throw") or self.lambda_():
                    if self.is_("throw"):
                        self.expression()
                    return
                continue
            return

    def operand(self, n: int) -> bool:
        return not self.next_is(n, "]", ")", ",", ";", "}")

    def unary(self) -> None:
        while self.eat("+", "-", "!", "~", "++", "--", "&", "*", "^", "..") or self.is_("await") and (self.k[self.i + 1] in "ins" or self.next_is(1, "(")) and self.eat("await"):
            pass
        if self.is_("(") and self.tried(self.cast):
            return
        self.postfix()

    def cast(self) -> None:
        self.need("(")
        builtin = self.t[self.i] in BUILTIN
        self.type_()
        self.need(")")
        if self.is_("++", "--") or not (self.kind("i", "n", "s") and not self.is_("is", "as", "switch", "with", "in") or self.is_("(", "!", "~") or builtin and self.is_("-", "+")):
            raise self.bad()
        self.unary()

    def arguments(self) -> None:
        self.need("(")
        self.listed(self.argument, ")")

    def argument(self) -> None:
        if self.k[self.i] == "i" and self.next_is(1, ":") :
            self.i += 2
        if self.is_("ref", "out", "in"):
            out = self.eat("out")
            if not out:
                self.i += 1
            if out and self.tried(self.out_variable):
                return
        self.expression()

    def out_variable(self) -> None:
        self.type_()
        self.need_name()
        if not self.is_(",", ")"):
            raise self.bad()

    def postfix(self) -> None:
        self.primary()
        while True:
            if self.eat(".", "->", "::", "?."):
                self.need_name()
            elif self.is_("?") and self.next_is(1, "[") and self.at[self.i + 1] == self.at[self.i] + 1 and self.tried(self.null_index):
                pass
            elif self.is_("("):
                self.arguments()
            elif self.eat("["):
                self.listed(self.argument, "]")
            elif self.is_("++", "--"):
                self.i += 1
            elif self.is_("!") and not self.next_is(1, "="):
                self.i += 1
            elif self.is_("<") and self.k[self.i - 1] == "i" and self.tried(self.generic_name):
                pass
            else:
                return

    def null_index(self) -> None:
        self.need("?")
        self.need("[")
        self.listed(self.argument, "]")
        if self.is_(":"):
            raise self.bad()

    def generic_name(self) -> None:
        self.type_arguments()
        if not (self.is_("(", ")", "]", "}", ":", ";", ",", ".", "?", "==", "!=", "?.", "{", "[", "&&", "||") or self.end()):
            raise self.bad()

    def primary(self) -> None:
        if self.kind("n", "s"):
            self.i += 1
        elif self.eat("this", "base", "true", "false", "null"):
            pass
        elif self.is_("("):
            self.i += 1
            n = 0
            while True:
                if self.k[self.i] == "i" and self.next_is(1, ":"):
                    self.i += 2
                if not (self.is_("var") or self.name() or self.t[self.i] in BUILTIN) or not self.tried(self.declared):
                    self.expression()
                n += 1
                if self.eat(")"):
                    return
                self.need(",")
        elif self.eat("["):

            def one() -> None:
                self.eat("..")
                self.expression()

            self.listed(one, "]", trailing=True)
        elif self.eat("new"):
            self.creation()
        elif self.eat("typeof", "sizeof", "default", "checked", "unchecked"):
            word = self.t[self.i - 1]
            if word == "default" and not self.is_("("):
                return
            self.need("(")
            if word in ("checked", "unchecked"):
                self.expression()
            else:
                self.type_()
            self.need(")")
        elif self.eat("stackalloc"):
            if not self.is_("["):
                self.type_()
            self.need("[")
            if not self.eat("]"):
                self.expression()
                self.need("]")
            if self.is_("{"):
                self.collection()
        elif self.k[self.i] == "i" and self.t[self.i] in BUILTIN:
            self.i += 1
            if not self.is_("."):
                raise self.bad()
        elif self.is_("var") and self.next_is(1, "("):
            self.i += 1
            self.designation()
        else:
            self.need_name()

    def declared(self) -> None:
        """A variable declared inside a tuple: (var a, int b) = ..."""
        self.type_()
        self.need_name()
        if not self.is_(",", ")"):
            raise self.bad()

    def designation(self) -> None:
        if self.eat("("):
            self.listed(self.designation, ")")
        else:
            self.need_name()

    def creation(self) -> None:
        if self.is_("("):
            self.arguments()
        elif self.is_("{"):
            self.collection()
            return
        elif self.is_("["):
            self.i += 1
            while self.eat(","):
                pass
            self.need("]")
            self.collection()
            return
        else:
            self.type_(nullable=False)
            if self.is_("?") and self.next_is(1, "[") and self.next_is(2, "]"):
                self.i += 1
                self.type_arrays()
            if self.t[self.i - 1] == "]":
                self.collection()
                return
            if self.eat("["):
                self.listed(self.expression, "]")
                self.type_arrays()
            elif self.is_("("):
                self.arguments()
            elif not self.is_("{"):
                raise self.bad()
        if self.is_("{"):
            self.collection()

    def type_arrays(self) -> None:
        while self.is_("[") and self.next_is(1, "]", ","):
            self.i = self.pair[self.i] + 1

    def switch_expression(self) -> None:
        self.i += 1

        def arm() -> None:
            self.pattern()
            if self.eat("when"):
                self.expression()
            self.need("=>")
            self.expression()

        self.need("{")
        self.listed(arm, "}", trailing=True)

    def pattern(self) -> None:
        while True:
            while self.eat("not"):
                pass
            self.pattern_operand()
            if not self.eat("and", "or"):
                return

    def pattern_operand(self) -> None:
        if self.eat("<", ">", "<=", ">=", "==", "!="):
            self.shift()
        elif self.is_("[") and not self.next_is(1, "]") or self.is_("["):
            self.i += 1

            def one() -> None:
                if self.eat(".."):
                    if self.operand(0):
                        self.pattern()
                    return
                self.pattern()

            self.listed(one, "]", trailing=True)
            if self.name() and not self.is_("and", "or", "when"):
                self.i += 1
        elif self.is_("{") or self.is_("("):
            self.recursive()
        elif self.is_("var"):
            self.i += 1
            self.designation()
        elif not self.tried(self.typed_pattern):
            self.shift()

    def shift(self) -> None:
        """A constant in a pattern."""
        self.eat("-", "+")
        if self.is_("(") and self.tried(self.cast):
            return
        self.postfix()
        while self.is_("+", "-", "*", "|", "<<"):
            self.i += 1
            self.postfix()

    def typed_pattern(self) -> None:
        self.type_(nullable=False)
        if self.is_("?") and self.next_is(1, ")", "&&", "||", ";", ",", "}"):
            self.i += 1
        if self.is_("(", "{"):
            if self.is_("{") and self.next_is(1, "return", "throw"):
                return
            self.recursive()
        elif self.name() and not self.is_("and", "or", "when", "select", "where", "orderby", "equals"):
            self.i += 1
        if self.is_(".", "(", "+", "-"):
            raise self.bad()

    def recursive(self) -> None:
        def positional() -> None:
            if self.k[self.i] == "i" and self.next_is(1, ":"):
                self.i += 2
            self.pattern()

        def named() -> None:
            self.need_name()
            while self.eat("."):
                self.need_name()
            self.need(":")
            self.pattern()

        if self.eat("("):
            self.listed(positional, ")")
        if self.eat("{"):
            self.listed(named, "}", trailing=True)
        if self.name() and not self.is_("and", "or", "when", "select", "where"):
            self.i += 1


STATEMENTS = {
    "if": CSharp.if_, "while": CSharp.while_, "do": CSharp.do, "for": CSharp.for_, "foreach": CSharp.foreach,
    "switch": CSharp.switch, "try": CSharp.try_, "using": CSharp.using_statement, "lock": CSharp.lock, "fixed": CSharp.fixed,
    "goto": CSharp.goto, "break": CSharp.jump, "continue": CSharp.jump, "return": CSharp.return_, "throw": CSharp.return_,
}

__all__ = ["Bad", "CSharp"]
