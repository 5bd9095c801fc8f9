"""JavaScript and TypeScript, with or without JSX."""

from __future__ import annotations

import re

from graphloom.llm.grammar.base import Bad, Tokens

SPACE = " \t\r\f\v\u00a0\ufeff"
BREAKS = "\n\u2028\u2029"
SKIP = re.compile(rf"[{SPACE}]+|//[^\n]*|(?P<nl>[{BREAKS}])|/\*.*?\*/|\A#![^\n]*", re.S)
WORD = re.compile("#?(?:[^\\W\\d]|[$\\\\])[\\w$\u200c\u200d\\\\]*")
NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$])")
STRING = re.compile(r"\"(?:[^\"\\\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\n]|\\(?:\r\n|.))*'", re.S)
REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
CHUNK = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
OPERATOR = re.compile(
    r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[-+*/%&|^<>=!()\[\]{},;.:?~@]"
)
JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
JSX_SPACE = re.compile(r"(?:\s|/\*.*?\*/|//[^\n]*)*", re.S)

RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split()
)
BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())
BINARY = frozenset("|| && ?? == != === !== < > <= >= + - * / % & | ^ << ** in instanceof".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=".split())
TYPE_MODIFIERS = frozenset("public private protected readonly abstract override declare".split())


class Script(Tokens):
    RESERVED = RESERVED

    def __init__(self, text: str, types: bool, jsx: bool, limit: int | None = None):
        self.types, self.jsx = types, jsx
        super().__init__(text, limit)

    # tokens

    def lex(self) -> None:
        self.lex_until(0, None)

    def lex_until(self, at: int, close: str | None) -> int:
        """Lex up to the end, or to the } that closes a template's or a JSX expression; returns the offset behind it."""
        text, n, nl, depth = self.text, len(self.text), False, 0
        while at < n:
            c = text[at]
            if c in SPACE or c in BREAKS or c == "/" and text[at + 1 : at + 2] in ("/", "*") or at == 0 and c == "#":
                m = SKIP.match(text, at)
                if m is not None:
                    nl = nl or "\n" in m[0] or m.lastgroup == "nl"
                    at = m.end()
                    continue
            if c == "}" and close and depth == 0:
                return at + 1
            m = WORD.match(text, at)
            if m is not None:
                self.add(m[0], "i", at, nl)
            elif c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit():
                m = NUMBER.match(text, at)
                if m is None:
                    raise self.bad_at(at)
                self.add("0", "n", at, nl)
            elif c in "\"'":
                m = STRING.match(text, at)
                if m is None:
                    raise self.bad_at(at, "unterminated")
                self.add('"', "s", at, nl)
            elif c == "`":
                self.add("`", "`", at, nl)
                nl = False
                at = self.template(at + 1)
                continue
            elif c == "/" and self.operand_next() and (m := REGEX.match(text, at)):
                self.add("/", "s", at, nl)
            elif c == "<" and self.jsx and self.operand_next() and re.match(r"<(?:[A-Za-z_$][\w$.:-]*(?=[\s/>])|>)", text[at : at + 80]) and not (
                self.types and re.match(r"<[A-Za-z_$][\w$]*(?:\s+extends\b|\s*,)", text[at : at + 80])
            ):
                start = len(self.t)
                end = self.element(at)
                del start
                self.add("<>", "s", at, nl)
                nl = False
                at = end
                continue
            else:
                m = OPERATOR.match(text, at)
                if m is None:
                    raise self.bad_at(at)
                depth += (c == "{") - (c == "}")
                self.add(m[0], "p", at, nl)
            nl = False
            at = m.end()
        if close:
            raise self.bad_at(n - 1, "unterminated")
        return at

    def operand_next(self) -> bool:
        """Whether an operand may come next, so that / begins a regular expression and < an element."""
        if not self.t:
            return True
        t, k = self.t[-1], self.k[-1]
        if k == "i":
            return t in BEFORE_REGEX
        return k == "p" and t not in (")", "]", "}", "++", "--")

    def template(self, at: int) -> int:
        while True:
            at = CHUNK.match(self.text, at).end()
            if at >= len(self.text):
                raise self.bad_at(at - 1, "unterminated")
            if self.text[at] == "`":
                self.add("`", "e", at, False)
                return at + 1
            self.add("${", "$", at, False)
            at = self.lex_until(at + 2, "}")
            self.add("}", "c", at - 1, False)

    def element(self, at: int) -> int:
        """Check one JSX element; what stands in its braces is parsed apart."""
        text = self.text
        m = JSX_NAME.match(text, at + 1)
        name, at = (m[0], m.end()) if m else ("", at + 1)
        while True:
            at = JSX_SPACE.match(text, at).end()
            if text.startswith("/>", at):
                return at + 2
            if text.startswith(">", at):
                at += 1
                break
            if text.startswith("{", at):
                at = self.embedded(at)
                continue
            m = JSX_NAME.match(text, at)
            if m is None:
                raise self.bad_at(at)
            at = JSX_SPACE.match(text, m.end()).end()
            if text.startswith("=", at):
                at = JSX_SPACE.match(text, at + 1).end()
                if text.startswith("{", at):
                    at = self.embedded(at)
                elif text[at : at + 1] in ("'", '"') and (end := text.find(text[at], at + 1)) > 0:
                    at = end + 1
                elif text.startswith("<", at):
                    at = self.element(at)
                else:
                    raise self.bad_at(at)
        while True:
            m = re.compile(r"[^<{}>]*").match(text, at)
            at = m.end()
            if at >= len(text):
                raise self.bad_at(at - 1, "unterminated")
            if text.startswith("</", at):
                m = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>").match(text, at)
                if m is None or (m[1] or "") != name:
                    raise self.bad_at(at)
                return m.end()
            if text[at] == "<":
                at = self.element(at)
            elif text[at] == "{":
                at = self.embedded(at)
            else:
                raise self.bad_at(at)

    def embedded(self, at: int) -> int:
        inner = object.__new__(type(self))
        inner.types, inner.jsx, inner.text = self.types, self.jsx, self.text
        inner.t, inner.k, inner.nl, inner.at, inner.i = [], [], [], [], 0
        end = inner.lex_until(at + 1, "}")
        inner.add("", "eof", end, True)
        inner.pair = inner._pairs()
        if not inner.end():
            inner.eat("...")
            inner.expression()
            if not inner.end():
                raise inner.bad()
        return end

    # statements

    def parse(self) -> None:
        while not self.end():
            self.statement()

    def semi(self) -> None:
        if not (self.eat(";") or self.is_("}") or self.end() or self.nl[self.i]):
            raise self.bad()

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
        elif t == "let" and (self.name(1) or self.next_is(1, "[", "{")):
            self.variables()
            self.semi()
        elif t in ("using", "await") and self.name(1) and not self.nl[self.i + 1] and (t == "using" or self.next_is(1, "using") and self.name(2)) and self.tried(self.using):
            pass
        elif t == "async" and self.next_is(1, "function") and not self.nl[self.i + 1]:
            self.i += 1
            self.function(True)
        elif t == "@":
            self.decorators()
            self.eat("export")
            self.eat("default")
            self.eat("abstract")
            self.class_(True)
        elif self.types and t in TYPE_STATEMENTS and self.tried(TYPE_STATEMENTS[t], self):
            pass
        elif self.name() and self.next_is(1, ":"):
            self.i += 2
            self.statement()
        else:
            self.expression()
            self.semi()

    def using(self) -> None:
        self.eat("await")
        self.need("using")
        self.need_name()
        self.need("=")
        self.assignment()
        self.semi()

    def variables(self, loop: bool = False) -> None:
        const = self.t[self.i] == "const"
        self.i += 1
        if const and self.types and self.is_("enum"):
            self.enum()
            return
        while True:
            pattern = self.is_("[", "{")
            self.binding()
            if self.types:
                self.eat("!")
                self.annotation()
            if self.eat("="):
                self.assignment(no_in=loop)
            elif not loop and (const or pattern) and not self.types:
                raise self.bad()
            if not self.eat(","):
                return

    def declare_variables(self) -> None:
        self.variables()
        if not (self.types and self.t[self.i - 1] == "}" and self.k[self.i - 1] == "p" and self.end()):
            self.semi()

    def binding(self) -> None:
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.assignment()
                if not self.is_("]"):
                    self.need(",")
        elif self.eat("{"):

            def one() -> None:
                if self.eat("..."):
                    self.binding()
                    return
                short = self.name()
                self.key()
                if self.eat(":"):
                    self.binding()
                elif not short:
                    raise self.bad()
                if self.eat("="):
                    self.assignment()

            self.listed(one, "}", trailing=True)
        else:
            self.need_name()

    def annotation(self) -> None:
        if self.types and self.eat(":"):
            self.type_(predicate=True)

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

    def for_(self) -> None:
        self.i += 1
        self.eat("await")
        self.need("(")
        if self.is_("var", "const") or self.is_("let", "using") and (self.name(1) or self.next_is(1, "[", "{")):
            self.variables(loop=True)
        elif not self.is_(";"):
            self.expression(no_in=True)
        if self.eat("of", "in"):
            self.expression()
        else:
            self.need(";")
            if not self.is_(";"):
                self.expression()
            self.need(";")
            if not self.is_(")"):
                self.expression()
        self.need(")")
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
        self.eat(";")

    def switch(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        while not self.eat("}"):
            if self.eat("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while not self.is_("case", "default", "}"):
                self.statement()

    def try_(self) -> None:
        self.i += 1
        self.block()
        n = 0
        if self.eat("catch"):
            n = 1
            if self.eat("("):
                self.binding()
                self.annotation()
                self.need(")")
            self.block()
        if self.eat("finally"):
            n = 1
            self.block()
        if not n:
            raise self.bad()

    def return_(self) -> None:
        self.i += 1
        if not (self.is_(";", "}") or self.end() or self.nl[self.i]):
            self.expression()
        self.semi()

    def throw(self) -> None:
        self.i += 1
        if self.nl[self.i]:
            raise self.bad()
        self.expression()
        self.semi()

    def jump(self) -> None:
        self.i += 1
        if self.name() and not self.nl[self.i]:
            self.i += 1
        self.semi()

    def with_(self) -> None:
        self.while_()

    def function_statement(self) -> None:
        self.function(True)

    def class_statement(self) -> None:
        self.class_(True)

    def import_(self) -> None:
        if self.next_is(1, "(", "."):
            self.expression()
            self.semi()
            return
        self.i += 1
        if self.k[self.i] != "s":
            if self.types and self.name() and self.next_is(1, "=") or self.types and self.is_("type") and self.name(1) and self.next_is(2, "="):
                self.eat("type") if self.next_is(2, "=") else None
                self.need_name()
                self.need("=")
                self.expression()
                self.semi()
                return
            if self.is_("type", "defer", "source") and (self.name(1) and not self.next_is(1, "from") or self.next_is(1, "{", "*")):
                if self.is_("type") and not self.types:
                    raise self.bad()
                self.i += 1
            if self.name():
                self.i += 1
                if not self.is_("from"):
                    self.need(",")
            if self.eat("*"):
                self.need("as")
                self.need_name()
            elif self.eat("{"):
                self.specifiers()
            self.need("from")
        self.module_name()
        self.semi()

    def module_name(self) -> None:
        if self.k[self.i] != "s" or self.t[self.i] != '"':
            raise self.bad()
        self.i += 1
        if self.eat("with", "assert"):
            if not self.is_("{"):
                raise self.bad()
            self.object()

    def specifiers(self) -> None:
        def one() -> None:
            if self.is_("type") and self.types and not self.next_is(1, ",", "}", "as"):
                self.i += 1
            for _ in range(2):
                if self.k[self.i] == "s":
                    self.i += 1
                elif self.k[self.i] == "i":
                    self.i += 1
                else:
                    raise self.bad()
                if not self.eat("as"):
                    return

        self.listed(one, "}", trailing=True)

    def export(self) -> None:
        self.i += 1
        if self.eat("default"):
            if self.is_("function", "class", "@", "abstract") or self.is_("async") and self.next_is(1, "function"):
                if self.eat("async"):
                    pass
                if self.is_("function"):
                    self.function(False)
                else:
                    self.decorators()
                    self.eat("abstract")
                    self.class_(False)
            elif self.types and self.is_("interface") and self.name(1):
                self.interface()
            else:
                self.assignment()
                self.semi()
        elif self.eat("*"):
            if self.eat("as"):
                self.i += 1
            self.need("from")
            self.module_name()
            self.semi()
        elif self.is_("{") or self.types and self.is_("type") and self.next_is(1, "{", "*"):
            self.eat("type")
            if self.eat("*"):
                if self.eat("as"):
                    self.need_name()
                self.need("from")
                self.module_name()
            else:
                self.need("{")
                self.specifiers()
                if self.eat("from"):
                    self.module_name()
            self.semi()
        elif self.types and self.eat("="):
            self.expression()
            self.semi()
        elif self.types and self.is_("as") and self.next_is(1, "namespace"):
            self.i += 2
            self.need_name()
            self.semi()
        elif self.is_("var", "let", "const", "function", "class", "async", "@", "import") or self.types and self.t[self.i] in TYPE_STATEMENTS:
            self.statement()
        else:
            raise self.bad()

    # functions and classes

    def function(self, named: bool) -> None:
        self.need("function")
        self.eat("*")
        if self.name():
            self.i += 1
        elif named:
            raise self.bad()
        self.function_rest()

    def function_rest(self, body: bool = True) -> None:
        self.type_parameters()
        self.parameters()
        self.annotation()
        if self.is_("{"):
            self.block()
        elif self.types and body:
            self.semi()  # an overload
        else:
            raise self.bad()

    def parameters(self) -> None:
        self.need("(")
        self.listed(self.parameter, ")", trailing=True)

    def parameter(self) -> None:
        self.decorators()
        if self.types:
            while self.k[self.i] == "i" and self.t[self.i] in TYPE_MODIFIERS and (self.k[self.i + 1] == "i" or self.next_is(1, "{", "[")):
                self.i += 1
        self.eat("...")
        if self.types and self.eat("this"):
            pass
        else:
            self.binding()
        if self.types:
            self.eat("?")
            self.annotation()
        if self.eat("="):
            self.assignment()

    def type_parameters(self) -> None:
        if self.types and self.is_("<"):
            self.i += 1
            while not self.split(">"):
                self.eat("const")
                while self.is_("in", "out") and self.k[self.i + 1] == "i":
                    self.i += 1
                self.need_name()
                if self.eat("extends"):
                    self.type_()
                if self.eat("="):
                    self.type_()
                if not self.is_(">", ">>", ">>=", ">>>="):
                    self.need(",")

    def decorators(self) -> None:
        while self.eat("@"):
            if self.is_("("):
                self.condition()
                continue
            self.need_name()
            while self.eat("."):
                self.i += 1
            if self.types and self.is_("<"):
                self.type_arguments()
            if self.is_("("):
                self.arguments()

    def class_(self, named: bool) -> None:
        self.need("class")
        if self.name() and not self.is_("implements"):
            self.i += 1
        elif named:
            raise self.bad()
        self.type_parameters()
        if self.eat("extends"):
            self.postfix(call=True)
            if self.types and self.is_("<"):
                self.type_arguments()
        if self.types and self.eat("implements"):
            self.type_()
            while self.eat(","):
                self.type_()
        self.need("{")
        while not self.eat("}"):
            self.member()

    def member(self) -> None:
        if self.eat(";"):
            return
        self.decorators()
        if self.is_("static") and self.next_is(1, "{"):
            self.i += 1
            self.block()
            return
        while self.k[self.i] == "i" and not self.next_is(1, "(", "=", ";", "}", ":", "?", "!", "<", ",") and not (self.nl[self.i + 1] and self.is_("get", "set", "static", "accessor", "async") and not self.is_("static")):
            w = self.t[self.i]
            if w in ("static", "accessor", "get", "set") or w == "async" and not self.nl[self.i + 1] or self.types and w in TYPE_MODIFIERS:
                self.i += 1
            else:
                break
        self.eat("*")
        if self.types and self.is_("[") and self.name(1) and self.next_is(2, ":"):
            self.index_signature()
            self.semi()
            return
        self.key()
        if self.types:
            self.eat("?", "!")
        if self.is_("(", "<"):
            self.function_rest()
            return
        self.annotation()
        if self.eat("="):
            self.assignment()
        self.semi()

    def index_signature(self) -> None:
        self.need("[")
        self.need_name()
        self.need(":")
        self.type_()
        self.need("]")
        self.eat("?")
        self.annotation()

    def key(self) -> None:
        if self.kind("i", "n") or self.kind("s") and self.t[self.i] == '"':
            self.i += 1
        elif self.eat("["):
            self.assignment()
            self.need("]")
        else:
            raise self.bad()

    # expressions

    def expression(self, no_in: bool = False) -> None:
        self.assignment(no_in)
        while self.eat(","):
            self.assignment(no_in)

    def arrow(self, is_async: bool = False) -> bool:
        """An arrow function at the cursor, if there is one."""
        if self.name() and self.next_is(1, "=>"):
            self.i += 1
        elif self.is_("(") or self.types and self.is_("<"):
            if self.is_("("):
                after = self.pair[self.i] + 1
                if not (self.t[after] == "=>" or self.types and self.t[after] == ":" and self.k[after] == "p"):
                    return False
            if not self.tried(self.arrow_head):
                return False
        else:
            return False
        if self.nl[self.i]:
            raise self.bad()
        self.need("=>")
        if self.is_("{"):
            self.block()
        else:
            self.assignment()
        return True

    def arrow_head(self) -> None:
        self.type_parameters()
        self.parameters()
        self.annotation()
        if not self.is_("=>"):
            raise self.bad()

    def assignment(self, no_in: bool = False) -> None:
        if self.is_("async") and not self.nl[self.i + 1] and (self.name(1) or self.next_is(1, "(", "<")):
            at = self.i
            self.i += 1
            if self.arrow(True):
                return
            self.i = at
        if self.arrow():
            return
        if self.is_("yield") and not self.next_is(1, "=", ".", "=>"):
            self.i += 1
            self.eat("*")
            if not (self.is_(")", "]", "}", ",", ";", ":") or self.end() or self.nl[self.i]):
                self.assignment(no_in)
            return
        start = self.i
        self.binary(no_in)
        if self.k[self.i] == "p" and self.t[self.i] in ASSIGN:
            if self.k[self.i - 1] in "n" or self.k[self.i - 1] == "s" or self.i - start == 1 and self.t[start] in ("this", "null", "true", "false"):
                raise self.bad()
            self.i += 1
            self.assignment(no_in)
        elif self.eat("?"):
            self.assignment()
            self.need(":")
            self.assignment(no_in)

    def binary(self, no_in: bool = False) -> None:
        while True:
            self.unary()
            while self.types and self.is_("as", "satisfies") and not self.nl[self.i]:
                self.i += 1
                if not self.eat("const"):
                    self.type_()
            t = self.t[self.i]
            if t in BINARY and self.k[self.i] in "pi" and not (no_in and t == "in"):
                if t == ">":
                    self.i += 1
                    while self.is_(">") and self.at[self.i] == self.at[self.i - 1] + 1:
                        self.i += 1
                else:
                    self.i += 1
                continue
            if self.k[self.i] == "p" and t in (">>", ">>>"):
                self.i += 1
                continue
            return

    def unary(self) -> None:
        while self.eat("!", "~", "+", "-", "++", "--", "typeof", "void", "delete") or self.is_("await") and not self.next_is(1, ")", ",", ";", ".", "=", "=>", ":", "]") and self.eat("await"):
            pass
        if self.types and not self.jsx and self.is_("<"):
            self.i += 1
            if not self.eat("const"):
                self.type_()
            if not self.split(">"):
                raise self.bad()
            self.unary()
            return
        self.postfix()
        if self.is_("++", "--") and not self.nl[self.i]:
            self.i += 1

    def arguments(self) -> None:
        def one() -> None:
            self.eat("...")
            self.assignment()

        self.need("(")
        self.listed(one, ")", trailing=True)

    def postfix(self, call: bool = True) -> None:
        if self.eat("new"):
            if self.eat("."):
                self.need("target")
            else:
                self.postfix(call=False)
                if self.types and self.is_("<"):
                    self.tried(self.type_arguments)
                if self.is_("("):
                    self.arguments()
                if not call:
                    return
        else:
            self.primary()
        while True:
            if self.eat("."):
                if self.k[self.i] != "i":
                    raise self.bad()
                self.i += 1
            elif self.eat("?."):
                if self.is_("("):
                    self.arguments()
                elif self.eat("["):
                    self.expression()
                    self.need("]")
                elif self.k[self.i] == "i":
                    self.i += 1
                else:
                    raise self.bad()
            elif self.eat("["):
                self.expression()
                self.need("]")
            elif self.is_("("):
                if not call:
                    return
                self.arguments()
            elif self.k[self.i] == "`":
                self.template_literal()
            elif self.types and self.is_("!") and not self.nl[self.i] and not self.next_is(1, "=", "=="):
                self.i += 1
            elif self.types and self.is_("<", "<<") and self.tried(self.call_types):
                pass
            else:
                return

    def call_types(self) -> None:
        self.type_arguments()
        if not (self.is_("(", ")", ",", ";", "]", "}", ".", "?.", ":") or self.k[self.i] in ("`", "eof") or self.nl[self.i]):
            raise self.bad()

    def template_literal(self) -> None:
        self.i += 1
        while self.k[self.i] != "e":
            if self.k[self.i] != "$":
                raise self.bad()
            self.i += 1
            self.expression()
            if self.k[self.i] != "c":
                raise self.bad()
            self.i += 1
        self.i += 1

    def primary(self) -> None:
        k, t = self.k[self.i], self.t[self.i]
        if k in "ns":
            self.i += 1
        elif k == "`":
            self.template_literal()
        elif k == "p":
            if t == "(":
                self.condition()
            elif t == "[":
                self.i += 1
                while not self.eat("]"):
                    if self.eat(","):
                        continue
                    self.eat("...")
                    self.assignment()
                    if not self.is_("]"):
                        self.need(",")
            elif t == "{":
                self.object()
            elif t == "@":
                self.decorators()
                self.class_(False)
            else:
                raise self.bad()
        elif k != "i":
            raise self.bad()
        elif t == "function":
            self.function(False)
        elif t == "class":
            self.class_(False)
        elif t == "async" and self.next_is(1, "function") and not self.nl[self.i + 1]:
            self.i += 1
            self.function(False)
        elif t == "import":
            self.i += 1
            if self.eat("."):
                self.i += 1
            if not self.is_("(", ".", ";", ")") and self.t[self.i - 1] != "meta":
                raise self.bad()
        elif t in ("this", "super", "null", "true", "false"):
            self.i += 1
        elif t[0] == "#" and not self.next_is(1, "in"):
            raise self.bad()
        elif t in RESERVED:
            raise self.bad()
        else:
            self.i += 1

    def object(self) -> None:
        def one() -> None:
            if self.eat("..."):
                self.assignment()
                return
            short = self.name()
            while self.is_("get", "set", "async") and not self.next_is(1, "(", ":", ",", "}", "=", "<"):
                self.i += 1
                short = False
            if self.eat("*"):
                short = False
            self.key()
            if self.is_("(") or self.types and self.is_("<"):
                self.function_rest(body=False)
            elif self.eat(":"):
                self.assignment()
            elif not short:
                raise self.bad()
            elif self.eat("="):
                self.assignment()

        self.need("{")
        self.listed(one, "}", trailing=True)

    # types

    def type_(self, predicate: bool = False) -> None:
        if predicate and self.is_("asserts") and (self.name(1) or self.next_is(1, "this")) and not self.nl[self.i + 1]:
            self.i += 2
            if self.eat("is"):
                self.type_()
            return
        if predicate and (self.name() or self.is_("this")) and self.next_is(1, "is") and not self.nl[self.i + 1]:
            self.i += 2
        if self.is_("new") or self.is_("abstract") and self.next_is(1, "new"):
            self.eat("abstract")
            self.i += 1
            self.function_type()
            return
        if self.is_("<") or self.is_("(") and self.t[self.pair[self.i] + 1] == "=>" :
            self.function_type()
            return
        self.union()
        if self.is_("extends") and not self.nl[self.i]:
            self.i += 1
            self.union_or_function()
            self.need("?")
            self.type_()
            self.need(":")
            self.type_()

    def union_or_function(self) -> None:
        if self.is_("(") and self.t[self.pair[self.i] + 1] == "=>" or self.is_("new"):
            self.eat("new")
            self.function_type()
        else:
            self.union()

    def function_type(self) -> None:
        self.type_parameters()
        self.parameters()
        self.need("=>")
        self.type_(predicate=True)

    def union(self) -> None:
        self.eat("|", "&")
        while True:
            if self.is_("(") and self.t[self.pair[self.i] + 1] == "=>":
                self.function_type()
                return
            self.type_operand()
            if not self.eat("|", "&"):
                return

    def type_operand(self) -> None:
        while self.is_("keyof", "unique", "readonly", "infer") and (self.k[self.i + 1] == "i" or self.next_is(1, "[", "(", "{")):
            if self.eat("infer"):
                self.need_name()
                if self.is_("extends") and self.tried(self.infer_bound):
                    pass
                return
            self.i += 1
        k = self.k[self.i]
        if k in "ns":
            self.i += 1
        elif self.is_("-"):
            self.i += 1
            if self.k[self.i] != "n":
                raise self.bad()
            self.i += 1
        elif k == "`":
            self.i += 1
            while self.k[self.i] != "e":
                self.i += 1
                self.type_()
                if self.k[self.i] != "c":
                    raise self.bad()
                self.i += 1
            self.i += 1
        elif self.eat("("):
            self.type_()
            self.need(")")
        elif self.eat("["):

            def element() -> None:
                self.eat("...")
                if self.k[self.i] == "i" and (self.next_is(1, ":") or self.next_is(1, "?") and self.next_is(2, ":")):
                    self.i += 1
                    self.eat("?")
                    self.need(":")
                    self.eat("...")
                self.type_()
                self.eat("?")

            self.listed(element, "]", trailing=True)
        elif self.is_("{"):
            self.object_type()
        elif self.eat("typeof"):
            if self.is_("import"):
                self.type_operand()
                return
            self.i += 1
            while self.eat("."):
                self.i += 1
            if self.is_("<") and not self.nl[self.i]:
                self.type_arguments()
        elif self.eat("import"):
            self.arguments()
            while self.eat("."):
                self.i += 1
            if self.is_("<"):
                self.type_arguments()
        elif k == "i" and (self.t[self.i] not in RESERVED or self.is_("this", "void", "null", "true", "false")):
            self.i += 1
            while self.eat("."):
                if self.k[self.i] != "i":
                    raise self.bad()
                self.i += 1
            if self.is_("<", "<<") and not self.nl[self.i]:
                self.type_arguments()
        else:
            raise self.bad()
        while self.is_("[") and not self.nl[self.i]:
            self.i += 1
            if not self.eat("]"):
                self.type_()
                self.need("]")

    def infer_bound(self) -> None:
        self.need("extends")
        self.union()
        if self.is_("?"):
            raise self.bad()

    def type_arguments(self) -> None:
        if not self.split("<"):
            raise self.bad()
        while True:
            self.type_()
            if self.split(">"):
                return
            self.need(",")

    def object_type(self) -> None:
        self.need("{")
        while not self.eat("}"):
            self.type_member()
            if not (self.eat(";", ",") or self.is_("}") or self.nl[self.i]):
                raise self.bad()

    def type_member(self) -> None:
        if self.eat("+", "-"):
            self.need("readonly")
        while self.is_("readonly", "get", "set") and not self.next_is(1, "(", ":", "?", ";", ",", "}", "<"):
            self.i += 1
        if self.is_("[") and self.name(1) and self.next_is(2, "in"):
            self.i += 3
            self.type_()
            if self.eat("as"):
                self.type_()
            self.need("]")
            if self.eat("+", "-"):
                self.need("?")
            else:
                self.eat("?")
            self.annotation()
            return
        if self.is_("[") and self.name(1) and self.next_is(2, ":"):
            self.index_signature()
            return
        if self.is_("new") and self.next_is(1, "(", "<"):
            self.i += 1
        elif not self.is_("(", "<"):
            self.key()
            self.eat("?")
        if self.is_("(", "<"):
            self.type_parameters()
            self.parameters()
        self.annotation()

    # TypeScript declarations

    def interface(self) -> None:
        self.need("interface")
        self.need_name()
        self.type_parameters()
        if self.eat("extends"):
            self.type_()
            while self.eat(","):
                self.type_()
        self.object_type()

    def alias(self) -> None:
        self.need("type")
        if self.nl[self.i]:
            raise self.bad()
        self.need_name()
        self.type_parameters()
        self.need("=")
        self.type_()
        self.semi()

    def enum(self) -> None:
        self.need("enum")
        self.need_name()
        self.need("{")

        def one() -> None:
            self.key()
            if self.eat("="):
                self.assignment()

        self.listed(one, "}", trailing=True)

    def namespace(self) -> None:
        self.i += 1
        if self.nl[self.i]:
            raise self.bad()
        if self.k[self.i] == "s":
            self.i += 1
        else:
            self.need_name()
            while self.eat("."):
                self.need_name()
        if self.is_("{"):
            self.block()
        else:
            self.semi()

    def declare(self) -> None:
        self.i += 1
        if self.nl[self.i] or self.k[self.i] != "i":
            raise self.bad()
        if self.eat("global"):
            self.block()
        elif self.is_("var", "let", "const", "function", "class", "abstract", "enum", "namespace", "module", "interface", "type", "async"):
            self.statement()
        else:
            raise self.bad()

    def abstract(self) -> None:
        self.i += 1
        self.class_(True)

    def debugger(self) -> None:
        self.i += 1
        self.semi()


STATEMENTS = {
    "if": Script.if_, "for": Script.for_, "while": Script.while_, "do": Script.do, "switch": Script.switch, "try": Script.try_,
    "return": Script.return_, "throw": Script.throw, "break": Script.jump, "continue": Script.jump, "with": Script.with_,
    "var": Script.declare_variables, "const": Script.declare_variables, "function": Script.function_statement,
    "class": Script.class_statement, "import": Script.import_, "export": Script.export, "debugger": Script.debugger,
}
TYPE_STATEMENTS = {
    "interface": Script.interface, "type": Script.alias, "enum": Script.enum, "namespace": Script.namespace, "module": Script.namespace,
    "declare": Script.declare, "abstract": Script.abstract,
}

__all__ = ["Bad", "Script"]
