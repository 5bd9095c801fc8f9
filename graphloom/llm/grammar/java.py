"""Java."""

from __future__ import annotations

import re

from graphloom.llm.grammar.base import Bad, Tokens

LEX = re.compile(
    r"(?P<nl>\n)|(?P<skip>[ \t\r\f\x1a]+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)"
    r"|(?P<num>(?:0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?)(?![\w$])"
    r"|(?P<str>\"\"\"[ \t\f]*\r?\n(?:[^\\]|\\.)*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))')"
    r"|(?P<op>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^<>=!()\[\]{},;.:?~@])",
    re.S,
)
RESERVED = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
PRIMITIVE = frozenset("boolean byte char short int long float double void".split())
MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
BINARY = frozenset("|| && == != < > <= >= + - * / % & | ^ <<".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())


class Java(Tokens):
    RESERVED = RESERVED

    def lex(self) -> None:
        self.scan(LEX, {"id": "i", "num": "n", "str": "s", "op": "p"}, {"num": "0", "str": '"'})

    # declarations

    def parse(self) -> None:
        at = self.i
        self.annotations()
        if self.eat("package"):
            self.qualified()
            self.need(";")
        else:
            self.i = at
        while self.is_("import", ";"):
            if self.eat(";"):
                continue
            self.i += 1
            self.eat("static")
            if self.is_("module") and self.name(1):
                self.i += 1
            self.need_name()
            while self.eat("."):
                if self.eat("*"):
                    break
                self.need_name()
            self.need(";")
        if self.is_("module", "open") and (self.name(1)):
            self.eat("open")
            self.need("module")
            self.qualified()
            if not self.is_("{"):
                raise self.bad()
            self.i = self.pair[self.i] + 1
        fields = methods = 0
        while not self.end():  # members without a class need a method among them
            self.member("")
            fields += self.t[self.i - 1] == ";" and self.t[self.i - 2] != ";" and self.t[self.i - 2] != "}"
            methods += self.t[self.i - 1] == "}"
        if fields and not methods:
            raise self.bad_at(self.at[0])

    def qualified(self) -> None:
        self.need_name()
        while self.eat("."):
            self.need_name()

    def annotations(self) -> None:
        while self.is_("@") and not self.next_is(1, "interface"):
            self.i += 1
            self.qualified()
            if self.eat("("):
                self.listed(self.annotation_value, ")")

    def annotation_value(self) -> None:
        if self.name() and self.next_is(1, "="):
            self.i += 2
        if self.is_("@"):
            self.annotations()
        elif self.eat("{"):
            self.listed(self.annotation_value, "}", trailing=True)
        else:
            self.conditional()

    def modifiers(self) -> None:
        while True:
            self.annotations()
            if self.is_("non") and self.next_is(1, "-") and self.next_is(2, "sealed"):
                self.i += 3
            elif self.k[self.i] == "i" and self.t[self.i] in MODIFIERS and not (self.is_("sealed") and self.next_is(1, "(", "=", ";", ".")):
                if self.is_("default") and self.next_is(1, ":", "->"):
                    return
                self.i += 1
            else:
                return

    def type_declaration(self) -> bool:
        if self.eat("class"):
            self.need_name()
            self.type_parameters()
            if self.eat("extends"):
                self.type_()
            self.heritage("implements", "permits")
            self.body("class")
        elif self.eat("interface"):
            self.need_name()
            self.type_parameters()
            self.heritage("extends", "permits")
            self.body("class")
        elif self.is_("@") and self.next_is(1, "interface"):
            self.i += 2
            self.need_name()
            self.body("class")
        elif self.eat("enum"):
            self.need_name()
            self.heritage("implements")
            self.body("enum")
        elif self.is_("record") and self.name(1) and self.next_is(2, "(", "<"):
            self.i += 2
            self.type_parameters()
            self.parameters()
            self.heritage("implements")
            self.body("record")
        else:
            return False
        return True

    def heritage(self, *words: str) -> None:
        for w in words:
            if self.eat(w):
                self.type_()
                while self.eat(","):
                    self.type_()

    def type_parameters(self) -> None:
        if self.eat("<"):
            while True:
                self.annotations()
                self.need_name()
                if self.eat("extends"):
                    self.type_()
                    while self.eat("&"):
                        self.type_()
                if self.split(">"):
                    return
                self.need(",")

    def body(self, kind: str) -> None:
        self.need("{")
        if kind == "enum":
            while not self.is_(";", "}"):
                self.annotations()
                self.need_name()
                if self.is_("("):
                    self.arguments()
                if self.is_("{"):
                    self.body("class")
                if not self.eat(","):
                    break
            if not self.is_("}"):
                self.need(";")
        while not self.eat("}"):
            self.member(kind)

    def member(self, kind: str) -> None:
        if self.eat(";"):
            return
        if self.is_("{"):
            if not kind:
                raise self.bad()
            self.block()
            return
        if self.is_("static") and self.next_is(1, "{"):
            self.i += 1
            self.block()
            return
        self.modifiers()
        if self.type_declaration():
            return
        self.type_parameters()
        if kind and self.name() and self.next_is(1, "("):  # constructor
            self.i += 1
            self.parameters()
            self.throws()
            self.block()
            return
        if kind == "record" and self.name() and self.next_is(1, "{"):
            self.i += 1
            self.block()
            return
        self.type_()
        self.need_name()
        if self.is_("("):
            self.parameters()
            self.dims()
            self.throws()
            if self.eat("default"):
                self.annotation_value()
            if not self.eat(";"):
                self.block()
        else:
            self.declarators()
            self.need(";")

    def throws(self) -> None:
        if self.eat("throws"):
            self.type_()
            while self.eat(","):
                self.type_()

    def parameters(self) -> None:
        self.need("(")
        self.listed(self.parameter, ")")

    def parameter(self) -> None:
        self.modifiers()
        self.type_()
        self.annotations()
        self.eat("...")
        if self.name() and self.next_is(1, "."):
            self.i += 2
        if not self.eat("this"):
            if not self.eat("_"):
                self.need_name()
        self.dims()

    def dims(self) -> None:
        while self.is_("[") and self.next_is(1, "]"):
            self.i += 2

    def declarators(self) -> None:
        """What follows the first declared name."""
        while True:
            self.dims()
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return
            self.need_name()

    def initializer(self) -> None:
        if self.eat("{"):
            self.listed(self.initializer, "}", trailing=True)
        else:
            self.expression()

    # types

    def type_(self) -> None:
        self.annotations()
        if self.k[self.i] == "i" and self.t[self.i] in PRIMITIVE:
            self.i += 1
        elif self.eat("?"):
            if self.eat("extends", "super"):
                self.type_()
            return
        else:
            while True:
                self.annotations()
                self.need_name()
                if self.is_("<"):
                    self.type_arguments()
                if self.is_(".") and (self.name(1) or self.next_is(1, "@")):
                    self.i += 1
                else:
                    break
        self.annotations()
        self.dims()

    def type_arguments(self) -> None:
        self.need("<")
        if self.split(">"):
            return
        while True:
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
        if rule is not None and not (t == "yield" and self.next_is(1, "=", "(", ".", "++", "--")) :
            rule(self)
        elif t == "{":
            self.block()
        elif t == ";":
            self.i += 1
        elif self.name() and self.next_is(1, ":"):
            self.i += 2
            self.statement()
        elif t in ("final", "abstract", "static", "@", "class", "interface", "enum", "strictfp") or t in ("record", "sealed", "non") and self.k[self.i + 1] == "i":
            self.modifiers()
            if not self.type_declaration():
                self.local()
                self.need(";")
        elif not self.tried(self.local_statement):
            self.expression_statement()
            self.need(";")

    def local_statement(self) -> None:
        self.local()
        self.need(";")

    def local(self) -> None:
        self.type_()
        if not self.eat("_"):
            self.need_name()
        self.declarators()

    def expression_statement(self) -> None:
        start = self.i
        self.expression()
        if not (self.assigned(start) or self.t[self.i - 1] in (")", "++", "--") or self.t[start] in ("++", "--") or self.t[start] == "new"):
            raise self.bad("no statement before")

    def assigned(self, start: int) -> bool:
        i = start
        while i < self.i:
            if self.k[i] == "p":
                if self.t[i] in ASSIGN:
                    return True
                if self.t[i] in "([{":
                    i = self.pair.get(i, i)
            i += 1
        return False

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
        if not self.tried(self.each):
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

    def each(self) -> None:
        self.modifiers()
        self.type_()
        if not self.eat("_"):
            self.need_name()
        self.need(":")
        self.expression()

    def for_local(self) -> None:
        self.modifiers()
        self.local()
        if not self.is_(";"):
            raise self.bad()

    def several(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()

    def switch(self, value: bool = False) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        while not self.eat("}"):
            if self.eat("case"):
                self.case_label()
                while self.eat(","):
                    self.case_label()
                if self.eat("when"):
                    self.conditional()
            else:
                self.need("default")
            if self.eat("->"):
                if self.is_("{"):
                    self.block()
                elif self.is_("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not self.is_("case", "}") and not (self.is_("default") and self.next_is(1, ":", "->")):
                    self.statement()

    def case_label(self) -> None:
        if self.eat("default"):
            return
        if not self.tried(self.case_pattern):
            self.conditional(lambdas=False)

    def case_pattern(self) -> None:
        self.pattern()
        if not self.is_(":", "->", ",", "when"):
            raise self.bad()

    def pattern(self) -> None:
        self.modifiers()
        if self.eat("_"):
            return
        self.type_()
        if self.eat("("):
            self.listed(self.pattern, ")")
            if self.name() and not self.is_("when"):
                self.i += 1
        elif not self.eat("_"):
            self.need_name()

    def try_(self) -> None:
        self.i += 1
        resources = self.eat("(")
        if resources:
            while not self.eat(")"):
                if not self.tried(self.resource):
                    self.expression()
                if not self.is_(")"):
                    self.need(";")
        self.block()
        n = 0
        while self.eat("catch"):
            n += 1
            self.need("(")
            self.modifiers()
            self.type_()
            while self.eat("|"):
                self.type_()
            if not self.eat("_"):
                self.need_name()
            self.need(")")
            self.block()
        if self.eat("finally"):
            n += 1
            self.block()
        if not n and not resources:
            raise self.bad()

    def resource(self) -> None:
        self.modifiers()
        self.type_()
        self.need_name()
        self.need("=")
        self.expression()

    def jump(self) -> None:
        self.i += 1
        if self.name():
            self.i += 1
        self.need(";")

    def return_(self) -> None:
        self.i += 1
        if not self.is_(";"):
            self.expression()
        self.need(";")

    def throw(self) -> None:
        self.i += 1
        self.expression()
        self.need(";")

    def synchronized(self) -> None:
        self.i += 1
        self.condition()
        self.block()

    def assert_(self) -> None:
        self.i += 1
        self.expression()
        if self.eat(":"):
            self.expression()
        self.need(";")

    def switch_statement(self) -> None:
        self.switch()

    # expressions

    def expression(self) -> None:
        self.conditional()
        if self.k[self.i] == "p" and self.t[self.i] in ASSIGN:
            last = self.t[self.i - 1]
            if self.k[self.i - 1] in "ns" or last == ")":
                raise self.bad()
            self.i += 1
            self.expression()
        elif self.is_(">") and self.t[self.i : self.i + 2] in ([">", ">="], [">", ">>="]):
            raise self.bad()

    def conditional(self, lambdas: bool = True) -> None:
        self.binary(lambdas)
        if self.eat("?"):
            self.expression()
            self.need(":")
            self.conditional()

    def binary(self, lambdas: bool = True) -> None:
        while True:
            self.unary(lambdas)
            while self.eat("instanceof"):
                if not self.tried(self.pattern):
                    self.modifiers()
                    self.type_()
            if self.k[self.i] == "p" and self.t[self.i] in BINARY:
                if self.eat(">"):
                    n = 1
                    while self.is_(">") and n < 3 and self.at[self.i] == self.at[self.i - 1] + 1:
                        self.i += 1
                        n += 1
                    if self.is_(">=") and self.at[self.i] == self.at[self.i - 1] + 1:
                        self.i += 1
                        self.expression()
                        return
                else:
                    self.i += 1
                continue
            return

    def unary(self, lambdas: bool = True) -> None:
        while self.eat("+", "-", "!", "~", "++", "--"):
            pass
        if self.is_("(") and lambdas:
            close = self.pair[self.i]
            if self.t[close + 1] == "->" and self.k[close + 1] == "p":
                self.lambda_()
                return
            if self.tried(self.cast):
                return
        if lambdas and (self.name() or self.is_("_")) and self.next_is(1, "->"):
            self.i += 2
            self.lambda_body()
            return
        self.postfix()

    def cast(self) -> None:
        self.need("(")
        primitive = self.t[self.i] in PRIMITIVE and not self.next_is(1, "[")
        self.type_()
        while self.eat("&"):
            self.type_()
        self.need(")")
        if not primitive and (self.kind("p", "eof") and not self.is_("(", "!", "~", "@") or self.is_("instanceof")):
            raise self.bad()
        self.unary()

    def lambda_(self) -> None:
        self.need("(")
        if not self.tried(self.untyped):
            self.listed(self.parameter, ")")
        self.need("->")
        self.lambda_body()

    def untyped(self) -> None:
        def one() -> None:
            if not self.eat("_"):
                self.need_name()

        self.listed(one, ")")

    def lambda_body(self) -> None:
        if self.is_("{"):
            self.block()
        else:
            self.expression()

    def arguments(self) -> None:
        self.need("(")
        self.listed(self.expression, ")")

    def postfix(self) -> None:
        self.primary()
        while True:
            if self.eat("."):
                if self.is_("<"):
                    self.type_arguments()
                if self.eat("new"):
                    self.creation()
                elif not self.eat("class", "this", "super"):
                    self.need_name()
            elif self.is_("("):
                if not (self.k[self.i - 1] == "i"):
                    raise self.bad()
                self.arguments()
            elif self.eat("["):
                self.expression()
                self.need("]")
            elif self.eat("++", "--"):
                pass
            elif self.eat("::"):
                if self.is_("<"):
                    self.type_arguments()
                if not self.eat("new"):
                    self.need_name()
            else:
                return

    def primary(self) -> None:
        if self.kind("n", "s"):
            self.i += 1
        elif self.eat("this", "super", "true", "false", "null"):
            pass
        elif self.eat("("):
            self.expression()
            self.need(")")
        elif self.eat("new"):
            self.creation()
        elif self.is_("switch"):
            self.switch(True)
        elif self.k[self.i] == "i" and self.t[self.i] in PRIMITIVE:
            self.type_()
            if not (self.is_("::") or self.is_(".") and self.next_is(1, "class")):
                raise self.bad()
        elif self.name():
            if self.next_is(1, "<", "[") and self.tried(self.generic_reference):
                return
            self.i += 1
        else:
            raise self.bad()

    def generic_reference(self) -> None:
        self.type_()
        if not (self.is_("::") or self.is_(".") and self.next_is(1, "class")):
            raise self.bad()

    def creation(self) -> None:
        if self.is_("<"):
            self.type_arguments()
        self.annotations()
        if self.k[self.i] == "i" and self.t[self.i] in PRIMITIVE:
            self.i += 1
        else:
            while True:
                self.annotations()
                self.need_name()
                if self.is_("<"):
                    self.type_arguments()
                if not self.eat("."):
                    break
        if self.is_("["):
            sized = False
            while self.eat("["):
                if not self.eat("]"):
                    self.expression()
                    self.need("]")
                    sized = True
            if self.is_("{"):
                self.initializer()
            elif not sized:
                raise self.bad()
        else:
            self.arguments()
            if self.is_("{"):
                self.body("class")


STATEMENTS = {
    "if": Java.if_, "while": Java.while_, "do": Java.do, "for": Java.for_, "switch": Java.switch_statement, "try": Java.try_,
    "break": Java.jump, "continue": Java.jump, "return": Java.return_, "throw": Java.throw, "yield": Java.throw,
    "synchronized": Java.synchronized, "assert": Java.assert_,
}

__all__ = ["Bad", "Java"]
