"""Text of the cube language to a tree.

    program := stmt ((";" | newline) stmt)*        stmt := name "=" expr | condition "=" expr | expr

from loosest to tightest: `..`, or, and, not, comparisons, + -, * / %, unary -, ^ ** (to the right), then `.name`, `[...]`,
`(...)` and `by year|month`.  Numbers with d, w, m or y are durations; "..." names a layer, $k the k-th input; # starts a
comment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+|\#[^\n]*)|(?P<end>[;\n]+)|(?P<date>\d{4}-\d{2}(?:-\d{2})?)|(?P<duration>\d+(?:\.\d+)?[dwmy]\b)
    |(?P<number>(?:\d+(?:\.(?!\.)\d*)?|\.\d+)(?:[eE][+-]?\d+)?)|(?P<text>"[^"\n]*"|'[^'\n]*')|(?P<input>\$\d+)
    |(?P<name>[A-Za-z_]\w*)|(?P<op>\.\.|\*\*|<=|>=|==|!=|&&|\|\||[-+*/%^<>=!()\[\],.:])""",
    re.X,
)


class CubeError(ValueError):
    """What is wrong, with the place in the text."""

    def __init__(self, message: str, text: str = "", at: int | None = None):
        if at is not None:
            line = text.count("\n", 0, at) + 1
            message = f"{message} (line {line}, column {at - text.rfind(chr(10), 0, at)})"
        super().__init__(message)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


@dataclass(frozen=True)
class Node:
    """kind: number, duration, date, text, name, input, call, unary, binary, member, index, slice, by, let, rule, program."""

    kind: str
    value: str = ""
    args: tuple = ()
    keywords: tuple = ()
    at: int = field(default=0, compare=False)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise CubeError(f"unexpected {text[at]!r}", text, at)
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("eof", "", at)]


BINARY = {"or": 2, "||": 2, "and": 3, "&&": 3, "<": 5, "<=": 5, ">": 5, ">=": 5, "==": 5, "!=": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7, "^": 9, "**": 9}
SAME = {"||": "or", "&&": "and", "**": "^"}
RANGE, NOT, UNARY = 1, 4, 8


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.k, self.depth = text, tokens(text), 0, 0

    @property
    def now(self) -> Token:
        while self.depth and self.tokens[self.k].kind == "end" and self.tokens[self.k].text.isspace():
            self.k += 1  # lines go on within brackets
        return self.tokens[self.k]

    def take(self, *texts: str) -> Token | None:
        t = self.now
        if texts and t.text not in texts or t.kind in ("eof", "text"):
            return None
        self.k += 1
        return t

    def need(self, text: str) -> Token:
        t = self.take(text)
        if not t:
            raise CubeError(f"{text!r} is missing before {self.now.text or 'the end'!r}", self.text, self.now.at)
        return t

    def program(self) -> Node:
        out = []
        while self.now.kind != "eof":
            if self.now.kind == "end":
                self.k += 1
                continue
            out.append(self.statement())
            if self.now.kind not in ("end", "eof"):
                raise CubeError(f"unexpected {self.now.text!r}", self.text, self.now.at)
        if not out:
            raise CubeError("the program is empty")
        return Node("program", args=tuple(out))

    def statement(self) -> Node:
        left = self.expression()
        if t := self.take("="):
            right = self.expression()
            if left.kind == "name":
                return Node("let", left.value, (right,), at=left.at)
            return Node("rule", args=(left, right), at=t.at)
        return left

    def expression(self, least: int = RANGE) -> Node:
        left = self.prefix()
        while True:
            t = self.now
            op = t.text if t.kind in ("op", "name") else ""
            if op == ".." and least <= RANGE:
                self.k += 1
                left = Node("slice", args=(left, self.expression(RANGE + 1)), at=t.at)
            elif op in BINARY and BINARY[op] >= least:
                self.k += 1
                power = BINARY[op] == 9
                left = Node("binary", SAME.get(op, op), (left, self.expression(8 if power else BINARY[op] + 1)), at=t.at)
            else:
                return left

    def prefix(self) -> Node:
        t = self.now
        if t.kind == "op" and t.text in "+-":
            self.k += 1
            return Node("unary", t.text, (self.expression(UNARY),), at=t.at)
        if t.kind == "name" and t.text == "not" or t.text == "!" and t.kind == "op":
            self.k += 1
            return Node("unary", "not", (self.expression(NOT),), at=t.at)
        return self.postfix(self.atom())

    def atom(self) -> Node:
        t = self.now
        self.k += 1
        if t.kind == "text":
            return Node("layer", t.text[1:-1], at=t.at)
        if t.kind in ("number", "duration", "date", "name", "input"):
            return Node(t.kind, t.text, at=t.at)
        if t.text == "(":
            self.depth += 1
            inner = self.expression()
            self.need(")")
            self.depth -= 1
            return inner
        self.k -= 1
        raise CubeError(f"unexpected {t.text or 'end'!r}", self.text, t.at)

    def postfix(self, node: Node) -> Node:
        while True:
            if node.kind == "name" and self.now.text == "(" and self.now.kind == "op":
                node = self.call(node)
            elif self.now.text == "." and self.now.kind == "op":
                self.k += 1
                t = self.now
                if t.kind not in ("name", "text"):
                    raise CubeError("a band's name is missing after '.'", self.text, t.at)
                self.k += 1
                node = Node("member", t.text.strip("\"'"), (node,), at=t.at)
            elif t := self.take("["):
                self.depth += 1
                inner = self.expression()
                self.need("]")
                self.depth -= 1
                node = Node("index", args=(node, inner), at=t.at)
            elif self.now.kind == "name" and self.now.text == "by" and self.tokens[self.k + 1].text in ("year", "month"):
                t = self.now
                node = Node("by", self.tokens[self.k + 1].text, (node,), at=t.at)
                self.k += 2
            else:
                return node

    def call(self, name: Node) -> Node:
        self.need("(")
        self.depth += 1
        args, keywords = [], []
        while not self.take(")"):
            if args or keywords:
                self.need(",")
            if self.now.kind == "name" and self.tokens[self.k + 1].text == "=":
                key = self.now.text
                self.k += 2
                keywords.append((key, self.expression()))
            else:
                args.append(self.expression())
        self.depth -= 1
        return Node("call", name.value, tuple(args), tuple(keywords), at=name.at)


def parse(text: str) -> Node:
    return Parser(text).program()


def render(node: Node) -> str:
    """Canonical text of a tree, with brackets everywhere."""
    a = [render(x) if isinstance(x, Node) else str(x) for x in node.args]
    match node.kind:
        case "program":
            return "; ".join(a)
        case "let":
            return f"{node.value} = {a[0]}"
        case "rule":
            return f"{a[0]} = {a[1]}"
        case "binary":
            return f"({a[0]} {node.value} {a[1]})"
        case "unary":
            return f"(not {a[0]})" if node.value == "not" else f"({node.value}{a[0]})"
        case "call":
            return f"{node.value}({', '.join([*a, *(f'{k}={render(v)}' for k, v in node.keywords)])})"
        case "member":
            return f"{a[0]}.{node.value}"
        case "index":
            return f"{a[0]}[{a[1]}]"
        case "slice":
            return f"{a[0]} .. {a[1]}"
        case "by":
            return f"{a[0]} by {node.value}"
        case "layer":
            return f'"{node.value}"'
    return node.value
