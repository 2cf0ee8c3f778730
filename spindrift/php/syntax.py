"""Tokens and syntax trees of PHP source."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*?(?=\?>|\n|\Z)|\#(?!\[)[^\n]*?(?=\?>|\n|\Z)|/\*.*?(?:\*/|\Z))
      |(?P<close>\?>\n?)
      |(?P<heredoc><<<[ \t]*(?P<q>['"]?)(?P<tag>\w+)(?P=q)\n.*?\n[ \t]*(?P=tag)\b)
      |(?P<var>\$\w+)
      |(?P<number>0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
      |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`)
      |(?P<cast>\((?:\s*)(?:int|integer|float|double|bool|boolean|string|array|object)(?:\s*)\))
      |(?P<name>\\?[A-Za-z_\x80-￿][\w\\\x80-￿]*)
      |(?P<op>===|!==|<=>|\*\*=|\?\?=|\.\.\.|<<=|>>=|\?->|==|!=|<>|<=|>=|&&|\|\||\?\?|->|=>|::|\+\+|--|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|.)""",
    re.X | re.S,
)
VARIABLE = re.compile(r"(?<!\\)\$(\w+)")


@dataclass
class Node:
    kind: str
    line: int
    value: str = ""
    children: list[Node] = field(default_factory=list)

    def walk(self):
        """The node and all below it, in preorder."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += reversed(n.children)


def tokens(code: str) -> list[tuple[str, str, int]]:
    """(kind, text, line). Text outside of code is one html token; code without an opening tag is read as code."""
    out, at, line = [], 0, 1
    inside = "<?php" not in code and "<?=" not in code
    while at < len(code):
        if not inside:
            m = re.compile(r"<\?(?:php\b|=)").search(code, at)
            text = code[at : m.start()] if m else code[at:]
            if text.strip():
                out.append(("html", text, line))
            line += text.count("\n")
            if not m:
                break
            if m[0] == "<?=":
                out.append(("name", "echo", line))
            at, inside = m.end(), True
            continue
        m = TOKEN.match(code, at)
        kind = m.lastgroup
        if kind == "close":
            out.append(("op", ";", line))
            inside = False
        elif kind != "space":
            out.append(("string" if kind == "heredoc" else kind, m[0], line))
        line += m[0].count("\n")
        at = m.end()
    return out


LEVELS = [["or"], ["xor"], ["and"], ["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!=", "===", "!==", "<>", "<=>"], ["<", ">", "<=", ">="], ["<<", ">>"], ["+", "-", "."], ["*", "/", "%"], ["instanceof"]]
RANK = {op: level for level, ops in enumerate(LEVELS) for op in ops}
ASSIGN = {"=", "+=", "-=", "*=", "/=", ".=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "??="}
MODIFIERS = {"public", "private", "protected", "static", "abstract", "final", "readonly", "var", "const"}


class Parser:
    """Recursive descent. What it can't read is skipped up to the next semicolon, so that the rest of a file still counts."""

    def __init__(self, code: str):
        self.t, self.i = tokens(code), 0

    def peek(self, k: int = 0) -> tuple[str, str, int]:
        return self.t[self.i + k] if self.i + k < len(self.t) else ("end", "", self.t[-1][2] if self.t else 1)

    def at(self, *texts: str) -> bool:
        kind, text, _ = self.peek()
        return kind in ("op", "name") and text.lower() in texts

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def program(self) -> Node:
        out = Node("program", 1)
        while self.peek()[0] != "end":
            out.children.append(self.statement())
        return out

    def block(self, *ends: str) -> Node:
        """A braced block, one statement, or with a colon statements up to one of ends."""
        out = Node("block", self.peek()[2])
        if self.take("{"):
            while not self.at("}") and self.peek()[0] != "end":
                out.children.append(self.statement())
            self.take("}")
        elif ends and self.take(":"):
            while not self.at(*ends) and self.peek()[0] != "end":
                out.children.append(self.statement())
        else:
            out.children.append(self.statement())
        return out

    def parens(self) -> Node:
        line = self.peek()[2]
        if not self.take("("):
            return Node("empty", line)
        out = self.expression() if not self.at(")") else Node("empty", line)
        self.take(")")
        return out

    def statement(self) -> Node:
        kind, text, line = self.peek()
        word, before = text.lower() if kind in ("name", "op") else "", self.i
        out = getattr(self, f"_{word}", None) if kind == "name" and word in STATEMENTS else None
        if out:
            self.i += 1
            node = out(line)
        elif kind == "html":
            self.i += 1
            node = Node("html", line, text)
        elif word == "{":
            node = self.block()
        elif word == ";":
            self.i += 1
            node = Node("empty", line)
        elif kind == "name" and word in MODIFIERS | {"interface", "trait", "enum", "namespace", "use"} and self.peek(1)[1] not in ("(", "::"):
            self.i += 1
            node = self._class(line) if word in ("interface", "trait", "enum") else self.statement() if word in MODIFIERS and (self.at("function", "class") or self.at(*MODIFIERS)) else self.simple(Node(word, line))
        else:
            node = Node("expr", line, "", [self.expression()])
            self.take(";")
        if self.i == before:
            self.i += 1
        return node

    def simple(self, node: Node) -> Node:
        while not self.at(";", "}") and self.peek()[0] != "end":
            before = self.i
            node.children.append(self.expression())
            if not self.take(",") and self.i == before:
                self.i += 1
        self.take(";")
        return node

    def _if(self, line: int) -> Node:
        test, then = self.parens(), self.block("elseif", "else", "endif")
        out = Node("if", line, "", [test, then])
        at = self.peek()[2]
        if self.take("elseif"):
            out.children.append(Node("block", at, "", [self._if(at)]))
            return out
        if self.at("else"):
            self.i += 1
            if self.take("if"):
                out.children.append(Node("block", at, "", [self._if(at)]))
            else:
                out.children.append(self.block("endif"))
        if self.take("endif"):
            self.take(";")
        return out

    def _while(self, line: int) -> Node:
        out = Node("while", line, "", [self.parens(), self.block("endwhile")])
        if self.take("endwhile"):
            self.take(";")
        return out

    def _do(self, line: int) -> Node:
        body = self.block()
        self.take("while")
        out = Node("do", line, "", [body, self.parens()])
        self.take(";")
        return out

    def _for(self, line: int) -> Node:
        parts: list[Node] = []
        self.take("(")
        for end in (";", ";", ")"):
            part = Node("block", line)
            while not self.at(end) and self.peek()[0] != "end":
                part.children.append(Node("expr", line, "", [self.expression()]))
                if not self.take(",") and not self.at(end):
                    self.i += 1
            self.take(end)
            parts.append(part)
        out = Node("for", line, "", [*parts, self.block("endfor")])
        if self.take("endfor"):
            self.take(";")
        return out

    def _foreach(self, line: int) -> Node:
        self.take("(")
        over = self.expression()
        self.take("as")
        names = [self.expression()]
        if self.take("=>"):
            names.append(self.expression())
        self.take(")")
        out = Node("foreach", line, "", [over, names[-1], self.block("endforeach")])
        if self.take("endforeach"):
            self.take(";")
        return out

    def _switch(self, line: int) -> Node:
        out = Node("switch", line, "", [self.parens()])
        self.take("{") or self.take(":")
        while not self.at("}", "endswitch") and self.peek()[0] != "end":
            at = self.peek()[2]
            if self.take("default"):
                case = Node("case", at, "default", [Node("empty", at)])
            elif self.take("case"):
                case = Node("case", at, "", [self.expression()])
            else:
                self.i += 1
                continue
            self.take(":") or self.take(";")
            while not self.at("case", "default", "}", "endswitch") and self.peek()[0] != "end":
                case.children.append(self.statement())
            out.children.append(case)
        self.take("}") or (self.take("endswitch") and self.take(";"))
        return out

    def _try(self, line: int) -> Node:
        out = Node("try", line, "", [self.block()])
        while self.at("catch", "finally"):
            at, word = self.peek()[2], self.peek()[1].lower()
            self.i += 1
            if word == "catch":
                while not self.take(")") and self.peek()[0] != "end":
                    self.i += 1
            out.children.append(Node(word, at, "", [self.block()]))
        return out

    def _function(self, line: int) -> Node:
        self.take("&")
        name = self.peek()[1] if self.peek()[0] == "name" else ""
        self.i += bool(name)
        params = self.parameters()
        if self.take("use"):
            self.parameters()
        while not self.at("{", ";") and self.peek()[0] != "end":
            self.i += 1
        body = self.block() if self.at("{") else Node("block", line)
        self.take(";") if not name else None
        return Node("function", line, name, [params, body])

    def parameters(self) -> Node:
        out = Node("params", self.peek()[2])
        depth = 0
        while self.peek()[0] != "end":
            kind, text, line = self.peek()
            self.i += 1
            depth += (text == "(") - (text == ")") if kind == "op" else 0
            if kind == "var" and depth == 1:
                out.children.append(Node("var", line, text[1:]))
            if depth <= 0:
                break
        return out

    def _class(self, line: int) -> Node:
        name = self.peek()[1]
        while not self.at("{", ";") and self.peek()[0] != "end":
            self.i += 1
        return Node("class", line, name, [self.block()])

    def _return(self, line: int) -> Node:
        return self.simple(Node("return", line))

    def _throw(self, line: int) -> Node:
        return self.simple(Node("throw", line))

    def _break(self, line: int) -> Node:
        return self.simple(Node("break", line))

    def _continue(self, line: int) -> Node:
        return self.simple(Node("continue", line))

    def _echo(self, line: int) -> Node:
        return self.simple(Node("echo", line))

    def _global(self, line: int) -> Node:
        return self.simple(Node("global", line))

    def expression(self) -> Node:
        left = self.ternary()
        kind, text, line = self.peek()
        if kind == "op" and text in ASSIGN:
            self.i += 1
            self.take("&")
            return Node("assign", left.line, text, [left, self.expression()])
        return left

    def ternary(self) -> Node:
        test = self.binary(0)
        line = self.peek()[2]
        if self.take("??"):
            return Node("coalesce", line, "", [test, self.expression()])
        if self.take("?"):
            then = test if self.at(":") else self.expression()
            self.take(":")
            return Node("ternary", line, "", [test, then, self.expression()])
        return test

    def binary(self, level: int) -> Node:
        """Operators of a level and those that bind closer."""
        left = self.unary()
        while True:
            kind, text, line = self.peek()
            rank = RANK.get(text.lower(), -1) if kind in ("op", "name") else -1
            if rank < level:
                return left
            self.i += 1
            left = Node("binary", line, text.lower(), [left, self.assigned(rank + 1)])

    def assigned(self, level: int) -> Node:
        right = self.binary(level)
        if self.peek()[0] == "op" and self.peek()[1] in ASSIGN:
            op = self.peek()[1]
            self.i += 1
            return Node("assign", right.line, op, [right, self.expression()])
        return right

    def unary(self) -> Node:
        kind, text, line = self.peek()
        if kind == "cast":
            self.i += 1
            return Node("cast", line, text.strip("() \t\n").lower(), [self.unary()])
        if kind == "op" and text in ("!", "-", "+", "@", "&", "~", "++", "--", "..."):
            self.i += 1
            return Node("unary", line, text, [self.unary()])
        if kind == "name" and (word := text.lower()) in ("new", "clone", "print", "include", "include_once", "require", "require_once", "yield", "throw"):
            self.i += 1
            inner = self.unary() if word in ("new", "clone") else self.expression()
            return Node("new" if word in ("new", "clone") else "call", line, word, inner.children if word == "new" and inner.kind == "call" else [inner])
        return self.postfix(self.primary())

    def arguments(self) -> list[Node]:
        out: list[Node] = []
        self.take("(")
        while not self.at(")") and self.peek()[0] != "end":
            before = self.i
            if self.peek()[0] == "name" and self.peek(1)[1] == ":" and self.peek(2)[1] != ":":
                self.i += 2
            out.append(self.expression())
            if not self.take(",") and self.i == before:
                self.i += 1
        self.take(")")
        return out

    def primary(self) -> Node:
        kind, text, line = self.peek()
        self.i += kind != "end"
        if kind == "var":
            return Node("var", line, text[1:])
        if kind == "number":
            return Node("number", line, text)
        if kind == "string":
            names = VARIABLE.findall(text) if text[0] in '"`' or text.startswith("<<<") and "'" not in text[:5] else []
            node = Node("interpolated" if names else "string", line, text, [Node("var", line, n) for n in names])
            return Node("call", line, "shell_exec", [node]) if text[0] == "`" else node
        if kind == "op" and text == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if kind == "op" and text == "[":
            return Node("array", line, "", self.items("]"))
        if kind == "name":
            if text.lower() in ("function", "fn"):
                if text.lower() == "function":
                    return self._function(line)
                params = self.parameters()
                self.take("=>")
                return Node("function", line, "", [params, Node("block", line, "", [Node("return", line, "", [self.expression()])])])
            if text.lower() in ("array", "list") and self.at("("):
                self.i += 1
                return Node("array", line, "", self.items(")"))
            if text.lower() == "static" and self.at("function", "fn"):
                return self.primary()
            return Node("name", line, text)
        if kind == "op" and text in (")", "]", "}", ";", ","):
            self.i -= 1
        return Node("empty", line)

    def items(self, end: str) -> list[Node]:
        out: list[Node] = []
        while not self.at(end) and self.peek()[0] != "end":
            before = self.i
            out.append(self.expression())
            if self.take("=>"):
                out[-1] = self.expression()
            if not self.take(",") and self.i == before:
                self.i += 1
        self.take(end)
        return out

    def postfix(self, node: Node) -> Node:
        while True:
            kind, text, line = self.peek()
            if kind != "op":
                return node
            if text == "(":
                args = self.arguments()
                node = Node("method", node.line, node.value, [node.children[0], *args]) if node.kind in ("prop", "static") else Node("call", node.line, node.value, args)
            elif text == "[":
                self.i += 1
                node = Node("index", line, "", [node] + ([self.expression()] if not self.at("]") else []))
                self.take("]")
            elif text in ("->", "?->", "::"):
                self.i += 1
                name = self.peek()[1].lstrip("$")
                self.i += 1
                node = Node("static" if text == "::" else "prop", line, name, [node])
            elif text in ("++", "--"):
                self.i += 1
                node = Node("unary", line, text, [node])
            else:
                return node


STATEMENTS = {"if", "while", "do", "for", "foreach", "switch", "try", "function", "class", "return", "throw", "break", "continue", "echo", "global"}


def parse(code: str | None) -> Node:
    return Parser(code or "").program()
