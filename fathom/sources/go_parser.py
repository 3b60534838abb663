"""Declarations of a Go source text, read from its tokens; what is sound survives a syntax error elsewhere."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"(?P<space>[ \t\r]+)|(?P<newline>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)"
    r"|(?P<string>`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<name>[^\W\d]\w*)|(?P<number>\.?\d[\w.]*)"
    r"|(?P<op>\.\.\.|<-|\+\+|--|:=|&&|\|\||[-+*/%&|^<>=!:]=|<<|>>|.)",
    re.DOTALL,
)
#: A line that ends with one of these ends a statement.
_ENDING_WORDS = {"break", "continue", "fallthrough", "return"}
_KEYWORDS = _ENDING_WORDS | set("case chan const default defer else for func go goto if import interface map package range select struct switch type var".split())
_OPEN = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Token:
    kind: str
    text: str
    line: int
    col: int
    end_line: int
    end_col: int


class SyntaxProblem(Exception):
    pass


@dataclass
class Result:
    package: str = ""
    imports: list[tuple[str, str]] = field(default_factory=list)
    symbols: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def _lex(text: str) -> tuple[list[Token], dict[int, str], list[str]]:
    """Tokens with statement ends put in, comment groups by the line they end on, problems."""
    out, comments, problems = [], {}, []
    line, start, group, group_end = 1, 0, "", -1
    width = lambda a, b: len(text[a:b].encode())

    def end_statement() -> None:
        last = out[-1] if out else None
        if last and (last.kind in ("string", "number") or last.text in (")", "]", "}", "++", "--") or last.kind == "name" and (last.text not in _KEYWORDS or last.text in _ENDING_WORDS)):
            out.append(Token("op", ";", line, 0, last.end_line, last.end_col))

    for m in _TOKEN.finditer(text):
        kind, s = m.lastgroup, m.group()
        col = 1 + width(start, m.start())
        if kind == "newline":
            end_statement()
            line, start = line + 1, m.end()
            continue
        if kind == "space":
            continue
        first, n = line, s.count("\n")
        if n:
            line, start = line + n, m.start() + s.rindex("\n") + 1
        if kind == "comment":
            if n:
                end_statement()
            body = re.sub(r"^// ?", "", s) if s.startswith("//") else s[2:-2]
            group = f"{group}\n{body}" if group and group_end == first - 1 and not (out and out[-1].end_line == first) else body
            group_end = line
            if not (out and out[-1].end_line == first):  # not behind code on its line
                comments[line] = group
            continue
        if kind == "op" and s in "\"'`":
            problems.append(f"{first}:{col}: literal not terminated")
            stop = text.find("\n", m.start())
            kind, s = "string", text[m.start() : stop if stop >= 0 else len(text)]
        out.append(Token(kind, s, first, col, line, 1 + width(start, m.start() + len(s))))
        group = ""
    end_statement()
    out.append(Token("end", "", line, 1, line, 1))
    return out, comments, problems


class _Parser:
    def __init__(self, text: str):
        self.toks, self.comments, problems = _lex(text)
        self.k, self.out = 0, Result(errors=problems)

    @property
    def tok(self) -> Token:
        return self.toks[self.k]

    def ahead(self, n: int = 1) -> Token:
        return self.toks[min(self.k + n, len(self.toks) - 1)]

    def at(self, *texts: str) -> bool:
        return self.tok.kind != "string" and self.tok.text in texts

    def take(self, text: str | None = None) -> Token:
        t = self.tok
        if t.kind == "end" or text is not None and (t.text != text or t.kind == "string"):
            raise SyntaxProblem(f"{t.line}:{t.col}: expected {text or 'more'}, found {t.text or 'end of file'}")
        self.k += 1
        return t

    def name(self) -> Token:
        if self.tok.kind != "name" or self.tok.text in _KEYWORDS:
            raise SyntaxProblem(f"{self.tok.line}:{self.tok.col}: expected a name, found {self.tok.text or 'end of file'}")
        return self.take()

    def skip_group(self) -> int:
        """Over a bracketed group; the place after it."""
        stack = [_OPEN[self.take().text]]
        while stack:
            t = self.take()
            if t.kind == "string":
                continue
            if t.text in _OPEN:
                stack.append(_OPEN[t.text])
            elif t.text in _OPEN.values() and t.text != stack.pop():
                raise SyntaxProblem(f"{t.line}:{t.col}: unexpected {t.text}")
        return self.k

    def after_group(self, k: int) -> Token:
        """The token behind the group that opens at k."""
        held, self.k = self.k, k
        try:
            return self.toks[self.skip_group()]
        finally:
            self.k = held

    def type(self) -> str:
        t = self.tok
        if t.kind == "name" and t.text not in _KEYWORDS:
            out = self.take().text
            if self.at("."):
                self.take()
                out += "." + self.name().text
            if self.at("["):
                self.skip_group()
                return "..."
            return out
        if self.at("*"):
            self.take()
            return "*" + self.type()
        if self.at("["):
            self.skip_group()
            return "[]" + self.type()
        if self.at("..."):
            self.take()
            return "..." + self.type()
        if self.at("<-", "chan"):
            while self.at("<-", "chan"):
                self.take()
            return "chan " + self.type()
        if self.at("map"):
            self.take()
            self.take("[")
            key = self.type()
            self.take("]")
            return f"map[{key}]{self.type()}"
        if self.at("func"):
            self.take()
            self.fields()
            self.results()
            return "func(...)"
        if self.at("interface", "struct"):
            word = self.take().text
            self.skip_group() if self.at("{") else self.take("{")
            return "interface{}" if word == "interface" else "..."
        if self.at("("):
            self.skip_group()
            return "..."
        raise SyntaxProblem(f"{t.line}:{t.col}: expected a type, found {t.text or 'end of file'}")

    def named(self) -> bool:
        """Whether a name with a type of its own stands here, as against a type."""
        if self.tok.kind != "name" or self.tok.text in _KEYWORDS:
            return False
        nxt = self.ahead()
        if nxt.text == "[" and nxt.kind == "op":
            return self.after_group(self.k + 1).text not in (",", ")", ";", "}") or self.ahead(2).text == "]"
        return nxt.kind == "name" or nxt.kind == "op" and nxt.text in ("*", "...", "<-", "(")

    def fields(self) -> list[tuple[str, str]]:
        """(name or '', type) of a parenthesized list."""
        self.take("(")
        entries: list[tuple[str, str | None]] = []
        while not self.at(")"):
            if self.named():
                entries.append((self.take().text, self.type()))
            else:
                entries.append(("", self.type()))
            if not self.at(")"):
                self.take(",")
            while self.at(";"):
                self.take()
        self.take(")")
        if any(n for n, _ in entries):  # then a lone word is a name that shares the type of the next
            kind = ""
            for k in range(len(entries) - 1, -1, -1):
                n, t = entries[k]
                kind = t if n else kind
                entries[k] = (n or t, kind)
        return entries

    def results(self) -> list[tuple[str, str]]:
        if self.at("("):
            return self.fields()
        if self.at("{", ";", ")", ",", "}", "]", "=", ":=", ":", "") or self.tok.kind in ("string", "end"):
            return []
        return [("", self.type())]

    def add(self, name: str, kind: str, signature: str, first: Token, doc: str = "", receiver: str = "") -> None:
        last = self.toks[self.k - 1]
        self.out.symbols.append({
            "name": name, "kind": kind, "signature": signature, "doc_comment": doc.strip(), "receiver": receiver,
            "start_line": first.line, "start_col": first.col, "end_line": last.end_line, "end_col": last.end_col,
        })

    def function(self, doc: str) -> None:
        first, receiver, prefix = self.take("func"), "", "func "
        method = self.at("(")
        if method:
            kind = (self.fields() or [("", "")])[0][1]
            prefix += f"({kind}) "
            bare = kind[1:] if kind.startswith("*") else kind
            receiver = bare if re.fullmatch(r"\w+", bare) else ""
        name = self.name().text
        if self.at("["):
            self.skip_group()
        show = lambda fs: ", ".join(f"{n} {t}" if n else t for n, t in fs)
        signature = f"{prefix}{name}({show(self.fields())})"
        results = self.results()
        if results:
            signature += f" ({show(results)})" if len(results) > 1 else f" {show(results)}"
        body = self.k
        if self.at("{"):
            self.skip_group()
        self.add(name, "method" if method else "function", signature, first, doc, receiver)
        end = self.k
        for k in range(body, end):  # declarations inside the body
            t = self.toks[k]
            if t.kind == "name" and t.text in ("type", "const", "var") and self.toks[k - 1].text != "(":
                self.k = k
                self.general(self.doc_of(t))
        self.k = end

    def general(self, doc: str) -> None:
        word = self.take().text
        spec = {"import": self.import_spec, "type": self.type_spec, "const": self.value_spec, "var": self.value_spec}[word]
        if not self.at("("):
            spec(word, doc)
            return
        self.take("(")
        while not self.at(")"):
            if self.at(";"):
                self.take()
            else:
                spec(word, doc)
        self.take(")")

    def import_spec(self, word: str, doc: str) -> None:
        alias = self.take().text if self.tok.kind == "name" or self.at(".") else ""
        path = self.take()
        if path.kind != "string":
            raise SyntaxProblem(f"{path.line}:{path.col}: expected an import path")
        self.out.imports.append((path.text.strip('"'), alias))

    def type_spec(self, word: str, doc: str) -> None:
        first = self.name()
        if self.at("[") and self.ahead().kind == "name" and self.ahead(2).text != "]":
            self.skip_group()
        if self.at("="):
            self.take()
        if self.at("struct"):
            self.struct(first, doc)
        elif self.at("interface"):
            self.take()
            start = self.k
            self.skip_group()
            self.add(first.text, "interface", f"type {first.text} interface {{ ... }} // {self.entries(start)} methods", first, doc)
        else:
            self.type()
            self.add(first.text, "type", f"type {first.text}", first, doc)

    def entries(self, start: int) -> int:
        depth, n, fresh = 0, 0, True
        for t in self.toks[start : self.k]:
            opens, closes = t.kind == "op" and t.text in _OPEN, t.kind == "op" and t.text in _OPEN.values()
            if depth == 1 and t.text == ";":
                fresh = True
            elif depth == 1 and fresh and not closes:
                n, fresh = n + 1, False
            depth += opens - closes
        return n

    def struct(self, first: Token, doc: str) -> None:
        self.take("struct")
        self.take("{")
        found, count, problem = [], 0, None
        try:
            while not self.at("}"):
                if self.at(";"):
                    self.take()
                    continue
                start, names = self.tok, []
                if self.named() or self.tok.kind == "name" and self.ahead().text == ",":
                    names.append(self.name())
                    while self.at(","):
                        self.take()
                        names.append(self.name())
                kind = self.type()
                if self.tok.kind == "string":
                    self.take()
                end = self.toks[self.k - 1]
                if not self.at(";", "}"):
                    raise SyntaxProblem(f"{self.tok.line}:{self.tok.col}: unexpected {self.tok.text or 'end of file'}")
                count += max(1, len(names))
                found += [(n.text, kind, start, end) for n in names]
            self.take("}")
        except SyntaxProblem as e:
            problem = e
        self.add(first.text, "struct", f"type {first.text} struct {{ ... }} // {count} fields", first, doc)
        for name, kind, start, end in found:
            self.out.symbols.append({"name": name, "kind": "field", "signature": f"{name} {kind}", "doc_comment": "", "receiver": first.text, "start_line": start.line, "start_col": start.col, "end_line": end.end_line, "end_col": end.end_col})
        if problem:
            raise problem

    def value_spec(self, word: str, doc: str) -> None:
        names = [self.name()]
        while self.at(","):
            self.take()
            names.append(self.name())
        kind, valued = "", False
        if not self.at("=", ";", ")"):
            kind = self.type()
        if self.at("="):
            valued = True
            while not self.at(";", ")", "") and self.tok.kind != "end":
                self.skip_group() if self.tok.kind == "op" and self.tok.text in _OPEN else self.take()
        for n in names:
            self.add(n.text, word, f"{n.text} {kind}" if kind else f"{n.text} = ..." if valued else n.text, names[0], doc)

    def doc_of(self, t: Token) -> str:
        return self.comments.get(t.line - 1, "")

    def run(self) -> Result:
        try:
            self.take("package")
            self.out.package = self.name().text
        except SyntaxProblem as e:
            self.out.errors.append(str(e))
        while self.tok.kind != "end":
            t = self.tok
            try:
                if self.at(";"):
                    self.take()
                elif self.at("func"):
                    self.function(self.doc_of(t))
                elif self.at("import", "type", "const", "var"):
                    self.general(self.doc_of(t))
                else:
                    raise SyntaxProblem(f"{t.line}:{t.col}: unexpected {t.text}")
            except SyntaxProblem as e:
                self.out.errors.append(str(e))
                self.k = max(self.k, self.toks.index(t) + 1)
                while self.tok.kind != "end" and not (self.tok.col == 1 and self.at("func", "type", "const", "var", "import")):
                    self.k += 1
        self.out.errors = [f"syntax error: {e}" for e in self.out.errors[:1]]
        return self.out


def parse_go(text: str) -> Result:
    """Package, imports (path, alias), symbols and at most one error; a text never fails as a whole."""
    return _Parser(text).run()
