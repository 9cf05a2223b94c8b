"""Definitions and raw edges of one JavaScript or TypeScript file, from its tokens.

There is no grammar here: a scanner knows strings, templates, comments and regular
expressions, brackets are matched, and definitions are recognised by how they begin.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

FILE_BODY, BODY = 16_000, 5_000
_TOKEN = re.compile(r"""(?P<blank>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<id>[A-Za-z_$#][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|\.\.\.|\?\.|[=!]==?|[<>]=|&&|\|\||\?\?|\+\+|--|.)""", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_BLANK = re.compile(r"\s+")
#: After these, a slash begins a regular expression.
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%<>~^") | {"=>", "==", "===", "!=", "!==", "&&", "||", "??", "return", "typeof", "case", "in", "of", "void", "delete", "throw", "new"}
KEYWORDS = set("if for while switch catch return typeof function class new delete void in of do else try finally throw await yield super import export default case with const let var async static get set this null true false".split())


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


def _template(source: str, at: int) -> int:
    """The end of a template that begins at a backtick; what it interpolates is skipped with it."""
    at += 1
    while at < len(source):
        if source[at] == "\\":
            at += 2
        elif source[at] == "`":
            return at + 1
        elif source.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(source) and depth:
                if source[at] == "`":
                    at = _template(source, at)
                    continue
                depth += {"{": 1, "}": -1}.get(source[at], 0)
                at += 1
        else:
            at += 1
    return at


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(source):
        c = source[at]
        if c == "`":
            end = _template(source, at)
            out.append(Token("str", source[at:end], at, end))
            at = end
            continue
        if c == "/" and source[at + 1 : at + 2] not in ("/", "*") and (not out or out[-1].text in _BEFORE_REGEX) and (m := _REGEX.match(source, at)):
            out.append(Token("str", m[0], at, m.end()))
            at = m.end()
            continue
        m = _TOKEN.match(source, at)
        if m.lastgroup != "blank":
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    return out


def _brackets(ts: list[Token]) -> dict[int, int]:
    """Index of each opening bracket's closing one; unclosed ones close at the end."""
    out, stack = {}, []
    for i, t in enumerate(ts):
        if t.kind == "op" and t.text in "([{":
            stack.append(i)
        elif t.kind == "op" and t.text in ")]}" and stack:
            out[stack.pop()] = i
    return out | {i: len(ts) - 1 for i in stack}


class _Scan:
    def __init__(self, path: str, source: str):
        self.path, self.source, self.ts = path, source, tokens(source)
        self.close, self.count = _brackets(self.ts), len(self.ts)
        self.ts += [Token("end", "", len(source), len(source))] * 16  # a cut-off construct looks ahead into these
        self.lines = [m.start() for m in re.finditer("\n", source)]
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.taken: dict[str, int] = {}
        n = source.count("\n") + 1
        self.nodes.append(self._row(path, path.rsplit("/", 1)[-1], "file", 1, n, source, None, None, True) | {"chars": len(source.encode("utf-16-le")) // 2})
        self.body(0, self.count, path, "", None, False)
        covered, done = bytearray(n + 2), 0
        for a, b in sorted((x["start_line"], x["end_line"]) for x in self.nodes[1:]):
            a = max(a, done + 1)
            if b >= a:
                covered[a : b + 1] = b"\1" * (b + 1 - a)
                done = b
        left = [x for i, x in enumerate(source.split("\n"), 1) if not covered[i]]
        self.nodes[0]["body"] = _BLANK.sub(" ", "\n".join(left)).strip()[:FILE_BODY]

    def _line(self, at: int) -> int:
        lo, hi = 0, len(self.lines)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.lines[mid] < at else (lo, mid)
        return lo + 1

    def _row(self, ident, name, kind, a, b, text, signature, owner, exported) -> dict:
        return {"id": ident, "name": name, "kind": kind, "path": self.path, "start_line": a, "end_line": b, "body_hash": hashlib.sha256(text.encode()).hexdigest(), "owner": owner, "signature": signature, "exported": exported, "origin": "ast", "chars": None, "body": _BLANK.sub(" ", text).strip()[:BODY]}

    def text(self, i: int) -> str:
        return self.ts[i].text if 0 <= i < self.count else ""

    def edge(self, source: str, relation: str, **more) -> None:
        self.edges.append({"source": source, "relation": relation, "file": self.path, **more, "seq": len(self.edges)})

    def define(self, name: str, kind: str, first: int, last: int, body: int, parent: str, scope: str, owner: str | None, exported: bool) -> tuple[str, str]:
        """A node of tokens first to last, its header up to body; its id and scope."""
        base = f"{self.path}#{scope + '.' if scope else ''}{name}"
        n = self.taken[base] = self.taken.get(base, 0) + 1
        ident = base if n == 1 else f"{base}~{n}"
        last = max(first, min(last, self.count - 1))
        a, b = self.ts[first].start, self.ts[last].end
        header = _BLANK.sub(" ", self.source[a : self.ts[body].start if body <= last else b]).strip()
        header = re.sub(r"\s*(=>|[{:=])$", "", header)
        self.nodes.append(self._row(ident, name, kind, self._line(a), self._line(b - 1), self.source[a:b], header, owner, exported))
        self.edge(parent, "contains", target_id=ident)
        return ident, f"{scope}.{name}" if scope else name

    def function_at(self, i: int) -> tuple[int, int] | None:
        """Of a function expression that begins at i: its body's first token and its last token."""
        i += self.text(i) == "async"
        if self.text(i) == "function":
            i += 1 + (self.text(i + 1) == "*")
            i += self.ts[i].kind == "id" if i < self.count else 0
            if self.text(i) == "(" and self.text(b := self.close[i] + 1) == "{":
                return b, self.close[b]
            return None
        if self.text(i) == "(" and self.text(self.close[i] + 1) == "=>":
            b = self.close[i] + 2
        elif i < self.count and self.ts[i].kind == "id" and self.text(i + 1) == "=>":
            b = i + 2
        else:
            return None
        if self.text(b) == "{":
            return b, self.close[b]
        return b, self.expression_end(b)

    def expression_end(self, i: int) -> int:
        last = i
        while i < self.count and self.ts[i].text not in (",", ";", ")", "]", "}"):
            if i > last and self.source.count("\n", self.ts[last].end, self.ts[i].start) and self.ts[last].text not in _BEFORE_REGEX and self.ts[i].text not in (".", "?.", "?", ":", "+", "-", "*", "/", "&&", "||", "??", "=", "==="):
                break
            last = self.close.get(i, i)
            i = last + 1
        return last

    def body(self, i: int, end: int, parent: str, scope: str, owner: str | None, exported: bool) -> None:
        """Statements and expressions from i to end."""
        public = False
        while i < end:
            t, word = self.ts[i], self.text(i)
            before = self.text(i - 1)
            if t.kind == "id" and before not in (".", "?."):
                if word == "export":
                    public, i = True, i + 1 + (self.text(i + 1) == "default")
                    continue
                jump = self.statement(i, end, parent, scope, owner, public)
                if jump is not None:
                    i, public = jump, False
                    continue
            if t.kind == "id" and word not in KEYWORDS and self.text(i + 1) == "(" and before != "new" and before != "function":
                if before in (".", "?."):
                    held = self.text(i - 2)
                    if self.ts[i - 2].kind == "id" and self.text(i - 3) not in (".", "?."):
                        self.edge(parent, "calls", name=word, via_member=held)
                    elif self.text(i - 2) in ("this",):
                        self.edge(parent, "calls", name=word, via_member="this")
                else:
                    self.edge(parent, "calls", name=word)
            if word in (";", "}"):
                public = False
            i += 1

    def statement(self, i: int, end: int, parent: str, scope: str, owner: str | None, public: bool) -> int | None:
        """Where to go on after a construct that begins at i; None if none does."""
        word = self.text(i)
        top = parent == self.path
        if word == "import" and self.text(i + 1) != "(" and top:
            return self.imports(i)
        if word == "class" and i + 1 < self.count and self.ts[i + 1].kind == "id" and self.text(i + 1) not in ("extends",):
            return self.klass(i, self.text(i + 1), i, parent, scope, public)
        k = i + (word == "async" and self.text(i + 1) == "function")
        if self.text(k) == "function":
            n = k + 1 + (self.text(k + 1) == "*")
            found = self.function_at(i)
            if found and self.ts[n].kind == "id":
                return self.enter(self.text(n), "function", i, found, parent, scope, owner, public)
            return None
        if word in ("const", "let", "var"):
            return self.binding(i, parent, scope, owner, public, top)
        return self.member(i, parent, scope)

    def enter(self, name: str, kind: str, first: int, found: tuple[int, int], parent: str, scope: str, owner: str | None, public: bool) -> int:
        b, last = found
        ident, inner = self.define(name, kind, first, last, b, parent, scope, owner, public)
        self.body(b, last + 1, ident, inner, owner, False)
        return last + 1

    def klass(self, first: int, name: str, at: int, parent: str, scope: str, public: bool) -> int | None:
        i = at + 1 + (self.text(at + 1) == name)
        base = None
        while i < self.count and self.text(i) != "{":
            if self.text(i) == "extends" and self.ts[i + 1].kind == "id" and self.text(i + 2) not in (".", "("):
                base = self.text(i + 1)
            i = self.close.get(i, i) + 1
        if i >= self.count:
            return None
        last = self.close[i]
        ident, inner = self.define(name, "class", first, last, i, parent, scope, None, public)
        if base:
            self.edge(ident, "extends", name=base)
        j = i + 1
        while j < last:
            start = j
            while self.text(j) in ("static", "async", "get", "set", "*", "readonly", "public", "private", "protected") and self.text(j + 1) not in ("(", "="):
                j += 1
            if self.ts[j].kind == "id" and self.text(j + 1) == "(" and self.text(j + 1):
                b = self.close[j + 1] + 1
                while b < last and self.text(b) not in ("{", ";"):
                    b = self.close.get(b, b) + 1
                if self.text(b) == "{":
                    j = self.enter(self.text(j), "method", start, (b, self.close[b]), ident, inner, name, True)
                    continue
            if self.ts[j].kind == "id" and self.text(j + 1) == "=" and (found := self.function_at(j + 2)):
                j = self.enter(self.text(j), "method", start, found, ident, inner, name, True)
                continue
            j = self.close.get(j, j) + 1
        return last + 1

    def binding(self, i: int, parent: str, scope: str, owner: str | None, public: bool, top: bool) -> int | None:
        n = i + 1
        is_name = n < self.count and self.ts[n].kind == "id"
        value = n + 2 if is_name else self.close.get(n, n) + 2
        if self.text(value - 1) != "=":
            return None
        if self.text(value) == "require" and self.text(value + 1) == "(" and value + 3 < self.count and self.ts[value + 2].kind == "str" and self.close[value + 1] == value + 3:
            spec, local = self.text(value + 2)[1:-1], None if top else parent
            self.edge(parent, "imports", specifier=spec, scope_id=local)
            if is_name:
                self.edge(parent, "imports", specifier=spec, name=self.text(n), imported_name="*", scope_id=local)
            else:
                self.names(n + 1, self.close[n], spec, local, parent, ":")
            if is_name and top:
                self.define(self.text(n), "constant" if self.text(i) == "const" else "variable", i, value + 3, value + 9, parent, scope, None, public)
            return value + 4
        if not is_name:
            return None
        if found := self.function_at(value):
            return self.enter(self.text(n), "function", n, found, parent, scope, owner, public)
        if self.text(value) == "class":
            return self.klass(n, self.text(n), value, parent, scope, public)
        if top:
            last = self.expression_end(value)
            self.define(self.text(n), "constant" if self.text(i) == "const" else "variable", i, last, last + 9, parent, scope, None, public)
            return value
        return None

    def member(self, i: int, parent: str, scope: str) -> int | None:
        """a.b = function, X.prototype.m = function, exports.x = function."""
        if self.text(i) in KEYWORDS or self.text(i + 1) != ".":
            return None
        chain, k = [self.text(i)], i
        while self.text(k + 1) == "." and k + 2 < self.count and self.ts[k + 2].kind == "id":
            k += 2
            chain.append(self.text(k))
        if self.text(k + 1) != "=" or not (found := self.function_at(k + 2)) or chain[-1] == "prototype":
            return None
        head = chain[:-1]
        if head in (["exports"], ["module", "exports"]):
            return self.enter(chain[-1], "function", i, found, parent, scope, None, True)
        if len(head) == 2 and head[1] == "prototype":
            head = head[:1]
        if len(head) != 1:
            return None
        inner = f"{scope}.{head[0]}" if scope else head[0]
        return self.enter(chain[-1], "method", i, found, parent, inner, head[0], False)

    def names(self, i: int, end: int, spec: str, local: str | None, parent: str, alias: str) -> None:
        while i < end:
            if self.ts[i].kind == "id" and self.text(i) != "type":
                name, known = self.text(i), self.text(i)
                if self.text(i + 1) == alias and self.ts[i + 2].kind == "id":
                    known, i = self.text(i + 2), i + 2
                self.edge(parent, "imports", specifier=spec, name=known, imported_name=name, scope_id=local)
            i += 1

    def imports(self, i: int) -> int:
        j = i + 1
        while j < self.count and self.ts[j].kind != "str" and self.text(j) != ";":
            j = self.close.get(j, j) + 1
        if j >= self.count or self.ts[j].kind != "str":
            return i + 1
        spec = self.text(j)[1:-1]
        self.edge(self.path, "imports", specifier=spec, scope_id=None)
        k = i + 1
        while k < j:
            if self.text(k) == "{":
                self.names(k + 1, self.close[k], spec, None, self.path, "as")
                k = self.close[k]
            elif self.text(k) == "*" and self.text(k + 1) == "as":
                self.edge(self.path, "imports", specifier=spec, name=self.text(k + 2), imported_name="*", scope_id=None)
                k += 2
            elif self.ts[k].kind == "id" and self.text(k) not in ("from", "type"):
                self.edge(self.path, "imports", specifier=spec, name=self.text(k), imported_name="default", scope_id=None)
            k += 1
        return j + 1


def extract(path: str, source: str) -> tuple[list[dict], list[dict]]:
    s = _Scan(path, source)
    return s.nodes, s.edges
