"""Definitions and raw edges of one Python file, from its syntax tree."""

from __future__ import annotations

import ast
import hashlib
import re

FILE_BODY, BODY = 16_000, 5_000
_BLANK = re.compile(r"\s+")
_LINE_END = re.compile(rb"\r\n|\r|\n")
_TYPE = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*")


def _flat(text: str, limit: int) -> str:
    return _BLANK.sub(" ", text).strip()[:limit]


class _Walk:
    def __init__(self, path: str, source: str, tree: ast.Module):
        self.path, self.source = path, source
        self.raw = source.encode()
        self.starts = [0, *(m.end() for m in _LINE_END.finditer(self.raw))]
        self.lines = _LINE_END.split(self.raw)
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.taken: dict[str, int] = {}
        self.parent, self.scope, self.owner, self.types = path, "", None, {}
        self.in_class = False
        self.local: str | None = None  # id of the innermost function
        self._file(tree)
        self._bindings(tree)
        for child in tree.body:
            self.visit(child)
        self._residual()

    def _slice(self, node: ast.AST) -> str:
        a = self.starts[node.lineno - 1] + node.col_offset
        return self.raw[a : self.starts[node.end_lineno - 1] + node.end_col_offset].decode()

    def _mint(self, name: str) -> str:
        base = f"{self.path}#{self.scope + '.' if self.scope else ''}{name}"
        n = self.taken[base] = self.taken.get(base, 0) + 1
        return base if n == 1 else f"{base}~{n}"

    def _edge(self, relation: str, **more) -> None:
        self.edges.append({"source": self.parent, "relation": relation, "file": self.path, **more, "seq": len(self.edges)})

    def _node(self, ident: str, name: str, kind: str, node: ast.AST, body: str, signature: str | None, owner: str | None) -> None:
        self.nodes.append({
            "id": ident, "name": name, "kind": kind, "path": self.path, "start_line": node.lineno, "end_line": node.end_lineno, "body_hash": hashlib.sha256(body.encode()).hexdigest(), "owner": owner, "signature": signature,
            "exported": not name.startswith("_"), "origin": "ast", "chars": None, "body": _flat(body, BODY),
        })
        self._edge("contains", target_id=ident)

    def _file(self, tree: ast.Module) -> None:
        self.nodes.append({
            "id": self.path, "name": self.path.rsplit("/", 1)[-1], "kind": "file", "path": self.path, "start_line": 1, "end_line": len(self.lines), "body_hash": hashlib.sha256(self.raw).hexdigest(), "owner": None, "signature": None,
            "exported": True, "origin": "ast", "chars": len(self.source.encode("utf-16-le")) // 2, "body": None,
        })

    def _residual(self) -> None:
        covered = bytearray(len(self.lines) + 2)
        done = 0
        for a, b in sorted((n["start_line"], n["end_line"]) for n in self.nodes[1:]):
            a = max(a, done + 1)
            if b >= a:
                covered[a : b + 1] = b"\1" * (b + 1 - a)
                done = b
        left = [x.decode() for i, x in enumerate(self.lines, 1) if not covered[i]]
        self.nodes[0]["body"] = _flat("\n".join(left), FILE_BODY)

    def _bindings(self, tree: ast.Module) -> None:
        seen = set()
        for s in tree.body:
            targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []
            for t in targets:
                if isinstance(t, ast.Name) and t.id not in seen:
                    seen.add(t.id)
                    text = self._slice(s)
                    self._node(self._mint(t.id), t.id, "constant" if t.id.upper() == t.id and any(c.isalpha() for c in t.id) else "variable", s, text, _flat(text.split("\n")[0], 200), None)

    # Definitions

    def _define(self, node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        is_class = isinstance(node, ast.ClassDef)
        kind = "class" if is_class else "method" if self.in_class else "function"
        ident, text = self._mint(node.name), self._slice(node)
        first = node.body[0]
        at = self.starts[first.lineno - 1] + first.col_offset
        begin = self.starts[node.lineno - 1] + node.col_offset
        header = _flat(self.raw[begin:at].decode(), 10_000)
        header = re.sub(r"\s*#[^\"']*$", "", header)
        self._node(ident, node.name, kind, node, text, header.rstrip(":").rstrip(), self.owner if kind == "method" else None)
        for d in node.decorator_list:
            self.visit(d)
        kept = (self.parent, self.scope, self.owner, self.types, self.in_class, self.local)
        self.parent = ident
        if is_class:
            for b in node.bases:
                if isinstance(b, ast.Name):
                    self._edge("extends", name=b.id)
                self.visit(b)
        self.scope, self.in_class = f"{self.scope}.{node.name}" if self.scope else node.name, is_class
        if is_class:
            self.owner = node.name
        else:
            self.local, self.types = ident, self._receivers(node)
        for child in node.body:
            self.visit(child)
        self.parent, self.scope, self.owner, self.types, self.in_class, self.local = kept

    def visit(self, top: ast.AST) -> None:
        """Definitions, imports and calls below a node, in the order of the text; expressions of any depth."""
        stack = [top]
        while stack:
            node = stack.pop()
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                self._define(node)
                continue
            if isinstance(node, ast.Import):
                self._import(node)
            elif isinstance(node, ast.ImportFrom):
                self._import_from(node)
            elif isinstance(node, ast.Call):
                self._call(node)
            stack += reversed(list(ast.iter_child_nodes(node)))

    # Receivers' types: an annotation or one constructor call; any other binding of the name removes it.

    def _annotation(self, node: ast.expr | None) -> str | None:
        if node is None:
            return None
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            try:
                node = ast.parse(node.value, mode="eval").body
            except SyntaxError:
                return None
        if isinstance(node, ast.Subscript) and ast.unparse(node.value).split(".")[-1] == "Optional":
            return self._annotation(node.slice)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
            sides = [x for x in (node.left, node.right) if not (isinstance(x, ast.Constant) and x.value is None)]
            return self._annotation(sides[0]) if len(sides) == 1 else None
        if isinstance(node, (ast.Name, ast.Attribute)):
            text = ast.unparse(node)
            return text.split(".")[-1] if _TYPE.fullmatch(text) else None
        return None

    def _receivers(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> dict[str, str]:
        """Types of names that a function binds in one way only: by an annotation, or by calling a name in upper case."""
        found: dict[str, set[str | None]] = {}

        def bind(name: str | None, kind: str | None = None) -> None:
            if name:
                found.setdefault(name, set()).add(kind)

        a = node.args
        for arg in [*a.posonlyargs, *a.args, *a.kwonlyargs]:
            if arg.arg not in ("self", "cls"):
                bind(arg.arg, self._annotation(arg.annotation))
        for arg in (a.vararg, a.kwarg):
            bind(arg.arg if arg else None)
        stack: list[ast.AST] = list(node.body)
        while stack:
            s = stack.pop()
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                bind(s.name)
                continue
            if isinstance(s, ast.Lambda):
                continue
            typed = None
            if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
                typed = s.target
                bind(typed.id, self._annotation(s.annotation))
            elif isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name):
                typed, made = s.targets[0], s.value.func if isinstance(s.value, ast.Call) else None
                bind(typed.id, made.id if isinstance(made, ast.Name) and made.id[:1].isupper() else None)
            elif isinstance(s, ast.Name) and not isinstance(s.ctx, ast.Load):
                bind(s.id)
            elif isinstance(s, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)):
                bind(s.name)
            elif isinstance(s, ast.MatchMapping):
                bind(s.rest)
            elif isinstance(s, (ast.Import, ast.ImportFrom)):
                for x in s.names:
                    bind((x.asname or x.name).split(".")[0])
            elif isinstance(s, (ast.Global, ast.Nonlocal)):
                for x in s.names:
                    bind(x)
            stack += [c for c in ast.iter_child_nodes(s) if c is not typed]
        return {k: next(iter(v)) for k, v in found.items() if len(v) == 1 and None not in v}

    # Imports and calls

    def _import(self, node: ast.Import) -> None:
        for a in node.names:
            self._edge("imports", specifier=a.name, scope_id=self.local)
            self._edge("imports", specifier=a.name if a.asname else a.name, name=a.asname or a.name, imported_name="*", scope_id=self.local)

    def _import_from(self, node: ast.ImportFrom) -> None:
        spec = "." * node.level + (node.module or "")
        self._edge("imports", specifier=spec, scope_id=self.local)
        for a in node.names:
            if a.name != "*":
                self._edge("imports", specifier=spec, name=a.asname or a.name, imported_name=a.name, scope_id=self.local)

    def _call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            self._edge("calls", name=f.id)
        elif isinstance(f, ast.Attribute):
            held = _dotted(f.value)
            if held:
                self._edge("calls", name=f.attr, via_member=held, recv_type=self.types.get(held))


def _dotted(node: ast.expr) -> str | None:
    """a.b.c of names and attributes; None of other expressions below an attribute's value."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    return ".".join([node.id, *reversed(names)])


def extract(path: str, source: str) -> tuple[list[dict], list[dict]]:
    """Nodes and raw edges of a file; of a file that can't be parsed or walked, the file node alone."""
    source = source.removeprefix("\ufeff")
    try:
        w = _Walk(path, source, ast.parse(source))
    except (SyntaxError, ValueError, RecursionError, MemoryError, UnicodeError, IndexError):
        w = _Walk(path, source, ast.Module([], []))
    return w.nodes, w.edges
