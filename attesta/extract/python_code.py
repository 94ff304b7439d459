"""Python source to declarations, occurrences and name scopes, by the standard library's parser.

Spans are UTF-8 byte offsets [start, end) of the file as it is, a byte order
mark included; lines count from 1.  A file that doesn't parse gives one
diagnostic and nothing else: bad input is data.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

TEST_PREFIX = "test"
_NEWLINE = re.compile(rb"\n")
RECORDS = ("symbols", "occurrences", "bindings", "diagnostics")


@dataclass
class Extraction:
    symbols: list[dict] = field(default_factory=list)
    occurrences: list[dict] = field(default_factory=list)
    bindings: list[dict] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)


class _Text:
    def __init__(self, content: bytes) -> None:
        self.bom = 3 if content.startswith(b"\xef\xbb\xbf") else 0
        self.content = content
        self.starts = [0, *(m.end() - self.bom for m in _NEWLINE.finditer(content, self.bom))]

    def at(self, line: int, column: int) -> int:
        return self.bom + self.starts[line - 1] + column

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def line(self, offset: int) -> int:
        return max(1, bisect_right(self.starts, offset - self.bom))


def _dotted(node: ast.AST | None) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else None
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    return None


def _last(name: str | None) -> str | None:
    return name.rsplit(".", 1)[-1] if name else None


def _stores(node: ast.AST) -> list[str]:
    """The names that are written anywhere below a node."""
    found, stack = [], [node]
    while stack:
        n = stack.pop()
        of = n.__class__
        if of is ast.Name:
            if n.ctx.__class__ is ast.Store:
                found.append(n.id)
        elif of is not ast.Constant:
            for v in n.__dict__.values():
                if v.__class__ is list:
                    stack += [x for x in v if isinstance(x, ast.AST)]
                elif isinstance(v, ast.AST) and v._fields:
                    stack.append(v)
    return found


def _is_test(name: str, kind: str) -> bool:
    return kind in ("function", "method") and name.startswith(TEST_PREFIX) or kind == "class" and name.startswith("Test")


def _decorated(text: _Text, node: ast.AST) -> int | None:
    """Where the first decorator above a declaration begins, None if there is none."""
    first = min([node, *node.decorator_list], key=lambda n: n.lineno) if node.decorator_list else node
    return None if first is node else text.content.rfind(b"@", 0, text.span(first)[0])


def _nothing(*_: object) -> None:
    pass


#: What visits a node of each class, as far as any was seen.
_VISITORS: dict[type, Callable[[_Walker, ast.AST], None]] = {}


class _Walker(ast.NodeVisitor):
    def __init__(self, source_id: str, text: _Text, out: Extraction, names: tuple[str, ...] = RECORDS, kinds: frozenset[str] | None = None) -> None:
        self.source, self.text, self.out, self.wanted = source_id, text, out, kinds
        self.binds, self.observes = "bindings" in names, "occurrences" in names
        for name, record in (("symbols", "declare"), ("occurrences", "observe"), ("bindings", "bind")):
            if name not in names:
                setattr(self, record, _nothing)
        self.scope: list[str] = []
        self.kinds: list[str] = []
        self.types: list[dict[str, tuple[str, str] | None]] = [{}]

    def visit(self, node: ast.AST) -> None:
        of = node.__class__
        visitor = _VISITORS.get(of)
        if visitor is None:
            visitor = _VISITORS[of] = _nothing if of is ast.Constant or not of._fields else getattr(_Walker, f"visit_{of.__name__}", _Walker.generic_visit)
        if self.observes or not isinstance(node, ast.expr):  # expressions hold occurrences only
            visitor(self, node)

    def generic_visit(self, node: ast.AST) -> None:
        for f in node._fields:
            v = getattr(node, f, None)
            if v.__class__ is list:
                for x in v:
                    if isinstance(x, ast.AST):
                        self.visit(x)
            elif isinstance(v, ast.AST):
                self.visit(v)

    # -- records

    def declare(self, node: ast.AST, name: str, kind: str, start: int | None = None) -> None:
        s, e = self.text.span(node)
        s = s if start is None else start
        piece = self.text.content[s:e]
        self.out.symbols.append(
            {"id": f"{self.source}:{kind}:{s}:{e}", "source_id": self.source, "name": name, "qualified_name": ".".join([*self.scope, name]), "kind": kind,
             "is_test": _is_test(name, kind), "top_level": not self.scope,
             "start": s, "end": e, "start_line": self.text.line(s), "end_line": self.text.line(max(s, e - 1)), "sha256": hashlib.sha256(piece).hexdigest()}
        )

    def observe(self, node: ast.AST, kind: str, candidate: str | None = None, rule: str | None = None) -> None:
        if self.wanted is not None and kind not in self.wanted:
            return
        text = self.text
        s, e = text.bom + text.starts[node.lineno - 1] + node.col_offset, text.bom + text.starts[node.end_lineno - 1] + node.end_col_offset
        if e > s:
            self.out.occurrences.append({"id": f"{self.source}:{kind}:{s}:{e}", "source_id": self.source, "kind": kind, "start": s, "end": e, "line": node.lineno, "candidate": candidate, "rule": rule, "label": text.content[s:e].decode("utf-8", "replace")[:256]})

    def bind(self, scope: ast.AST | None, head: str, dotted: str | None) -> None:
        s, e = self.text.span(scope) if scope is not None else (0, len(self.text.content))
        self.out.bindings.append({"scope_source": self.source, "scope_start": s, "scope_end": e, "scope_line": self.text.line(s), "head": head, "dotted": dotted, "is_local": dotted is None})

    # -- declarations

    def _annotation(self, node: ast.AST | None, kind: str) -> None:
        if node is not None:
            for n in ast.walk(node):
                if isinstance(n, ast.Name | ast.Attribute) or isinstance(n, ast.Constant) and isinstance(n.value, str):
                    self.observe(n, kind, _last(_dotted(n)))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.declare(node, node.name, "class", _decorated(self.text, node))
        for d in node.decorator_list:
            self.visit(d)
        for b in node.bases:
            self.observe(b, "base_class", _last(_dotted(b)))
            self.visit(b)
        self._inside(node, node.name, "class", node.body)

    def _inside(self, node: ast.AST, name: str, kind: str, body: list[ast.stmt]) -> None:
        self.scope.append(name)
        self.kinds.append(kind)
        self.types.append({})
        for n in body:
            self.visit(n)
        self.types.pop()
        self.kinds.pop()
        self.scope.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        kind = "method" if self.kinds and self.kinds[-1] == "class" else "function"
        self.declare(node, node.name, kind, _decorated(self.text, node))
        for d in node.decorator_list:
            self.visit(d)
        a = node.args
        every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])] if self.observes or self.binds else ()
        own: dict[str, tuple[str, str] | None] = {}
        for p in every:
            self.observe(p, "keyword_parameter" if p in a.kwonlyargs else "parameter", p.arg)
            self._annotation(p.annotation, "type_reference")
            self.bind(node, p.arg, None)
            if p.annotation is not None and _dotted(p.annotation):
                own[p.arg] = (_last(_dotted(p.annotation)), "parameter")
        if kind == "method" and a.args:
            own[a.args[0].arg] = (self.scope[-1], "self")
        for n in [*a.defaults, *[x for x in a.kw_defaults if x is not None]]:
            self.visit(n)
        self._annotation(node.returns, "declared_return")
        for name in _stores(node) if self.binds else ():
            self.bind(node, name, None)
        self.scope.append(node.name)
        self.kinds.append(kind)
        self.types.append(own)
        for n in node.body:
            self.visit(n)
        self.types.pop()
        self.kinds.pop()
        self.scope.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    # -- imports

    def visit_Import(self, node: ast.Import) -> None:
        for n in node.names:
            self.bind(None, n.asname or n.name.split(".")[0], n.name if n.asname else n.name.split(".")[0])

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for n in node.names:
            self.bind(None, n.asname or n.name, "." * node.level + ".".join(x for x in (node.module, n.name) if x))

    # -- occurrences

    def _receiver_type(self, node: ast.AST) -> None:
        if isinstance(node, ast.Name):
            for scope in reversed(self.types):
                if node.id in scope:
                    if scope[node.id]:
                        self.observe(node, "receiver_type", *scope[node.id])
                    return

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        self.observe(node, "method_call_observed" if isinstance(f, ast.Attribute) else "call_observed", _last(_dotted(f)) if not isinstance(f, ast.Attribute) else f.attr)
        if isinstance(f, ast.Attribute):
            self._receiver_type(f.value)
            self.visit(f.value)
        elif not isinstance(f, ast.Name):
            self.visit(f)
        for k in node.keywords:
            if k.arg:
                self.observe(k, "keyword_argument", k.arg)
            self.visit(k.value)
        for x in node.args:
            self.visit(x)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self.observe(node, "attribute_access", node.attr)
        self._receiver_type(node.value)
        self.visit(node.value)

    def visit_Name(self, node: ast.Name) -> None:
        self.observe(node, "name_reference" if isinstance(node.ctx, ast.Load) else "name_write", node.id)

    def _assigned(self, target: ast.AST, value: ast.AST | None, annotation: ast.AST | None = None) -> None:
        if isinstance(target, ast.Name):
            kind = "field" if self.kinds and self.kinds[-1] == "class" else "variable" if not self.scope else None
            if kind:
                self.declare(target, target.id, kind)
            elif isinstance(value, ast.List | ast.ListComp):
                self.observe(target, "list_binding", target.id)
            else:
                self.observe(target, "local_binding", target.id)
            made = (_last(_dotted(annotation)), "annotation") if annotation is not None else (_last(_dotted(value.func)), "constructor") if isinstance(value, ast.Call) and (_last(_dotted(value.func)) or "a")[0].isupper() else None
            have = self.types[-1].get(target.id, made)
            self.types[-1][target.id] = made if have == made else None  # assignments must agree
        elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and self.kinds and self.kinds[-1] == "method" and target.value.id == "self":
            self.declare(target, target.attr, "field")
        elif isinstance(target, ast.Tuple | ast.List):
            for t in target.elts:
                self._assigned(t, None)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            self._assigned(t, node.value)
            self.visit(t)
        self.visit(node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._assigned(node.target, node.value, node.annotation)
        self._annotation(node.annotation, "type_reference")
        self.visit(node.target)
        if node.value is not None:
            self.visit(node.value)

    def _loop(self, node: ast.AST, iterable: ast.AST | None) -> None:
        self.observe(node, "loop")
        if iterable is not None:
            self.observe(iterable, "loop_iterable", _last(_dotted(iterable)))
        self.generic_visit(node)

    def visit_For(self, node: ast.For) -> None:
        self._loop(node, node.iter)

    visit_AsyncFor = visit_For

    def visit_While(self, node: ast.While) -> None:
        self._loop(node, None)

    def _comprehension(self, node: ast.AST) -> None:
        self._loop(node, node.generators[0].iter)

    visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = _comprehension

    def visit_With(self, node: ast.With) -> None:
        self.observe(node, "with_block")
        self.generic_visit(node)

    visit_AsyncWith = visit_With

    def visit_Compare(self, node: ast.Compare) -> None:
        for op, right in zip(node.ops, node.comparators):
            if isinstance(op, ast.In | ast.NotIn):
                self.observe(right, "membership", _last(_dotted(right)))
        self.generic_visit(node)


#: What ``declarations`` tells of each.
DECLARATION = ("qualified_name", "kind", "is_test", "start_line", "end_line")
#: Fields of statements, handlers and cases that hold such, last first, by their class, as far as any was seen.
_BLOCKS: dict[type, tuple[str, ...]] = {}


def _declared(content: bytes, body: list[ast.stmt], scope: str, kind: str | None, found: list[tuple]) -> None:
    """Adds the declarations of a body to ``found``: ``scope`` is what their qualified names begin with, and ``kind`` that of what they stand in."""
    named = "field" if kind == "class" else None if scope else "variable"
    rest = body[::-1]
    while rest:
        n = rest.pop()
        of = n.__class__
        if of is ast.Assign or of is ast.AnnAssign:
            targets = n.targets[::-1] if of is ast.Assign else [n.target]
            while targets:
                t = targets.pop()
                of = t.__class__
                if of is ast.Name:
                    if named:
                        found.append((scope + t.id, named, False, t.lineno, t.end_lineno))
                elif of is ast.Attribute:
                    if kind == "method" and t.value.__class__ is ast.Name and t.value.id == "self":
                        found.append((scope + t.attr, "field", False, t.lineno, t.end_lineno))
                elif of is ast.Tuple or of is ast.List:
                    targets += t.elts[::-1]
        elif of is ast.FunctionDef or of is ast.AsyncFunctionDef or of is ast.ClassDef:
            name = n.name
            own = "class" if of is ast.ClassDef else "method" if kind == "class" else "function"
            line = n.lineno
            if n.decorator_list:
                text = _Text(content)
                start = _decorated(text, n)
                line = line if start is None else text.line(start)
            found.append((scope + name, own, _is_test(name, own), line, n.end_lineno))
            _declared(content, n.body, f"{scope}{name}.", own, found)
        else:
            blocks = _BLOCKS.get(of)
            if blocks is None:
                blocks = _BLOCKS[of] = tuple(f for f in reversed(of._fields) if f in ("body", "handlers", "cases", "orelse", "finalbody"))
            for f in blocks:
                rest += getattr(n, f)[::-1]


def _parsed(source_id: str, content: bytes, diagnostics: list[dict]) -> ast.Module | None:
    """A file's tree, or none and a diagnostic."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        diagnostics.append({"source_id": source_id, "code": "invalid_utf8", "message": str(e)})
        return None
    try:
        return ast.parse(text.replace("\r\n", " \n"))
    except (SyntaxError, ValueError, RecursionError) as e:
        diagnostics.append({"source_id": source_id, "code": "python_parse_error", "message": str(e)})
        return None


def declarations(content: bytes) -> list[tuple]:
    """A file's symbols by the columns ``DECLARATION``, in the order of ``extract``: only statements are walked, and no ids, spans or hashes made."""
    found: list[tuple] = []
    tree = _parsed("", content, [])
    if tree is not None:
        _declared(content, tree.body, "", None, found)
    return found


def extract(source_id: str, content: bytes, names: tuple[str, ...] = RECORDS, kinds: frozenset[str] | None = None) -> Extraction:
    """The records ``names`` of a file, of occurrences those of ``kinds`` (all, if None); the others may be left out."""
    out = Extraction()
    tree = _parsed(source_id, content, out.diagnostics)
    if tree is not None and set(names) - {"diagnostics"}:
        _Walker(source_id, _Text(content), out, names, kinds).visit(tree)
    return out
