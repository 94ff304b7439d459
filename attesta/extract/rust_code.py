"""Rust source to declarations and occurrences, by a scanner of our own.

There is no Rust parser here, so a tokeniser that knows comments, strings,
raw strings, characters and lifetimes is followed by a structural pass over
items and bodies.  Attributes belong to their item's span.  Macros are not
expanded and their arguments not read.  Offsets are bytes.
"""

from __future__ import annotations

import hashlib
import re

from attesta.extract.python_code import Extraction

_TOKEN = re.compile(
    rb"""(?P<skip>\s+|//[^\n]*|/\*)|(?P<str>b?"(?:[^"\\]|\\.)*"|b?'(?:[^'\\]|\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.))')|(?P<raw>b?r(?P<h>\#*)")|(?P<life>'[A-Za-z_]\w*)|(?P<id>(?:r\#)?[A-Za-z_\x80-\xff][\w\x80-\xff]*)|(?P<num>\d[\w.]*)|(?P<op>::|->|=>|\.\.=?|&&|\|\||[-+*/%^&|<>=!]=|.)""",
    re.S | re.X,
)
_ITEMS = {b"fn", b"struct", b"enum", b"union", b"trait", b"type", b"mod", b"const", b"static", b"impl"}
_KIND = {b"fn": "function", b"mod": "module"}
_KEYWORDS = {b"if", b"while", b"for", b"match", b"loop", b"return", b"in", b"as", b"let", b"mut", b"ref", b"move", b"unsafe", b"else", b"fn", b"impl", b"where", b"pub", b"use", b"dyn", b"async", b"await"}
_ITERATORS = {b"map", b"for_each", b"filter", b"fold", b"any", b"all", b"flat_map", b"filter_map", b"find", b"position", b"try_for_each"}


def tokenize(data: bytes) -> list[tuple[str, bytes, int, int]]:
    """(kind, text, start, end) of the tokens that matter."""
    out, at = [], 3 if data.startswith(b"\xef\xbb\xbf") else 0
    if data[at : at + 2] == b"#!" and data[at + 2 : at + 3] != b"[":
        at = data.find(b"\n", at) + 1 or len(data)
    while at < len(data):
        m = _TOKEN.match(data, at)
        kind, end = m.lastgroup, m.end()
        if m["skip"] is not None:
            if m["skip"] == b"/*":
                depth = 1
                while depth and end < len(data):
                    a, b = data.find(b"/*", end), data.find(b"*/", end)
                    if b < 0:
                        end = len(data)
                    elif 0 <= a < b:
                        depth, end = depth + 1, a + 2
                    else:
                        depth, end = depth - 1, b + 2
            at = end
            continue
        if m["raw"] is not None:
            close = data.find(b'"' + m["h"], end)
            end = len(data) if close < 0 else close + 1 + len(m["h"])
            kind = "str"
        out.append(("id" if m["id"] is not None else "str" if m["str"] is not None or m["raw"] is not None else kind, data[at:end], at, end))
        at = end
    return out


class _Scanner:
    def __init__(self, source_id: str, data: bytes) -> None:
        self.source, self.data, self.tokens, self.out = source_id, data, tokenize(data), Extraction()
        self.match: dict[int, int] = {}
        stack = []
        for i, (_, t, *_rest) in enumerate(self.tokens):
            if t in (b"(", b"[", b"{"):
                stack.append((t, i))
            elif t in (b")", b"]", b"}"):
                if not stack or {b"(": b")", b"[": b"]", b"{": b"}"}[stack[-1][0]] != t:
                    raise ValueError(f"unbalanced {t.decode()} at byte {self.tokens[i][2]}")
                self.match[stack.pop()[1]] = i
        if stack:
            raise ValueError(f"unclosed {stack[-1][0].decode()} at byte {self.tokens[stack[-1][1]][2]}")

    def text(self, i: int) -> bytes:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else b""

    def line(self, offset: int) -> int:
        return self.data.count(b"\n", 0, offset) + 1

    def declare(self, name: str, kind: str, start: int, end: int, scope: list[str], is_test: bool) -> None:
        self.out.symbols.append(
            {"id": f"{self.source}:{kind}:{start}:{end}", "source_id": self.source, "name": name, "qualified_name": "::".join([*scope, name]), "kind": kind, "is_test": is_test, "top_level": not scope,
             "start": start, "end": end, "start_line": self.line(start), "end_line": self.line(max(start, end - 1)), "sha256": hashlib.sha256(self.data[start:end]).hexdigest()}
        )

    def observe(self, kind: str, start: int, end: int, candidate: str | None) -> None:
        if end > start:
            self.out.occurrences.append({"id": f"{self.source}:{kind}:{start}:{end}", "source_id": self.source, "kind": kind, "start": start, "end": end, "line": self.line(start), "candidate": candidate, "rule": None, "label": self.data[start:end].decode("utf-8", "replace")[:256]})

    def until(self, i: int, stops: tuple[bytes, ...], last: int) -> int:
        """The first token at the same depth that is one of ``stops``; bracketed parts are stepped over."""
        while i < last:
            t = self.text(i)
            if t in stops:
                return i
            i = self.match.get(i, i) + 1
        return last

    def items(self, i: int, last: int, scope: list[str], inside: str | None = None) -> None:
        while i < last:
            first, is_test = i, False
            while self.text(i) == b"#":
                at = i + 1 + (self.text(i + 1) == b"!")
                end = self.match.get(at, at)
                names = [self.text(k) for k in range(at + 1, end)]
                is_test |= names[-1:] == [b"test"] or names[:1] == [b"test"]
                i = end + 1
            while self.text(i) in (b"pub", b"unsafe", b"async", b"extern", b"default") or self.tokens[i][0] == "str" if i < last else False:
                i += 1
                if self.text(i) == b"(":
                    i = self.match[i] + 1
            if i >= last:
                return
            if self.text(i) == b"const" and self.text(i + 1) in (b"fn", b"unsafe", b"async"):
                i += 1
                continue_from = first
            else:
                continue_from = first
            word = self.text(i)
            if word not in _ITEMS:
                i = self.until(i, (b";",), last) + 1 if word in (b"use", b"extern") else self.match.get(i, i) + 1
                continue
            start = self.tokens[continue_from][2]
            i = self.item(i, last, start, scope, is_test, inside)

    def item(self, i: int, last: int, start: int, scope: list[str], is_test: bool, inside: str | None) -> int:
        word = self.text(i)
        if word == b"impl":
            brace = self.until(i, (b"{", b";"), last)
            head = [k for k in range(i + 1, brace)]
            label = self.data[self.tokens[i][2] : self.tokens[brace - 1][3]].decode("utf-8", "replace") if brace > i else "impl"
            end = self.match.get(brace, brace)
            self.declare(" ".join(label.split()), "impl", start, self.tokens[min(end, last - 1)][3], scope, is_test)
            self.types(head)
            if self.text(brace) == b"{":
                self.items(brace + 1, end, [*scope, " ".join(label.split())], "impl")
            return end + 1
        name = self.text(i + 1).decode("utf-8", "replace")
        body = self.until(i + 1, (b"{", b";") if word != b"const" and word != b"static" and word != b"type" else (b";",), last)
        end = self.match.get(body, body) if self.text(body) == b"{" else body
        kind = _KIND.get(word, word.decode())
        if word == b"fn" and inside:
            kind = "trait_method" if inside == "trait" else "method"
        self.declare(name, kind, start, self.tokens[min(end, last - 1)][3], scope, is_test)
        inner = [*scope, name]
        if word == b"fn":
            arrow = next((k for k in range(i, body) if self.text(k) == b"->"), None)
            for k in range(i + 2, body):
                if self.tokens[k][0] == "id" and self.text(k)[:1].isupper():
                    self.observe("declared_return" if arrow is not None and k > arrow else "type_reference", *self.tokens[k][2:], self.text(k).decode())
            if self.text(body) == b"{":
                self.body(body + 1, end)
        elif word in (b"mod", b"trait") and self.text(body) == b"{":
            self.items(body + 1, end, inner, "trait" if word == b"trait" else None)
        elif word in (b"struct", b"union", b"enum") and self.text(body) == b"{":
            self.members(body + 1, end, inner, "variant" if word == b"enum" else "field")
        else:
            self.types(range(i + 2, end))
            if word in (b"const", b"static"):
                self.body(i + 2, end)
        return end + 1

    def members(self, i: int, last: int, scope: list[str], kind: str) -> None:
        while i < last:
            first = i
            while self.text(i) == b"#":
                i = self.match.get(i + 1, i + 1) + 1
            if self.text(i) == b"pub":
                i += 1
                i = self.match[i] + 1 if self.text(i) == b"(" else i
            comma = i
            while comma < last and self.text(comma) != b",":
                comma = self.match.get(comma, comma) + 1
            if i < last and self.tokens[i][0] == "id":
                self.declare(self.text(i).decode("utf-8", "replace"), kind, self.tokens[first][2], self.tokens[comma - 1][3], scope, False)
                self.types(range(i + 1, comma))
            i = comma + 1

    def types(self, span: range | list[int]) -> None:
        for k in span:
            if self.tokens[k][0] == "id" and self.text(k)[:1].isupper():
                self.observe("type_reference", *self.tokens[k][2:], self.text(k).decode("utf-8", "replace"))

    def body(self, i: int, last: int) -> None:
        """Calls, paths, loops, literals, bindings and field uses of a body."""
        k = i
        while k < last:
            kind, t, s, e = self.tokens[k]
            nxt = self.text(k + 1)
            if t in (b"for", b"while", b"loop") and kind == "id" and nxt != b"<":
                brace = self.until(k + 1, (b"{",), last)
                if self.text(brace) == b"{":
                    self.observe("loop", s, self.tokens[self.match[brace]][3], None)
                    into = next((x for x in range(k + 1, brace) if self.text(x) == b"in"), None)
                    if t == b"for" and into is not None and into + 1 < brace:
                        self.observe("loop_iterable", self.tokens[into + 1][2], self.tokens[brace - 1][3], None)
            elif t == b"let":
                at = k + 1 + (nxt == b"mut")
                if self.tokens[at][0] == "id" and self.text(at) not in _KEYWORDS:
                    self.observe("local_binding", *self.tokens[at][2:], self.text(at).decode("utf-8", "replace"))
            elif kind == "id" and t not in _KEYWORDS and nxt == b"!" and self.text(k + 2) in (b"(", b"[", b"{"):
                k = self.match[k + 2]  # a macro's arguments are not read
            elif kind == "id" and t not in _KEYWORDS:
                name = t.decode("utf-8", "replace")
                after = k + 1
                if nxt == b"::" and self.text(k + 2) == b"<":
                    after = self.until(k + 3, (b">",), last) + 1
                if self.text(after) == b"(":
                    method = self.text(k - 1) == b"."
                    begin = s
                    if method:
                        begin = self.chain(k - 1)
                    elif self.text(k - 1) == b"::":
                        begin = self.path(k)
                    close = self.match[after]
                    self.observe("method_call_observed" if method else "call_observed", begin, self.tokens[close][3], name)
                    if method and t in _ITERATORS and self.text(after + 1) in (b"|", b"||", b"move"):
                        self.observe("loop", begin, self.tokens[close][3], None)
                elif self.text(k - 1) == b".":
                    wrote = nxt == b"=" or nxt in (b"+=", b"-=", b"*=", b"/=")
                    self.observe("field_assign" if wrote else "attribute_access", s, e, name)
                elif nxt == b"{" and t[:1].isupper() and self.text(k - 1) not in (b"in", b"match", b"if", b"while"):
                    self.observe("struct_literal", s, self.tokens[self.match[k + 1]][3], name)
                    for x in range(k + 2, self.match[k + 1]):
                        if self.tokens[x][0] == "id" and self.text(x + 1) == b":" and self.text(x - 1) in (b"{", b","):
                            self.observe("field_init", *self.tokens[x][2:], self.text(x).decode("utf-8", "replace"))
                elif t[:1].isupper():
                    self.observe("type_reference" if nxt == b"::" or self.text(k - 1) in (b":", b"as", b"<") else "name_reference", s, e, name)
                elif nxt != b"::" and nxt != b":":
                    self.observe("name_reference", s, e, name)
            k += 1

    def chain(self, dot: int) -> int:
        """Where the receiver before a dot begins."""
        opened = {v: k for k, v in self.match.items()}
        k = dot - 1
        while k >= 0:
            k = opened.get(k, k)
            before = self.text(k - 1)
            if self.text(k) in (b"(", b"[") and (self.tokens[k - 1][0] == "id" and before not in _KEYWORDS or before in (b")", b"]", b"?")):
                k -= 1
            elif before in (b".", b"::") or self.text(k) == b"?":
                k -= 2 if before in (b".", b"::") else 1
            else:
                break
        return self.tokens[max(k, 0)][2]

    def path(self, k: int) -> int:
        while self.text(k - 1) == b"::" and self.tokens[k - 2][0] == "id":
            k -= 2
        return self.tokens[k][2]


def extract(source_id: str, content: bytes) -> Extraction:
    out = Extraction()
    try:
        content.decode("utf-8")
    except UnicodeDecodeError as e:
        out.diagnostics.append({"source_id": source_id, "code": "invalid_utf8", "message": str(e)})
        return out
    try:
        scanner = _Scanner(source_id, content)
        scanner.items(0, len(scanner.tokens), [])
    except (ValueError, IndexError, RecursionError) as e:
        out.diagnostics.append({"source_id": source_id, "code": "rust_parse_error", "message": str(e)})
        return out
    return scanner.out


def body_brace(text: str) -> int | None:
    """The byte offset of the brace that opens a function's body; comments, strings and parentheses are stepped over."""
    depth = 0
    for _, t, s, _e in tokenize(text.encode()):
        depth += (t in (b"(", b"[")) - (t in (b")", b"]"))
        if t == b"{" and depth == 0:
            return s
        if t == b";" and depth == 0:
            return None
    return None
