"""Functions on code and diffs whose brackets or order regular expressions can't follow: plain Python, and Arrow UDFs of it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from attesta.session import let_workers_import

#: Lines of context around an edit, and the cells beyond which a diff is not computed line by line.
CONTEXT, CELLS = 3, 4_000_000
_PAIRS = {")": "(", "]": "[", "}": "{", ">": "<"}


def matching_open(text: str, close: int) -> int | None:
    """Where the bracket that the one at ``close`` closes opens, read from the right."""
    want, depth = _PAIRS[text[close]], 0
    for i in range(close, -1, -1):
        depth += (text[i] == text[close]) - (text[i] == want)
        if not depth:
            return i
    return None


def call_parts(text: str | None) -> dict | None:
    """Receiver (empty for a plain call, ``()`` for a computed one) and name of a written call."""
    text = (text or "").rstrip()
    if not text.endswith(")"):
        return None
    open_ = matching_open(text, len(text) - 1)
    head = text[:open_].rstrip() if open_ is not None else ""
    if head.endswith(">"):
        angle = matching_open(head, len(head) - 1)
        if angle is not None:
            head = head[:angle].removesuffix("::")
    name = re.search(r"\w+$", head)
    if not name:
        return None
    before = head[: name.start()].rstrip()
    for mark in (".", "::"):
        if before.endswith(mark):
            receiver = before[: -len(mark)].rstrip()
            return {"receiver": receiver if re.fullmatch(r"[\w.:]+", receiver) else "()", "name": name[0]}
    return {"receiver": "", "name": name[0]}


def arguments(text: str | None) -> list[dict]:
    """(name or None, value) of a call's arguments, cut at commas outside brackets and strings."""
    text = (text or "").rstrip()
    if not text.endswith(")"):
        return []
    open_ = matching_open(text, len(text) - 1)
    out, depth, quote, start = [], 0, "", (open_ or 0) + 1
    body = text[:-1]
    for i in range(start, len(body) + 1):
        c = body[i] if i < len(body) else ","
        if quote:
            quote = "" if c == quote and body[i - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        if c == "," and not quote and not depth:
            part = body[start:i].strip()
            named = re.match(r"([A-Za-z_]\w*)\s*=(?!=)\s*(.*)$", part, re.S)
            if part:
                out.append({"name": named[1], "value": named[2]} if named else {"name": None, "value": part})
            start = i + 1
    return out


def marked_hunks(patch: str | None) -> list[dict]:
    """Hunks of a unified diff: path, old_start, old_lines, new_start, new_lines, removed (numbers of old lines that go), changes (whether any line does), ok (counts as announced)."""
    out, path, hunk = [], None, None
    for line in (patch or "").split("\n"):
        if line.startswith("+++ "):
            path = line[4:].removeprefix("b/").split("\t")[0]
            hunk = None
        elif m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            hunk = {"path": path, "old_start": int(m[1]), "new_start": int(m[3]), "old_lines": [], "new_lines": [], "removed": [], "changes": False, "_n": (int(m[2] or 1), int(m[4] or 1))}
            out.append(hunk)
        elif hunk is not None and line[:1] in (" ", "-", "+") and (len(hunk["old_lines"]), len(hunk["new_lines"])) != hunk["_n"]:
            hunk["changes"] |= line[0] != " "
            if line[0] == "-":
                hunk["removed"].append(hunk["old_start"] + len(hunk["old_lines"]))
            if line[0] in " -":
                hunk["old_lines"].append(line[1:])
            if line[0] in " +":
                hunk["new_lines"].append(line[1:])
    for h in out:
        h["ok"] = (len(h["old_lines"]), len(h["new_lines"])) == h.pop("_n")
    return out


def parse_patch(patch: str | None) -> list[dict]:
    """Hunks of a unified diff: path, old_start, old_lines, new_start, new_lines, ok (counts as announced)."""
    return [{k: v for k, v in h.items() if k not in ("removed", "changes")} for h in marked_hunks(patch)]


def line_diff(old: list[str], new: list[str]) -> list[str]:
    """Lines with ``' '``, ``'-'`` or ``'+'`` in front, by a longest common subsequence; beyond ``CELLS`` all old then all new."""
    if len(old) * len(new) > CELLS:
        return [f"-{x}" for x in old] + [f"+{x}" for x in new]
    best = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i in range(len(old) - 1, -1, -1):
        for j in range(len(new) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if old[i] == new[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(old) or j < len(new):
        if i < len(old) and j < len(new) and old[i] == new[j]:
            out.append(f" {old[i]}")
            i, j = i + 1, j + 1
        elif i < len(old) and (j == len(new) or best[i + 1][j] >= best[i][j + 1]):
            out.append(f"-{old[i]}")
            i += 1
        else:
            out.append(f"+{new[j]}")
            j += 1
    return out


def edits_to_diff(path: str, lines: list[str], edits: list[dict]) -> str:
    """A unified diff of edits (start_line, end_line, new), hunks with three lines around, those that touch as one."""
    edits = sorted(edits, key=lambda e: e["start_line"])
    groups: list[list[dict]] = []
    for e in edits:
        if groups and e["start_line"] - CONTEXT <= groups[-1][-1]["end_line"] + CONTEXT + 1:
            groups[-1].append(e)
        else:
            groups.append([e])
    out, shift = [f"--- a/{path}", f"+++ b/{path}"], 0
    for g in groups:
        first, last = max(1, g[0]["start_line"] - CONTEXT), min(len(lines), g[-1]["end_line"] + CONTEXT)
        body, at = [], first
        for e in g:
            body += [f" {x}" for x in lines[at - 1 : e["start_line"] - 1]]
            body += line_diff(lines[e["start_line"] - 1 : e["end_line"]], e["new"].split("\n") if e["new"] else [])
            at = e["end_line"] + 1
        body += [f" {x}" for x in lines[at - 1 : last]]
        n_old, n_new = sum(x[0] in " -" for x in body), sum(x[0] in " +" for x in body)
        out += [f"@@ -{first},{n_old} +{first + shift},{n_new} @@", *body]
        shift += n_new - n_old
    return "\n".join(out) + "\n"


def file_changes(diff: str | None) -> list[dict]:
    """(path, removed: old line numbers, added: texts) of a unified diff."""
    by: dict[str, dict] = {}
    for h in parse_patch(diff):
        c = by.setdefault(h["path"], {"path": h["path"], "removed": [], "added": []})
        old, new, at = h["old_lines"], h["new_lines"], h["old_start"]
        for x in line_diff(old, new):
            if x[0] == "-":
                c["removed"].append(at)
            elif x[0] == "+":
                c["added"].append(x[1:])
            at += x[0] in " -"
    return list(by.values())


def json_leaves(text: str | None) -> list[dict]:
    """(path, kind, value) of every leaf of a JSON text; array places are ``[]``.  Empty containers and nulls are leaves."""
    out: list[dict] = []

    def walk(x: object, path: str) -> None:
        if isinstance(x, dict) and x:
            for k, v in x.items():
                walk(v, f"{path}.{k}" if path else k)
        elif isinstance(x, list) and x:
            for v in x:
                walk(v, f"{path}[]")
        else:
            out.append({"path": path, "kind": "null" if x is None else type(x).__name__, "value": json.dumps(x, ensure_ascii=False)})

    try:
        walk(json.loads(text or ""), "")
    except ValueError:
        return []
    return out


def json_groups(text: str | None) -> list[list[str]]:
    """Lists of strings from a text that should be JSON: all of them if it is, else the complete innermost lists that it holds."""
    try:
        value = json.loads(text or "")
        rows = value.get("groups", []) if isinstance(value, dict) else value
        return [[str(w) for w in r] for r in rows if isinstance(r, list)]
    except ValueError:
        return [json.loads(m) for m in re.findall(r'\[\s*"(?:[^"\\]|\\.)*"(?:\s*,\s*"(?:[^"\\]|\\.)*")*\s*\]', text or "")]


PARTS = "struct<receiver:string,name:string>"
ARGUMENTS = "array<struct<name:string,value:string>>"
HUNKS = "array<struct<path:string,old_start:int,old_lines:array<string>,new_start:int,new_lines:array<string>,ok:boolean>>"
MARKED = "array<struct<path:string,old_start:int,old_lines:array<string>,new_start:int,new_lines:array<string>,removed:array<int>,changes:boolean,ok:boolean>>"
CHANGES = "array<struct<path:string,removed:array<int>,added:array<string>>>"
LEAVES = "array<struct<path:string,kind:string,value:string>>"


def _applied(f: Callable, column: Column | str, schema: str, kind: pa.DataType) -> Column:
    """``f`` of each value of a column as an Arrow UDF: values come and go as Arrow arrays, nested ones too."""
    let_workers_import(SparkSession.getActiveSession())

    def batch(s: pa.Array) -> pa.Array:
        return pa.array([f(t) for t in s.to_pylist()], kind)

    return F.arrow_udf(batch, schema)(F.col(column) if isinstance(column, str) else column)


_TEXT, _PART = pa.string(), pa.struct([("receiver", pa.string()), ("name", pa.string())])
_ARGUMENT = pa.list_(pa.struct([("name", _TEXT), ("value", _TEXT)]))
_HUNK = pa.list_(pa.struct([("path", _TEXT), ("old_start", pa.int32()), ("old_lines", pa.list_(_TEXT)), ("new_start", pa.int32()), ("new_lines", pa.list_(_TEXT)), ("ok", pa.bool_())]))
_MARKED = pa.list_(pa.struct([("path", _TEXT), ("old_start", pa.int32()), ("old_lines", pa.list_(_TEXT)), ("new_start", pa.int32()), ("new_lines", pa.list_(_TEXT)), ("removed", pa.list_(pa.int32())), ("changes", pa.bool_()), ("ok", pa.bool_())]))
_CHANGE = pa.list_(pa.struct([("path", _TEXT), ("removed", pa.list_(pa.int32())), ("added", pa.list_(_TEXT))]))
_LEAF = pa.list_(pa.struct([("path", _TEXT), ("kind", _TEXT), ("value", _TEXT)]))


def call_parts_of(column: Column | str) -> Column:
    return _applied(call_parts, column, PARTS, _PART)


def arguments_of(column: Column | str) -> Column:
    return _applied(arguments, column, ARGUMENTS, _ARGUMENT)


def hunks_of(column: Column | str) -> Column:
    return _applied(parse_patch, column, HUNKS, _HUNK)


def marked_hunks_of(column: Column | str) -> Column:
    return _applied(marked_hunks, column, MARKED, _MARKED)


def changes_of(column: Column | str) -> Column:
    return _applied(file_changes, column, CHANGES, _CHANGE)


def leaves_of(column: Column | str) -> Column:
    return _applied(json_leaves, column, LEAVES, _LEAF)


def groups_of(column: Column | str) -> Column:
    return _applied(json_groups, column, "array<array<string>>", pa.list_(pa.list_(_TEXT)))


def diff_of(old: Column, new: Column) -> Column:
    """``line_diff`` of two texts, joined by line feeds."""
    let_workers_import(SparkSession.getActiveSession())

    def batch(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(["\n".join(line_diff((x or "").split("\n"), (y or "").split("\n"))) for x, y in zip(a.to_pylist(), b.to_pylist())], _TEXT)

    return F.arrow_udf(batch, "string")(old, new)


def edits_diff_of(path: Column, lines: Column, edits: Column) -> Column:
    """``edits_to_diff`` of a path, its lines and edits (start_line, end_line, new)."""
    let_workers_import(SparkSession.getActiveSession())

    def batch(p: pa.Array, ls: pa.Array, es: pa.Array) -> pa.Array:
        return pa.array([edits_to_diff(*row) for row in zip(p.to_pylist(), ls.to_pylist(), es.to_pylist())], _TEXT)

    return F.arrow_udf(batch, "string")(path, lines, edits)


def body_braces_of(column: Column | str) -> Column:
    """Where the bracket that opens a Rust function's body ends, in characters; null where there is no body."""
    from attesta.extract.rust_code import body_brace

    def place(text: str | None) -> int | None:
        at = None if text is None else body_brace(text)
        return None if at is None else len(text.encode()[:at].decode()) + 1

    return _applied(place, column, "int", pa.int32())
