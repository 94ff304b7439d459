"""Source trees as editions: immutable tables of sources, declarations, occurrences and diagnostics.

A tree is listed and read by tasks, each file once; extraction runs in the
executors, one file at a time.  An edition is written create-only and
its manifest last, so a folder without a manifest is no edition.  Reading it
again can verify it: tables are computed anew from the stored contents and must
be equal, row for row.
"""

from __future__ import annotations

import gc
import json
import os
import re
import subprocess
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import records
from attesta.plans.registry import profile
from attesta.session import let_workers_import
from attesta.storage import arrow_files, drop, new_path, save

# What an extraction keeps of each record; ids are made of the source's id, the kind and the span, and ``container`` and ``owner`` name a symbol by its id's end.
_SYMBOL = "name string, qualified_name string, kind string, is_test boolean, top_level boolean, start bigint, `end` bigint, start_line bigint, end_line bigint, sha256 string, container string"
_OCCURRENCE = "kind string, start bigint, `end` bigint, line bigint, candidate string, rule string, label string, owner string"
_BINDING = "scope_start bigint, scope_end bigint, scope_line bigint, head string, dotted string, is_local boolean"
_DIAGNOSTIC = "code string, message string"
_RECORDS = {"symbols": _SYMBOL, "occurrences": _OCCURRENCE, "bindings": _BINDING, "diagnostics": _DIAGNOSTIC}
TABLES = ("sources", "symbols", "occurrences", "bindings", "diagnostics")
#: Symbols that own what happens in them.
BODY_KINDS = ("function", "method", "trait_method", "class", "impl", "module")
#: Symbols that are methods of a type, and those that are a type or its block.
METHOD_KINDS, TYPE_KINDS = ("method", "trait_method", "function"), ("class", "struct", "impl", "trait")


def list_tree(spark: SparkSession, root: str, inputs: list[str] | None = None, profile_name: str = "V9") -> DataFrame:
    """(uri, path) of the files under ``root`` that the profile reads; no file's content is read, and skipped folders are not entered.

    ``inputs`` are relative paths; a folder named there is entered even if its
    name is one that is skipped, and a file named there is kept whatever it is.
    Folders are listed by tasks, a level of the tree at a time.
    """
    let_workers_import(spark)
    p = profile(profile_name)
    base = root.rstrip("/")
    if "://" not in base:
        base = "file://" + os.path.abspath(base)
    named = [i.strip("/") for i in inputs or []]
    skipped, languages = set(p.skipped_dirs), set(p.languages)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = arrow_files(base)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                listed = where.get_file_info(pyarrow.fs.FileSelector(f"{at}/{folder}".rstrip("/")))
                rows = [((f"{folder}/" if folder else "") + f.base_name, f.type == pyarrow.fs.FileType.Directory) for f in sorted(listed, key=lambda f: f.path)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], names=["path", "is_dir"])

    name = F.element_at(F.split("path", "/"), -1)
    asked = F.col("path").isin(*named) if named else F.lit(False)
    toward = F.lit(not named)  # a named input may lie below a folder, or hold it
    for i in named:
        toward = toward | F.col("path").startswith(i + "/") | (F.col("path") == i) | F.lit(i).startswith(F.concat("path", F.lit("/")))
    enters = asked | (toward & ~name.isin(*skipped) & ~name.startswith("."))
    for i in named:
        enters = enters | F.lit(i).startswith(F.concat("path", F.lit("/")))
    found, level = [], spark.createDataFrame([("",)], "path string")
    while True:
        listed = save(level.repartition(max(1, min(level.count(), 1000))).mapInArrow(entries, "path string, is_dir boolean"), "listed")
        found.append(listed.where(~F.col("is_dir")).select("path"))
        level = listed.where(F.col("is_dir") & enters).select("path")
        if level.isEmpty():
            break
    below = F.lit(not named)
    for i in named:
        below = below | F.col("path").startswith(i + "/")
    readable = T.path_is_safe(F.col("path")) & (asked | (below & T.language_of(F.col("path")).isin(*languages)))
    return reduce(DataFrame.unionByName, found).where(readable).select(F.concat(F.lit(base + "/"), "path").alias("uri"), "path")


def read_tree(spark: SparkSession, root: str, inputs: list[str] | None = None, profile_name: str = "V9") -> DataFrame:
    """(id, path, sha256, byte_len, language, content) of the files that ``list_tree`` finds, each opened once, by tasks."""
    files = list_tree(spark, root, inputs, profile_name)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, at = arrow_files(uri)
                with where.open_input_file(at) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], names=["path", "content"])

    return sources_of(files.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(contents, "path string, content binary"))


def sources_of(files: DataFrame) -> DataFrame:
    """Source rows of (path, content binary): the id is made of the hashes of both."""
    sha = F.sha2("content", 256)
    return files.select(F.concat(F.lit("src:"), F.sha2("path", 256), F.lit(":"), sha).alias("id"), "path", sha.alias("sha256"), F.length("content").cast("long").alias("byte_len"), T.language_of(F.col("path")).alias("language"), "content")


def suggested_inputs(sources: DataFrame) -> DataFrame:
    """Top-level files and folders that hold something the profile reads, in order."""
    return sources.where("language <> 'auxiliary'").select(F.split("path", "/")[0].alias("input")).where("input not like '.%'").distinct().orderBy("input")


#: Content that one batch of an extraction is made of, unless a single file is longer.
_BATCH_BYTES = 256 << 10


def _fields(ddl: str) -> dict[str, pa.DataType]:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return {f.split()[0].strip("`"): kinds[f.split()[1]] for f in ddl.split(", ")}


def _end_of(row: dict) -> str:
    return f"{row['kind']}:{row['start']}:{row['end']}"


def around(inner: list[dict], outer: list[dict]) -> list[str | None]:
    """Of each span the end of the id of the smallest outer span of the same file that contains it and isn't itself, ties to the lesser one: ``intervals.innermost`` of one file, by one sort of both.

    What is compared with a span are the outer spans that its start lies in.
    """
    rest = sorted([(o["start"], o["end"], _end_of(o)) for o in outer], reverse=True)
    open_: list[tuple[int, int, str]] = []
    found: list[str | None] = [None] * len(inner)
    for start, end, at in sorted([(r["start"], r["end"], i) for i, r in enumerate(inner)]):
        while rest and rest[-1][0] <= start:
            open_.append(rest.pop())
        best = None
        for o in open_:
            if o[1] >= end and not (o[1] == end and o[0] == start and o[2] == _end_of(inner[at])):
                length = o[1] - o[0]
                if best is None or length < least or length == least and o[2] < best:
                    best, least = o[2], length
        found[at] = best
        if open_ and min([o[1] for o in open_]) < start:
            open_ = [o for o in open_ if o[1] >= start]
    return found


def _distinct(rows: list[dict]) -> list[dict]:
    return list({tuple(r.values()): r for r in rows}.values())


@contextmanager
def _cycles_left():  # noqa: ANN202
    """Without searches for cycles, which syntax trees have none of, but go through again and again; the caller searches now and then."""
    was = gc.isenabled()
    gc.freeze()
    gc.disable()
    try:
        yield
    finally:
        gc.unfreeze()
        if was:
            gc.enable()


def _extractor(names: tuple[str, ...], keep: tuple[str, ...] = (), nested: bool = False):  # noqa: ANN202
    """Batches of sources (id, language, content and ``keep``) to one row each with the arrays ``names``; containers and owners are null unless ``nested``."""
    fields = {n: _fields(_RECORDS[n]) for n in names}

    def listed(name: str, files: list[list[dict]]) -> pa.ListArray:
        rows = [r for f in files for r in f]
        offsets = [0]
        for f in files:
            offsets.append(offsets[-1] + len(f))
        columns = [pa.array([r.get(c) for r in rows], t) for c, t in fields[name].items()]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=[pa.field(c, t) for c, t in fields[name].items()]))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from attesta.extract import python_code, rust_code

        read = (*names, "symbols") if nested else names
        by = {"python": lambda *file: python_code.extract(*file, read), "rust": rust_code.extract}
        with _cycles_left():
            for batch in batches:
                first = size = 0
                found: list[dict[str, list[dict]]] = []
                for n, (source, language, content) in enumerate(zip(batch["id"].to_pylist(), batch["language"].to_pylist(), batch["content"].to_pylist())):
                    got = by[language](source, content)
                    records = {name: _distinct(getattr(got, name)) for name in names}
                    if nested and "symbols" in names:
                        for r, c in zip(records["symbols"], around(records["symbols"], got.symbols)):
                            r["container"] = c
                    if nested and "occurrences" in names:
                        for r, o in zip(records["occurrences"], around(records["occurrences"], [x for x in got.symbols if x["kind"] in BODY_KINDS])):
                            r["owner"] = o
                    found.append(records)
                    size += len(content)
                    if size >= _BATCH_BYTES or n + 1 == batch.num_rows:
                        part = batch.slice(first, len(found))
                        arrays = [part["id"], part["language"], *(part[k] for k in keep), *(listed(name, [f[name] for f in found]) for name in names)]
                        yield pa.RecordBatch.from_arrays(arrays, names=["source_id", "language", *keep, *names])
                        first, size, found = n + 1, 0, []
                        gc.collect()

    return extract


def _dealt(sources: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(id, language, content and ``keep``) of each parsed source, once, dealt to all tasks."""
    spark = sources.sparkSession
    let_workers_import(spark)
    columns = dict.fromkeys(["id", "language", "content", *keep])
    return sources.where("language <> 'auxiliary'").select(*columns).repartition(4 * max(1, spark.sparkContext.defaultParallelism), "id").dropDuplicates(["id"])


def extracted(sources: DataFrame, names: tuple[str, ...] = TABLES[1:], keep: tuple[str, ...] = (), nested: bool = False) -> DataFrame:
    """One row per parsed source with the arrays ``names`` (symbols, occurrences, bindings, diagnostics) and the source's columns ``keep``; ``auxiliary`` files are not parsed.

    With ``nested``, symbols have a container and occurrences an owner.

    Sources are dealt to tasks by their id, as a table's one small file may hold very many; a repeated source is parsed once.
    """
    arrays = [f"{n} array<struct<{', '.join(f.replace(' ', ':', 1) for f in _RECORDS[n].split(', '))}>>" for n in names]
    kept = [f"`{k}` {sources.schema[k].dataType.simpleString()}" for k in keep]
    return _dealt(sources, keep).mapInArrow(_extractor(tuple(names), tuple(keep), nested), ", ".join(["source_id string", "language string", *kept, *arrays]))


def rows_of(found: DataFrame, name: str, keep: tuple[str, ...] = (), nested: bool = False) -> DataFrame:
    """A record table of an extraction, with the columns ``keep``; ``nested`` adds the ``container`` of symbols or the ``owner`` of occurrences."""
    r = found.select("source_id", "language", *keep, F.explode(name).alias("r"))
    columns = {c: F.col("r")[c].alias(c) for c in _fields(_RECORDS[name])}
    held = [c for c in ("container", "owner") if columns.pop(c, None) is not None]
    source = F.col("source_id").alias("scope_source" if name == "bindings" else "source_id")
    if name in ("symbols", "occurrences"):
        of = lambda end: F.concat("source_id", F.lit(":"), end)
        ends = F.concat_ws(":", "r.kind", "r.start", "r.end")
        extra = [of(F.col("r")[c]).alias(c) for c in held] if nested else []
        return r.select(of(ends).alias("id"), source, *columns.values(), "language", *extra, *keep)
    return r.select(source, *columns.values(), *(["language"] if name == "bindings" else []), *keep)


def _declare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sources (language, content) to what is told of their declarations."""
    from attesta.extract import python_code, rust_code

    types = _fields(_SYMBOL)
    told = python_code.DECLARATION
    by = {"python": python_code.declarations, "rust": lambda content: [tuple([r[c] for c in told]) for r in _distinct(rust_code.extract("", content).symbols)]}

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, types[c]) for c, values in zip(told, zip(*found))], names=list(told))

    with _cycles_left():
        for batch in batches:
            size, found = 0, []
            for language, content in zip(batch["language"].to_pylist(), batch["content"].to_pylist()):
                found += by[language](content)
                size += len(content)
                if size >= _BATCH_BYTES and found:
                    yield rows(found)
                    size, found = 0, []
            if found:
                yield rows(found)
            gc.collect()


def declared(sources: DataFrame) -> DataFrame:
    """What extractors' ``declarations`` tell of the table of symbols; nothing else is extracted, and no row holds a file's array."""
    from attesta.extract.python_code import DECLARATION

    types = {f.split()[0].strip("`"): f for f in _SYMBOL.split(", ")}
    return _dealt(sources, ()).mapInArrow(_declare, ", ".join(types[c] for c in DECLARATION))


def tables_of(sources: DataFrame, found: DataFrame, nested: bool = False) -> dict[str, DataFrame]:
    """The record tables that ``found`` has arrays of; a file's repeated rows are gone."""
    return {"sources": sources.drop("content"), **{n: rows_of(found, n, nested=nested) for n in TABLES[1:] if n in found.columns}}


#: Tables of numbered records: ids, and columns that name a source or symbol, are numbers.
_NUMBERED = {
    "sources": "id bigint, path string, language string",
    "symbols": f"id bigint, source_id bigint, {_SYMBOL.replace('container string', 'container bigint')}, type bigint, language string",
    "occurrences": f"id bigint, source_id bigint, {_OCCURRENCE.replace('owner string', 'owner bigint')}, language string",
    "bindings": f"scope_source bigint, {_BINDING}, language string",
    "diagnostics": f"source_id bigint, {_DIAGNOSTIC}",
}
#: Their columns that aren't an extractor's.
_MADE = {
    "sources": (), "symbols": ("id", "source_id", "container", "type", "language"), "occurrences": ("id", "source_id", "owner", "language"), "bindings": ("scope_source", "language"),
    "diagnostics": ("source_id",),
}
#: Columns of occurrences that are made only where they are asked for: the container of one's owner, the loops around it, without those in whose iterable it stands;
#: of calls the types written for what they begin with, and the name of the module that their receiver is bound to by an import.
MADE_IF_ASKED = {"within": "bigint", "loops": "array<bigint>", "typed": "array<string>", "imported": "string"}
CALL_KINDS = ("call_observed", "method_call_observed")
_RECEIVER = re.compile(r"([\w.]+)\.\w+\(", re.ASCII)
#: What a task holds of a table before it is written, and the numbers that a task has for its records.
_HELD_BYTES, _TASK_NUMBERS = 16 << 20, 1 << 40


def _around(inner: list[tuple[int, int, int | None]], outer: list[tuple[int, int, int]]) -> list[int | None]:
    """``around`` of spans (start, end, number) of a file whose numbers have the order of their ids."""
    rest = sorted(outer, reverse=True)
    open_: list[tuple[int, int, int]] = []
    found: list[int | None] = [None] * len(inner)
    ends = 0  # no open span ends before
    for at in sorted(range(len(inner)), key=inner.__getitem__):
        start, end, own = inner[at]
        while rest and rest[-1][0] <= start:
            open_.append(rest.pop())
            if open_[-1][1] < ends:
                ends = open_[-1][1]
        if ends < start:
            open_ = [o for o in open_ if o[1] >= start]
            ends = min([o[1] for o in open_], default=start)
        best = None
        for o in open_:
            if o[1] >= end and o[2] != own:
                length = o[1] - o[0]
                if best is None or length < least or length == least and o[2] < best:
                    best, least = o[2], length
        found[at] = best
    return found


def _all_around(inner: list[tuple[int, int]], outer: list[tuple[int, int, int]]) -> list[list[int]]:
    """Of each span the numbers of all outer spans (start, end, number) of the same file that contain it, by one sort of both."""
    found: list[list[int]] = [[] for _ in inner]
    if not outer:
        return found
    rest = sorted(outer, reverse=True)
    open_: list[tuple[int, int, int]] = []
    for at in sorted(range(len(inner)), key=inner.__getitem__):
        start, end = inner[at]
        while rest and rest[-1][0] <= start:
            open_.append(rest.pop())
        if open_ and min([o[1] for o in open_]) < start:
            open_ = [o for o in open_ if o[1] >= start]
        found[at] = [o[2] for o in open_ if o[1] >= end]
    return found


def _loops(rows: list[dict], numbers: list[int]) -> list[list[int]]:
    """Of each occurrence of a file the loops around it, without those in whose iterable it stands: ``intervals.loop_members`` of one file.

    The innermost loop around an iterable owns it, the shortest one if there are several.
    """
    loops = [(r["start"], r["end"], n) for r, n in zip(rows, numbers) if r["kind"] == "loop"]
    found = _all_around([(r["start"], r["end"]) for r in rows], loops)
    if loops:
        its = [(r["start"], r["end"], None) for r in rows if r["kind"] == "loop_iterable"]
        iterable: dict[int, tuple[int, int]] = {}
        for (s, e, _), loop in zip(its, _around(its, loops)):
            if loop is not None and (loop not in iterable or (e - s, s) < (iterable[loop][1] - iterable[loop][0], iterable[loop][0])):
                iterable[loop] = s, e
        for at, held in enumerate(found):
            if held:
                s, e = rows[at]["start"], rows[at]["end"]
                found[at] = [n for n in held if n not in iterable or not (iterable[n][0] <= s and e <= iterable[n][1])]
    return found


def _typed(rows: list[dict]) -> list[list[str] | None]:
    """Of each call of a file the types written for what it begins with."""
    written: dict[int, list[str]] = {}
    for r in rows:
        if r["kind"] == "receiver_type" and r["candidate"] is not None and r["candidate"] not in written.setdefault(r["start"], []):
            written[r["start"]].append(r["candidate"])
    return [written.get(r["start"]) if r["kind"] in CALL_KINDS else None for r in rows]


def _imported(rows: list[dict], bindings: list[dict]) -> list[str | None]:
    """Of each call of a file the dotted name that the innermost scope which binds its receiver's head gives it, null for a local: the first half of ``resolve.import_links``."""
    by_head: dict[str, list[dict]] = {}
    for b in bindings:
        by_head.setdefault(b["head"], []).append(b)
    found: list[str | None] = [None] * len(rows)
    for at, r in enumerate(rows):
        if r["kind"] == "method_call_observed" and (m := _RECEIVER.match(r["label"])):
            fits = [b for b in by_head.get(m[1].split(".", 1)[0], ()) if b["scope_start"] <= r["start"] and r["end"] <= b["scope_end"]]
            if fits:
                found[at] = min([(b["scope_end"] - b["scope_start"], not b["is_local"], b["dotted"] or "") for b in fits])[2] or None
    return found


def _numbers(rows: list[dict], before: int) -> tuple[list[dict], list[int], int]:
    """The distinct ``rows`` of a file, their numbers in the order of their ids, those of an equal id alike, and the greatest number."""
    ids = [r["id"] for r in rows]
    every = sorted(set(ids))
    if len(every) < len(ids):
        rows = _distinct(rows)
        ids = [r["id"] for r in rows]
    number = dict(zip(every, range(before + 1, before + 1 + len(every))))
    return rows, [number[i] for i in ids], before + len(every)


def _numbered_file(got, source: int, language: str, rows: dict[str, list[dict]], made: dict[str, dict[str, list]], occurring: frozenset[str] | None = None) -> int:  # noqa: ANN001
    """Adds the records of a file whose number is ``source`` to ``rows``, and their columns that are made here to ``made``; returns the next number."""
    symbols, numbers, last = _numbers(got.symbols, source)
    spans = [(r["start"], r["end"], n) for r, n in zip(symbols, numbers)]
    kinds = [r["kind"] for r in symbols]
    contained = _around(spans, spans) if "symbols" in rows or "within" in made.get("occurrences", ()) else []
    if "symbols" in rows:
        types = _around([s if k in METHOD_KINDS else (*s[:2], None) for s, k in zip(spans, kinds)], [s for s, k in zip(spans, kinds) if k in TYPE_KINDS])
        rows["symbols"] += symbols
        m = made["symbols"]
        m["id"] += numbers
        m["container"] += contained
        m["type"] += [t if k in METHOD_KINDS else None for t, k in zip(types, kinds)]
        m["source_id"] += [source] * len(symbols)
        m["language"] += [language] * len(symbols)
    if "occurrences" in rows:
        seen, numbers, last = _numbers(got.occurrences if occurring is None else [r for r in got.occurrences if r["kind"] in occurring], last)
        rows["occurrences"] += seen
        m = made["occurrences"]
        m["id"] += numbers
        owners = _around([(r["start"], r["end"], None) for r in seen], [s for s, k in zip(spans, kinds) if k in BODY_KINDS])
        m["owner"] += owners
        if "within" in m:
            held = {s[2]: c for s, c in zip(spans, contained)}
            m["within"] += [held.get(o) for o in owners]
        if "loops" in m:
            m["loops"] += _loops(seen, numbers)
        if "typed" in m:
            m["typed"] += _typed(seen)
        if "imported" in m:
            m["imported"] += _imported(seen, got.bindings)
        m["source_id"] += [source] * len(seen)
        m["language"] += [language] * len(seen)
    if "bindings" in rows:
        found = _distinct(got.bindings)
        rows["bindings"] += found
        made["bindings"]["scope_source"] += [source] * len(found)
        made["bindings"]["language"] += [language] * len(found)
    if "diagnostics" in rows:
        found = _distinct(got.diagnostics)
        rows["diagnostics"] += found
        made["diagnostics"]["source_id"] += [source] * len(found)
    return last + 1


def _recorder(root: str, names: tuple[str, ...], kinds: frozenset[str] | None = None, asked: tuple[str, ...] = ()):  # noqa: ANN202
    """Batches of sources (id, language, content, path) to files of numbered records under ``root``, and those files' (name, uri)."""
    ddl = _numbered_ddl(asked)
    made_of = {**_MADE, "occurrences": (*_MADE["occurrences"], *asked)}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from attesta.extract import python_code, rust_code

        read = tuple(dict.fromkeys((*names, "symbols", *(["bindings"] if "imported" in asked else []))))
        by = {"python": lambda *file: python_code.extract(*file, read, kinds), "rust": rust_code.extract}
        schemas = {n: pa.schema(list(_fields(ddl[n]).items())) for n in ("sources", *names)}
        files, at = arrow_files(root)
        part = TaskContext.get().partitionId()
        following = part * _TASK_NUMBERS
        writers: dict[str, pq.ParquetWriter] = {}
        uris: dict[str, str] = {}
        held: dict[str, list[pa.Table]] = {n: [] for n in schemas}
        rows: dict[str, list[dict]] = {n: [] for n in schemas}
        made: dict[str, dict[str, list]] = {n: {c: [] for c in made_of[n]} for n in schemas}

        def put(least: int) -> None:
            for n, schema in schemas.items():
                if rows[n]:
                    held[n].append(pa.table([pa.array(made[n][c] if c in made[n] else [r[c] for r in rows[n]], schema.field(c).type) for c in schema.names], schema=schema))
                    rows[n].clear()
                    for values in made[n].values():
                        values.clear()
                if held[n] and sum(t.nbytes for t in held[n]) >= least:
                    if n not in writers:
                        name = f"{n}/{part}-{uuid.uuid4().hex}.parquet"  # another attempt has another name
                        uris[n] = f"{root}/{name}"
                        files.create_dir(f"{at}/{n}", recursive=True)
                        writers[n] = pq.ParquetWriter(f"{at}/{name}", schema, filesystem=files, compression="zstd")
                    writers[n].write_table(pa.concat_tables(held[n]))
                    held[n].clear()

        with _cycles_left():
            size = 0
            for batch in batches:
                for language, content, path in zip(*(batch[c].to_pylist() for c in ("language", "content", "path"))):
                    rows["sources"].append({"id": following, "path": path, "language": language})
                    following = _numbered_file(by[language]("", content), following, language, rows, made, kinds)
                    size += len(content)
                    if size >= _BATCH_BYTES:
                        put(_HELD_BYTES)
                        size = 0
                        gc.collect()
            put(0)
        for w in writers.values():
            w.close()
        yield pa.RecordBatch.from_pydict({"name": list(uris), "uri": list(uris.values())}, schema=pa.schema([("name", pa.string()), ("uri", pa.string())]))

    return write


def _numbered_ddl(asked: tuple[str, ...]) -> dict[str, str]:
    return {**_NUMBERED, "occurrences": ", ".join([_NUMBERED["occurrences"], *(f"{c} {MADE_IF_ASKED[c]}" for c in asked)])}


def numbered_tables(sources: DataFrame, names: tuple[str, ...] = TABLES[1:], kinds: tuple[str, ...] | None = None, asked: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """``tables_of`` one stored extraction with owners and containers, and a method's ``type``, but with numbers for ids.

    ``kinds`` are the kinds of occurrences that are read (all, if None), and ``asked`` names columns of ``MADE_IF_ASKED``.

    Ids of sources, symbols and occurrences are made of two hashes each, which
    joins would have to shuffle; numbers stand for them one for one and, within a
    file, in their order.  Tasks write each table where it is read, and an index
    of the files that count.
    """
    spark = sources.sparkSession
    root = new_path(spark, "records")
    index = save(_dealt(sources, ("path",)).mapInArrow(_recorder(root, tuple(names), None if kinds is None else frozenset(kinds), tuple(asked)), "name string, uri string"), "index")
    uris: dict[str, list[str]] = {}
    for r in index.collect():  # a few a task
        uris.setdefault(r.name, []).append(r.uri)
    drop(index)
    ddl = _numbered_ddl(tuple(asked))
    return {n: spark.read.schema(ddl[n]).parquet(*uris[n]) if n in uris else spark.createDataFrame([], ddl[n]) for n in ("sources", *names)}


def git_metadata(root: str) -> dict | None:
    """head and dirty of a work tree, or None: the best that can be had."""
    try:
        run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, timeout=20, check=True).stdout.strip()
        return {"head": run("rev-parse", "HEAD"), "dirty": bool(run("status", "--porcelain"))}
    except (OSError, subprocess.SubprocessError):
        return None


def digest(table: DataFrame) -> str:
    """A hash of a table's rows, whatever their order: a sum of row hashes, with the count."""
    columns = sorted(table.columns)
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    row = table.agg(F.count("*").alias("n"), F.sum(h).alias("h")).first()
    return f"{row.n}:{row.h or 0}"


def write_edition(spark: SparkSession, root: str, destination: str, inputs: list[str] | None = None, profile_name: str = "V9") -> dict:
    """Write an edition of ``root`` to a new folder; returns its manifest."""
    return write_sources(read_tree(spark, root, inputs, profile_name), destination, inputs, profile_name, git_metadata(root))


def write_sources(sources: DataFrame, destination: str, inputs: list[str] | None = None, profile_name: str = "V9", git: dict | None = None) -> dict:
    """Write an edition of source rows to a new folder, the manifest last; returns it."""
    spark = sources.sparkSession
    sources.write.mode("errorifexists").parquet(f"{destination}/snapshots")
    stored = spark.read.parquet(f"{destination}/snapshots")
    if stored.isEmpty():
        raise ValueError("nothing to read: no file is one that the profile reads")
    extracted(stored).write.mode("errorifexists").parquet(f"{destination}/extracted")
    tables = tables_of(stored, spark.read.parquet(f"{destination}/extracted"))
    for name, t in tables.items():
        t.write.mode("errorifexists").parquet(f"{destination}/{name}")
    written = {name: spark.read.parquet(f"{destination}/{name}") for name in tables}
    manifest = {"schema_version": 1, "extractor": profile(profile_name).identity, "config": {"inputs": inputs or []}, "git": git, "files": {n: digest(t) for n, t in written.items()},
                "source_count": written["sources"].count(), "symbol_count": written["symbols"].count(), "diagnostic_count": written["diagnostics"].count()}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{destination}/manifest")
    return manifest


def write_graph(edges: DataFrame, destination: str, version: int = 1) -> None:
    """Store a graph's edges with the version of their contract; nothing that is there is overwritten."""
    edges.withColumn("schema_version", F.lit(version)).write.mode("errorifexists").parquet(destination)


def verify_graph(spark: SparkSession, folder: str, rebuilt: DataFrame, versions: tuple[int, ...] = (1,)) -> DataFrame:
    """One row: missing, extra and equal of a stored graph against one built anew; a version that no contract has is an error."""
    stored = spark.read.parquet(folder)
    unknown = F.when(~F.col("schema_version").isin(*versions), F.raise_error(F.lit("unknown graph version"))).otherwise(F.col("schema_version"))
    return records.same_rows(rebuilt, stored.withColumn("schema_version", unknown).where("schema_version is not null").drop("schema_version").select(*rebuilt.columns))


def write_bundle(parts: dict[str, DataFrame], origin: DataFrame, destination: str) -> None:
    """Store a query's parts (dossier, question, query), and what they come from last: a folder without ``origin`` is no bundle."""
    for name, rows in parts.items():
        rows.write.mode("errorifexists").parquet(f"{destination}/{name}")
    origin.write.mode("errorifexists").parquet(f"{destination}/origin")


def read_edition(spark: SparkSession, folder: str, verify: bool = True) -> dict[str, DataFrame]:
    """The edition's tables; with ``verify``, all is computed anew from the stored contents and must be equal."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first().value)
    if manifest["schema_version"] != 1:
        raise ValueError("unknown schema version")
    profile_of = {profile(n).identity for n in ("V9",)}
    if manifest["extractor"] not in profile_of:
        raise ValueError("unknown extractor profile")
    tables = {n: spark.read.parquet(f"{folder}/{n}") for n in TABLES}
    if verify:
        for name, t in tables.items():
            if digest(t) != manifest["files"][name]:
                raise ValueError(f"{name} differs from the manifest")
        stored = spark.read.parquet(f"{folder}/snapshots")
        again = tables_of(sources_of(stored.select("path", "content")), extracted(stored))
        for name, t in again.items():
            if not records.same_rows(t, tables[name]).first().equal:
                raise ValueError(f"{name} can't be derived from the contents")
        if not records.repeated_ids(tables["symbols"], "id").isEmpty():
            raise ValueError("repeated symbol id")
    return tables


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines log; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Add to a log; what is there is never touched."""
    rows.write.mode("append").json(path)


def project_profile(texts: DataFrame) -> DataFrame:
    """The parts of a project's own settings (value, JSON) that the engine reads."""
    schema = "measures map<string, struct<means:string, better:string>>, commands map<string, struct<argv:array<string>, timeout_s:int, `repeat`:int>>, protected array<string>"
    return texts.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("p")).select("p.*")
