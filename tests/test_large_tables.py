"""What larger tables than the smallest ones need: no caps, no table of input rows sent to every worker, work dealt to all tasks."""

import gc

import pytest
from pyspark.sql import functions as F

from attesta import queries
from attesta.extract import python_code, rust_code
from attesta.operators import code, envelope, graph, inventory
from attesta.plans import code_plans
from attesta.sources import editions


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of part, supplier and nation of the given numbers of rows, each one small file."""

    def make(parts: int, suppliers: int = 3) -> str:
        part = spark.range(parts).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"))
        supplier = spark.range(suppliers).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).cast("int").alias("s_nationkey"))
        nation = spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"))
        for name, rows in (("part", part), ("supplier", supplier), ("nation", nation)):
            rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_claim_edits_broadcasts_no_side(spark, tables):
    plan = plan_of(queries.QUERIES["claim_edits"](spark, tables(200)))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_lacuna_targets_are_not_capped(spark, tables):
    parts = 60_000
    found = queries.QUERIES["lacuna_targets"](spark, tables(parts)).collect()
    assert len(found) > 1000
    types = [(n, p) for n in range(0, 25, 2) for p in range(n, parts, 97) if p % 5 == 0]
    assert sorted((r.ordinal, r.symbol_id) for r in found if r.how == "type") == types


def test_code_project_is_dealt_before_extraction(spark, tables):
    """A table's one small file would be one task, however many files the project has."""
    d = tables(300)
    files = code_plans.project(spark, d)
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    found = editions.extracted(editions.sources_of(files.coalesce(1)), ("diagnostics",))
    used = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert found.columns == ["source_id", "language", "diagnostics"] and used >= spark.sparkContext.defaultParallelism


def test_records_are_those_of_the_interval_operators(spark, tables):
    """Owners and containers that an extraction gives are those of ``innermost``, and a repeated source is read once."""
    sources = editions.sources_of(code_plans.project(spark, tables(30)))
    found = editions.extracted(sources.unionByName(sources), nested=True)
    t, plain = editions.tables_of(sources, found, nested=True), editions.tables_of(sources, found)
    assert "owner" not in plain["occurrences"].columns and "container" not in plain["symbols"].columns
    for given, made in ((t["symbols"], code.with_containers(plain["symbols"])), (code.with_owners(t["occurrences"], t["symbols"]), code.with_owners(plain["occurrences"], plain["symbols"]))):
        a, b = (sorted(map(repr, rows.select(sorted(given.columns)).collect())) for rows in (given, made))
        assert a == b and len(a) > 100


def test_around_of_crossing_and_equal_spans():
    spans = [{"kind": k, "start": a, "end": b} for k, a, b in (("class", 0, 9), ("impl", 0, 9), ("class", 3, 12), ("module", 0, 30), ("class", 4, 6), ("class", 40, 41))]
    assert editions.around(spans, spans) == ["impl:0:9", "class:0:9", "module:0:30", None, "class:0:9", None]


def test_extraction_of_some_records_is_part_of_the_whole():
    text = b"import re\nA = 1\n\n\ndef f(x):\n    y = [z for z in x]\n    with g() as (a, b):\n        for c.d, e in y:\n            re.compile(a)\n\n    def h(k=0):\n        w: int = k\n        return (n := w)\n    return h\n"
    whole = python_code.extract("s", text)
    assert {b["head"] for b in whole.bindings} == {"re", "x", "y", "z", "a", "b", "e", "k", "w", "n"}
    for name in python_code.RECORDS:
        part = python_code.extract("s", text, (name,))
        assert getattr(part, name) == getattr(whole, name)
        assert not any(getattr(part, n) for n in python_code.RECORDS if n != name)


def test_numbered_tables_are_those_of_ids(spark, tables):
    """Numbers stand for ids one for one, and owners, containers and types are those of the interval operators."""
    sources = editions.sources_of(code_plans.project(spark, tables(30)))
    plain = editions.tables_of(sources, editions.extracted(sources))
    t = editions.numbered_tables(sources.unionByName(sources))
    names = {r.n: r.id for r in t["symbols"].join(t["sources"].select(F.col("id").alias("source_id"), "path"), "source_id").select(F.col("id").alias("n"), F.concat_ws(":", "path", "kind", "start", "end").alias("id")).collect()}
    assert len(names) == len(set(names.values())) == plain["symbols"].count()
    paths = sources.select(F.col("id").alias("source_id"), "path")
    by_id = {r.id: r.n for r in plain["symbols"].join(paths, "source_id").select("id", F.concat_ws(":", "path", "kind", "start", "end").alias("n")).collect()}
    for table, at in (("symbols", "container"), ("occurrences", "owner")):
        whole = (code.with_containers if at == "container" else lambda s: code.with_owners(s, plain["symbols"]))(plain[table])
        columns = [c for c in t[table].columns if c not in ("id", "source_id", at, "type")]
        a = sorted(map(repr, [(*r[:-1], names.get(r[-1])) for r in t[table].select(*columns, at).collect()]))
        assert a == sorted(map(repr, [(*r[:-1], by_id.get(r[-1])) for r in whole.select(*columns, at).collect()])) and len(a) > 100
    assert {str(f.dataType) for f in t["occurrences"].schema if f.name in ("id", "source_id", "owner")} == {"LongType()"}
    a = sorted((names[r.type], names[r.id]) for r in envelope.owner_methods(t["symbols"]).collect())
    assert a == sorted((by_id[r.type], by_id[r.id]) for r in envelope.owner_methods(plain["symbols"]).collect()) and a


def test_numbers_have_the_order_of_ids_and_crossing_spans():
    spans = [{"id": f":{k}:{a}:{b}", "kind": k, "start": a, "end": b} for k, a, b in (("class", 0, 9), ("impl", 0, 9), ("class", 3, 12), ("module", 0, 30), ("class", 4, 6), ("class", 40, 41), ("class", 4, 6))]
    rows, numbers, last = editions._numbers(spans, 7)
    assert rows == spans[:-1] and last == 13 and [r["id"] for _, r in sorted(zip(numbers, rows), key=lambda x: x[0])] == sorted(r["id"] for r in rows)
    spans = rows
    of = {n: f"{s['kind']}:{s['start']}:{s['end']}" for n, s in zip(numbers, spans)} | {None: None}
    numbered = [(s["start"], s["end"], n) for s, n in zip(spans, numbers)]
    assert [of[n] for n in editions._around(numbered, numbered)] == editions.around(spans, spans)


def test_code_tables_are_joined_by_numbers(spark, tables):
    """Ids of two hashes in each joined row were most of what was shuffled."""
    d = tables(30)
    for query in ("code_owner_methods", "code_trait_impls"):
        assert "src:" not in plan_of(queries.QUERIES[query](spark, d))
    t = code_plans._tables(spark, d, "symbols", "occurrences")
    assert set(t) == {"sources", "symbols", "occurrences"} and dict(t["occurrences"].dtypes)["id"] == "bigint"


def test_headers_and_lines_come_with_their_file(spark, tables):
    d = tables(30)
    headers = plan_of(queries.QUERIES["code_headers"](spark, d))
    assert "Join" not in headers and "Generate" not in headers
    lines = spark.createDataFrame([(["", "# a", " ", "class A:", "x"], 4), (["class A:"], 1), (["", "  ", "x"], 3), (["a"], None)], "lines array<string>, first bigint")
    assert [r.n for r in lines.select(envelope.header_line(F.col("lines"), F.col("first")).alias("n")).collect()] == [2, None, None, None]
    assert "substring" not in plan_of(queries.QUERIES["code_occurrences"](spark, d))
    text = b"\xef\xbb\xbfdef f(x):\r\n    return [g(y)\n for y in x]\n"
    assert all(o["line"] == text[: o["start"]].count(b"\n") + 1 for o in python_code.extract("", text).occurrences)
    rust = b"fn f() {\n for x in y {\n  g(x);\n }\n}\n"
    assert [o["line"] for o in rust_code.extract("", rust).occurrences if o["kind"] == "call_observed"] == [3]


def test_extraction_searches_no_cycles_and_restores_that():
    was = gc.isenabled()
    with editions._cycles_left():
        assert not gc.isenabled()
    assert gc.isenabled() == was


def test_made_columns_are_those_of_the_operators(spark, tables):
    """Loops, written types and imports that an extraction gives are those of the operators on whole tables, and calls resolve alike."""
    sources = editions.sources_of(code_plans.project(spark, tables(30)))
    sources = sources.unionByName(editions.sources_of(spark.createDataFrame([("p1/odd.py", bytearray(b"import re as r\n\n\ndef f(xs):\n    while xs:\n        for a in (b for b in g(xs)):\n            r.sub(a)\n            [r.x(c) for c in h(a)]\n    r = 1\n    return r.y()\n")), ("p2/own.py", bytearray(b"import p1.odd as odd\n\n\ndef k(x: Box1):\n    return odd.f(x.put1(1)), x.put1(2)\n"))], "path string, content binary")))
    whole = editions.numbered_tables(sources)
    t = editions.numbered_tables(sources, ("symbols", "occurrences"), asked=("loops", *code.SEEN))
    key = lambda t: t["occurrences"].join(t["sources"].select(F.col("id").alias("source_id"), "path"), "source_id").select("id", F.concat_ws(":", "path", "kind", "start", "end").alias("at"))
    at, made = {r.id: r["at"] for r in key(whole).collect()}, {r.id: r["at"] for r in key(t).collect()}
    loops = inventory.loops_of(whole["occurrences"])
    odd = [r for r in inventory.in_loops(whole["occurrences"], loops).select("id", "outer_id").collect() if not at[r.outer_id].startswith("p1/odd")]
    mine = [r for r in inventory.in_loops(t["occurrences"], loops).select("id", "outer_id").collect() if not made[r.outer_id].startswith("p1/odd")]
    assert sorted((at[r.id], at[r.outer_id]) for r in odd) == sorted((made[r.id], made[r.outer_id]) for r in mine) and len(mine) > 100
    calls = []
    for tables_, names in ((whole, at), (t, made)):
        target = tables_["symbols"].join(tables_["sources"].select(F.col("id").alias("source_id"), "path"), "source_id").select(F.col("id").alias("target"), F.concat_ws(":", "path", "kind", "start", "end").alias("to"))
        rows = code.resolved_calls(spark, tables_).join(target, "target", "left").collect()
        calls.append(sorted((names[r.occ_id], r.how, r.to or "") for r in rows))
    assert calls[0] == calls[1] and {how for _, how, _ in calls[0]} >= {"unique", "import", "receiver", "type", "no_candidate"}


def test_candidate_lists_are_name_candidates(spark):
    symbols = spark.createDataFrame([(n, name, kind, "python", n % 3, n % 2 == 0) for n, name, kind in [*((i, "many", "function") for i in range(12)), *((20 + i, "few", "function") for i in range(3)), (40, "few", "method")]], "id long, name string, kind string, language string, source_id long, top_level boolean")
    occurrences = spark.createDataFrame([(100 + i, name, kind, "python", i % 4) for i, (name, kind) in enumerate((n, k) for n in ("many", "few", "none", None) for k in ("call_observed", "method_call_observed", "other") for _ in range(4))], "id long, candidate string, kind string, language string, source_id long")
    allowed = spark.createDataFrame([("python", "call_observed", "function"), ("python", "method_call_observed", "function"), ("python", "method_call_observed", "method")], "language string, occ_kind string, sym_kind string")
    for cap in (1, 8):
        pairs, above = graph.name_candidates(occurrences, symbols, allowed, cap)
        lists = graph.candidate_lists(occurrences, symbols, allowed, ("name",), cap)
        assert lists.count() == occurrences.count()
        assert sorted(lists.select("id", F.explode("candidates.sym_id")).collect()) == sorted(pairs.collect()) and pairs.count() > 0
        assert sorted(lists.where(F.col("n") > cap).select("id", "n").collect()) == sorted(above.collect()) and above.count() > 0


def test_code_queries_extract_what_they_read(spark, tables):
    d = tables(30)
    t = code_plans._call_tables(spark, d)
    assert {r.kind for r in t["occurrences"].select("kind").distinct().collect()} == set(code_plans.CALLED)
    for query in ("code_inventory", "code_bindings", "code_trait_impls", "code_hot_operations"):
        plan = plan_of(queries.QUERIES[query](spark, d))
        assert "substring" not in plan and "content" not in plan.split("MapInArrow")[0]
    assert "Join" not in plan_of(queries.QUERIES["code_inventory"](spark, d))
    assert inventory.rule_table(spark, [("a'", "o", None, "call", ["\u00e9"], [])]).collect() == [("a'", "o", None, "call", ["\u00e9"], [])]


def test_declarations_are_the_symbols_of_the_whole_extraction(spark, tables):
    """``code_symbols`` makes only its columns, row for row those of the table of symbols, without an array for each file."""
    text = b"""\xef\xbb\xbfA = B, [C, *D] = E.f = 1; A = 2
@a
@(
    b)
class TestX(Y, k=0):
    n: int = 0
    m, self.q = 1, 2
    def test_a(self, x=lambda: 0):
        self.n, (self.m, z) = self.k.l = x
        if x:
            self.o: int = 1
        elif y:
            def f(): self.p = g = 1
        for self.r in x:
            try:
                self.s = 1
            except E:
                self.t = (\n 1)
            else:
                class In: v = w = 1
            finally:
                async def test_h(): pass
        match x:
            case [u]:
                self.u = [e for e in x]
        with a as self.v:
            self.w += 1
while A:
    T = (n := 1)
else:
    import t

    @c
    async def test_i(): U = 1
"""
    for content in (text, text.replace(b"\n", b"\r\n"), b"", b"def (", b"\xff", b"if 0: pass\n" + b"elif 1: A = 1\n" * 50):
        whole = [tuple(r[c] for c in python_code.DECLARATION) for r in python_code.extract("s", content).symbols]
        assert python_code.declarations(content) == whole and (len(whole) > 20 or len(content) < 10 or len(whole) == 50)
    d = tables(30)
    sources = editions.sources_of(code_plans.project(spark, d))
    symbols = editions.tables_of(sources, editions.extracted(sources, ("symbols",)))["symbols"].select(*python_code.DECLARATION)
    query = queries.QUERIES["code_symbols"](spark, d)
    assert "Generate" not in plan_of(query) and "sha256" not in plan_of(query)
    for found in (query, editions.declared(sources.unionByName(sources))):
        assert found.dtypes == symbols.dtypes and sorted(found.collect()) == sorted(symbols.collect()) and found.count() > 200
