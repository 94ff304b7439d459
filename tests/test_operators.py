"""Operators on tiny tables, with the cases that their texts name."""

import random

from pyspark.sql import functions as F

from attesta.operators import claims, graph, intervals, inventory, measures, records, resolve, search


def spans(spark, rows):
    return spark.createDataFrame(rows, "id string, key string, start long, end long")


def test_containers_and_innermost(spark):
    rng = random.Random(1)
    rows = [(f"s{i}", rng.choice("ab"), s, s + rng.randint(0, 40)) for i in range(120) for s in [rng.randint(0, 60)]]
    df = spans(spark, rows)
    pairs = {(r.id, r.outer_id) for r in intervals.containers(df, df, "key").collect()}
    assert pairs == {(i[0], o[0]) for i in rows for o in rows if i[1] == o[1] and o[2] <= i[2] and i[3] <= o[3]}
    got = {r.id: r.outer_id for r in intervals.innermost(df, df, "key", "id", "id").collect()}
    want = {}
    for i in rows:
        around = [(o[3] - o[2], o[0]) for o in rows if o[0] != i[0] and o[1] == i[1] and o[2] <= i[2] and i[3] <= o[3]]
        if around:
            want[i[0]] = min(around)[1]
    assert got == want


def test_merged_touching_and_null_free(spark):
    df = spans(spark, [("1", "a", 0, 5), ("2", "a", 5, 7), ("3", "a", 9, 10), ("4", "a", 1, 2), ("5", "b", 0, 1)])
    assert sorted(tuple(r) for r in intervals.merged(df, "key").collect()) == [("a", 0, 7), ("a", 9, 10), ("b", 0, 1)]
    assert intervals.merged(df.limit(0), "key").count() == 0


def test_name_candidates_cap_and_file_scope(spark):
    sym = [(f"m{i}", "many", "py", "function", "f0", False) for i in range(9)] + [(f"e{i}", "eight", "py", "function", "f0", False) for i in range(8)]
    sym += [("x1", "x", "py", "function", "f1", True), ("x2", "x", "py", "function", "f2", True), ("x3", "x", "rs", "function", "f1", True), ("x4", "x", "py", "class", "f1", True)]
    symbols = spark.createDataFrame(sym, "id string, name string, language string, kind string, source_id string, top_level boolean")
    occ = [("o1", "many", "py", "call", "f0"), ("o2", "eight", "py", "call", "f9"), ("o3", "x", "py", "call", "f1"), ("o4", "x", "py", "call", "f9"), ("o5", None, "py", "call", "f1"), ("o6", "nothing", "py", "call", "f1")]
    occurrences = spark.createDataFrame(occ, "id string, candidate string, language string, kind string, source_id string")
    allowed = spark.createDataFrame([("py", "call", "function"), ("rs", "call", "function")], "language string, occ_kind string, sym_kind string")
    pairs, above = graph.name_candidates(occurrences, symbols, allowed)
    got = {}
    for r in pairs.collect():
        got.setdefault(r.occ_id, set()).add(r.sym_id)
    assert got == {"o2": {f"e{i}" for i in range(8)}, "o3": {"x1"}, "o4": {"x1", "x2"}}
    assert [tuple(r) for r in above.collect()] == [("o1", 9)]


def test_walks_with_cycles_loops_and_leaves(spark):
    edges = spark.createDataFrame([("a", "b", "k"), ("b", "a", "k"), ("b", "b", "k"), ("b", "c", "k"), ("a", "s", "k"), ("s", "z", "k"), ("c", "d", "k")], "from string, to string, kind string")
    nodes = spark.createDataFrame([(x, "source" if x == "s" else "symbol") for x in "abcdsz"], "id string, kind string")
    seed = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.layer for r in graph.neighborhood(edges, nodes, seed, 3).collect()} == {"a": 0, "b": 1, "s": 1, "c": 2, "d": 3}
    assert [r.id for r in graph.neighborhood(edges, nodes, seed, 3, max_nodes=3).orderBy("layer", "id").collect()] == ["a", "b", "s"]
    steps = edges.select(F.col("from").alias("a"), F.col("to").alias("b"))
    entries = spark.createDataFrame([("e", "a", "b")], "entry string, a string, b string")
    assert {(r.node, r.length) for r in graph.shortest_chains(graph.reach(entries, steps)).collect()} == {("b", 1), ("c", 2), ("d", 3)}


def test_calls_from_reports_what_it_does_not_follow(spark):
    rows = [("a", "1", "b", "unique"), ("a", "2", None, "no_candidate"), ("b", "3", "c", "homonym"), ("b", "4", "d", "type"), ("d", "5", None, "above_limit")]
    resolved = spark.createDataFrame(rows, "caller string, occ_id string, target string, how string")
    found, open_ = graph.calls_from(resolved, spark.createDataFrame([("a",)], "id string"), 3)
    assert {r.id for r in found.collect()} == {"a", "b", "d"}
    assert {(r.occ_id, r.reason) for r in open_.collect()} == {("2", "no_candidate_in_project"), ("3", "homonym"), ("5", "above_candidate_limit")}


def test_cascade_precedence(spark):
    calls = spark.createDataFrame([(f"o{i}", "c") for i in range(5)], "occ_id string, caller string")
    t = lambda *rows: spark.createDataFrame(list(rows), "occ_id string, target string")
    rules = {"unique": t(("o0", "u")), "receiver": t(("o0", "r"), ("o1", "r")), "type": t(("o1", "t"), ("o2", "t1"), ("o2", "t2")), "homonym": t(("o2", "h"))}
    got = {(r.occ_id, r.how, r.target) for r in resolve.cascade(calls, rules, above=t(("o3", "x")).select("occ_id")).collect()}
    assert got == {("o0", "unique", "u"), ("o1", "receiver", "r"), ("o2", "type", "t1"), ("o2", "type", "t2"), ("o3", "above_limit", None), ("o4", "no_candidate", None)}
    sources = spark.createDataFrame([("1", "a/b.py"), ("2", "a/c/__init__.py"), ("3", "x/b.py"), ("4", "r.rs")], "id string, path string")
    files = {r.dotted: r.source_id for r in resolve.module_files(sources).collect()}
    assert files == {"a.b": "1", "a.c": "2", "c": "2", "x.b": "3"}


def test_search_coverage_and_tests(spark):
    docs = spark.createDataFrame([(1, "sendMail", "mail code"), (2, "test_mail", "send letters"), (3, "other", "nothing here")], "id long, name string, body string")
    index = search.postings(docs, "id", {"name": "name", "code": "body"})
    q = spark.createDataFrame([(7, "how to send the mail")], "question_id long, question string")
    lexicon = spark.createDataFrame([("g", "mail"), ("g", "letters")], "group string, token string")
    tests = spark.createDataFrame([(2,)], "id long")
    rows = {r.doc_id: (r.matched, r.score) for r in search.scored(index, search.query_groups(q, lexicon), tests).collect()}
    assert rows == {1: (2, 216), 2: (2, 200 + 8 + 1 - 20)}
    assert search.status(q, search.scored(index, search.query_groups(q, lexicon), tests), 11, 0).first().status == "rejected"


def test_measure_lines(spark):
    lines = ["attesta-measure a=1", " attesta-measure a.b=2e3 ms at=src/x.rs:4", "attesta-measure a=inf", "attesta-measure a=1 at=/x:1", "attesta-measure a=1 at=x:0", "attesta-measure a=1 at=..:3",
             "attesta-measure =1", "attesta-measure a", "attesta-measurea=1", "attesta-measure a=1 at=x:1 at=y:1", "attesta-measure a=-.5 s extra", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r.i: (r.name, r.value, r.unit, r["at"], r.series) for r in measures.parse_lines(df).collect()}
    assert got == {0: ("a", 1.0, None, None, "a"), 1: ("a.b", 2000.0, "ms", "src/x.rs:4", "a.b@src/x.rs:4"), 10: ("a", -0.5, "s", None, "a")}


def test_comparison_and_gate(spark):
    s = "change long, series string, median double, min double, max double"
    base = spark.createDataFrame([(1, "calls@f", 100.0, 100.0, 100.0), (1, "t_ms", 10.0, 9.0, 11.0), (2, "calls@f", 100.0, 100.0, 100.0), (1, "zero", 0.0, 0.0, 0.0)], s)
    now = spark.createDataFrame([(1, "calls@f", 94.0, 94.0, 94.0), (1, "t_ms", 8.0, 7.5, 8.5), (2, "calls@f", 106.0, 106.0, 106.0), (1, "zero", 3.0, 3.0, 3.0)], s)
    c = measures.compared(base, now, ["change", "series"])
    rows = {(r.change, r.series): (r.change_pct, r.ranges_overlap) for r in c.collect()}
    assert rows == {(1, "calls@f"): (-6.0, False), (1, "t_ms"): (-20.0, False), (2, "calls@f"): (6.0, False), (1, "zero"): (None, False)}
    n = measures.project_numbers(c, F.lit(None).cast("string"))
    ex = spark.createDataFrame([(1, 3, 3, 0, 0), (2, 3, 3, 0, 0)], "change long, attempted long, succeeded long, issues long, stopped long")
    out = spark.createDataFrame([(1, "same")], "change long, state string")
    v = {r.change: (r.passed, r.n_issues, r.dropped) for r in measures.verdict(ex, c, out, n, ["change"]).collect()}
    assert v == {1: (True, 0, True), 2: (False, 1, False)}
    assert {r.change: r.gain for r in measures.gain(c, n, ["change"]).collect()} == {1: 20.0, 2: -6.0}


def test_fact_log(spark):
    log = [(1, "promoted", "F1", "FACT"), (2, "revoked", "F1", "FACT"), (3, "promoted", "F1", "FACT"), (4, "promoted", "F2", "FACT"), (5, "revoked", "F2", "FACT"), (6, "revoked", "F9", "FACT"), (7, "promoted", "F3", "CHANGE"), (8, "promoted", "F4", "FACT")]
    events = spark.createDataFrame(log, "seq long, event string, id string, kind string")
    holds = spark.createDataFrame([("F1", True), ("F4", False)], "id string, holds boolean")
    got = {r.id: r.status for r in records.fact_status(events, holds).collect()}
    assert got == {"F1": "current", "F2": "revoked", "F3": "proposed", "F4": "stale"}


def test_greedy_skips_and_goes_on(spark):
    items = spark.createDataFrame([("k", 1, 60), ("k", 2, 50), ("k", 3, 40), ("k", 4, 1), ("j", 1, 500)], "key string, n int, size int")
    taken = {(r.key, r.n) for r in records.greedy(items, ["key"], [F.col("n")], "size", 100).where("taken").collect()}
    assert taken == {("k", 1), ("k", 3)}
    few = records.greedy(items, ["key"], [F.col("n")], "size", 1000, max_items=1, always=F.col("n") == 4).where("taken").collect()
    assert {(r.key, r.n) for r in few} == {("k", 1), ("k", 4), ("j", 1)}


def test_claims_against_evidence(spark):
    evidence = spark.createDataFrame([("e", "p", 10, 12, ["a", "b", "c"])], "id string, path string, start_line int, end_line int, lines array<string>")
    cites = [("1", "e", "p", 10, 11, "a\nb"), ("2", "e", "q", 10, 10, "a"), ("3", "x", "p", 10, 10, "a"), ("4", "e", "p", 9, 10, "a"), ("5", "e", "p", 11, 12, "b\nC"), ("6", "e", "p", 12, 11, "")]
    df = spark.createDataFrame(cites, "claim_id string, evidence_id string, path string, start_line int, end_line int, quote string")
    got = {r.claim_id: r.code for r in claims.citation_issues(df, evidence).collect()}
    assert got == {"2": "wrong_path", "3": "unknown_evidence", "4": "outside_evidence", "5": "quote_differs", "6": "outside_evidence"}
    rows = [("1", True), ("2", True), ("3", True), ("4", False)]
    made = spark.createDataFrame([(i, "HYPOTHESIS", e) for i, e in rows], "id string, kind string, has_edits boolean")
    edits = [("1", 1, "replace", "p", 10, 10, ["z"]), ("1", 2, "replace", "p", 10, 11, ["("]), ("2", 1, "replace", "p", 12, 12, ["c"]), ("3", 1, "replace", "r", 1, 1, ["b"])]
    e = spark.createDataFrame(edits, "claim_id string, edit_no int, op string, path string, start_line int, end_line int, new_lines array<string>")
    said = spark.createDataFrame([("1", "p", 10, 11)], "claim_id string, path string, start_line int, end_line int")
    found = {(r.claim_id, r.code) for r in claims.edit_issues(made, e, said, evidence, spark.createDataFrame([], "path string, declaration_line int, end_line int")).collect()}
    assert found == {("1", "edits_overlap"), ("1", "edits_unbalanced"), ("2", "edits_no_change"), ("2", "edits_change_uncited_lines"), ("3", "edits_unknown_path")}
    assert {r.code for r in claims.edit_issues(made, e, said, evidence, evidence.select("path", evidence["start_line"].alias("declaration_line"), "end_line"), allowed=False).collect()} == {"edits_not_allowed"}


def test_compared_answers(spark):
    rows = [("a", "FACT", "x  Y", "p", 1, 2), ("b", "FACT", "X y", "p", 1, 2), ("c", "FACT", "other", "p", 2, 5), ("d", "FACT", "far", "q", 1, 1)]
    df = spark.createDataFrame(rows, "answer_id string, kind string, text string, path string, start_line int, end_line int")
    got = claims.compared_answers(df).collect()
    first = {r.answer_id: r.state for r in got if r.shared == 2}
    assert first == {"a": "equal", "b": "equal", "c": "partial", "d": "absent"} and len(got) == 12


def test_rules(spark):
    rules = inventory.rule_table(spark, [("r", "io", "python", "call", ["open"], []), ("r", "io", None, "call", [], []), ("w", "w", None, "module_write", [], [])])
    assert {(r.id, r.issue) for r in inventory.rule_issues(rules).collect()} == {("r", "repeated_id"), ("r", "no_names")}


def test_partition_and_diff(spark):
    t = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    issues = records.partition_issues({"a": t(1, 2), "b": t(2, 3)}, "id", t(1, 4))
    assert {(r.id, r.issue) for r in issues.collect()} == {(2, "several"), (4, "absent")}
    p = lambda *r: spark.createDataFrame(list(r), "path string, sha string")
    assert {r.path: r.state for r in records.changed(p(("a", "1"), ("b", "2"), ("c", "3")), p(("a", "1"), ("b", "9"), ("d", "4")), "path", "sha").collect()} == {"a": "same", "b": "changed", "c": "unavailable", "d": "added"}


def test_measure_states_and_lacunas(spark):
    t = lambda cols, *rows: spark.createDataFrame(list(rows), cols)
    commands = t("name string, sha256 string", ("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("e", "1"))
    approved = t("name string, sha256 string", ("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("e", "0"))
    runs = t("name string, sha256 string, succeeded int", ("a", "1", 2), ("b", "0", 2), ("d", "1", 0))
    got = {r.name: r.state for r in records.measure_states(commands, approved, runs).collect()}
    assert got == {"a": "available", "b": "stale", "c": "not_run", "d": "failed", "e": "not_approved"}
    symbols = t("id string, name string, qualified_name string, kind string", ("1", "Box", "Box", "class"), ("2", "put", "Box::put", "method"), ("3", "put", "Bag::put", "trait_method"), ("4", "f", "f", "function"))
    names = t("ordinal int, name string", (1, "Box"), (2, "Box::put"), (3, "put"), (4, "zzz"))
    found = [(r.ordinal, r.symbol_id, r.how) for r in search.lacuna_targets(names, symbols, 10).orderBy("ordinal").collect()]
    assert sorted(found) == [(1, "1", "type"), (2, "2", "exact"), (3, "2", "method"), (3, "3", "method")]
    assert search.lacuna_targets(names, symbols, 2).count() == 2
