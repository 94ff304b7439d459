import json

from pyspark.sql import functions as F

from attesta.functions import code_text as C
from attesta.operators import envelope, provenance


def test_calls_and_arguments():
    cases = {"f(x)": ("", "f"), "a.b.c(x, (1))": ("a.b", "c"), "A::new::<T<u8>>(1)": ("A", "new"), "f(1).g(2)": ("()", "g"), "x": None, "self.m( )": ("self", "m")}
    assert {t: C.call_parts(t) for t in cases} == {t: v and {"receiver": v[0], "name": v[1]} for t, v in cases.items()}
    assert C.arguments("f(a, k=[1, 2], 'x,y', b == 2)") == [{"name": None, "value": "a"}, {"name": "k", "value": "[1, 2]"}, {"name": None, "value": "'x,y'"}, {"name": None, "value": "b == 2"}]
    assert C.arguments("f()") == [] == C.arguments(None)


def test_diffs():
    lines = [f"l{i}" for i in range(1, 21)]
    diff = C.edits_to_diff("p.py", lines, [{"start_line": 4, "end_line": 5, "new": "x\nl5\ny"}, {"start_line": 15, "end_line": 15, "new": ""}])
    hunks = C.parse_patch(diff)
    assert [h["ok"] for h in hunks] == [True, True] and hunks[0]["old_lines"] == lines[0:8] and hunks[1]["new_start"] == hunks[1]["old_start"] + 1
    assert C.file_changes(diff) == [{"path": "p.py", "removed": [4, 15], "added": ["x", "y"]}]
    assert C.line_diff(["a", "b"], ["b", "c"]) == ["-a", " b", "+c"]
    assert not C.parse_patch("+++ b/x\n@@ -1,2 +1,1 @@\n a\n")[0]["ok"]


def test_json():
    assert C.json_leaves('{"a": {"b": [1, {"c": null}]}, "d": []}') == [{"path": "a.b[]", "kind": "int", "value": "1"}, {"path": "a.b[].c", "kind": "null", "value": "null"}, {"path": "d", "kind": "list", "value": "[]"}]
    assert C.json_leaves("{") == []
    assert C.json_groups('{"groups": [["a", "b"]]}') == [["a", "b"]]
    assert C.json_groups('{"groups": [["a", "b"], ["c", "d"], ["e"') == [["a", "b"], ["c", "d"]]


def test_udfs(spark):
    df = spark.createDataFrame([("a.f(x=1)",), (None,)], "t string")
    got = df.select(C.call_parts_of("t").alias("p"), C.arguments_of("t").alias("a")).collect()
    assert got[0].p.receiver == "a" and got[0].a[0].name == "x" and got[1].p is None and got[1].a == []


def test_provenance(spark):
    cards = spark.createDataFrame([("c1", "p", 1, 2), ("c2", "p", 2, 9), ("c3", "q", 1, 1)], "card_id string, path string, start_line int, end_line int")
    sources = spark.createDataFrame([("p", "a\nb\nc\n")], "path string, content string")
    u = provenance.units(cards, sources)
    assert {r.card_id: (r.text, r.error) for r in u.collect()} == {"c1": ("a\nb", None), "c2": (None, "past_the_end"), "c3": (None, "no_source")}
    good = u.where("error is null").select("card_id", "sha256", "text")
    assert provenance.unit_issues(good, good).count() == 0
    assert {r.issue for r in provenance.unit_issues(good.withColumn("text", F.lit("z")), good).collect()} == {"text"}
    docs = spark.createDataFrame([(1, json.dumps({"a": 1, "b": 2}))], "doc_id long, value string")
    classes = spark.createDataFrame([("a", "x"), ("c", "y")], "path string, class string")
    assert {(r.path, r.issue) for r in provenance.classified_leaves(docs, classes).collect()} == {("b", "unclassified"), ("c", "absent")}
    shapes = spark.createDataFrame([(1, 0, None, None), (2, None, 9, None), (3, None, None, "e"), (4, 0, 9, None)], "id int, exit_code int, signal int, error string")
    assert [r["shape"] for r in provenance.result_shape(shapes).orderBy("id").collect()] == ["exited", "signaled", "start_failed", "invalid"]
    answers = spark.createDataFrame([(1, 200, "{}"), (2, 200, " "), (3, 200, "{"), (4, 404, "x"), (5, 503, None)], "id int, status int, content string")
    assert [r.state for r in provenance.response_state(answers).orderBy("id").collect()] == ["ok", "empty", "malformed", "rejected", "unavailable"]
    i = spark.range(1).select(provenance.builder_identity(F.lit("eng 1.2 (abcdef0)")).alias("b")).first().b
    assert tuple(i) == ("eng", "1.2", "abcdef0")


def test_envelope(spark):
    symbols = spark.createDataFrame([("m", "T", False), ("T", None, False), ("g", None, False), ("t", None, True)], "id string, container string, is_test boolean")
    links = spark.createDataFrame([("m", "1", "g", "unique"), ("t", "2", "m", "unique"), ("m", "3", "a", "homonym"), ("m", "3", "b", "homonym")], "caller string, occ_id string, target string, how string")
    chosen = spark.createDataFrame([("m",)], "id string")
    got = envelope.candidates(chosen, envelope.around(chosen, links, symbols))
    assert [(r.id, r.reason) for r in got.orderBy("ordinal").collect()] == [("m", "chosen"), ("T", "owner_type"), ("g", "called"), ("t", "test_caller")]
    settled, gaps = envelope.homonym_gaps(chosen, links, spark.createDataFrame([("b",)], "id string"))
    assert [r.id for r in settled.collect()] == ["b"] and gaps.count() == 0
    lines = spark.createDataFrame([("s", 1, "#"), ("s", 2, "import x"), ("s", 3, " "), ("s", 4, "def f")], "source_id string, line_no int, line string")
    head = envelope.header(spark.createDataFrame([("s", 4)], "source_id string, start_line int"), lines)
    assert [tuple(r) for r in head.collect()] == [("s", 2)]
