import json
import subprocess

import pytest

from attesta.extract import python_code, rust_code
from attesta.operators import code
from attesta.sources import editions
from attesta.streaming import facts

PROJECT = {
    "app/main.py": "import re\nfrom app import store\n\n\ndef run(items):\n    out = []\n    for i in items:\n        re.compile(i)\n        store.save(i)\n        store.save(i)\n    if run in out:\n        pass\n    return sorted(items)\n",
    "app/store.py": "CACHE = {}\n\n\nclass Box:\n    def put(self, x):\n        return self.fit(x)\n\n    def fit(self, x):\n        return abs(x)\n\n\ndef save(x):\n    b = Box()\n    b.put(x)\n    return helper(x)\n\n\ndef helper(x):\n    return x\n",
    "lib/view.rs": "struct View { lock: Mutex<u8> }\nimpl View {\n    fn draw(&self) { for x in self.all() { x.clone(); paint(x); } }\n    fn all(&self) -> Vec<u8> { vec![] }\n}\nfn paint(x: u8) {}\n#[test]\nfn it_paints() { paint(1); }\n",
    "lib/broken.py": "def (\n",
}


@pytest.fixture
def tree(tmp_path):
    for path, text in {**PROJECT, "target/x.py": "a = 1\n", ".hidden/y.py": "b = 1\n", "notes.txt": "hi\n"}.items():
        f = tmp_path / "tree" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return tmp_path / "tree"


def test_edition_is_written_once_and_verified(spark, tree, tmp_path):
    out = str(tmp_path / "edition")
    manifest = editions.write_edition(spark, str(tree), out)
    assert manifest["source_count"] == 4 and manifest["diagnostic_count"] == 1
    tables = editions.read_edition(spark, out)
    assert {r.qualified_name for r in tables["symbols"].where("kind = 'method'").collect()} >= {"Box.put", "impl View::draw"}
    with pytest.raises(Exception, match="already exists"):
        editions.write_edition(spark, str(tree), out)
    tables["symbols"].limit(3).write.mode("overwrite").parquet(str(tmp_path / "fewer"))
    spark.read.parquet(str(tmp_path / "fewer")).write.mode("overwrite").parquet(f"{out}/symbols")
    with pytest.raises(ValueError, match="symbols"):
        editions.read_edition(spark, out)


def test_inputs_and_empty_trees(spark, tree, tmp_path):
    named = {r.path for r in editions.read_tree(spark, str(tree), ["target", "notes.txt"]).collect()}
    assert named == {"target/x.py", "notes.txt"}
    every = editions.read_tree(spark, str(tree))
    assert [r.input for r in editions.suggested_inputs(every).collect()] == ["app", "lib"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.txt").write_text("x")
    with pytest.raises(ValueError, match="nothing"):
        editions.write_edition(spark, str(tmp_path / "none"), str(tmp_path / "e2"))


def test_python_spans():
    content = b"\xef\xbb\xbf# \xc3\xa9\r\n@d\r\nclass A:\r\n    def f(self): return g(1)\r\n"
    found = python_code.extract("s", content)
    a, f = found.symbols
    assert content[a["start"] : a["end"]].startswith(b"@d\r\nclass A") and content[f["start"] : f["end"]] == b"def f(self): return g(1)"
    assert [content[o["start"] : o["end"]] for o in found.occurrences if o["kind"] == "call_observed"] == [b"g(1)"]
    assert [d["code"] for d in python_code.extract("s", b"def (").diagnostics] == ["python_parse_error"]
    assert [d["code"] for d in python_code.extract("s", b"\xff").diagnostics] == ["invalid_utf8"]
    assert python_code.extract("s", b"").symbols == []


def test_rust_spans():
    content = b'/* { /* } */ */ // {\n#[a(b = "}")]\nfn f<\'a>(x: &\'a str) -> R { let c = \'{\'; let s = r#"}"#; g(x) }\n'
    found = rust_code.extract("s", content)
    assert [(s["kind"], s["name"]) for s in found.symbols] == [("function", "f")]
    assert content[found.symbols[0]["start"] :].startswith(b"#[a") and content[: found.symbols[0]["end"]].endswith(b"g(x) }")
    assert [d["code"] for d in rust_code.extract("s", b"fn f( {").diagnostics] == ["rust_parse_error"]
    assert rust_code.body_brace("fn f(x: [u8; 2]) /* { */ -> S { }") == 30
    assert rust_code.body_brace("fn f();") is None


def test_resolved_calls(spark, tree, tmp_path):
    t = editions.tables_of(s := editions.read_tree(spark, str(tree)), editions.extracted(s))
    r = code.resolved_calls(spark, t).join(t["occurrences"].selectExpr("id as occ_id", "label"), "occ_id")
    how = {(x.label, x.how) for x in r.collect()}
    assert {("store.save(i)", "import"), ("helper(x)", "unique"), ("abs(x)", "no_candidate"), ("self.fit(x)", "unique")} <= how


def test_stream_folds_like_the_batch(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [{"seq": 1, "event": "promoted", "id": "F1", "kind": "FACT", "ts": "2024-01-01T00:00:00"}, {"seq": 2, "event": "promoted", "id": "F2", "kind": "CHANGE", "ts": "2024-01-01T00:01:00"}]
    (log / "1.json").write_text("\n".join(map(json.dumps, rows)))
    q = facts.follow(facts.read_events(spark, str(log)), "facts_now", str(tmp_path / "cp"))
    q.processAllAvailable()
    assert {r.id: r.status for r in spark.table("facts_now").collect()} == {"F1": "current", "F2": "proposed"}
    (log / "2.json").write_text(json.dumps({"seq": 3, "event": "revoked", "id": "F1", "kind": "FACT", "ts": "2024-01-01T00:02:00"}))
    q.processAllAvailable()
    assert {r.id: r.status for r in spark.table("facts_now").collect()} == {"F1": "revoked", "F2": "proposed"}
    q.stop()
    batch = editions.read_jsonl(spark, str(log), facts.EVENTS)
    assert {r.id: r.status for r in facts.with_status(facts.folded(batch)).collect()} == {"F1": "revoked", "F2": "proposed"}


def test_windows_of_a_stream(spark, tmp_path):
    log = tmp_path / "w"
    log.mkdir()
    (log / "1.json").write_text("\n".join(json.dumps({"seq": i, "event": "promoted", "id": f"F{i}", "kind": "FACT", "ts": f"2024-01-01T00:0{i}:00"}) for i in range(8)))
    q = facts.per_window(facts.read_events(spark, str(log))).writeStream.outputMode("complete").format("memory").queryName("facts_win").start()
    q.processAllAvailable()
    assert sorted(r.n for r in spark.table("facts_win").collect()) == [3, 5]
    q.stop()


def test_git_metadata(tmp_path):
    assert editions.git_metadata(str(tmp_path)) is None
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "x").write_text("1")
    run("add", "x")
    run("commit", "-q", "-m", "one")
    head = subprocess.run(["git", "-C", str(tmp_path), "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()
    assert editions.git_metadata(str(tmp_path)) == {"head": head, "dirty": False}
    (tmp_path / "x").write_text("2")
    assert editions.git_metadata(str(tmp_path)) == {"head": head, "dirty": True}


def test_membership_and_field_rules(spark):
    from attesta.operators import code, inventory
    from attesta.plans.registry import RULES

    texts = {
        "a.py": "def keep(x):\n    got = []\n    if x in got:\n        return x\n",
        "b.py": "def keep(x, got):\n    got = []\n    if x in got:\n        return x\n",
        "c.py": "def keep(x):\n    got = {}\n    if x in got:\n        return x\n",
    }
    sources = editions.sources_of(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "path string, content binary"))
    t = editions.tables_of(sources, editions.extracted(sources))
    found = inventory.operations(code.with_owners(t["occurrences"], t["symbols"]), t["symbols"], inventory.rule_table(spark, RULES))
    hits = found.where("operation = 'list_membership'").join(t["occurrences"].selectExpr("id as occ_id", "source_id"), "occ_id").join(t["sources"].selectExpr("id as source_id", "path"), "source_id")
    assert [r.path for r in hits.collect()] == ["a.py"]
    symbols = spark.createDataFrame([("f", "field", "s", 0, 20, "rust"), ("g", "field", "s", 30, 50, "rust")], "name string, kind string, source_id string, start long, end long, language string")
    symbols = symbols.withColumn("top_level", symbols["start"] < 0)
    rows = [("1", "call_observed", "Mutex", 5, 9), ("2", "call_observed", "Other", 35, 39), ("3", "attribute_access", "f", 60, 61), ("4", "attribute_access", "g", 70, 71), ("5", "field_assign", "f", 80, 81)]
    occ = spark.createDataFrame([(i, k, c, "s", a, b, "rust", None, "o") for i, k, c, a, b in rows], "id string, kind string, candidate string, source_id string, start long, end long, language string, receiver string, owner string")
    hits = inventory.operations(occ, symbols, inventory.rule_table(spark, RULES)).where("rule = 'lock-field'").collect()
    assert sorted(r.occ_id for r in hits) == ["3", "5"]


def test_named_inputs_and_odd_roots(spark, tmp_path):
    root = tmp_path / "c++ (x)[1]"
    for p in ("a/x.py", "a/node_modules/y.py", "node_modules/z.py", "b/w.txt", "c d/é.rs", ".hidden/h.py"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("x = 1\n")
    paths = lambda *inputs: sorted(r.path for r in editions.read_tree(spark, str(root), list(inputs)).collect())
    assert paths() == ["a/x.py", "c d/é.rs"]
    assert paths("node_modules") == ["node_modules/z.py"] and paths("a/node_modules") == ["a/node_modules/y.py"]
    assert paths("b/w.txt", "a") == ["a/x.py", "b/w.txt"] and paths("nowhere") == []
