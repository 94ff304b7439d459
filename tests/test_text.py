import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.functions import text as T

CASES = [None, "", "getHTTPResponse2Ray_x", "aBcD", "Ação não", "e\u0301tude", "123", "a\r\nb\rc\n", "x\n\n", "\n", "one", "日本語 é🎉" * 60]


def values(spark, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string")
    return [r[1] for r in rows.select("i", column(F.col("t"))).orderBy("i").collect()]


def plain_tokens(text):
    out = ""
    for i, c in enumerate(text or ""):
        if c.isupper() and i and (text[i - 1].islower() or text[i - 1].isnumeric() or (text[i - 1].isupper() and i + 1 < len(text) and text[i + 1].islower())):
            out += " "
        c = c.lower()[0]
        c = dict(zip(T.ACCENTED, T.FOLDED)).get(c, c)
        if "\u0300" <= c <= "\u036f":
            continue
        out += c if c.isalpha() or c.isnumeric() else " "
    return out.split()


def test_tokens(spark):
    assert values(spark, T.tokens) == [plain_tokens(t) for t in CASES]


def test_lines(spark):
    def plain(t):
        if t is None:
            return None
        parts = t.split("\n")
        parts = parts[:-1] if parts[-1] == "" else parts
        return [p[:-1] if p.endswith("\r") else p for p in parts]

    assert values(spark, T.split_lines) == [plain(t) for t in CASES]


def test_windows(spark):
    lines = F.array(*map(F.lit, ["a", "b", "", "c"]))
    got = spark.range(1).select(*(T.window_of_lines(lines, F.lit(s), F.lit(e)) for s, e in ((1, 2), (2, 4), (0, 1), (3, 2), (4, 5))), T.trimmed_window(lines, F.lit(2), F.lit(3)), T.window_error(lines, F.lit(3), F.lit(2))).first()
    assert list(got) == ["a\nb", "b\n\nc", None, None, None, "b", "reversed"]


def test_cut_bytes(spark):
    for limit in (1, 4, 7, 160):
        want = [None if t is None else t.encode()[:limit].decode(errors="ignore") for t in CASES]
        assert values(spark, lambda c, n=limit: T.cut_bytes(c, n)) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=30))
def test_cut_bytes_any_text(spark, texts):
    texts = [unicodedata.normalize("NFC", t).encode(errors="ignore").decode() for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.cut_bytes(F.col("t"), 9)).orderBy("i").collect()
    assert [r[1] for r in rows] == [t.encode()[:9].decode(errors="ignore") for t in texts]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_names_and_fences(spark):
    assert one(spark, T.lacuna_names(F.lit("needs `a.b`, Foo::bar, run() and BigThing; `a.b`"))) == ["a.b", "Foo::bar", "run", "BigThing"]
    assert one(spark, T.fenced(F.lit("x\n```json\n{1}\n```\n"))) == "{1}"
    assert one(spark, T.fenced(F.lit("```\na\n```\n```\nb\n```"))) is None
    assert one(spark, T.fenced(F.lit("plain"))) == "plain"
    assert tuple(one(spark, T.impl_parts(F.lit("impl<T> fmt::Display for Box<T>")))) == ("Box", "Display")
    assert tuple(one(spark, T.impl_parts(F.lit("impl View")))) == ("View", None)
    assert one(spark, T.last_segment(F.lit("a::b::C<d::E>"))) == "C"
    assert one(spark, T.mentioned_lines(F.lit("see line 12, Linhas 7 and lines x"))) == [12, 7]
    assert one(spark, T.diff_files(F.lit("--- a/x\n+++ b/x y.py\n@@\n+++ c\n+++ b/z\n"))) == ["x y.py", "z"]
    assert one(spark, T.tail(F.lit("abcdef"), 2)) == "ef"


def test_appears(spark):
    span = F.lit("let a = 1;\n  let b = 2;\n let c = 3;")
    got = [one(spark, T.appears(F.lit(x), span)) for x in ("let a = 1; let b", "let a ... let c", "let c … let a", "...", "zzz")]
    assert got == [True, True, False, False, False]


def test_paths(spark):
    paths = ["a/b.py", "/a", "a//b", "a/../b", "./a", "a\\b", "c:x", "", "x.rs", "n"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").select("i", T.path_is_safe(F.col("p")), T.language_of(F.col("p"))).orderBy("i").collect()
    assert [r[1] for r in rows] == [True, False, False, False, False, False, False, False, True, True]
    assert [rows[i][2] for i in (0, 8, 9)] == ["python", "rust", "auxiliary"]
    assert re.fullmatch("over_context|truncated", one(spark, T.input_suspicion(F.lit(4000), F.lit(100), F.lit(1000))))


def test_identifiers_and_model_files(spark):
    got = [one(spark, T.identifier_column(F.lit("fn fab(fa: A) {}"), F.lit(n))) for n in ("fa", "fab", "fn", "z")]
    assert got == [8, 4, 1, 0]
    file = 'FROM x\nPARAMETER num_ctx 8192\nSYSTEM """a\n$1 b"""\n'
    assert one(spark, T.modelfile_parameter(F.lit(file), "num_ctx")) == "8192" and one(spark, T.modelfile_parameter(F.lit(file), "seed")) is None
    assert one(spark, T.modelfile_system(F.lit(file))) == "a\n$1 b" and one(spark, T.modelfile_system(F.lit("SYSTEM hi\n"))) == "hi"
    assert one(spark, T.with_system(F.lit(file), F.lit("new $2 \\ c"))) == 'FROM x\nPARAMETER num_ctx 8192\nSYSTEM """new $2 \\ c"""\n'
    assert one(spark, T.with_system(F.lit("FROM x"), F.lit("s"))) == 'FROM x\nSYSTEM """s"""\n'
