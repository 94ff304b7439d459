"""Queries on scalar functions of text, code and diffs, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import code_text as C
from attesta.functions import text as T
from attesta.operators import intervals, provenance
from attesta.plans.tables import table


def _part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.split("p_name", " ").alias("words"))


def _number(c: str = "k") -> F.Column:
    return F.col(c).cast("string")


def identifier_places(spark: SparkSession, d: str) -> DataFrame:
    """Where a part's first word, its last or an end of its first stands in its name as a whole word; and its trailing identifier."""
    word = F.when(F.col("k") % 3 == 0, F.col("words")[0]).when(F.col("k") % 3 == 1, F.element_at("words", -1)).otherwise(F.substring(F.col("words")[0], 2, 99))
    p = _part(spark, d).withColumn("word", word)
    return p.select("k", T.identifier_column(F.col("name"), F.col("word")).cast("long").alias("place"), T.trailing_identifier(F.col("name")).alias("last"))


def annotation_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that may stand above a declaration, of lines that begin in eight ways."""
    starts = F.array(*map(F.lit, ["@", "  # ", "// ", " /* ", "* ", "let ", "", "x#"]))
    p = _part(spark, d).withColumn("line", F.concat(F.element_at(starts, (F.col("k") % 8 + 1).cast("int")), F.when(F.col("k") % 8 == 6, F.lit("  ")).otherwise(F.col("name"))))
    return p.select("k", T.is_annotation(F.col("line")).alias("annotation"))


def decoded_urls(spark: SparkSession, d: str) -> DataFrame:
    """Percent-encoded addresses; every third with a broken escape."""
    coded = F.replace(F.replace("url", F.lit("/"), F.lit("%2F")), F.lit(":"), F.lit("%3a"))
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(coded, F.lit("%zz"))).otherwise(coded).alias("c"))
    return p.select("page_id", T.percent_decoded(F.col("c")).alias("url"))


def numbers_written(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.thousands(F.col("n_chars") * 1009).alias("written"))


def owner_name_forms(spark: SparkSession, d: str) -> DataFrame:
    p = _part(spark, d).withColumn("owned", F.concat(F.col("words")[0], F.lit("<T>::"), F.element_at("words", -1), _number()))
    return p.select("k", F.array_join(T.owner_forms(F.col("owned")), " ").alias("forms"))


def sentences_and_ends(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of whole texts, their last hundred characters, and their bytes with line ends as LF."""
    text = F.col("text")
    crlf = F.replace(text, F.lit("\n"), F.lit("\r\n"))
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(text)).cast("long").alias("n"), T.tail(text, 100).alias("tail"), T.sha256_hex(T.lf(crlf)).alias("sha"))


def line_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Lines and names in backticks that a written sentence mentions."""
    said = F.concat(F.lit("See `"), F.col("words")[0], F.lit("` on line "), _number(), F.lit(" and Lines "), (F.col("k") + 1).cast("string"), F.lit(", linha 7"))
    p = _part(spark, d).withColumn("said", said)
    return p.select("k", F.array_join(T.mentioned_lines(F.col("said")).cast("array<string>"), ",").alias("lines"), F.array_join(T.backticked(F.col("said")), ",").alias("names"))


def call_forms(spark: SparkSession, d: str) -> DataFrame:
    """Receiver and name of calls written in five ways."""
    n = _number()
    ways = [F.concat(F.lit("go"), n, F.lit("(x)")), F.concat(F.lit("a.b.go"), n, F.lit("(x, (y))")), F.concat(F.lit("f(x).go"), n, F.lit("(y)")), F.concat(F.lit("Vec::<u8>::go"), n, F.lit("::<T>(x)")), F.concat(F.lit("go"), n)]
    p = _part(spark, d).select("k", F.element_at(F.array(*ways), (F.col("k") % 5 + 1).cast("int")).alias("call"))
    return p.select("k", C.call_parts_of("call").alias("p")).select("k", "p.receiver", "p.name")


def argument_lists(spark: SparkSession, d: str) -> DataFrame:
    """Arguments with brackets, strings and names."""
    call = F.concat(F.lit("f(a"), _number(), F.lit(", b="), _number(), F.lit(", g(c, d), 'x,y', e==2)"))
    p = _part(spark, d).select("k", F.posexplode(C.arguments_of(call)).alias("place", "a"))
    return p.select("k", F.col("place").cast("long").alias("place"), "a.name", "a.value")


def _patch() -> F.Column:
    n = _number()
    return F.concat(F.lit("--- a/src/m"), n, F.lit(".py\n+++ b/src/m"), n, F.lit(".py\n@@ -"), n, F.lit(",3 +"), n, F.lit(",4 @@\n one\n-two\n+second\n+and more\n three\n@@ -"), (F.col("k") + 50).cast("string"), F.lit(",2 +"), (F.col("k") + 51).cast("string"),
                    F.when(F.col("k") % 4 == 0, F.lit(",2 @@\n ten\n")).otherwise(F.lit(",1 @@\n ten\n-eleven\n")))


def patch_hunks(spark: SparkSession, d: str) -> DataFrame:
    """Hunks of a patch per part; every fourth patch's second one is cut short."""
    p = _part(spark, d).select("k", F.explode(C.hunks_of(_patch())).alias("h"))
    return p.select("k", "h.path", F.col("h.old_start").cast("long").alias("old_start"), F.array_join("h.old_lines", "|").alias("old"), F.array_join("h.new_lines", "|").alias("new"), "h.ok")


def patch_changes(spark: SparkSession, d: str) -> DataFrame:
    """The files that a patch writes, with the old numbers of the lines that it takes away and the texts that it adds."""
    p = _part(spark, d).select("k", T.diff_files(_patch()).alias("files"), F.explode(C.changes_of(_patch())).alias("c"))
    return p.select("k", F.array_join("files", ",").alias("files"), "c.path", F.array_join(F.col("c.removed").cast("array<string>"), ",").alias("removed"), F.array_join("c.added", "|").alias("added"))


def line_diffs(spark: SparkSession, d: str) -> DataFrame:
    """The words of a name as lines, one of them gone and one more at the end."""
    lines = F.transform("words", lambda w, i: F.concat(w, i.cast("string")))
    gone = F.col("k") % F.size("words")
    p = _part(spark, d).withColumn("old", lines).withColumn("new", F.filter("old", lambda w, i: i != gone))
    return p.select("k", C.diff_of(F.array_join("old", "\n"), F.array_join(F.concat("new", F.array(F.lit("last"))), "\n")).alias("diff"))


def edit_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Unified diffs of an edit of one line of nine, with three lines around it."""
    at = (F.col("k") % 9 + 1).cast("int")
    lines = F.array(*(F.lit(f"l{i}") for i in range(1, 10)))
    edits = F.array(F.struct(at.alias("start_line"), at.alias("end_line"), F.concat(F.lit("new"), _number()).alias("new")))
    return _part(spark, d).select("k", C.edits_diff_of(F.concat(F.lit("m"), _number(), F.lit(".py")), lines, edits).alias("diff"))


def recovered_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of words from JSON, from an object with groups, and from an answer that breaks off."""
    w, n = F.col("words")[0], _number()
    pair = F.concat(F.lit('["'), w, F.lit('", "x'), n, F.lit('"]'))
    ways = [F.concat(F.lit("["), pair, F.lit("]")), F.concat(F.lit('{"groups": ['), pair, F.lit(', ["z"]]}')), F.concat(F.lit('{"groups": ['), pair, F.lit(', ["cut", "o')), F.lit("none")]
    p = _part(spark, d).select("k", F.posexplode_outer(C.groups_of(F.element_at(F.array(*ways), (F.col("k") % 4 + 1).cast("int")))).alias("place", "g"))
    return p.select("k", F.col("place").cast("long").alias("place"), F.array_join("g", ",").alias("words"))


def model_files(spark: SparkSession, d: str) -> DataFrame:
    """A parameter and the system text of model files, and the text with another system."""
    n = F.col("s_suppkey").cast("string")
    head = F.concat(F.lit("FROM base\nPARAMETER num_ctx "), n, F.lit("\n"))
    text = F.when(F.col("s_suppkey") % 3 == 0, head).when(F.col("s_suppkey") % 3 == 1, F.concat(head, F.lit("SYSTEM plain "), n, F.lit("\n"))).otherwise(F.concat(head, F.lit('SYSTEM """two\nlines """\nEND\n')))
    s = table(spark, d, "supplier").select("s_suppkey", text.alias("t"))
    t = F.col("t")
    return s.select("s_suppkey", T.modelfile_parameter(t, "num_ctx").alias("num_ctx"), T.modelfile_parameter(t, "seed").alias("seed"), T.modelfile_system(t).alias("system"), T.with_system(t, F.lit("be brief")).alias("changed"))


def builder_names(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("tool"), _number(), F.lit(" 1."), _number(), F.when(F.col("k") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" ("), F.substring(F.md5(_number()), 1, 10), F.lit(")"))))
    return _part(spark, d).select("k", provenance.builder_identity(said).alias("b")).select("k", "b.name", "b.version", "b.commit")


def byte_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Bytes 20 to 119 of every text as evidence: hashes of source and excerpt, and the lines that they stand on."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.encode("text", "UTF-8").alias("content"))
    spans = docs.where(F.length("content") >= 120).select(F.col("id").alias("source_id"), F.lit(20).cast("long").alias("start"), F.lit(120).cast("long").alias("end"))
    return intervals.evidence_of(spans, docs).select("source_id", "path", "source_sha256", "excerpt_sha256", "start_line", "end_line")


QUERIES = {f.__name__: f for f in (
    identifier_places, annotation_lines, decoded_urls, numbers_written, owner_name_forms, sentences_and_ends, line_mentions, call_forms, argument_lists, patch_hunks, patch_changes, line_diffs,
    edit_diffs, recovered_lists, model_files, builder_names, byte_evidence,
)}

_P = "p AS (SELECT p_partkey AS k, p_name AS name, string_split(p_name, ' ') AS words, CAST(p_partkey AS VARCHAR) AS n FROM part)"

ORACLE_SQL = {
    "identifier_places": f"""WITH {_P}, w AS (SELECT *, CASE k % 3 WHEN 0 THEN words[1] WHEN 1 THEN words[-1] ELSE substr(words[1], 2) END AS word FROM p)
SELECT k, CAST(instr(' ' || name || ' ', ' ' || word || ' ') AS BIGINT) AS place, words[-1] AS last FROM w""",
    "annotation_lines": "SELECT p_partkey AS k, p_partkey % 8 NOT IN (5, 7) AS annotation FROM part",
    "decoded_urls": "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN replace(url, '+', ' ') END AS url FROM pages",
    "numbers_written": "SELECT doc_id, format('{:,}', n_chars * 1009) AS written FROM documents",
    "owner_name_forms": f"WITH {_P} SELECT k, words[1] || '<T>::' || words[-1] || n || ' ' || words[1] || '::' || words[-1] || n || ' ' || words[1] AS forms FROM p",
    "sentences_and_ends": r"""SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s) <> '')) AS BIGINT) AS n,
  right(text, 100) AS tail, sha256(text) AS sha FROM documents""",
    "line_mentions": f"WITH {_P} SELECT k, n || ',' || (k + 1) || ',7' AS lines, words[1] AS names FROM p",
    "call_forms": f"""WITH {_P} SELECT k, CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'a.b' WHEN 2 THEN '()' WHEN 3 THEN '()' END AS receiver, CASE WHEN k % 5 <> 4 THEN 'go' || n END AS name FROM p""",
    "argument_lists": f"""WITH {_P} SELECT k, CAST(u.place AS BIGINT) AS place, u.name, u.value FROM p,
unnest([{{'place': 0, 'name': NULL, 'value': 'a' || n}}, {{'place': 1, 'name': 'b', 'value': n}}, {{'place': 2, 'name': NULL, 'value': 'g(c, d)'}}, {{'place': 3, 'name': NULL, 'value': '''x,y'''}}, {{'place': 4, 'name': NULL, 'value': 'e==2'}}]) AS t(u)""",
    "patch_hunks": f"""WITH {_P} SELECT k, 'src/m' || n || '.py' AS path, k AS old_start, 'one|two|three' AS old, 'one|second|and more|three' AS new, true AS ok FROM p
UNION ALL SELECT k, 'src/m' || n || '.py', k + 50, CASE WHEN k % 4 = 0 THEN 'ten' ELSE 'ten|eleven' END, 'ten', k % 4 <> 0 FROM p""",
    "patch_changes": f"""WITH {_P} SELECT k, 'src/m' || n || '.py' AS files, 'src/m' || n || '.py' AS path, CASE WHEN k % 4 = 0 THEN CAST(k + 1 AS VARCHAR) ELSE (k + 1) || ',' || (k + 51) END AS removed, 'second|and more' AS added FROM p""",
    "line_diffs": f"""WITH {_P} SELECT k, array_to_string(list_transform(range(1, len(words) + 1), lambda i: CASE WHEN i - 1 = k % len(words) THEN '-' ELSE ' ' END || words[i] || (i - 1)), chr(10)) || chr(10) || '+last' AS diff FROM p""",
    "edit_diffs": f"""WITH {_P}, e AS (SELECT k, n, k % 9 + 1 AS pos, greatest(k % 9 + 1 - 3, 1) AS first, least(k % 9 + 1 + 3, 9) AS last FROM p)
SELECT k, '--- a/m' || n || '.py' || chr(10) || '+++ b/m' || n || '.py' || chr(10) || '@@ -' || first || ',' || (last - first + 1) || ' +' || first || ',' || (last - first + 1) || ' @@' || chr(10)
  || array_to_string(list_transform(range(first, last + 1), lambda i: CASE WHEN i = pos THEN '-l' || i || chr(10) || '+new' || n ELSE ' l' || i END), chr(10)) || chr(10) AS diff FROM e""",
    "recovered_lists": f"""WITH {_P} SELECT k, CASE WHEN k % 4 < 3 THEN CAST(0 AS BIGINT) END AS place, CASE WHEN k % 4 < 3 THEN words[1] || ',x' || n END AS words FROM p UNION ALL SELECT k, 1, 'z' FROM p WHERE k % 4 = 1""",
    "model_files": """WITH s AS (SELECT s_suppkey, s_suppkey % 3 AS m, 'FROM base' || chr(10) || 'PARAMETER num_ctx ' || s_suppkey || chr(10) AS head FROM supplier)
SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS num_ctx, CAST(NULL AS VARCHAR) AS seed, CASE m WHEN 1 THEN 'plain ' || s_suppkey WHEN 2 THEN 'two' || chr(10) || 'lines ' END AS system,
  head || 'SYSTEM \"\"\"be brief\"\"\"' || chr(10) || CASE m WHEN 2 THEN 'END' || chr(10) ELSE '' END AS changed FROM s""",
    "builder_names": f"""WITH {_P} SELECT k, CASE WHEN k % 3 <> 0 THEN 'tool' || n END AS name, CASE WHEN k % 3 <> 0 THEN '1.' || n END AS version, CASE WHEN k % 3 <> 0 THEN substr(md5(n), 1, 10) END AS "commit" FROM p""",
    "byte_evidence": r"""WITH b AS (SELECT doc_id, source, hex(encode(text)) AS h FROM documents WHERE octet_length(encode(text)) >= 120)
SELECT doc_id AS source_id, source AS path, sha256(unhex(h)) AS source_sha256, sha256(unhex(substr(h, 41, 200))) AS excerpt_sha256,
  CAST(1 + len(list_filter(range(0, 20), lambda i: substr(h, 2 * i + 1, 2) = '0A')) AS BIGINT) AS start_line, CAST(1 + len(list_filter(range(0, 119), lambda i: substr(h, 2 * i + 1, 2) = '0A')) AS BIGINT) AS end_line FROM b""",
}
