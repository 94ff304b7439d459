"""Queries on what is written for readers and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import reports
from attesta.plans.proof_plans import _in_turn, _pick
from attesta.plans.tables import table


def io_counters(spark: SparkSession, d: str) -> DataFrame:
    return reports.io_counters(table(spark, d, "documents").select(F.col("source").alias("category"), F.octet_length("text").cast("long").alias("bytes")))


def request_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Queries made of parts, some without a question, instructions or evidence, some with a schema, and some without a model."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    n = k.cast("string")
    head = F.concat(F.lit('{"question":"'), F.when(k % 7 == 1, " ").otherwise(F.concat(F.lit("q"), n)), F.lit('","evidence":'), F.when(k % 7 == 2, "[]").otherwise("{}"), F.lit(',"instructions":'), F.when(k % 7 == 3, "[]").otherwise('["do"]'))
    schema = F.when(k % 4 == 0, ',"response_schema":{"type":"object"}').when(k % 4 == 1, ',"response_schema":{"type":"array"}').otherwise("")
    q = p.select(k.alias("id"), F.when(k % 11 == 0, " ").otherwise("m").alias("model"), F.concat(head, schema, F.lit("}")).alias("query"))
    return reports.request_bodies(q)


def rendered_models(spark: SparkSession, d: str) -> DataFrame:
    """Nations as tasks and suppliers as profiles, of the same kind where they are of one nation."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    tasks = n.select(F.concat(F.lit("t"), "n_nationkey").alias("task"), F.col("n_nationkey").alias("kind"), (F.col("n_nationkey") * 100).alias("num_predict"), F.col("n_name").alias("system"))
    key = F.col("s_suppkey").cast("string")
    profiles = s.select(F.concat(F.lit("p"), key).alias("profile"), F.col("s_nationkey").alias("kind"), F.lit("base").alias("base"), F.create_map(F.lit("num_ctx"), key, F.lit("a"), F.lit("1")).alias("parameters"))
    return reports.rendered_models(tasks, profiles, ["pt", "en"])


def note_lines(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey")
    s = p.select(k.alias("id"), F.col("p_name").alias("name"), F.lit("src/a.py").alias("path"), k.alias("start_line"), (k + 3).alias("end_line"), _pick(k, [*reports.NOTE_ROLES, "other"]).alias("role"), F.when(k % 2 == 0, F.col("p_size")).alias("calls"))
    return reports.note_lines(s)


def tagged_limits(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    r = o.select(k.alias("id"), F.array(*(F.lit(x) for x in "abcd")).alias("limits"), (k % 2 == 0).alias("with_targets"), (k % 3 == 0).alias("with_callees"), (k % 5 == 0).alias("with_owners"), F.lit("v2").alias("version"), F.lit("x9").alias("extractor"))
    return reports.tagged_limits(r, 3).withColumn("place", F.col("place").cast("long"))


def edition_facts(spark: SparkSession, d: str) -> DataFrame:
    """Customers as selected ids: declarations, heads of files, and what the edition doesn't have."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    n = k.cast("string")
    selected = c.select(F.when(k % 3 == 0, F.concat(F.lit("header:f"), n)).otherwise(F.concat(F.lit("s"), n)).alias("id"))
    symbols = c.where("c_custkey % 5 <> 0").select(F.concat(F.lit("s"), n).alias("id"), F.concat(F.lit("n"), n).alias("name"), F.lit("p").alias("path"), F.lit("function").alias("kind"), k.alias("start_line"), (k + 2).alias("end_line"), (k * 10).alias("bytes"))
    heads = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("f"), n).alias("path"), (k % 9).alias("end_line"), (k * 7).alias("bytes"))
    return reports.edition_facts(selected, symbols, heads)


def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines 1 to 4 of each document with whole windows, and two declarations of which one fits inside."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(T.split_lines(F.col("text")), F.array(F.lit(""), F.lit(""), F.lit(""))).alias("lines"))
    path = F.col("doc_id").cast("string")
    windows = docs.select(F.col("doc_id").alias("id"), path.alias("path"), F.lit(1).cast("long").alias("start_line"), F.lit(4).cast("long").alias("end_line"))
    symbols = docs.select(path.alias("path"), F.explode(F.array(F.struct(F.lit(1).cast("long").alias("start_line"), F.lit(2).cast("long").alias("end_line")), F.struct(F.lit(3).cast("long").alias("start_line"), F.lit(9).cast("long").alias("end_line")))).alias("s")).select("path", "s.*")
    return reports.context_blocks(windows, docs.select(path.alias("path"), "lines"), symbols).select("id", "end_line", F.sha2("excerpt", 256).alias("sha"), "n_symbols")


def measure_details(spark: SparkSession, d: str) -> DataFrame:
    """The latest instrumented run of each customer's command."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    e = o.select(F.col("o_custkey").alias("command"), F.date_format("o_orderdate", "yyyyMMdd-HHmmss").alias("started"), F.concat_ws("-", (k % 100).cast("string"), F.lit("run"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "count!();").alias("instrumentation"), F.concat(F.lit("diff of "), k.cast("string")).alias("diff"))
    return reports.measure_detail(e, ["command"]).select("command", "id", "diff")


QUERIES = {f.__name__: f for f in (io_counters, request_bodies, rendered_models, note_lines, tagged_limits, edition_facts, context_blocks, measure_details)}

_LS = r"""ls AS (SELECT doc_id, CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM (
    SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), chr(13) || '$', ''), chr(10)) AS l FROM documents))"""

ORACLE_SQL = {
    "io_counters": "SELECT source AS category, count(*) AS calls, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1",
    "request_bodies": """WITH p AS (SELECT p_partkey AS k, '{"question":"' || CASE WHEN p_partkey % 7 = 1 THEN ' ' ELSE 'q' || p_partkey END || '","evidence":' || CASE WHEN p_partkey % 7 = 2 THEN '[]' ELSE '{}' END || ',"instructions":' || CASE WHEN p_partkey % 7 = 3 THEN '[]' ELSE '["do"]' END
  || CASE p_partkey % 4 WHEN 0 THEN ',"response_schema":{"type":"object"}' WHEN 1 THEN ',"response_schema":{"type":"array"}' ELSE '' END || '}' AS q FROM part),
i AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'no_model' WHEN k % 7 IN (1, 2, 3) THEN 'malformed' WHEN k % 4 = 1 THEN 'bad_schema' END AS issue FROM p)
SELECT k AS id, CASE WHEN issue IS NULL THEN '{"model":"m","prompt":"' || replace(q, '"', '\\"') || '","stream":false' || CASE WHEN k % 4 = 0 THEN ',"format":{"type":"object"}' ELSE '' END || '}' END AS body, issue FROM i""",
    "rendered_models": """SELECT 't' || n_nationkey || '-p' || s_suppkey || s AS name, 'FROM base' || chr(10) || 'PARAMETER a 1' || chr(10) || 'PARAMETER num_ctx ' || s_suppkey || chr(10) || 'PARAMETER num_predict ' || n_nationkey * 100 || chr(10) || chr(10) || 'SYSTEM \"\"\"' || chr(10) || n_name || '\"\"\"' || chr(10) AS text
FROM nation JOIN supplier ON s_nationkey = n_nationkey, unnest(['', '-en']) AS u(s)""",
    "note_lines": f"""SELECT p_partkey AS id, 'Papel de ' || p_name || ' (src/a.py:' || p_partkey || '-' || (p_partkey + 3) || '): ' || {_in_turn("p_partkey", [*reports.NOTE_ROLES.values(), "other"])} || CASE WHEN p_partkey % 2 = 0 THEN '; ' || p_size || ' chamadas na medição' ELSE '' END || '.' AS note FROM part""",
    "tagged_limits": """WITH r AS (SELECT o_orderkey AS id, CAST(u.i AS BIGINT) AS place, (['a','b','c','d'])[u.i + 1] AS text, CASE WHEN o_orderkey % 6 = 0 AND u.i = 3 THEN 'callees' WHEN o_orderkey % 2 = 0 AND u.i = 0 THEN 'step_kind' WHEN o_orderkey % 10 = 0 AND u.i = 1 THEN 'owner_step'
  WHEN o_orderkey % 2 = 1 AND u.i = 3 THEN 'exclude_tests' ELSE 'profile_search' END AS producer FROM orders, unnest([0, 1, 2, 3]) AS u(i))
SELECT *, CASE producer WHEN 'step_kind' THEN 'route' WHEN 'profile_search' THEN 'edition_profile' ELSE 'request' END AS input, CASE producer WHEN 'callees' THEN NULL WHEN 'profile_search' THEN 'x9' ELSE 'v2' END AS rule, CASE producer WHEN 'owner_step' THEN 'system_generated' ELSE 'system_fixed' END AS provenance FROM r""",
    "edition_facts": """WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS n, c_custkey % 3 = 0 AS head, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 ELSE c_custkey % 5 <> 0 END AS there FROM customer)
SELECT CASE WHEN head THEN 'header:f' || n ELSE 's' || n END AS id, CASE WHEN there THEN CASE WHEN head THEN 'f' || n ELSE 'n' || n END END AS name, CASE WHEN there THEN CASE WHEN head THEN 'f' || n ELSE 'p' END END AS path, CASE WHEN there THEN CASE WHEN head THEN 'header' ELSE 'function' END END AS kind,
  CASE WHEN there THEN CASE WHEN head THEN 1 ELSE k END END AS start_line, CASE WHEN there THEN CASE WHEN head THEN k % 9 ELSE k + 2 END END AS end_line, CASE WHEN there THEN CASE WHEN head THEN k * 7 ELSE k * 10 END END AS bytes FROM c""",
    "context_blocks": f"""WITH {_LS}, w AS (SELECT doc_id, regexp_replace(array_to_string((l || ['', '', ''])[1:4], chr(10)), '\\n+$', '') AS t FROM ls WHERE len(l) >= 1)
SELECT doc_id AS id, CAST(len(string_split(t, chr(10))) AS BIGINT) AS end_line, sha256(t) AS sha, CAST(len(string_split(t, chr(10))) >= 2 AS BIGINT) AS n_symbols FROM w WHERE t <> ''""",
    "measure_details": """SELECT command, id, diff FROM (SELECT o_custkey AS command, (o_orderkey % 100) || '-run-' || o_orderkey AS id, 'diff of ' || o_orderkey AS diff, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y%m%d-%H%M%S') DESC, o_orderkey % 100 DESC, (o_orderkey % 100) || '-run-' || o_orderkey DESC) AS r
FROM orders WHERE o_orderkey % 3 = 0) WHERE r = 1""",
}
