"""Queries on records: latest-of, event logs, comparisons, unions, budgets, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import claims, records
from attesta.plans.tables import EVENT_LOG, event_log, table


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return records.latest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def _executions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    started = F.when(F.col("o_orderkey") % 7 == 0, "yesterday").otherwise(F.date_format("o_orderdate", "yyyyMMdd-HHmmss"))
    return o.select(F.col("o_custkey").alias("command"), started.alias("started"), F.concat_ws("-", (F.col("o_orderkey") % 100).cast("string"), F.lit("run"), F.col("o_orderkey").cast("string")).alias("id"),
                    F.when(F.col("o_orderkey") % 3 == 0, "x").alias("change"), F.lit(None).cast("string").alias("instrumentation"), (F.col("o_orderkey") % 2).alias("succeeded"))


def latest_execution(spark: SparkSession, d: str) -> DataFrame:
    return records.latest(_executions(spark, d), ["command"], records.chronology()).select("command", "id")


def latest_baseline(spark: SparkSession, d: str) -> DataFrame:
    return records.baseline(_executions(spark, d), ["command"]).select("command", "id")


def latest_run_first_tie(spark: SparkSession, d: str) -> DataFrame:
    """The latest day of each customer; of equal ones the first order stays."""
    o = table(spark, d, "orders")
    return records.latest(o, ["o_custkey"], [F.desc(F.col("o_orderdate").cast("date")), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


def sequential_ids(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return records.sequential_ids(s, ["s_nationkey", "s_suppkey"]).select("s_suppkey", "id")


def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    quotas = docs.select("lang").distinct().withColumn("quota", F.lit(25))
    return records.quota_sample(docs, "doc_id", "lang", "source", quotas).select("doc_id", "lang")


def event_log_fold(spark: SparkSession, d: str) -> DataFrame:
    log = event_log(spark, d)
    holds = log.select("id").distinct().withColumn("holds", F.length("id") % 2 == 0)
    applied = log.select("id").distinct().withColumn("applied", F.col("id").endswith("3"))
    return records.fact_status(log, holds, applied)


def active_fact(spark: SparkSession, d: str) -> DataFrame:
    return records.active_fact(event_log(spark, d), ["user_id"]).select("user_id", "id", "seq")


def command_approvals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    log = e.where("event_id % 4 = 0").select(F.col("event_type").alias("name"), F.sha2((F.col("user_id") % 20).cast("string"), 256).alias("sha256"), F.col("event_id").alias("approved"))
    commands = e.select(F.col("event_type").alias("name"), F.sha2((F.col("user_id") % 30).cast("string"), 256).alias("sha256")).distinct()
    return records.approvals(log, commands)


def change_applied(spark: SparkSession, d: str) -> DataFrame:
    """Turns as changes: whether all lines of a turn are lines of documents or of another turn."""
    c = table(spark, d, "conversations")
    lines = c.where("turn > 0").select("conv_id", F.explode(T.split_lines(F.col("text"))).alias("line")).select((F.col("conv_id") % 10).alias("path"), "line")
    changes = c.where("turn < 2").select(F.concat_ws("-", "conv_id", "turn").alias("id"), (F.col("conv_id") % 10).alias("path"), F.explode(T.split_lines(F.col("text"))).alias("line"))
    return records.is_applied(changes, lines)


def promotion_gates(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    c = docs.select(F.col("doc_id").alias("id"), F.lit("FACT").alias("kind"))
    checks = labels.where("quality = 0").select(F.col("doc_id").alias("id"))
    links = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5 != 0).alias("matches"))
    notes = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "seen").otherwise(" ").alias("note"))
    return records.promotion_gates(c, checks, links, notes)


def record_equality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return records.same_rows(docs, docs.where("doc_id % 10 <> 3").withColumn("n_chars", F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("n_chars"))))


def edition_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    current = docs.where("doc_id % 11 <> 0").withColumn("sha", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("sha"))).withColumn("doc_id", F.when(F.col("doc_id") % 13 == 0, -F.col("doc_id")).otherwise(F.col("doc_id")))
    return records.changed(docs, current, "doc_id", "sha")


def copy_check(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    copy = docs.where("path % 9 <> 0").withColumn("content", F.when(F.col("path") % 4 == 0, F.replace("content", F.lit("\n"), F.lit("\r\n"))).when(F.col("path") % 6 == 1, "z").otherwise(F.col("content")))
    return records.copy_check(docs, copy, docs.where("path % 10 = 0"))


def partition_issues(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    parts = {"included": c.where("id % 4 = 0"), "removed": c.where("id % 4 = 1"), "left_out": c.where("id % 8 = 0"), "not_joined": c.where("id % 4 = 2")}
    return records.partition_issues(parts, "id", c)


def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    return records.repeated_ids(l, "id")


def unknown_ids(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return records.unknown_ids(c.select(F.col("c_custkey").alias("id")), o.select(F.col("o_custkey").alias("id")), "id")


def reason_union(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ordinal"), F.when((F.col("event_type") == "purchase") & (F.col("user_id") % 3 == 0), "chosen").otherwise(F.col("event_type")).alias("reason"))
    r = records.with_reasons(e, "id")
    return r.select("id", "ordinal", F.array_join("reasons", ",").alias("reasons"))


def ordered_absorption(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("provenance"), F.col("event_id").cast("string").alias("data"), F.array("event_type").alias("reasons"))
    return records.absorbed(e, "id").select("id", "provenance", "data", F.array_join("reasons", ",").alias("reasons"))


def greedy_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", "doc_id", "n_chars")
    out = records.greedy(docs, ["lang"], [F.desc("n_chars"), F.asc("doc_id")], "n_chars", 20000)
    return out.where("taken").select("lang", "doc_id")


def evidence_selection(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    reason = F.element_at(F.array(*map(F.lit, ["chosen", "owner_type", "header", "called", "caller", "type_reference", "called", "caller", "decorator", "called"])), (F.col("doc_id") % 10 + 1).cast("int"))
    c = docs.select("source", "doc_id", F.array(reason).alias("reasons"), (F.col("doc_id") % 17 == 0).alias("is_test"), (F.col("doc_id") % 6).cast("double").alias("calls"), (F.col("doc_id") % 2 == 0).alias("counted"), F.col("n_chars").alias("bytes"), F.col("doc_id").alias("ordinal"))
    out = records.evidence_selection(c, ["source"])
    return out.select("source", "doc_id", "role", F.col("rank").cast("long").alias("rank"), "taken", "left_out")


def capped_additions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return records.capped(o, ["o_custkey"], [F.asc("o_orderkey")], records.OWNER_ADDITIONS)


def gap_groups(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.col("l_partkey").alias("field"), F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"))
    g = records.grouped_gaps(l, "field")
    return g.select("field", "n", F.array_join(F.transform("sites", lambda s: F.concat_ws(":", s["path"], s["line"])), " ").alias("sites"))


def field_groups(spark: SparkSession, d: str) -> DataFrame:
    """Grouping fields by class and expanding them again loses nothing."""
    f = table(spark, d, "part").select("p_brand", "p_size", "p_partkey", "p_name")
    again = records.expanded_fields(records.grouped_fields(f, ["p_brand", "p_size"], ["p_partkey", "p_name"]))
    return records.same_rows(f, again)


def claim_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Each document cited for its second line, one in three times from the first."""
    lines = T.split_lines(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("path"), lines.alias("lines"))
    at = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(2)
    cites = docs.where(F.size("lines") >= 2).select("doc_id", "path", at.alias("start_line"), at.alias("end_line"), F.col("lines")[1].alias("quote"))
    return claims.quote_holds(cites, docs.select("path", "lines")).select("doc_id", "holds")


def citation_issues(spark: SparkSession, d: str) -> DataFrame:
    lines = T.split_lines(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", "source", lines.alias("ls")).where(F.size("ls") >= 4)
    evidence = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.lit(2).alias("start_line"), F.lit(3).alias("end_line"), F.slice("ls", 2, 2).alias("lines"))
    k = F.col("doc_id") % 4
    cites = docs.select(F.col("doc_id").alias("claim_id"), F.col("doc_id").alias("evidence_id"), F.when(k == 1, "other").otherwise(F.col("source")).alias("path"), F.when(k == 2, 1).otherwise(2).alias("start_line"), F.lit(3).alias("end_line"),
                        F.when(k == 3, "wrong").otherwise(F.concat_ws("\n", F.col("ls")[1], F.col("ls")[2])).alias("quote"))
    return claims.citation_issues(cites, evidence)


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    kind = F.element_at(F.array(*map(F.lit, [*claims.KINDS, "OTHER"])), (F.col("doc_id") % 5 + 1).cast("int"))
    c = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 9).alias("answer_id"), kind.alias("kind"), F.when(F.col("doc_id") % 13 == 0, " ").otherwise(F.col("text")).alias("text"),
                    F.when(F.col("doc_id") % 3 == 0, F.array(F.col("doc_id") - 1)).otherwise(F.array().cast("array<bigint>")).alias("premises"), F.when(F.col("doc_id") % 4 == 2, "run it").alias("verification_plan"))
    cites = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("claim_id"), F.lit("e").alias("evidence_id"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    return c.withColumn("premises", F.col("premises").cast("array<string>")).withColumn("id", F.col("id").cast("string")), cites.withColumn("claim_id", F.col("claim_id").cast("string"))


def claim_issues(spark: SparkSession, d: str) -> DataFrame:
    return claims.claim_issues(*_claims(spark, d))


def answer_outcome(spark: SparkSession, d: str) -> DataFrame:
    c, cites = _claims(spark, d)
    o = claims.outcome(c, claims.claim_issues(c, cites))
    return o.select("answer_id", "usable", "lacunas", F.array_join("codes", ",").alias("codes"))


def unique_runs(spark: SparkSession, d: str) -> DataFrame:
    """The first line of each document placed in its source's lines where it stands once."""
    docs = table(spark, d, "documents").select("doc_id", "source", T.split_lines(F.col("text")).alias("ls")).where(F.size("ls") >= 2)
    lines = docs.select(F.col("doc_id").alias("evidence_id"), F.posexplode("ls").alias("p", "text")).select("evidence_id", (F.col("p") + 1).alias("line_no"), "text")
    quotes = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("evidence_id"), F.concat_ws("\n", F.col("ls")[0], F.col("ls")[1]).alias("quote"))
    return claims.unique_run(quotes, lines).select("id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


def answer_compare(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as a claim of its role that cites each line of its whole text, at its place."""
    c = table(spark, d, "conversations")
    lines = c.select("conv_id", "turn", "role", F.posexplode_outer(T.split_lines(F.col("text"))).alias("n", "line"))
    at = F.when(F.col("line").isNotNull(), F.col("n") + 1).cast("long")
    rows = lines.select((F.col("conv_id") % 6).alias("answer_id"), F.concat_ws("-", "conv_id", "turn").alias("claim_id"), F.col("role").alias("kind"), T.sha256_hex(F.col("line")).alias("path"), at.alias("start_line"), at.alias("end_line"))
    return claims.compared_answers(rows).groupBy("state", "shared").agg(F.count("*").alias("n"), F.count_distinct("content").alias("contents"))


QUERIES = {f.__name__: f for f in (
    latest_per_key, latest_execution, latest_baseline, latest_run_first_tie, sequential_ids, quota_sample, event_log_fold, active_fact, command_approvals, change_applied, promotion_gates,
    record_equality, edition_diff, copy_check, partition_issues, repeated_ids, unknown_ids, reason_union, ordered_absorption, greedy_budget, evidence_selection, capped_additions, gap_groups,
    field_groups, claim_quotes, citation_issues, claim_issues, answer_outcome, unique_runs, answer_compare,
)}

_EXEC = """ex AS (SELECT o_custkey AS command, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y%m%d-%H%M%S') END AS st, o_orderkey % 100 AS num, (o_orderkey % 100) || '-run-' || o_orderkey AS id,
  o_orderkey % 3 = 0 AS changed, o_orderkey % 2 AS ok FROM orders)"""
_LS = r"""ls AS (SELECT doc_id, source, CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM (
    SELECT doc_id, source, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), chr(13) || '$', ''), chr(10)) AS l FROM documents))"""
_CLAIM = """c AS (SELECT doc_id AS i, doc_id % 9 AS answer_id, (['FACT','INFERENCE','HYPOTHESIS','LACUNA','OTHER'])[doc_id % 5 + 1] AS kind, doc_id % 13 = 0 OR trim(text) = '' AS blank, doc_id % 3 = 0 AS prem, doc_id % 4 = 2 AS plan, doc_id % 2 = 0 AS cites FROM documents),
iss AS (SELECT i, 'unknown_kind' AS code FROM c WHERE kind = 'OTHER' UNION SELECT i, 'empty_text' FROM c WHERE blank UNION SELECT i, 'no_citation' FROM c WHERE kind IN ('FACT','HYPOTHESIS') AND NOT cites
  UNION SELECT i, 'lacuna_cites' FROM c WHERE kind = 'LACUNA' AND cites UNION SELECT i, 'no_premises' FROM c WHERE kind = 'INFERENCE' AND NOT prem UNION SELECT i, 'premises_not_allowed' FROM c WHERE kind <> 'INFERENCE' AND prem
  UNION SELECT i, 'unknown_premise' FROM c WHERE prem AND i - 1 NOT IN (SELECT i FROM c) UNION SELECT i, 'no_plan' FROM c WHERE kind = 'HYPOTHESIS' AND NOT plan UNION SELECT i, 'plan_not_allowed' FROM c WHERE kind <> 'HYPOTHESIS' AND plan)"""

ORACLE_SQL = {
    "latest_per_key": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "latest_execution": f"WITH {_EXEC} SELECT command, id FROM (SELECT *, row_number() OVER (PARTITION BY command ORDER BY st DESC NULLS LAST, num DESC, id DESC) AS r FROM ex) WHERE r = 1",
    "latest_baseline": f"WITH {_EXEC} SELECT command, id FROM (SELECT *, row_number() OVER (PARTITION BY command ORDER BY st DESC NULLS LAST, num DESC, id DESC) AS r FROM ex WHERE NOT changed AND ok > 0) WHERE r = 1",
    "latest_run_first_tie": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS r FROM orders) WHERE r = 1",
    "sequential_ids": "SELECT s_suppkey, 'F' || row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS id FROM supplier",
    "quota_sample": """WITH f AS (SELECT *, sha256(CAST(doc_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS f FROM documents)
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY (f > 1)::INT, h) AS n FROM f) WHERE n <= 25""",
    "event_log_fold": f"""WITH {EVENT_LOG}, p AS (SELECT id, max(seq) AS p, arg_max(kind, seq) AS kind FROM log WHERE event = 'promoted' GROUP BY 1), r AS (SELECT id, max(seq) AS r FROM log WHERE event = 'revoked' GROUP BY 1)
SELECT p.id, p.kind, CASE WHEN r > p THEN 'revoked' WHEN kind = 'CHANGE' THEN CASE WHEN p.id LIKE '%3' THEN 'applied' ELSE 'proposed' END WHEN length(p.id) % 2 = 0 THEN 'current' ELSE 'stale' END AS status FROM p LEFT JOIN r ON r.id = p.id""",
    "active_fact": f"""WITH {EVENT_LOG}, r AS (SELECT id, max(seq) AS r FROM log WHERE event = 'revoked' GROUP BY 1)
SELECT user_id, id, seq FROM (SELECT log.*, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS n FROM log LEFT JOIN r ON r.id = log.id WHERE event = 'promoted' AND (r IS NULL OR r < seq)) WHERE n = 1""",
    "command_approvals": """WITH l AS (SELECT event_type AS name, sha256(CAST(user_id % 20 AS VARCHAR)) AS sha256, max(event_id) AS approved FROM events WHERE event_id % 4 = 0 GROUP BY 1, 2)
SELECT c.name, c.sha256, approved FROM (SELECT DISTINCT event_type AS name, sha256(CAST(user_id % 30 AS VARCHAR)) AS sha256 FROM events) c LEFT JOIN l ON l.name = c.name AND l.sha256 = c.sha256""",
    "change_applied": """WITH x AS (SELECT conv_id, turn, conv_id % 10 AS path, unnest(string_split(text, chr(10))) AS line FROM conversations)
SELECT conv_id || '-' || turn AS id, bool_and(EXISTS (SELECT 1 FROM x y WHERE y.turn > 0 AND y.path = x.path AND y.line = x.line)) AS applied FROM x WHERE turn < 2 AND trim(line) <> '' GROUP BY 1""",
    "promotion_gates": """WITH b AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) SELECT d.doc_id AS id, 'FACT' AS kind, b.doc_id IS NULL AS mechanical, d.doc_id % 3 <> 0 AND d.doc_id % 5 <> 0 AS link, d.doc_id % 4 = 0 AS note,
  b.doc_id IS NULL AND d.doc_id % 3 <> 0 AND d.doc_id % 5 <> 0 AND d.doc_id % 4 = 0 AS promoted FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id""",
    "record_equality": """WITH c AS (SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 10 <> 3), a AS (SELECT doc_id, lang, n_chars FROM documents)
SELECT (SELECT count(*) FROM (FROM a EXCEPT ALL FROM c)) AS missing, (SELECT count(*) FROM (FROM c EXCEPT ALL FROM a)) AS extra, false AS equal""",
    "edition_diff": """WITH c AS (SELECT CASE WHEN doc_id % 13 = 0 THEN -doc_id ELSE doc_id END AS doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE sha256(text) END AS c FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(d.doc_id, c.doc_id) AS doc_id, CASE WHEN c IS NULL THEN 'unavailable' WHEN d.doc_id IS NULL THEN 'added' WHEN c = sha256(text) THEN 'same' ELSE 'changed' END AS state FROM documents d FULL JOIN c ON c.doc_id = d.doc_id""",
    "copy_check": """SELECT doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 4 = 0 THEN CASE WHEN contains(text, chr(10)) THEN 'line_ends' ELSE 'same' END WHEN doc_id % 6 = 1 AND text <> 'z' THEN 'different' ELSE 'same' END AS state
FROM documents WHERE doc_id % 10 <> 0""",
    "partition_issues": """SELECT c_custkey AS id, 'several' AS issue FROM customer WHERE c_custkey % 8 = 0 UNION ALL SELECT c_custkey, 'absent' FROM customer WHERE c_custkey % 4 = 3""",
    "repeated_ids": "SELECT l_orderkey || '-' || l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "unknown_ids": "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "reason_union": """WITH e AS (SELECT user_id AS id, event_id AS o, CASE WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN 'chosen' ELSE event_type END AS reason FROM events), f AS (SELECT id, reason, min(o) AS o FROM e GROUP BY 1, 2)
SELECT id, min(o) AS ordinal, CASE WHEN bool_or(reason = 'chosen') THEN 'chosen' ELSE string_agg(reason, ',' ORDER BY o) END AS reasons FROM f GROUP BY 1""",
    "ordered_absorption": """WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2)
SELECT e.user_id AS id, arg_min(e.event_type, e.event_id) AS provenance, CAST(max(e.event_id) AS VARCHAR) AS data, (SELECT string_agg(event_type, ',' ORDER BY o) FROM f WHERE f.user_id = e.user_id) AS reasons FROM events e GROUP BY e.user_id""",
    "greedy_budget": """WITH RECURSIVE o AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents),
g AS (SELECT lang, doc_id, n, n_chars <= 20000 AS taken, CASE WHEN n_chars <= 20000 THEN n_chars ELSE 0 END AS used FROM o WHERE n = 1
  UNION ALL SELECT o.lang, o.doc_id, o.n, g.used + o.n_chars <= 20000, CASE WHEN g.used + o.n_chars <= 20000 THEN g.used + o.n_chars ELSE g.used END FROM g JOIN o ON o.lang = g.lang AND o.n = g.n + 1)
SELECT lang, doc_id FROM g WHERE taken""",
    "evidence_selection": """WITH RECURSIVE c AS (SELECT source, doc_id, (['chosen','owner_type','header','called','caller','type_reference','called','caller','decorator','called'])[doc_id % 10 + 1] AS reason, doc_id % 17 = 0 AS t, CAST(doc_id % 6 AS DOUBLE) AS calls, doc_id % 2 = 0 AS counted, n_chars FROM documents),
r AS (SELECT *, CASE WHEN t THEN 5 WHEN reason = 'chosen' THEN 0 WHEN reason IN ('owner_type', 'header') THEN 1 WHEN reason = 'called' AND calls > 0 THEN 2 WHEN reason = 'caller' THEN 3 ELSE 4 END AS rank FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, calls DESC, doc_id) AS n, rank >= 2 AND counted AND calls = 0 AS cold,
  CASE WHEN t THEN 'constraint' WHEN reason = 'chosen' THEN 'target' WHEN reason = 'owner_type' THEN 'origin' WHEN reason = 'called' AND calls > 0 THEN 'cost' WHEN reason = 'caller' THEN 'path' ELSE 'support' END AS role FROM r),
z AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS items, NULL::BIGINT AS doc_id, false AS taken FROM o
  UNION ALL SELECT o.source, o.n, CASE WHEN k THEN used + n_chars ELSE used END, CASE WHEN k THEN items + 1 ELSE items END, o.doc_id, k FROM (
    SELECT o.*, z.used, z.items, o.rank = 0 OR (NOT cold AND o.rank <> 5 AND z.items < 16 AND z.used + n_chars <= 6144) AS k FROM z JOIN o ON o.source = z.source AND o.n = z.n + 1) o)
SELECT o.source, o.doc_id, role, CAST(rank AS BIGINT) AS rank, taken, CASE WHEN taken THEN NULL WHEN rank = 5 THEN 'test' WHEN cold THEN 'did_not_run' ELSE 'no_room' END AS left_out FROM o JOIN z ON z.source = o.source AND z.n = o.n""",
    "capped_additions": "SELECT o_custkey, o_orderkey, n > 8 AS truncated FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r <= 8",
    "gap_groups": """WITH s AS (SELECT DISTINCT l_partkey AS f, CAST(l_orderkey AS VARCHAR) AS p, l_linenumber AS l FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY p, l) AS r FROM s)
SELECT l_partkey AS field, count(*) AS n, (SELECT string_agg(p || ':' || l, ' ' ORDER BY p, l) FROM r WHERE r.f = l_partkey AND r.r <= 3) AS sites FROM lineitem GROUP BY l_partkey""",
    "field_groups": "SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, true AS equal",
    "claim_quotes": f"WITH {_LS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN l[1] = l[2] ELSE true END AS holds FROM ls WHERE len(l) >= 2",
    "citation_issues": f"""WITH {_LS}, x AS (SELECT doc_id AS claim_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown_evidence' WHEN doc_id % 4 = 1 THEN 'wrong_path' WHEN doc_id % 4 = 2 THEN 'outside_evidence' WHEN doc_id % 4 = 3 THEN 'quote_differs' END AS code FROM ls WHERE len(l) >= 4) SELECT * FROM x WHERE code IS NOT NULL""",
    "claim_issues": f"WITH {_CLAIM} SELECT CAST(i AS VARCHAR) AS claim_id, code FROM iss",
    "answer_outcome": f"""WITH {_CLAIM} SELECT answer_id, CAST(sum((kind = 'HYPOTHESIS' AND c.i NOT IN (SELECT i FROM iss))::INT) AS BIGINT) AS usable, CAST(sum((kind = 'LACUNA')::INT) AS BIGINT) AS lacunas,
  coalesce((SELECT string_agg(DISTINCT code, ',' ORDER BY code) FROM iss JOIN c d ON d.i = iss.i WHERE d.answer_id = c.answer_id), '') AS codes FROM c GROUP BY answer_id""",
    "unique_runs": f"""WITH {_LS}, h AS (SELECT doc_id, u.i FROM ls, unnest(range(1, len(l))) AS u(i) WHERE len(l) >= 2 AND l[u.i] = l[1] AND l[u.i + 1] = l[2])
SELECT doc_id AS id, CAST(min(i) AS BIGINT) AS start_line, CAST(min(i) + 1 AS BIGINT) AS end_line FROM h GROUP BY 1 HAVING count(*) = 1""",
    "answer_compare": r"""WITH t AS (SELECT conv_id % 6 AS a, role, CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM (
    SELECT conv_id, role, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), chr(13) || '$', ''), chr(10)) AS l FROM conversations)),
c AS (SELECT DISTINCT a, role, l, role || ' ' || md5(CAST(l AS VARCHAR)) || len(l) AS content FROM t),
k AS (SELECT content, any_value(role) AS role, any_value(l) AS l, count(DISTINCT a) AS shared FROM c GROUP BY content),
e AS (SELECT content, u.i || ':' || l[u.i] AS item FROM k, unnest(range(1, len(l) + 1)) AS u(i)),
near AS (SELECT DISTINCT x.content, c.a FROM e x JOIN e y ON x.item = y.item JOIN c ON c.content = y.content UNION SELECT k.content, c.a FROM k JOIN c ON c.l = k.l AND c.role <> k.role),
g AS (SELECT k.content, k.shared, a.a, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.content = k.content AND c.a = a.a) THEN 'equal' WHEN EXISTS (SELECT 1 FROM near n WHERE n.content = k.content AND n.a = a.a) THEN 'partial' ELSE 'absent' END AS state FROM k, (SELECT DISTINCT a FROM c) a)
SELECT state, shared, count(*) AS n, count(DISTINCT content) AS contents FROM g GROUP BY 1, 2""",
}
