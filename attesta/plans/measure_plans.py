"""Queries on measurements: parsing, statistics, comparison, gate, coverage and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import measures
from attesta.plans.tables import HALF_RUNS, half_runs, table


def _better() -> Column:
    return F.when(F.col("series") == "purchase", "higher").when(F.col("series") == "view", "lower")


def _summaries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = half_runs(spark, d)
    of = lambda side: measures.summary(r.where(F.col("side") == side), ["change", "series"])
    return of("baseline"), of("current")


def _comparison(spark: SparkSession, d: str) -> DataFrame:
    return measures.compared(*_summaries(spark, d), ["change", "series"])


def measure_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events printed as measure lines, some of them broken."""
    e = table(spark, d, "events")
    k = F.pmod("event_id", F.lit(8))
    value = F.format_string("%.4f", F.abs("value"))
    line = (
        F.when(k == 0, F.concat(F.lit("attesta-measure a.b="), value))
        .when(k == 1, F.concat(F.lit("  attesta-measure n_1="), value, F.lit(" ms")))
        .when(k == 2, F.concat(F.lit("attesta-measure n="), value, F.lit(" at=src/x.py:12")))
        .when(k == 3, F.concat(F.lit("attesta-measure n="), value, F.lit(" at=../x.py:1")))
        .when(k == 4, F.lit("attesta-measure n=NaN"))
        .when(k == 5, F.concat(F.lit("attesta-measure n-x="), value))
        .when(k == 6, F.concat(F.lit("attesta-measure n="), value, F.lit(" at=a:1 at=b:2")))
        .otherwise(F.concat(F.lit("hello attesta-measure n="), value))
    )
    return measures.parse_lines(e.select("event_id", line.alias("line"))).select("event_id", "name", "value", "unit", "at", "series")


def series_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("u", F.pmod("user_id", F.lit(50)))
    return measures.summary(e, ["event_type", "u"])


def successful_runs(spark: SparkSession, d: str) -> DataFrame:
    """Only repetitions that ended well count."""
    e = table(spark, d, "events").select("event_type", "value", F.pmod("event_id", F.lit(3)).alias("exit_code"), (F.pmod("event_id", F.lit(6)) == 0).alias("timed_out"))
    return measures.summary(measures.successes(e), ["event_type"])


def baseline_compare(spark: SparkSession, d: str) -> DataFrame:
    return _comparison(spark, d)


def output_stability(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "b").otherwise("c").alias("side"), F.sha2("o_orderpriority", 256).alias("sha256"))
    of = lambda s: measures.stability(o.where(F.col("side") == s), ["o_custkey"])
    return measures.compared_outputs(of("b"), of("c"), "o_custkey")


def project_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = measures.project_numbers(_comparison(spark, d), _better())
    return n.select("change", "series", "improved", measures.moved().alias("moved"))


def worse_numbers(spark: SparkSession, d: str) -> DataFrame:
    return measures.worse(measures.project_numbers(_comparison(spark, d), _better())).select("change", "series", "improved")


def _executions(spark: SparkSession, d: str) -> DataFrame:
    r = half_runs(spark, d)
    return r.groupBy("change").agg(F.count("*").alias("attempted"), (F.count("*") - F.sum(((F.col("change") == 3) & (F.col("event_id") % 40 == 3)).cast("int"))).alias("succeeded"), F.max((F.col("change") % 4 == 1).cast("int")).alias("stopped"), F.lit(0).alias("issues"))


def gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    c = _comparison(spark, d)
    outputs = c.select("change", F.when(F.col("series").endswith("_ms") & (F.col("change") == 5), "different").otherwise("same").alias("state"))
    return measures.verdict(_executions(spark, d), c, outputs, measures.project_numbers(c, _better()), ["change"])


def gate_gain(spark: SparkSession, d: str) -> DataFrame:
    c = _comparison(spark, d)
    return measures.gain(c, measures.project_numbers(c, _better()), ["change"])


def best_change(spark: SparkSession, d: str) -> DataFrame:
    v = gate_verdict(spark, d).withColumn("g", F.col("change") % 2).withColumn("passed", F.col("n_issues") < 2)
    g = gate_gain(spark, d).withColumn("g", F.col("change") % 2)
    return measures.best_change(v, g, ["g"], "change")


def vanished_counters(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("series"), F.col("s_nationkey").alias("function"))
    after = s.where("series % 3 <> 0")
    kept = table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("function"))
    return measures.vanished_counters(s, after, kept, s.where("series % 2 = 0"))


def tampering(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), T.split_lines(F.col("text")).alias("added"), T.split_lines(F.col("text")).alias("removed"))
    return measures.tampering(c, spark.sql("SELECT 'src1' AS prefix"), "anst")


def function_counts(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_quantity").alias("calls"))
    return measures.per_function(l, "symbol", "calls")


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    f = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"))
    c = labels.select(F.col("doc_id").alias("symbol"), (F.col("quality") * 2).alias("calls"), F.when(F.col("toxic") == 1, "own_counter").otherwise("entry_calls").alias("count_kind"))
    return measures.coverage_states(f, c, docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit("generated").alias("reason")))


def coverage_states(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d).groupBy("state", "zero", "reason").agg(F.count("*").alias("n"))


def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return measures.coverage_tally(_coverage(spark, d))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    return l.groupBy(F.col("l_partkey").alias("symbol")).agg(F.when(F.min("l_linenumber") > 1, None).otherwise(F.count("*")).alias("calls"), F.when(F.max("l_linenumber") > 4, F.max("l_quantity")).alias("cpu_ms")).withColumn("at", F.concat(F.lit("p"), "symbol"))


def hotspot_order(spark: SparkSession, d: str) -> DataFrame:
    return measures.hotspots(_counts(spark, d), 25).select("at", "calls", "cpu_ms")


def hot_rankings(spark: SparkSession, d: str) -> DataFrame:
    return measures.rankings(_counts(spark, d)).select("ranking", F.col("position").cast("long").alias("position"), "at")


def relevant_callers(spark: SparkSession, d: str) -> DataFrame:
    c = _counts(spark, d).where("calls is not null").select("symbol", "calls")
    links = c.select(F.col("symbol").alias("caller"), (F.col("symbol") % 40).alias("target"))
    return measures.relevant_callers(links, c)


def weighted_estimate(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    sample = labels.join(docs, "doc_id").select("lang", "quality")
    return measures.weighted_estimate(sample, docs, "lang", "quality")


def histogram_gate(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("category"), "o_orderkey")
    return measures.histogram_gate(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "category", "O", "F")


QUERIES = {f.__name__: f for f in (
    measure_lines, series_summary, successful_runs, baseline_compare, output_stability, project_numbers, worse_numbers, gate_verdict, gate_gain, best_change, vanished_counters, tampering,
    function_counts, coverage_states, coverage_rollup, hotspot_order, hot_rankings, relevant_callers, weighted_estimate, histogram_gate,
)}

_STATS = "count(value) AS n, median(value) AS median, min(value) AS min, max(value) AS max"
_CMP = f"""{HALF_RUNS},
st AS (SELECT change, series, side, {_STATS} FROM runs GROUP BY ALL),
c AS (SELECT c.change, c.series, b.median AS baseline_median, c.median,
    CASE WHEN b.median <> 0 THEN round((c.median - b.median) / b.median * 1000) / 10 END AS change_pct, NOT (c.max < b.min OR c.min > b.max) AS ranges_overlap
  FROM st c JOIN st b ON b.change = c.change AND b.series = c.series AND b.side = 'baseline' AND c.side = 'current'),
num AS (SELECT * FROM (SELECT *, CASE WHEN series = 'purchase' THEN coalesce(change_pct, 0) WHEN series = 'view' OR series LIKE '%\\_ms' ESCAPE '\\' THEN -coalesce(change_pct, 0) END AS improved
  FROM c WHERE NOT contains(series, '@') AND series <> 'wall_ms') WHERE improved IS NOT NULL)"""
_VERDICT = f"""{_CMP},
ex AS (SELECT change, count(*) AS attempted, count(*) - sum(CASE WHEN change = 3 AND event_id % 40 = 3 THEN 1 ELSE 0 END) AS succeeded, change % 4 = 1 AS stopped FROM runs GROUP BY change),
v AS (SELECT ex.change, CAST(CASE WHEN succeeded < attempted THEN 1 ELSE 0 END
    + coalesce((SELECT count(*) FROM c WHERE c.change = ex.change AND series LIKE 'calls@%' AND change_pct >= 5), 0)
    + coalesce((SELECT count(*) FROM c WHERE c.change = ex.change AND c.change = 5 AND series LIKE '%\\_ms' ESCAPE '\\'), 0) AS BIGINT) AS n_issues,
  stopped OR EXISTS (SELECT 1 FROM c WHERE c.change = ex.change AND series LIKE 'calls@%' AND change_pct <= -5)
    OR EXISTS (SELECT 1 FROM num WHERE num.change = ex.change AND improved >= 10 AND NOT ranges_overlap) AS dropped FROM ex)"""
_GAIN = """g AS (SELECT c.change, coalesce((SELECT max(improved) FROM num WHERE num.change = c.change),
  CASE WHEN sum(CASE WHEN series LIKE 'calls@%' THEN baseline_median END) > 0 THEN (sum(CASE WHEN series LIKE 'calls@%' THEN baseline_median END) - sum(CASE WHEN series LIKE 'calls@%' THEN median END))
    / sum(CASE WHEN series LIKE 'calls@%' THEN baseline_median END) * 100 ELSE 0 END, 0) AS gain FROM c GROUP BY c.change)"""
_COV = """cov AS (SELECT d.doc_id AS id, d.lang AS language, CASE WHEN l.calls IS NULL THEN 'no_coverage' WHEN l.calls > 0 THEN 'counted_and_ran' ELSE 'counted_no_passes' END AS state,
  CASE WHEN l.calls = 0 THEN CASE l.k WHEN 'entry_calls' THEN 'entry_zero' ELSE 'own_zero' END END AS zero,
  CASE WHEN l.calls IS NULL THEN CASE WHEN d.doc_id % 2 = 0 THEN 'generated' ELSE 'not_instrumented' END END AS reason
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality * 2) AS calls, min(CASE WHEN toxic = 1 THEN 'own_counter' ELSE 'entry_calls' END) AS k FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id)"""
_COUNTS = """cnt AS (SELECT l_partkey AS symbol, CASE WHEN min(l_linenumber) > 1 THEN NULL ELSE count(*) END AS calls, CASE WHEN max(l_linenumber) > 4 THEN max(l_quantity) END AS cpu_ms, 'p' || l_partkey AS "at" FROM lineitem GROUP BY l_partkey)"""

ORACLE_SQL = {
    "measure_lines": """WITH e AS (SELECT event_id, event_id % 8 AS k, CAST(printf('%.4f', abs(value)) AS DOUBLE) AS value FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'a.b' WHEN 1 THEN 'n_1' ELSE 'n' END AS name, value, CASE WHEN k = 1 THEN 'ms' END AS unit, CASE WHEN k = 2 THEN 'src/x.py:12' END AS "at",
  CASE k WHEN 0 THEN 'a.b' WHEN 1 THEN 'n_1' ELSE 'n@src/x.py:12' END AS series FROM e WHERE k < 3""",
    "series_summary": f"SELECT event_type, user_id % 50 AS u, {_STATS} FROM events GROUP BY ALL",
    "successful_runs": f"SELECT event_type, {_STATS} FROM events WHERE event_id % 3 = 0 AND event_id % 6 <> 0 GROUP BY 1",
    "baseline_compare": f"WITH {_CMP} SELECT * FROM c",
    "output_stability": """WITH o AS (SELECT o_custkey, o_orderkey % 2 AS s, count(DISTINCT o_orderpriority) AS n, min(o_orderpriority) AS p FROM orders GROUP BY 1, 2)
SELECT c.o_custkey, CASE WHEN c.n > 1 OR b.n IS NULL OR b.n > 1 THEN 'unstable' WHEN b.p = c.p THEN 'same' ELSE 'different' END AS state FROM o c LEFT JOIN o b ON b.o_custkey = c.o_custkey AND b.s = 0 WHERE c.s = 1""",
    "project_numbers": f"WITH {_CMP} SELECT change, series, improved, abs(improved) >= 10 AND NOT ranges_overlap AS moved FROM num",
    "worse_numbers": f"WITH {_CMP} SELECT change, series, improved FROM num WHERE improved <= -10 AND NOT ranges_overlap",
    "gate_verdict": f"WITH {_VERDICT} SELECT change, n_issues = 0 AND dropped AS passed, n_issues, dropped FROM v",
    "gate_gain": f"WITH {_CMP}, {_GAIN} SELECT * FROM g",
    "best_change": f"""WITH {_VERDICT}, {_GAIN}, j AS (SELECT v.change % 2 AS g, v.change, gain, n_issues < 2 AS passed FROM v JOIN g ON g.change = v.change)
SELECT g, change, gain, CASE WHEN NOT passed THEN 'refused' WHEN row_number() OVER (PARTITION BY g, passed ORDER BY gain DESC, change) = 1 THEN 'best' ELSE 'passed_smaller' END AS label FROM j""",
    "vanished_counters": """SELECT s_suppkey AS series, s_nationkey AS function, CASE WHEN n_regionkey = 2 THEN 'with_function' WHEN s_suppkey % 2 = 0 THEN 'deleted' ELSE 'stopped' END AS fate
FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 3 = 0""",
    "tampering": """WITH c AS (SELECT source || '/' || doc_id AS path, text AS a, text AS r FROM documents)
SELECT path, 'protected_path' AS issue FROM c WHERE path LIKE 'src1%' UNION ALL SELECT path, 'statement_removed' FROM c WHERE contains(r, 'anst') UNION ALL SELECT path, 'statement_added' FROM c WHERE contains(a, 'anst')""",
    "function_counts": "SELECT l_partkey AS symbol, max(l_quantity) AS calls FROM lineitem GROUP BY 1",
    "coverage_states": f"WITH {_COV} SELECT state, zero, reason, count(*) AS n FROM cov GROUP BY ALL",
    "coverage_rollup": f"""WITH {_COV} SELECT language, count(*) AS total, CAST(sum((state <> 'no_coverage')::INT) AS BIGINT) AS counted, CAST(sum((state = 'counted_and_ran')::INT) AS BIGINT) AS ran,
  CAST(sum((state = 'counted_no_passes')::INT) AS BIGINT) AS no_passes, CAST(sum((state = 'no_coverage')::INT) AS BIGINT) AS no_coverage FROM cov GROUP BY ROLLUP (language)""",
    "hotspot_order": f'WITH {_COUNTS} SELECT "at", calls, cpu_ms FROM cnt ORDER BY calls DESC NULLS LAST, cpu_ms DESC NULLS LAST, "at" LIMIT 25',
    "hot_rankings": f"""WITH {_COUNTS}, r AS (SELECT 'count' AS ranking, row_number() OVER (ORDER BY calls DESC NULLS LAST, "at") AS position, "at" FROM cnt WHERE calls > 0
  UNION ALL SELECT 'time', row_number() OVER (ORDER BY cpu_ms DESC NULLS LAST, "at"), "at" FROM cnt WHERE calls > 0) SELECT * FROM r WHERE position <= 5""",
    "relevant_callers": f"""WITH {_COUNTS}, j AS (SELECT t.symbol AS target, c.symbol AS caller, c.calls, t.calls AS tc, row_number() OVER (PARTITION BY t.symbol ORDER BY c.calls DESC, c.symbol) AS r
  FROM cnt c JOIN cnt t ON t.symbol = c.symbol % 40 WHERE c.calls IS NOT NULL AND t.calls IS NOT NULL) SELECT target, caller, calls FROM j WHERE calls * 20 >= tc OR r = 1""",
    "weighted_estimate": """WITH s AS (SELECT lang, quality FROM labels JOIN documents USING (doc_id)), k AS (SELECT lang, quality, count(*) AS k FROM s GROUP BY ALL), m AS (SELECT lang, count(*) AS m FROM s GROUP BY 1), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
SELECT quality, CAST(round(sum(n * k / m)) AS BIGINT) AS estimate FROM k JOIN m USING (lang) JOIN n USING (lang) GROUP BY 1""",
    "histogram_gate": """WITH h AS (SELECT o_orderstatus AS category, count(CASE WHEN o_orderkey % 2 = 0 THEN 1 END) AS before, count(CASE WHEN o_orderkey % 2 = 1 THEN 1 END) AS after FROM orders GROUP BY 1)
SELECT *, CASE category WHEN 'O' THEN after <= before WHEN 'F' THEN after >= before ELSE true END AS holds FROM h""",
}
