"""Views of the driver's tables in the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order line, days [ship date, ship date + quantity) keyed by part: spans that nest and cross."""
    l = table(spark, sf_dir, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return l.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_suppkey").alias("key"), day.cast("long").alias("start"), (day + F.col("l_quantity").cast("int")).cast("long").alias("end"),
        F.col("l_partkey").alias("part"),
    )


#: The same in SQL.
ORDER_SPANS = """spans AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, l_suppkey AS key, CAST(datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS start,
    CAST(datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) AS BIGINT) AS "end", l_partkey AS part FROM lineitem)"""


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer - order - part - supplier as directed edges of string ids."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        o.select(name("c", "o_custkey").alias("from"), name("o", "o_orderkey").alias("to"), F.lit("places").alias("kind")),
        l.select(name("o", "l_orderkey").alias("from"), name("p", "l_partkey").alias("to"), F.lit("holds").alias("kind")),
        l.select(name("p", "l_partkey").alias("from"), name("s", "l_suppkey").alias("to"), F.lit("from").alias("kind")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


SUPPLY_EDGES = """edges AS (
  SELECT DISTINCT 'c' || o_custkey AS a, 'o' || o_orderkey AS b, 'places' AS kind FROM orders
  UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'holds' FROM lineitem
  UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'from' FROM lineitem)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of promotions and revocations of facts: one fact a user and value's whole part."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.pmod("event_id", F.lit(3)) == 2, "revoked").otherwise("promoted")
    fact = F.concat(F.lit("F"), F.col("user_id").cast("string"), F.lit("-"), F.pmod("event_id", F.lit(7)).cast("string"))
    return e.select(F.col("event_id").alias("seq"), kind.alias("event"), fact.alias("id"), F.when(F.pmod("user_id", F.lit(2)) == 0, "CHANGE").otherwise("FACT").alias("kind"), "user_id")


EVENT_LOG = """log AS (
  SELECT event_id AS seq, CASE WHEN event_id % 3 = 2 THEN 'revoked' ELSE 'promoted' END AS event, 'F' || user_id || '-' || event_id % 7 AS id,
    CASE WHEN user_id % 2 = 0 THEN 'CHANGE' ELSE 'FACT' END AS kind, user_id FROM events)"""


def half_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measurements: a series per event type and user group, half of them baseline and half current."""
    e = table(spark, sf_dir, "events")
    series = F.when(F.pmod("user_id", F.lit(4)) == 0, F.concat(F.lit("calls@"), "event_type")).when(F.pmod("user_id", F.lit(4)) == 1, F.concat("event_type", F.lit("_ms"))).otherwise(F.col("event_type"))
    return e.select(F.pmod("user_id", F.lit(10)).alias("change"), series.alias("series"), F.when(F.pmod("event_id", F.lit(2)) == 0, "baseline").otherwise("current").alias("side"), F.abs("value").alias("value"), "event_id")


HALF_RUNS = """runs AS (
  SELECT user_id % 10 AS change, CASE WHEN user_id % 4 = 0 THEN 'calls@' || event_type WHEN user_id % 4 = 1 THEN event_type || '_ms' ELSE event_type END AS series,
    CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'current' END AS side, abs(value) AS value, event_id FROM events)"""


def duck_tokens(expression: str) -> str:
    """DuckDB SQL for ``functions.text.tokens``."""
    spaced = f"regexp_replace(regexp_replace(coalesce({expression}, ''), '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')"
    folded = f"translate(lower({spaced}), 'áàâãäéêèëíìîïóòôõöúùûüç', 'aaaaaeeeeiiiiooooouuuuc')"
    return f"regexp_extract_all(regexp_replace({folded}, '[\\x{{0300}}-\\x{{036f}}]', '', 'g'), '[\\p{{L}}\\p{{N}}]+')"


STOPS = "('a','o','as','os','de','da','do','das','dos','e','em','no','na','nos','nas','um','uma','para','por','que','qual','quais','onde','como','the','of','in','to','from','with','is','does','how','where')"
