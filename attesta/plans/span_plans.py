"""Queries on spans and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import graph, intervals, resolve
from attesta.plans.tables import ORDER_SPANS, SUPPLY_EDGES, order_spans, supply_edges, table
from attesta.storage import save


def _wide(spans: DataFrame) -> DataFrame:
    return spans.where("end - start >= 40")


def innermost_container(spark: SparkSession, d: str) -> DataFrame:
    s = order_spans(spark, d)
    out = intervals.innermost(s, _wide(s), "key", "id", "id")
    return out.select("id", "outer_id")


def container_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = order_spans(spark, d)
    return intervals.containers(s, _wide(s), "key").groupBy("id").agg(F.count("*").alias("n"))


def outside_tests(spark: SparkSession, d: str) -> DataFrame:
    """Spans that lie in no span of a marked part."""
    s = order_spans(spark, d)
    return intervals.outside_all(s, s.where("part % 10 = 0"), "key").groupBy("key").agg(F.count("*").alias("n"))


def loop_membership(spark: SparkSession, d: str) -> DataFrame:
    """Spans inside a wide one but not inside its first five days."""
    s = order_spans(spark, d)
    loops = _wide(s).withColumn("iter_start", F.col("start")).withColumn("iter_end", F.col("start") + 5)
    return intervals.loop_members(s, loops, "key").select("id", "outer_id")


def span_nesting(spark: SparkSession, d: str) -> DataFrame:
    s = order_spans(spark, d)
    return intervals.nesting(s, "key", "id").select("id", "depth", "inner")


def merge_ranges(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merged(order_spans(spark, d), "key")


def context_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every 50th character of benchmark-sized facts, widened by three lines in documents of 40 lines."""
    facts = table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), (F.col("turn") * 5 + 1).alias("line"), F.lit(None).cast("long").alias("end_line"))
    sources = facts.groupBy("source_id").agg((F.max("line") + 2).alias("n_lines"))
    return intervals.context_ranges(facts, sources, 3)


def window_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = order_spans(spark, d)
    parts = s.select("key", "start", "end")
    windows = s.where("part % 7 = 0").select("id", "key", "start", (F.col("end") + 10).alias("end"))
    return intervals.covers(parts, windows, "key").select("id", "covered")


def edit_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlapping(order_spans(spark, d).select("key", "start", "end", "id"), "key").groupBy("key").agg(F.count("*").alias("n"))


def line_holder(spark: SparkSession, d: str) -> DataFrame:
    """The innermost span of its supplier that holds each line's ship date."""
    s = order_spans(spark, d)
    symbols = _wide(s).select("key", F.col("start").alias("start_line"), F.col("end").alias("end_line"), "id")
    points = s.select("key", F.col("start").alias("line")).distinct()
    return intervals.holder(points, symbols, "key", "line", "id").select("key", "line", "holder")


def shared_context(spark: SparkSession, d: str) -> DataFrame:
    s = order_spans(spark, d)
    ranges = intervals.merged(s.where("part % 5 = 0"), "key")
    points = s.where("part % 3 = 0").select("id", "key", F.col("start").alias("line"))
    return intervals.shared_blocks(points, ranges, "key").select("id", F.col("block").cast("long").alias("block"))


def name_candidates_capped(spark: SparkSession, d: str) -> DataFrame:
    """Words of part names as names written by lines of their part: candidates up to eight, else the count alone."""
    p = table(spark, d, "part")
    symbols = p.select(F.concat(F.lit("s"), F.col("p_partkey")).alias("id"), F.col("p_type").alias("name"), F.col("p_brand").alias("language"), F.when(F.col("p_size") % 2 == 0, "function").otherwise("class").alias("kind"), F.col("p_size").alias("source_id"), (F.col("p_partkey") % 4 == 0).alias("top_level"))
    occ = p.select(F.concat(F.lit("o"), F.col("p_partkey")).alias("id"), F.col("p_type").alias("candidate"), F.col("p_brand").alias("language"), F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("type").alias("kind"), F.col("p_size").alias("source_id"))
    allowed = p.select(F.col("p_brand").alias("language")).distinct().withColumn("x", F.explode(F.array(F.struct(F.lit("call").alias("occ_kind"), F.lit("function").alias("sym_kind")), F.struct(F.lit("type").alias("occ_kind"), F.lit("class").alias("sym_kind"))))).select("language", "x.occ_kind", "x.sym_kind")
    pairs, above = graph.name_candidates(occ, symbols, allowed)
    n = pairs.groupBy("occ_id").agg(F.count("*").alias("n_candidates"), F.min("sym_id").alias("least"))
    return n.select("occ_id", "n_candidates", "least", F.lit(None).cast("long").alias("ambiguous")).unionByName(above.select("occ_id", F.lit(None).cast("long").alias("n_candidates"), F.lit(None).cast("string").alias("least"), F.col("ambiguous_candidates").alias("ambiguous")))


def edge_identity(spark: SparkSession, d: str) -> DataFrame:
    e = graph.distinct_edges(supply_edges(spark, d))
    return e.select("from", "to", graph.edge_id("from", "to", "kind").alias("id"))


def _nodes(e: DataFrame) -> DataFrame:
    ids = e.select(F.col("from").alias("id")).union(e.select("to")).distinct()
    return ids.withColumn("kind", F.when(F.col("id").startswith("s"), "source").otherwise("symbol"))


def neighborhood_bfs(spark: SparkSession, d: str) -> DataFrame:
    seed = spark.sql("SELECT 'c7' AS id")
    edges = save(supply_edges(spark, d), "edges")
    return graph.neighborhood(edges, _nodes(edges), seed, depth=4, max_nodes=None).select("id", F.col("layer").cast("long").alias("layer"))


def neighborhood_capped(spark: SparkSession, d: str) -> DataFrame:
    seed = spark.sql("SELECT 'c7' AS id")
    edges = save(supply_edges(spark, d), "edges")
    return graph.neighborhood(edges, _nodes(edges), seed, depth=4, max_nodes=graph.NEIGHBORHOOD_NODES).select("id", F.col("layer").cast("long").alias("layer"))


def used_by_layers(spark: SparkSession, d: str) -> DataFrame:
    """Who uses a supplier: parts named by lines that orders own, taken as uses of parts."""
    l = table(spark, d, "lineitem")
    occ = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    edges = l.select(occ.alias("from"), F.concat(F.lit("p"), F.col("l_partkey")).alias("to"), F.lit("name_candidate").alias("kind")).unionByName(l.select(F.concat(F.lit("p"), F.col("l_partkey") - F.col("l_suppkey")).alias("from"), occ.alias("to"), F.lit("observes").alias("kind")))
    return graph.used_by(edges, spark.sql("SELECT 'p77' AS id"), depth=2, max_nodes=None).select("id", F.col("layer").cast("long").alias("layer"))


def call_reach(spark: SparkSession, d: str) -> DataFrame:
    """Chains of up to four steps over a sparse graph of parts, from every part: the shortest of each pair."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    steps = p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") * 2 % 211 + F.col("p_size") % 3).alias("b"))
    entries = steps.select(F.col("a").alias("entry"), "a", "b")
    return graph.shortest_chains(graph.reach(entries, steps, 4)).select("entry", "node", F.col("length").cast("long").alias("length"))


def reexport_follow(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("module"), F.col("n_name").alias("name"))
    e = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("module"), F.col("n_name").alias("name"), F.pmod(F.col("n_regionkey") + 1, F.lit(5)).alias("to_module"), F.col("n_name").alias("to_name"))
    more = e.select(F.pmod(F.col("module") + 1, F.lit(5)).alias("module"), "name", F.pmod(F.col("module") + 2, F.lit(5)).alias("to_module"), F.concat("name", F.lit("_")).alias("to_name"))
    return graph.follow(n, e.unionByName(more)).select("module", "name", "at_module", "at_name", F.col("hops").cast("long").alias("hops"))


def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Lines as calls of their part: a unique supplier links, else one of the customer's nation, else all are homonyms."""
    l = table(spark, d, "lineitem")
    calls = l.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("occ_id"), F.col("l_orderkey").alias("caller"), "l_partkey").distinct()
    offers = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("sym_id")).distinct()
    candidates = save(calls.join(offers, "l_partkey").select("occ_id", "caller", "sym_id"), "candidates")
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sym_id"), "s_nationkey")
    home = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("caller"), "c_nationkey")
    same = candidates.join(home, "caller").join(supplier, "sym_id").where("c_nationkey = s_nationkey")
    rules = {"unique": resolve.unique_links(candidates), "type": resolve.unique_links(same), "homonym": candidates.where("sym_id % 2 = 0").select("occ_id", F.col("sym_id").alias("target"))}
    return resolve.cascade(calls, rules, above=candidates.where("sym_id % 3 = 0").select("occ_id")).select("occ_id", "how", "target")


def agreed_returns(spark: SparkSession, d: str) -> DataFrame:
    """Per customer, the priority that all of their orders agree on."""
    o = table(spark, d, "orders")
    bindings = o.select(F.col("o_custkey").alias("binding"), F.col("o_orderkey").alias("occ_id"))
    targets = o.select(F.col("o_orderkey").alias("occ_id"), F.col("o_orderkey").alias("target"))
    returns = o.where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("symbol"), F.col("o_orderstatus").alias("type"))
    return resolve.agreed_returns(bindings, targets, returns)


QUERIES = {f.__name__: f for f in (
    innermost_container, container_pairs, outside_tests, loop_membership, span_nesting, merge_ranges, context_windows, window_coverage, edit_overlaps, line_holder, shared_context,
    name_candidates_capped, edge_identity, neighborhood_bfs, neighborhood_capped, used_by_layers, call_reach, reexport_follow, resolve_cascade, agreed_returns,
)}

_IN = 'o.key = i.key AND o.start <= i.start AND i."end" <= o."end"'
_ISLANDS = """m AS (SELECT *, max("end") OVER (PARTITION BY key ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {0}),
n AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b + {1} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS isl FROM m),
u AS (SELECT key, min(start) AS start, max("end") AS "end" FROM n GROUP BY key, isl)"""
_BFS = """und AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
w AS (SELECT 'c7' AS id, 0 AS layer UNION SELECT und.b, w.layer + 1 FROM w JOIN und ON und.a = w.id WHERE w.layer < 4 AND w.id NOT LIKE 's%'),
f AS (SELECT id, CAST(min(layer) AS BIGINT) AS layer FROM w GROUP BY id)"""

ORACLE_SQL = {
    "innermost_container": f"""WITH {ORDER_SPANS}, p AS (SELECT i.id, o.id AS outer_id, row_number() OVER (PARTITION BY i.id ORDER BY o."end" - o.start, o.id) AS r
  FROM spans i JOIN spans o ON {_IN} AND o."end" - o.start >= 40 AND i.id <> o.id) SELECT id, outer_id FROM p WHERE r = 1""",
    "container_pairs": f"""WITH {ORDER_SPANS} SELECT i.id, count(*) AS n FROM spans i JOIN spans o ON {_IN} AND o."end" - o.start >= 40 GROUP BY 1""",
    "outside_tests": f"""WITH {ORDER_SPANS} SELECT key, count(*) AS n FROM spans i WHERE NOT EXISTS (SELECT 1 FROM spans o WHERE {_IN} AND o.part % 10 = 0) GROUP BY 1""",
    "loop_membership": f"""WITH {ORDER_SPANS} SELECT i.id, o.id AS outer_id FROM spans i JOIN spans o ON {_IN} AND o."end" - o.start >= 40 WHERE NOT (o.start <= i.start AND i."end" <= o.start + 5)""",
    "span_nesting": f"""WITH {ORDER_SPANS}, s AS (SELECT * FROM spans), p AS (SELECT i.id AS i, o.id AS o FROM s i JOIN s o ON {_IN} AND i.id <> o.id)
SELECT id, coalesce((SELECT count(*) FROM p WHERE p.i = s.id), 0) AS depth, coalesce((SELECT count(*) FROM p WHERE p.o = s.id), 0) AS inner FROM s""",
    "merge_ranges": f"WITH {ORDER_SPANS}, {_ISLANDS.format('spans', 0)} SELECT * FROM u",
    "context_windows": f"""WITH f AS (SELECT conv_id AS key, turn * 5 + 1 AS line, max(turn * 5 + 1) OVER (PARTITION BY conv_id) + 2 AS n FROM conversations),
x AS (SELECT key, greatest(line - 3, 1) AS start, least(line + 3, n) AS "end" FROM f), {_ISLANDS.format('x', 0)} SELECT key AS source_id, start, "end" FROM u""",
    "window_coverage": f"""WITH {ORDER_SPANS}, {_ISLANDS.format('spans', 1)} SELECT i.id, EXISTS (SELECT 1 FROM u o WHERE o.key = i.key AND o.start <= i.start AND i."end" + 10 <= o."end") AS covered FROM spans i WHERE part % 7 = 0""",
    "edit_overlaps": f"""WITH {ORDER_SPANS}, b AS (SELECT *, max("end") OVER (PARTITION BY key ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM spans) SELECT key, count(*) AS n FROM b WHERE start <= b GROUP BY 1""",
    "line_holder": f"""WITH {ORDER_SPANS}, p AS (SELECT DISTINCT key, start AS line FROM spans), h AS (SELECT p.key, p.line, o.id AS holder, row_number() OVER (PARTITION BY p.key, p.line ORDER BY o."end" - o.start, o.id) AS r
  FROM p JOIN spans o ON o.key = p.key AND p.line BETWEEN o.start AND o."end" AND o."end" - o.start >= 40) SELECT key, line, holder FROM h WHERE r = 1""",
    "shared_context": f"""WITH {ORDER_SPANS}, five AS (SELECT * FROM spans WHERE part % 5 = 0), {_ISLANDS.format('five', 0)}, b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start) AS block FROM u)
SELECT s.id, b.block FROM spans s LEFT JOIN b ON b.key = s.key AND s.start BETWEEN b.start AND b."end" WHERE s.part % 3 = 0""",
    "name_candidates_capped": """WITH s AS (SELECT 's' || p_partkey AS id, p_type AS name, p_brand AS lang, CASE WHEN p_size % 2 = 0 THEN 'call' ELSE 'type' END AS ok, p_size AS src, p_partkey % 4 = 0 AS top FROM part),
o AS (SELECT 'o' || p_partkey AS occ_id, p_type AS c, p_brand AS lang, CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'type' END AS ok, p_size AS src FROM part),
j AS (SELECT o.occ_id, s.id, s.top AND s.src = o.src AS loc FROM o JOIN s ON o.c = s.name AND o.lang = s.lang AND o.ok = s.ok),
k AS (SELECT occ_id, id FROM j WHERE loc OR NOT EXISTS (SELECT 1 FROM j x WHERE x.occ_id = j.occ_id AND x.loc)),
n AS (SELECT occ_id, count(*) AS n, min(id) AS least FROM k GROUP BY 1)
SELECT occ_id, CASE WHEN n <= 8 THEN n END AS n_candidates, CASE WHEN n <= 8 THEN least END AS least, CASE WHEN n > 8 THEN n END AS ambiguous FROM n""",
    "edge_identity": f"""WITH {SUPPLY_EDGES} SELECT a AS "from", b AS "to", 'edge:' || sha256('{{"from":"' || a || '","to":"' || b || '","kind":"' || kind || '"}}') AS id FROM edges""",
    "neighborhood_bfs": f"WITH RECURSIVE {SUPPLY_EDGES}, {_BFS} SELECT id, layer FROM f",
    "neighborhood_capped": f"WITH RECURSIVE {SUPPLY_EDGES}, {_BFS} SELECT id, layer FROM f ORDER BY layer, id LIMIT 128",
    "used_by_layers": """WITH RECURSIVE uses AS (SELECT DISTINCT 'p' || l_partkey AS used, 'p' || (l_partkey - l_suppkey) AS usr FROM lineitem),
w AS (SELECT 'p77' AS id, 0 AS layer UNION SELECT usr, layer + 1 FROM w JOIN uses ON used = id WHERE layer < 2) SELECT id, CAST(min(layer) AS BIGINT) AS layer FROM w GROUP BY 1""",
    "call_reach": """WITH RECURSIVE s AS (SELECT p_partkey AS a, p_partkey * 2 % 211 + p_size % 3 AS b FROM part),
c AS (SELECT a AS entry, b AS node, 1 AS n, [a, b] AS path FROM s UNION ALL SELECT entry, s.b, n + 1, list_append(path, s.b) FROM c JOIN s ON s.a = c.node WHERE n < 4 AND NOT list_contains(path, s.b))
SELECT entry, node, CAST(min(n) AS BIGINT) AS length FROM c GROUP BY 1, 2""",
    "reexport_follow": """WITH RECURSIVE e1 AS (SELECT n_regionkey AS m, n_name AS n, (n_regionkey + 1) % 5 AS tm, n_name AS tn FROM nation WHERE n_nationkey % 2 = 0),
e AS (SELECT * FROM e1 UNION ALL SELECT (m + 1) % 5, n, (m + 2) % 5, n || '_' FROM e1),
w AS (SELECT n_regionkey AS module, n_name AS name, n_regionkey AS at_module, n_name AS at_name, 0 AS hops FROM nation
  UNION ALL SELECT module, name, tm, tn, hops + 1 FROM w JOIN e ON e.m = at_module AND e.n = at_name WHERE hops < 3)
SELECT module, name, arg_max(at_module, hops) AS at_module, arg_max(at_name, hops) AS at_name, CAST(max(hops) AS BIGINT) AS hops FROM w GROUP BY 1, 2""",
    "resolve_cascade": """WITH calls AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS occ_id, l_orderkey AS caller, l_partkey FROM lineitem),
cand AS (SELECT DISTINCT occ_id, caller, o.s FROM calls JOIN (SELECT DISTINCT l_partkey, l_suppkey AS s FROM lineitem) o USING (l_partkey)),
r AS (SELECT occ_id, s AS target, 1 AS rank FROM (SELECT *, count(*) OVER (PARTITION BY occ_id) AS n FROM cand) WHERE n = 1
  UNION ALL SELECT occ_id, s, 4 FROM (SELECT c.occ_id, c.s, count(*) OVER (PARTITION BY c.occ_id) AS n FROM cand c JOIN orders ON o_orderkey = caller JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = s WHERE c_nationkey = s_nationkey) WHERE n = 1
  UNION ALL SELECT occ_id, s, 7 FROM cand WHERE s % 2 = 0),
b AS (SELECT *, min(rank) OVER (PARTITION BY occ_id) AS best FROM r)
SELECT c.occ_id, CASE best WHEN 1 THEN 'unique' WHEN 4 THEN 'type' WHEN 7 THEN 'homonym' ELSE CASE WHEN EXISTS (SELECT 1 FROM cand x WHERE x.occ_id = c.occ_id AND x.s % 3 = 0) THEN 'above_limit' ELSE 'no_candidate' END END AS how, target
FROM calls c LEFT JOIN (SELECT * FROM b WHERE rank = best) b ON b.occ_id = c.occ_id""",
    "agreed_returns": """SELECT o_custkey AS binding, CASE WHEN count(DISTINCT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END) = 1 AND count(CASE WHEN o_orderkey % 9 <> 0 THEN 1 END) = count(*) THEN max(o_orderstatus) END AS type FROM orders GROUP BY 1""",
}
