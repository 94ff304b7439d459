"""Inventory of operations by rules, of loops and of what happens in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions import code_text
from attesta.operators import intervals

RULE = "id string, operation string, language string, matcher string, names array<string>, receivers array<string>"


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """The rules as values in the plan, whose size is known, so that what they are joined with isn't shuffled."""
    text = lambda v: "CAST(NULL AS STRING)" if v is None else "'" + "".join(f"\\U{ord(c):08X}" for c in v) + "'"
    words = lambda vs: f"CAST(array({', '.join(map(text, vs))}) AS ARRAY<STRING>)"
    if not rules:
        return spark.createDataFrame([], RULE)
    rows = ", ".join(f"({', '.join(map(text, r[:4]))}, {words(r[4])}, {words(r[5])})" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(id, operation, language, matcher, names, receivers)")


def rule_issues(rules: DataFrame) -> DataFrame:
    """(id, issue): repeated ids, and call or field rules without names."""
    twice = rules.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated_id").alias("issue"))
    bare = rules.where((F.col("matcher") != "module_write") & (F.col("matcher") != "list_membership") & (F.size("names") == 0)).select("id", F.lit("no_names").alias("issue"))
    return twice.unionByName(bare)


def _applies() -> Column:
    return F.col("rule_language").isNull() | (F.col("rule_language") == F.col("language"))


def operations(occurrences: DataFrame, symbols: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(occ_id, rule, operation and the occurrence's columns ``keep``) of occurrences (id, source_id, kind, language, candidate, receiver, owner) by four matchers.

    call: the name is listed, and the receiver too if the rule lists any;
    field_declared_with: a use of a field whose declaration calls a listed name;
    module_write: a write of a top-level variable inside a symbol;
    list_membership: ``in`` on a name that only lists are bound to and that is no parameter.
    """
    occurrences = occurrences.drop("rule")
    r = rules.select(F.col("id").alias("rule"), "operation", F.col("language").alias("rule_language"), "matcher", "names", "receivers")
    calls = occurrences.where(F.col("kind").isin("call_observed", "method_call_observed"))
    named = r.where("matcher = 'call'").withColumn("name", F.explode("names"))
    by_call = calls.join(named, F.col("candidate") == F.col("name")).where(_applies() & ((F.size("receivers") == 0) | F.array_contains("receivers", F.col("receiver"))))
    fields = r.where("matcher = 'field_declared_with'").withColumn("name", F.explode("names"))
    declared = symbols.where("kind = 'field'").select(F.col("name").alias("field"), "source_id", "start", "end", F.col("language").alias("_fl"))
    making = calls.join(fields.select(F.col("name").alias("candidate")).distinct(), "candidate", "left_semi")
    made = intervals.containers(making.select("source_id", "start", "end", "candidate"), declared.select("source_id", "start", "end", "field"), "source_id")
    by_field = occurrences.where(F.col("kind").isin("attribute_access", "field_assign")).join(made.select(F.col("outer_field").alias("candidate"), F.col("candidate").alias("name")).distinct(), "candidate").join(fields, "name").where(_applies())
    top = symbols.where("kind = 'variable' and top_level").select(F.col("source_id").alias("_s"), F.col("name").alias("_n")).distinct()
    writes = occurrences.where("kind = 'name_write' and owner is not null").join(top, (F.col("source_id") == F.col("_s")) & (F.col("candidate") == F.col("_n")), "left_semi")
    by_write = writes.join(r.where("matcher = 'module_write'"), _applies())
    asked = occurrences.where("kind = 'membership'").select("source_id", "owner", "candidate").distinct()
    bound = occurrences.where(F.col("kind").isin("list_binding", "local_binding", "parameter", "keyword_parameter")).join(asked, ["source_id", "owner", "candidate"], "left_semi")
    only_lists = bound.groupBy("source_id", "owner", "candidate").agg(F.min((F.col("kind") == "list_binding").cast("int")).alias("l")).where("l = 1").drop("l")
    members = occurrences.where("kind = 'membership'").join(only_lists, ["source_id", "owner", "candidate"], "left_semi")
    by_member = members.join(r.where("matcher = 'list_membership'"), _applies())
    out = [x.select(F.col("id").alias("occ_id"), "rule", "operation", *(x[k] for k in keep)) for x in (by_call, by_field, by_write, by_member)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).distinct()


def rule_hits(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule with its number of hits, 0 included."""
    n = found.groupBy(F.col("rule").alias("id")).agg(F.count("*").alias("hits"))
    return rules.select("id").join(n, "id", "left").fillna(0, ["hits"])


def calls_unmatched(occurrences: DataFrame, found: DataFrame) -> DataFrame:
    calls = occurrences.where(F.col("kind").isin("call_observed", "method_call_observed"))
    return calls.join(found.select(F.col("occ_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("calls_unmatched"))


def loops_of(occurrences: DataFrame) -> DataFrame:
    """Loops with their iterable's span: the innermost loop that holds an iterable owns it."""
    loops = occurrences.where("kind = 'loop'").select("id", "source_id", "start", "end")
    iterables = occurrences.where("kind = 'loop_iterable'").select(F.col("id").alias("it"), "source_id", "start", "end")
    own = intervals.innermost(iterables.withColumnRenamed("it", "id"), loops, "source_id", "id", "id").select(F.col("outer_id").alias("_l"), F.col("start").alias("iter_start"), F.col("end").alias("iter_end"))
    return loops.join(own, F.col("id") == F.col("_l"), "left").drop("_l").dropDuplicates(["id"])


def in_loops(rows: DataFrame, loops: DataFrame) -> DataFrame:
    """``rows`` once for each loop around them, ``outer_id``; by ``loops_of`` unless an extraction gives the loops of each."""
    if "loops" in rows.columns:
        return rows.withColumn("outer_id", F.explode("loops")).drop("loops")
    return intervals.loop_members(rows, loops, "source_id")


def direct(occurrences: DataFrame, loops: DataFrame, found: DataFrame) -> DataFrame:
    """(loop, occ_id, operation): operations inside a loop and outside its iterable."""
    rows = found if "loops" in found.columns else occurrences.join(found, F.col("id") == F.col("occ_id"))
    return in_loops(rows, loops).select(F.col("outer_id").alias("loop"), "occ_id", "operation", *(["owner"] if "owner" in found.columns else []))


def repeated_calls(occurrences: DataFrame, loops: DataFrame) -> DataFrame:
    """(loop, name, lines): names called more than once in a loop, with their places in order."""
    calls = occurrences.where(F.col("kind").isin("call_observed", "method_call_observed") & F.col("candidate").isNotNull())
    inside = in_loops(calls, loops)
    return inside.groupBy(F.col("outer_id").alias("loop"), F.col("candidate").alias("name")).agg(F.array_sort(F.collect_list("start")).alias("places")).where(F.size("places") > 1)


def through_calls(chains: DataFrame, found: DataFrame, owners: DataFrame) -> DataFrame:
    """(entry, operation, node, length): of each operation that a chain from a loop reaches, the shortest chain."""
    ops = found.join(owners.select("occ_id", "owner"), "occ_id").select(F.col("owner").alias("node"), "operation", "occ_id")
    j = chains.join(ops, "node")
    best = Window.partitionBy("entry", "occ_id").orderBy("length", "path")
    return j.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("entry", "operation", "node", "length", "occ_id")


def symbol_operations(found: DataFrame, owners: DataFrame, links: DataFrame) -> DataFrame:
    """Symbols with operations: those operations, and which other such symbols they call and are called by."""
    own = (found if "owner" in found.columns else found.join(owners.select("occ_id", "owner"), "occ_id")).groupBy(F.col("owner").alias("symbol")).agg(F.array_sort(F.collect_set("operation")).alias("operations"))
    ids = own.select("symbol")
    within = links.join(ids.withColumnRenamed("symbol", "caller"), "caller", "left_semi").join(ids.withColumnRenamed("symbol", "target"), "target", "left_semi")
    calls = within.groupBy(F.col("caller").alias("symbol")).agg(F.array_sort(F.collect_set("target")).alias("calls"))
    called = within.groupBy(F.col("target").alias("symbol")).agg(F.array_sort(F.collect_set("caller")).alias("called_by"))
    return own.join(calls, "symbol", "left").join(called, "symbol", "left")


def summary_text(found: DataFrame) -> DataFrame:
    """One line per operation, the most frequent first: ``operation: n``."""
    n = found.groupBy("operation").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "operation").select(F.format_string("%s: %d", "operation", "n").alias("line"))


def declaration_places(found: DataFrame, occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source_id, qualified_name, start_line) of the declarations that hold an operation."""
    owners = found.select(F.col("owner").alias("id")) if "owner" in found.columns else occurrences.join(found.select(F.col("occ_id").alias("id")), "id", "left_semi").select(F.col("owner").alias("id"))
    return symbols.join(owners, "id", "left_semi").select("source_id", "qualified_name", "start_line")


def hot_operations(inside: DataFrame, occurrences: DataFrame, counts: DataFrame) -> DataFrame:
    """(symbol, operation, occ_id) of operations in loops (``direct``), other than arithmetic, of functions (symbol, calls) that ran."""
    rows = inside.where("operation <> 'math'")
    if "owner" in inside.columns:
        rows = rows.select("occ_id", "operation", F.col("owner").alias("symbol")).distinct()
    else:
        rows = rows.select("occ_id", "operation").distinct().join(occurrences.select(F.col("id").alias("occ_id"), F.col("owner").alias("symbol")), "occ_id")
    return rows.join(counts.where("calls > 0").select("symbol").distinct(), "symbol", "left_semi").select("symbol", "operation", "occ_id")


def whole_each_turn(occurrences: DataFrame, loops: DataFrame, links: DataFrame) -> DataFrame:
    """(loop, occ_id, callee, parameter, argument): calls in a loop to a function that walks one of its parameters in a loop, and that pass for it
    something which uses no name bound inside the caller's loop: the same collection is walked on every turn.

    ``links`` are resolved calls (occ_id, how, target).  A call on a receiver fills ``self`` or ``cls`` without an argument.
    """
    calls = occurrences.where(F.col("kind").isin("call_observed", "method_call_observed"))
    inside = intervals.loop_members(calls, loops, "source_id").select(F.col("outer_id").alias("loop"), F.col("id").alias("occ_id"), "label", "receiver")
    settled = links.where(F.col("target").isNotNull() & ~F.col("how").isin("homonym")).select("occ_id", F.col("target").alias("callee")).distinct()
    walked = occurrences.where("kind = 'loop_iterable' and owner is not null").select(F.col("owner").alias("callee"), F.trim("label").alias("parameter")).distinct()
    place = F.row_number().over(Window.partitionBy("owner").orderBy("start")) - 1
    given = occurrences.where(F.col("kind").isin("parameter", "keyword_parameter") & F.col("owner").isNotNull()).withColumn("_at", place)
    first = given.where("_at = 0").select(F.col("owner").alias("callee"), F.col("label").isin("self", "cls").alias("_own"))
    named = given.select(F.col("owner").alias("callee"), F.trim("label").alias("parameter"), "_at", (F.col("kind") == "parameter").alias("_positional"))
    j = inside.join(settled, "occ_id").join(walked, "callee").join(named, ["callee", "parameter"]).join(first, "callee", "left")
    j = j.withColumn("_args", code_text.arguments_of("label"))
    skip = F.when(F.col("receiver").isNotNull() & F.coalesce("_own", F.lit(False)), 1).otherwise(0)
    by_name = F.get(F.filter("_args", lambda a: a["name"] == F.col("parameter")), F.lit(0))["value"]
    by_place = F.when(F.col("_positional") & (F.col("_at") >= skip), F.get(F.filter("_args", lambda a: a["name"].isNull()), F.col("_at") - skip)["value"])
    found = j.withColumn("argument", F.coalesce(by_name, by_place)).where("argument is not null").select("loop", "occ_id", "callee", "parameter", "argument")
    bound = occurrences.where(F.col("kind").isin("local_binding", "name_write", "list_binding"))
    changing = intervals.loop_members(bound, loops, "source_id").groupBy(F.col("outer_id").alias("loop")).agg(F.collect_set("label").alias("_changing"))
    names = F.regexp_extract_all("argument", F.lit(r"[^\W\d]\w*"), F.lit(0))
    fixed = found.join(changing, "loop", "left").where(~F.coalesce(F.arrays_overlap(names, F.col("_changing")), F.lit(False)))
    return fixed.drop("_changing").distinct()
