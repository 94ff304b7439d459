"""From extracted records to a code graph and its resolved calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators import graph, intervals, resolve
from attesta.plans.registry import candidate_kinds
from attesta.storage import save

CALLS = ("call_observed", "method_call_observed")
#: Columns of calls that an extraction makes from their own file.
SEEN = ("within", "typed", "imported")


def with_containers(symbols: DataFrame) -> DataFrame:
    """Symbols with ``container``: the innermost other symbol around each, null at the top; as it is where an extraction gives it."""
    if "container" in symbols.columns:
        return symbols
    inner = intervals.innermost(symbols.select("id", "source_id", "start", "end"), symbols.select("id", "source_id", "start", "end"), "source_id", "id", "id")
    return symbols.join(inner.select("id", F.col("outer_id").alias("container")), "id", "left")


def with_owners(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Occurrences with ``owner``, the innermost symbol around each, and ``receiver``, what is written before the last dot of a call; an owner that an extraction gives stays."""
    receiver = F.when(F.col("kind") == "method_call_observed", F.regexp_extract("label", r"^([\w.]+)\.\w+\(", 1))
    if "owner" in occurrences.columns:
        return occurrences.withColumn("receiver", receiver)
    bodies = symbols.where("kind in ('function', 'method', 'trait_method', 'class', 'impl', 'module')").select("id", "source_id", "start", "end")
    own = intervals.innermost(occurrences.select("id", "source_id", "start", "end"), bodies, "source_id", "id", "id").select("id", F.col("outer_id").alias("owner"))
    return occurrences.join(own, "id", "left").withColumn("receiver", receiver)


def edges(symbols: DataFrame, occurrences: DataFrame, pairs: DataFrame) -> DataFrame:
    """declares, contains, observes and name_candidate edges, each once."""
    s = with_containers(symbols)
    parts = [
        symbols.select(F.col("source_id").alias("from"), F.col("id").alias("to"), F.lit("declares").alias("kind")),
        s.where("container is not null").select(F.col("container").alias("from"), F.col("id").alias("to"), F.lit("contains").alias("kind")),
        occurrences.where("owner is not null").select(F.col("owner").alias("from"), F.col("id").alias("to"), F.lit("observes").alias("kind")),
        pairs.select(F.col("occ_id").alias("from"), F.col("sym_id").alias("to"), F.lit("name_candidate").alias("kind")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return graph.distinct_edges(out).withColumn("id", graph.edge_id("from", "to", "kind"))


def admitted(pairs: DataFrame, calls: DataFrame, contained: DataFrame) -> DataFrame:
    """Candidates that a call's form admits, by symbols with their container: a receiver's call never reaches a free function, a plain one no method but of its own class."""
    s = contained.select(F.col("id").alias("sym_id"), F.col("kind").alias("_k"), F.col("container").alias("_c"))
    caller = contained.select(F.col("id").alias("owner"), F.col("container").alias("_oc"))
    j = pairs.join(calls.select(F.col("id").alias("occ_id"), F.col("kind").alias("_call"), "owner"), "occ_id").join(s, "sym_id").join(caller, "owner", "left")
    is_method = F.col("_k").isin("method", "trait_method")
    ok = F.when(F.col("_call") == "method_call_observed", is_method | (F.col("_k") == "class")).otherwise(~is_method | F.coalesce(F.col("_c") == F.col("_oc"), F.lit(False)))
    return j.where(ok).select("occ_id", "sym_id")


def _resolved_by_file(spark: SparkSession, tables: dict[str, DataFrame], keep: tuple[str, ...]) -> DataFrame:
    """``resolved_calls`` of occurrences with ``within``, ``typed`` and ``imported``: the rules on a call's candidates are one expression on its row, and only calls that these leave are joined again."""
    symbols = tables["symbols"]
    calls = with_owners(tables["occurrences"], symbols).where(F.col("kind").isin(*CALLS) & F.col("owner").isNotNull())
    calls = calls.select(F.col("id").alias("occ_id"), F.col("owner").alias("caller"), "kind", "candidate", "language", "source_id", "within", "typed", "imported", F.coalesce(F.col("receiver") == "self", F.lit(False)).alias("own"), *keep)
    found = graph.candidate_lists(calls, symbols, candidate_kinds(spark).where(F.col("occ_kind").isin(*CALLS)), ("container",))
    is_method = lambda x: x["sym_kind"].isin("method", "trait_method")
    beside = lambda x: F.coalesce(x["container"] == F.col("within"), F.lit(False))
    admits = lambda x: F.when(F.col("kind") == "method_call_observed", is_method(x) | (x["sym_kind"] == "class")).otherwise(~is_method(x) | beside(x))
    mine = F.coalesce(F.filter("candidates", admits), F.filter(F.col("candidates"), lambda x: F.lit(False)))
    ids = lambda c: F.transform(c, lambda x: x["sym_id"])
    fellows = F.filter("mine", beside)
    receiver = F.when(F.col("own") & (F.size(fellows) == 1) & (fellows[0]["sym_kind"] != "trait_method"), ids(fellows))
    found = found.withColumn("mine", mine).withColumn("receiver", receiver)
    one = F.coalesce(F.size("mine") == 1, F.lit(False))
    row = ["occ_id", "caller", *keep, "source_id", F.col("candidate").alias("name")]
    asks = ~one & (F.col("imported").isNotNull() | (F.col("typed").isNotNull() & F.col("receiver").isNull()))
    held = save(found.select(*row, F.when(asks, F.col("typed")).alias("typed"), F.when(asks, F.col("imported")).alias("imported"), one.alias("one"), asks.alias("asks"), "receiver", F.when(F.size("mine") > 0, ids(F.col("mine"))).alias("named"), F.coalesce(F.col("n") > graph.CANDIDATE_CAP, F.lit(False)).alias("above")), "admitted")
    asked = held.where("asks")
    files = resolve.module_files(tables["sources"]).select(F.col("dotted").alias("imported"), F.col("source_id").alias("_src"))
    top = symbols.where("top_level and kind in ('function', 'class')").select(F.col("id").alias("target"), "name", F.col("source_id").alias("_src"))
    by_import = asked.where("imported is not null").select("occ_id", "name", "imported").join(files, "imported").join(top, ["_src", "name"]).groupBy("occ_id").agg(F.collect_set("target").alias("by_import"))
    classes = symbols.where("kind = 'class'").select(F.col("id").alias("container"), F.col("name").alias("_class"))
    methods = symbols.where("kind in ('method', 'trait_method')").select(F.col("id").alias("target"), "name", "container").join(classes, "container").select("_class", "name", "target")
    typed = asked.where("typed is not null and receiver is null").select("occ_id", "name", F.explode("typed").alias("_class"))
    by_type = typed.join(methods, ["_class", "name"]).groupBy("occ_id").agg(F.collect_set("target").alias("by_type"))
    asked = asked.join(by_import, "occ_id", "left").join(by_type, "occ_id", "left")
    every = held.where("not asks").withColumns({"by_import": F.lit(None).cast("array<long>"), "by_type": F.lit(None).cast("array<long>")}).unionByName(asked)
    rules = (("unique", F.when(F.col("one"), F.col("named"))), ("import", F.col("by_import")), ("receiver", F.col("receiver")), ("type", F.col("by_type")), ("homonym", F.col("named")))
    how = F.coalesce(*(F.when(targets.isNotNull(), F.lit(rule)) for rule, targets in rules), F.when(F.col("above"), "above_limit").otherwise("no_candidate"))
    targets = F.coalesce(*(t for _, t in rules))
    return every.select("occ_id", "caller", *keep, how.alias("how"), F.explode_outer(targets).alias("target"))


def resolved_calls(spark: SparkSession, tables: dict[str, DataFrame], chosen: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(occ_id, caller, how, target) of every call of an edition's tables; with the columns ``keep`` of calls where the extraction gives what a call sees of its own file."""
    if chosen is None and set(SEEN) <= set(tables["occurrences"].columns):
        return _resolved_by_file(spark, tables, keep)
    symbols, occurrences = tables["symbols"], with_owners(tables["occurrences"], tables["symbols"])
    contained = with_containers(symbols)
    if "owner" not in tables["occurrences"].columns:  # made by a join
        occurrences = save(occurrences, "occurrences")
    if "container" not in symbols.columns:
        contained = save(contained, "contained")
    pairs, above = graph.name_candidates(occurrences, symbols, candidate_kinds(spark))
    calls = occurrences.where(F.col("kind").isin(*CALLS) & F.col("owner").isNotNull())
    mine = save(admitted(pairs.join(calls.select(F.col("id").alias("occ_id")), "occ_id", "left_semi"), calls, contained), "admitted")
    table = calls.select(F.col("id").alias("occ_id"), F.col("owner").alias("caller"), F.col("candidate").alias("name"), "source_id", "start", "end", F.split("receiver", r"\.")[0].alias("receiver_head"), F.col("receiver").isin("self").alias("own_receiver"))
    methods = contained.where("kind in ('method', 'trait_method')").select("id", "name", "container")
    classes = symbols.where("kind = 'class'").select(F.col("id").alias("type"), F.col("name").alias("_class"))
    written = occurrences.where("kind = 'receiver_type'").select("source_id", F.col("start").alias("_s"), F.col("candidate").alias("_class"))
    typed = table.join(written, (table["source_id"] == written["source_id"]) & (F.col("start") == F.col("_s"))).drop(written["source_id"]).join(classes, "_class").select("occ_id", "type").distinct()
    rules = {
        "unique": resolve.unique_links(mine),
        "import": resolve.import_links(table, tables["bindings"], resolve.module_files(tables["sources"]), symbols),
        "receiver": resolve.receiver_links(mine, table, contained),
        "type": resolve.type_links(table, typed, methods),
        "homonym": mine.select("occ_id", F.col("sym_id").alias("target")),
    }
    if chosen is not None:
        rules["chosen"] = chosen.select("occ_id", "target")
    return resolve.cascade(table, rules, above)
