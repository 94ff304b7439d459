"""Candidates for an evidence package: tagged joins around chosen declarations, their gaps, and what their code does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators import intervals, records


def header(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(source_id, end_line): the last line that isn't blank before the first declaration of each file (source_id, line_no, line); files that begin with one have none."""
    first = symbols.groupBy("source_id").agg(F.min("start_line").alias("_f"))
    above = lines.join(first, "source_id").where((F.col("line_no") < F.col("_f")) & (F.trim("line") != ""))
    return above.groupBy("source_id").agg(F.max("line_no").alias("end_line"))


def header_line(lines: Column, first: Column) -> Column:
    """``header`` of one file by its array of lines and the line of its first declaration: the last line that isn't blank before that, null if there is none."""
    above = F.slice(lines, F.lit(1), (first - 1).cast("int"))
    return F.array_max(F.transform(above, lambda line, at: F.when(F.trim(line) != "", (at + 1).cast("long"))))


def candidates(chosen: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(ordinal, id, for_target, reason) in the order of ``parts``: chosen (id) first, then each tagged table (for_target, id)."""
    rows = [chosen.select(F.col("id"), F.col("id").alias("for_target"), F.lit("chosen").alias("reason"), F.lit(0).alias("_p"))]
    for place, (reason, df) in enumerate(parts.items(), 1):
        rows.append(df.select("id", "for_target", F.lit(reason).alias("reason"), F.lit(place).alias("_p")))
    every = reduce(DataFrame.unionByName, rows).distinct()
    return records.numbered(every, ["_p", "for_target", "id"], "ordinal").drop("_p")


def around(chosen: DataFrame, links: DataFrame, symbols: DataFrame) -> dict[str, DataFrame]:
    """The tagged tables that resolved calls and containers give: owner_type, called, called_owner, caller, test_caller."""
    c = chosen.select(F.col("id").alias("for_target"))
    s = symbols.select(F.col("id"), "container", "is_test")
    settled = links.where("target is not null and how <> 'homonym'")
    owner = c.join(s, F.col("for_target") == F.col("id")).where("container is not null").select("for_target", F.col("container").alias("id"))
    called = c.join(settled, F.col("for_target") == F.col("caller")).select("for_target", F.col("target").alias("id")).distinct()
    called_owner = called.join(s, "id").where("container is not null").select("for_target", F.col("container").alias("id")).distinct()
    callers = c.join(settled, F.col("for_target") == F.col("target")).select("for_target", F.col("caller").alias("id")).distinct().join(s.select("id", "is_test"), "id")
    return {"owner_type": owner, "called": called, "called_owner": called_owner, "caller": callers.where("not is_test").drop("is_test"), "test_caller": callers.where("is_test").drop("is_test")}


def homonym_gaps(chosen: DataFrame, links: DataFrame, ran: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Calls of chosen declarations with several candidates: those settled because just one candidate ran (for_target, id), and the others as gaps (for_target, occ_id, n)."""
    h = links.where("how = 'homonym'").join(chosen.select(F.col("id").alias("caller")), "caller", "left_semi")
    if ran is not None:
        h = h.join(ran.select(F.col("id").alias("target"), F.lit(1).alias("_r")).distinct(), "target", "left")
    else:
        h = h.withColumn("_r", F.lit(None).cast("int"))
    per = h.groupBy(F.col("caller").alias("for_target"), "occ_id").agg(F.count("*").alias("n"), F.sum("_r").alias("ran"), F.max(F.when(F.col("_r") == 1, F.col("target"))).alias("id"))
    return per.where("ran = 1").select("for_target", "id").distinct(), per.where("coalesce(ran, 0) <> 1").select("for_target", "occ_id", "n")


def trait_impls(owners: DataFrame, impls: DataFrame) -> DataFrame:
    """(type, id) of ``impl Trait for Type`` blocks (id, type, trait) of the owners' types."""
    return impls.where("trait is not null").join(owners.select("type").distinct(), "type", "left_semi").select("type", "id")


def behavior(chosen: DataFrame, occurrences: DataFrame, found: DataFrame, tests: DataFrame) -> DataFrame:
    """(id, fact, n): loops, operations, field writes and tests that the graph sees for each chosen declaration."""
    counted = occurrences.where("kind in ('loop', 'field_assign', 'name_write')") if "owner" in found.columns else occurrences
    of = chosen.select(F.col("id").alias("owner"))
    own = counted.join(of, "owner", "left_semi")
    loops = own.where("kind = 'loop'").groupBy(F.col("owner").alias("id")).agg(F.count("*").alias("n")).withColumn("fact", F.lit("loops"))
    held = found.join(of, "owner", "left_semi") if "owner" in found.columns else own.join(found.select(F.col("occ_id").alias("id"), "operation"), "id")
    ops = held.groupBy(F.col("owner").alias("id"), F.concat(F.lit("operation:"), "operation").alias("fact")).agg(F.count("*").alias("n"))
    writes = own.where("kind in ('field_assign', 'name_write')").groupBy(F.col("owner").alias("id")).agg(F.count("*").alias("n")).withColumn("fact", F.lit("writes"))
    tested = tests.join(chosen, "id", "left_semi").groupBy("id").agg(F.count("*").alias("n")).withColumn("fact", F.lit("tests"))
    return loops.unionByName(ops).unionByName(writes).unionByName(tested)


def field_writers(writes: DataFrame, owners: DataFrame, listed: int = records.LISTED_WRITES) -> tuple[DataFrame, DataFrame]:
    """Writes of fields (occ_id, field, owner_type or None, writer) joined with their owner's fields (owner_type, field); those that no owner explains are counted, the first ``listed`` shown."""
    hit = writes.join(owners.select("owner_type", "field").distinct(), ["owner_type", "field"]).select("owner_type", "field", F.col("writer").alias("id")).distinct()
    lost = writes.where("owner_type is null").join(owners.select("field").distinct(), "field", "left_semi")
    n = lost.groupBy("field").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("occ_id")), 1, listed).alias("sites"))
    return hit, n


def owner_methods(symbols: DataFrame) -> DataFrame:
    """(type, id): methods with the innermost class, struct or impl around them; as it is where an extraction gives it."""
    if "type" in symbols.columns:
        return symbols.where("kind in ('method', 'trait_method', 'function') and type is not null").select("type", "id")
    outer = symbols.where("kind in ('class', 'struct', 'impl', 'trait')").select("id", "source_id", "start", "end")
    inner = symbols.where("kind in ('method', 'trait_method', 'function')").select("id", "source_id", "start", "end")
    return intervals.innermost(inner, outer, "source_id", "id", "id").select(F.col("outer_id").alias("type"), "id")
