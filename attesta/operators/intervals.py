"""Joins and algebra of half-open spans [start, end) within a key.

Pairs come from a join on the key and on buckets of the outer span's size class
and place (``containers``), which keeps the work near the number of true pairs.
Questions that one outer span per inner one answers (is it in any, which of
disjoint ones holds it) take one sort of both and a running maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_levels(df: DataFrame, start: str, end: str) -> DataFrame:
    """Each outer span under the buckets, at its own power-of-two size, that it touches (at most two)."""
    size = F.greatest(F.col(end) - F.col(start), F.lit(1)).cast("double")
    level = F.ceil(F.log2(size)).cast("int")
    leveled = df.withColumn("_level", level)
    ends = leveled.withColumn("_first", F.col(start).cast("long")).withColumn("_last", F.greatest(F.col(end) - 1, F.col(start)).cast("long"))
    return ends.withColumn("_bucket", F.expr("explode(sequence(shiftright(_first, _level), shiftright(_last, _level)))")).drop("_first", "_last")


def containers(inner: DataFrame, outer: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of an inner span and an outer one of the same key that contains it; the outer's columns are prefixed ``outer_``.

    An inner span looks in one bucket for each power-of-two size that an outer
    span has (64 at most, a subquery of the plan), so a file of n nested spans
    costs n times the number of sizes, not n squared.
    """
    o = _with_levels(outer, start, end)
    sizes = o.select("_level").where("_level is not null").distinct().agg(F.collect_list("_level"))
    i = inner.withColumn("_levels", sizes.scalar()).withColumn("_level", F.explode("_levels")).drop("_levels")
    i = i.withColumn("_first", F.col(start).cast("long")).withColumn("_bucket", F.expr("shiftright(_first, _level)")).drop("_first")
    renamed = o.select(*(F.col(c).alias(f"outer_{c}") for c in outer.columns), F.col("_level").alias("_l"), F.col("_bucket").alias("_b"))
    on = (F.col(key) == F.col(f"outer_{key}")) & (F.col("_level") == F.col("_l")) & (F.col("_bucket") == F.col("_b"))
    inside = (F.col(f"outer_{start}") <= F.col(start)) & (F.col(end) <= F.col(f"outer_{end}"))
    return i.join(renamed, on).where(inside).drop("_level", "_bucket", "_l", "_b")


def _last_begun(rows: DataFrame, spans: DataFrame, key: str, at: str, start: str, value: Column) -> DataFrame:
    """``rows`` with ``_last``: the greatest ``value`` of the spans of their key that begin at or before ``at``; one sort, no join."""
    null = F.lit(None).cast(spans.select(value.alias("v")).schema["v"].dataType)
    own = rows.select(F.col(key).alias("_k"), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_late"), null.alias("_v"), F.struct(*rows.columns).alias("_row"))
    nothing = F.lit(None).cast(own.schema["_row"].dataType)
    begun = spans.select(F.col(key).alias("_k"), F.col(start).cast("long").alias("_at"), F.lit(0).alias("_late"), value.alias("_v"), nothing.alias("_row"))
    upto = Window.partitionBy("_k").orderBy("_at", "_late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = own.unionByName(begun).withColumn("_last", F.max("_v").over(upto)).where("_late = 1")
    return marked.select("_row.*", "_last")


def innermost(inner: DataFrame, outer: DataFrame, key: str, inner_id: str, outer_id: str, start: str = "start", end: str = "end") -> DataFrame:
    """Each inner span with the smallest outer span that contains it and isn't itself; ties go to the lesser outer id.  Spans in none are left out."""
    pairs = containers(inner, outer, key, start, end).where(~F.col(inner_id).eqNullSafe(F.col(f"outer_{outer_id}")))
    length = F.col(f"outer_{end}") - F.col(f"outer_{start}")
    best = Window.partitionBy(inner_id).orderBy(length, f"outer_{outer_id}")
    return pairs.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def outside_all(inner: DataFrame, outer: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Inner spans that no outer span of their key contains: none that begins no later ends no earlier.  A null key or bound is in no span."""
    known = outer.where(F.col(key).isNotNull() & F.col(start).isNotNull())
    marked = _last_begun(inner, known, key, start, start, F.col(end))
    return marked.where(F.coalesce(F.col("_last") < F.col(end), F.lit(True))).drop("_last")


def loop_members(occurrences: DataFrame, loops: DataFrame, key: str) -> DataFrame:
    """(occurrence, loop) where it stands inside the loop's span and not inside its iterable's (iter_start, iter_end, null if none)."""
    pairs = containers(occurrences, loops, key)
    in_iterable = (F.col("outer_iter_start") <= F.col("start")) & (F.col("end") <= F.col("outer_iter_end"))
    return pairs.where(~F.coalesce(in_iterable, F.lit(False)))


def nesting(spans: DataFrame, key: str, span_id: str) -> DataFrame:
    """Adds depth (spans around it) and inner (spans within it)."""
    pairs = containers(spans, spans, key).where(F.col(span_id) != F.col(f"outer_{span_id}"))
    around = pairs.groupBy(span_id).agg(F.count("*").alias("depth"))
    within = pairs.groupBy(F.col(f"outer_{span_id}").alias(span_id)).agg(F.count("*").alias("inner"))
    return spans.join(around, span_id, "left").join(within, span_id, "left").fillna(0, ["depth", "inner"])


def merged(spans: DataFrame, key: str, start: str = "start", end: str = "end", touch: int = 0) -> DataFrame:
    """Unions of spans that overlap or touch (``touch`` 1: of inclusive line ranges that adjoin), per key."""
    order = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + touch), 1).otherwise(0)
    marked = spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order))
    return marked.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def context_ranges(facts: DataFrame, sources: DataFrame, radius: int, key: str = "source_id") -> DataFrame:
    """Line ranges of facts (line, end_line) widened by ``radius``, clamped to the source's ``n_lines``, merged."""
    wide = facts.join(sources.select(key, "n_lines"), key).select(
        key, F.greatest(F.col("line") - radius, F.lit(1)).alias("start"), F.least(F.coalesce("end_line", "line") + radius, F.col("n_lines")).alias("end")
    )
    return merged(wide, key, touch=0)


def covers(parts: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """``windows`` with covered: whether the union of ``parts`` (inclusive lines) holds the whole window."""
    found = _last_begun(windows, merged(parts, key, touch=1), key, "start", "start", F.col("end"))
    return found.withColumn("covered", F.coalesce(F.col("_last") >= F.col("end"), F.lit(False))).drop("_last")


def overlapping(edits: DataFrame, key: str) -> DataFrame:
    """Edits that begin before an earlier one of the same key ends (inclusive lines)."""
    order = Window.partitionBy(key).orderBy("start", "end")
    return edits.withColumn("_before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("start") <= F.col("_before")).drop("_before")


def holder(points: DataFrame, symbols: DataFrame, path: str, line: str, symbol_id: str) -> DataFrame:
    """Each (path, line) with the innermost symbol whose lines hold it."""
    s = symbols.select(F.col(path), F.col("start_line").alias("_s"), (F.col("end_line") + 1).alias("_e"), F.col(symbol_id).alias("holder"))
    p = points.withColumn("_s", F.col(line)).withColumn("_e", F.col(line) + 1)
    pairs = containers(p, s, path, "_s", "_e")
    best = Window.partitionBy(*points.columns).orderBy(F.col("outer__e") - F.col("outer__s"), "outer_holder")
    first = pairs.withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    return first.select(*points.columns, F.col("outer_holder").alias("holder"))


def shared_blocks(selections: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Selections with the number of the merged range that holds their first line: one block for all that share it."""
    r = ranges.withColumn("block", F.row_number().over(Window.partitionBy(key).orderBy("start")))
    found = _last_begun(selections, r, key, "line", "start", F.struct("start", "end", "block"))
    return found.withColumn("block", F.when(F.col("line") <= F.col("_last.end"), F.col("_last.block"))).drop("_last")


def by_bytes(content: Column, start: Column, end: Column) -> Column:
    """The bytes [start, end) of a binary column."""
    return F.substring(content, start.cast("int") + 1, (end - start).cast("int"))


def line_of_byte(content: Column, offset: Column) -> Column:
    """The line (from 1) on which a byte offset of a binary column lies: one more than the line feeds before it."""
    before = F.decode(F.substring(content, F.lit(1), offset.cast("int")), "ISO-8859-1")
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def evidence_of(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """Spans (source_id, start, end) with the path, the source's and the excerpt's hash, and the first and last line; sources have id, path, content."""
    s = sources.select(F.col("id").alias("source_id"), "path", "content", F.sha2("content", 256).alias("source_sha256"))
    j = spans.join(s, "source_id")
    excerpt = by_bytes(F.col("content"), F.col("start"), F.col("end"))
    last = line_of_byte(F.col("content"), F.greatest(F.col("end") - 1, F.col("start")))
    return j.select(*spans.columns, "path", "source_sha256", F.sha2(excerpt, 256).alias("excerpt_sha256"), line_of_byte(F.col("content"), F.col("start")).alias("start_line"), last.alias("end_line"))
