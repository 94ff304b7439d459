"""Measurements: parsing, statistics of repetitions, comparison with a baseline, and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import code_text
from attesta.operators import intervals

#: The line's mark where none is given.
MARK = "attesta-measure"
#: The thresholds of the gate in percent.
CALLS_CHANGE, MOVED = 5.0, 10.0


def parse_lines(lines: DataFrame, line: str = "line", mark: str = MARK) -> DataFrame:
    """Valid measure lines ``mark name=value [unit] [at=path:line]`` with name, value, unit, at, series; other lines go.

    A value must be a finite number, a name letters, digits, ``_`` and ``.``, and
    there may be one origin: a relative path without ``..`` or colon, and a line from 1.
    """
    words = F.split(F.trim(F.regexp_extract(F.trim(line), rf"^{mark}\s+(.*)$", 1)), r"\s+")
    rows = lines.where(F.trim(line).rlike(rf"^{mark}\s")).withColumn("_w", words)
    rest = F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0)))
    ats = F.filter(rest, lambda w: w.startswith("at="))
    units = F.filter(rest, lambda w: ~w.startswith("at="))
    name, raw = F.regexp_extract(F.col("_w")[0], r"^([A-Za-z0-9_.]+)=", 1), F.regexp_extract(F.col("_w")[0], r"^[^=]*=(.*)$", 1)
    value = F.when(raw.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.expr("try_cast(regexp_extract(_w[0], '^[^=]*=(.*)$', 1) as double)"))
    at = F.when(F.size(ats) == 1, F.substring(ats[0], 4, 1 << 20))
    good_at = at.rlike(r"^(?![/\\])[^:]+:0*[1-9]\d*$") & ~at.rlike(r"(^|[/\\])\.\.([/\\]|:)")
    parsed = rows.select(*lines.columns, name.alias("name"), value.alias("value"), F.get(units, F.lit(0)).alias("unit"), at.alias("at"), (F.size(ats) == 0).alias("_no"), F.coalesce(good_at, F.lit(False)).alias("_ok"))
    kept = parsed.where((F.col("name") != "") & F.col("value").isNotNull() & (F.abs("value") < float("inf")) & (F.col("_no") | F.col("_ok"))).drop("_no", "_ok")
    return kept.withColumn("series", series_key())


def series_key() -> Column:
    return F.when(F.col("at").isNull(), F.col("name")).otherwise(F.concat("name", F.lit("@"), "at"))


def summary(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, median (mean of the middle two where even), min and max per key."""
    return values.groupBy(*keys).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))


def successes(runs: DataFrame) -> DataFrame:
    return runs.where("exit_code = 0 and not timed_out")


def stability(outputs: DataFrame, keys: list[str], sha: str = "sha256") -> DataFrame:
    """Per key: the number of distinct hashes, and the hash if there is one only."""
    return outputs.groupBy(*keys).agg(F.count_distinct(sha).alias("n_distinct"), F.when(F.count_distinct(sha) == 1, F.min(sha)).alias("sha256"))


def compared_outputs(baseline: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """same, different, or unstable (more than one hash, or none to compare with) for each current output of ``stability``."""
    b = baseline.select(key, F.col("sha256").alias("_b"))
    state = F.when(F.col("sha256").isNull() | F.col("_b").isNull(), "unstable").when(F.col("sha256") == F.col("_b"), "same").otherwise("different")
    return current.join(b, key, "left").select(key, state.alias("state"))


def compared(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Series of both summaries: medians, change in percent to one decimal (null from 0), and whether the ranges overlap."""
    b = baseline.select(*keys, F.col("median").alias("baseline_median"), F.col("min").alias("_bmin"), F.col("max").alias("_bmax"))
    j = current.join(b, keys)
    change = F.when(F.col("baseline_median") != 0, _rounded((F.col("median") - F.col("baseline_median")) / F.col("baseline_median") * 1000) / 10)
    overlap = ~((F.col("max") < F.col("_bmin")) | (F.col("min") > F.col("_bmax")))
    return j.select(*keys, "baseline_median", "median", change.alias("change_pct"), overlap.alias("ranges_overlap"))


def _rounded(c: Column) -> Column:
    """Half away from zero."""
    return F.signum(c) * F.floor(F.abs(c) + 0.5)


def project_numbers(comparison: DataFrame, better: Column) -> DataFrame:
    """Series that the project measured, with ``improved`` in percent: by the declared direction, else ``_ms`` gets better when it drops."""
    own = comparison.where(~F.col("series").contains("@") & (F.col("series") != "wall_ms"))
    change = F.coalesce("change_pct", F.lit(0.0))
    improved = F.when(better == "higher", change).when(better.isNotNull(), -change).when(F.col("series").endswith("_ms"), -change)
    return own.withColumn("improved", improved).where("improved is not null")


def moved() -> Column:
    return (F.abs("improved") >= MOVED) & ~F.col("ranges_overlap")


def worse(numbers: DataFrame) -> DataFrame:
    """Numbers that moved the wrong way: shown beside the verdict, refused by nobody."""
    return numbers.where((F.col("improved") < 0) & moved())


def verdict(executions: DataFrame, comparison: DataFrame, outputs: DataFrame, numbers: DataFrame, keys: list[str]) -> DataFrame:
    """Per change: passed, n_issues, dropped.

    It passes without issues and with something that dropped: all repetitions of
    each execution (succeeded, attempted, issues, stopped) succeeded, no output
    changed, no count rose by 5 % or more, and a count fell by 5 %, a counter
    stopped, or a number improved by a tenth with its ranges apart.
    """
    calls = F.col("series").startswith("calls@")
    ex = executions.groupBy(*keys).agg(
        F.sum(F.when((F.col("attempted") == 0) | (F.col("succeeded") < F.col("attempted")), 1).otherwise(0) + F.coalesce("issues", F.lit(0))).alias("a"), F.max((F.coalesce("stopped", F.lit(0)) > 0).cast("int")).alias("da")
    )
    co = comparison.groupBy(*keys).agg(F.sum((calls & (F.col("change_pct") >= CALLS_CHANGE)).cast("int")).alias("b"), F.max((calls & (F.col("change_pct") <= -CALLS_CHANGE)).cast("int")).alias("db"))
    ou = outputs.groupBy(*keys).agg(F.sum((F.col("state") != "same").cast("int")).alias("c"))
    nu = numbers.groupBy(*keys).agg(F.max(((F.col("improved") > 0) & moved()).cast("int")).alias("dc"))
    j = ex.join(co, keys, "left").join(ou, keys, "left").join(nu, keys, "left").fillna(0)
    issues, dropped = F.col("a") + F.col("b") + F.col("c"), F.greatest("da", "db", "dc") > 0
    return j.select(*keys, (F.coalesce(issues, F.lit(0)) == 0).__and__(dropped).alias("passed"), issues.cast("long").alias("n_issues"), dropped.alias("dropped"))


def gain(comparison: DataFrame, numbers: DataFrame, keys: list[str]) -> DataFrame:
    """Per change: the largest improvement of a project number, else by how many percent the total of counts fell."""
    calls = comparison.where(F.col("series").startswith("calls@")).groupBy(*keys).agg(F.sum("baseline_median").alias("_b"), F.sum("median").alias("_a"))
    best = numbers.groupBy(*keys).agg(F.max("improved").alias("_t"))
    every = comparison.select(*keys).distinct().join(calls, keys, "left").join(best, keys, "left")
    counted = F.when(F.col("_b") > 0, (F.col("_b") - F.col("_a")) / F.col("_b") * 100).otherwise(0.0)
    return every.select(*keys, F.coalesce("_t", counted, F.lit(0.0)).alias("gain"))


def best_change(verdicts: DataFrame, gains: DataFrame, group: list[str], change: str) -> DataFrame:
    """Changes labelled refused, best (the greatest gain of those passed; ties to the lesser id) or passed_smaller."""
    j = verdicts.join(gains, [*group, change])
    order = Window.partitionBy(*group, "passed").orderBy(F.desc("gain"), change)
    label = F.when(~F.col("passed"), "refused").when(F.row_number().over(order) == 1, "best").otherwise("passed_smaller")
    return j.select(*group, change, "gain", label.alias("label"))


def vanished_counters(before: DataFrame, after: DataFrame, kept_functions: DataFrame, removed_lines: DataFrame) -> DataFrame:
    """Per series (function, series) that is gone: with_function if the function is gone too, deleted if its line was removed, else stopped."""
    gone = before.join(after.select("series"), "series", "left_anti")
    j = gone.join(kept_functions.select("function", F.lit(True).alias("_kept")).distinct(), "function", "left")
    j = j.join(removed_lines.select("series", F.lit(True).alias("_removed")).distinct(), "series", "left")
    return j.select("series", "function", F.when(F.col("_kept").isNull(), "with_function").when(F.col("_removed").isNotNull(), "deleted").otherwise("stopped").alias("fate"))


def tampering(changed: DataFrame, protected: DataFrame, statement: str) -> DataFrame:
    """Issues of changed lines (path, added, removed arrays): protected_path, statement_removed, statement_added."""
    p = protected.select("prefix").where("prefix is not null").distinct()
    sizes = p.select(F.length("prefix").alias("n")).distinct().agg(F.collect_list("n"))  # the lengths of prefixes are few
    starts = changed.select("path").withColumn("_n", sizes.scalar()).select("path", F.explode("_n").alias("_n")).select("path", F.substring(F.col("path"), F.lit(1), F.col("_n")).alias("prefix"))
    hit = starts.join(p, "prefix", "left_semi").select("path").distinct().select("path", F.lit("protected_path").alias("issue"))
    has = lambda c: F.exists(c, lambda x: x.contains(statement))
    removed = changed.where(has("removed")).select("path", F.lit("statement_removed").alias("issue"))
    added = changed.where(has("added")).select("path", F.lit("statement_added").alias("issue"))
    return hit.unionByName(removed).unionByName(added)


def weighted_estimate(sample: DataFrame, population: DataFrame, stratum: str, category: str) -> DataFrame:
    """Sum over strata of the stratum's size times the category's share of its sample, rounded."""
    share = sample.groupBy(stratum, category).agg(F.count("*").alias("_k"))
    total = sample.groupBy(stratum).agg(F.count("*").alias("_m"))
    j = share.join(total, stratum).join(population.groupBy(stratum).agg(F.count("*").alias("_n")), stratum)
    return j.groupBy(category).agg(F.round(F.sum(F.col("_n") * F.col("_k") / F.col("_m"))).cast("long").alias("estimate"))


def histogram_gate(base: DataFrame, now: DataFrame, category: str, bad: str, good: str) -> DataFrame:
    """Counts per category of both, and whether it holds: no more of ``bad``, no fewer of ``good``."""
    b = base.groupBy(category).agg(F.count("*").alias("before"))
    n = now.groupBy(category).agg(F.count("*").alias("after"))
    j = b.join(n, category, "full_outer").fillna(0, ["before", "after"])
    holds = F.when(F.col(category) == bad, F.col("after") <= F.col("before")).when(F.col(category) == good, F.col("after") >= F.col("before")).otherwise(True)
    return j.withColumn("holds", holds)


def per_function(counts: DataFrame, symbol: str, value: str) -> DataFrame:
    """A function's count is the greatest of its lines', never their sum."""
    return counts.groupBy(symbol).agg(F.max(value).alias(value))


def coverage_states(functions: DataFrame, counts: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Functions (id, language) with state counted_and_ran, counted_no_passes or no_coverage, the reason of the latter and the kind of a zero (count_kind)."""
    c = counts.groupBy(F.col("symbol").alias("id")).agg(F.max("calls").alias("calls"), F.min("count_kind").alias("count_kind"))
    j = functions.join(c, "id", "left")
    if reasons is not None:
        j = j.join(reasons.select("id", "reason"), "id", "left")
    else:
        j = j.withColumn("reason", F.lit(None).cast("string"))
    state = F.when(F.col("calls").isNull(), "no_coverage").when(F.col("calls") > 0, "counted_and_ran").otherwise("counted_no_passes")
    kinds = {"entry_calls": "entry_zero", "own_counter": "own_zero", "several_lines": "several_zero"}
    zero = F.lit("unknown_zero")
    for k, v in kinds.items():
        zero = F.when(F.col("count_kind") == k, v).otherwise(zero)
    return j.withColumn("state", state).withColumn("zero", F.when(F.col("calls") == 0, zero)).withColumn("reason", F.when(F.col("calls").isNull(), F.coalesce("reason", F.lit("not_instrumented"))))


def coverage_tally(states: DataFrame, key: str = "language") -> DataFrame:
    """total, counted, ran, no_passes and no_coverage per key, and overall (key null)."""
    count = lambda *s: F.sum(F.col("state").isin(*s).cast("int")).alias
    return states.rollup(key).agg(
        F.count("*").alias("total"), count("counted_and_ran", "counted_no_passes")("counted"), count("counted_and_ran")("ran"), count("counted_no_passes")("no_passes"), count("no_coverage")("no_coverage")
    )


def hotspots(counts: DataFrame, k: int | None = None) -> DataFrame:
    """Rows by calls, then cpu_ms, both descending with nulls last, then at."""
    out = counts.orderBy(F.desc_nulls_last("calls"), F.desc_nulls_last("cpu_ms"), "at")
    return out if k is None else out.limit(k)


def rankings(rows: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` that ran by count, and by time: ranking, position and the row."""
    ran = rows.where("calls > 0")
    by = {"count": [F.desc_nulls_last("calls"), "at"], "time": [F.desc_nulls_last("cpu_ms"), "at"]}
    parts = [ran.orderBy(*o).limit(k).withColumn("position", F.row_number().over(Window.orderBy(*o))).withColumn("ranking", F.lit(n)) for n, o in by.items()]
    return parts[0].unionByName(parts[1])


def relevant_callers(links: DataFrame, counts: DataFrame) -> DataFrame:
    """Per target, callers with 5 % of its count and more, else the greatest one: target, caller, calls."""
    j = links.join(counts.select(F.col("symbol").alias("caller"), F.col("calls")), "caller").join(counts.select(F.col("symbol").alias("target"), F.col("calls").alias("_t")), "target")
    order = Window.partitionBy("target").orderBy(F.desc("calls"), "caller")
    many = F.col("calls") * 20 >= F.col("_t")
    return j.withColumn("_r", F.row_number().over(order)).where(many | (F.col("_r") == 1)).select("target", "caller", "calls")


#: Kinds that are counted, and the language whose functions get a counter.
MEASURED_KINDS, MEASURED_LANGUAGE = ("function", "method", "trait_method"), "rust"
#: Resolutions that link a call, and kinds of targets that a call makes an instance of.
LINKED, INSTANTIATED = ("unique", "receiver", "type", "trait_default", "import", "chosen"), ("class", "struct", "variant")
#: What a fact depends on, from the mildest to the worst.
SEVERITIES = ("independent", "right", "suspect", "wrong")


def can_place(sources: DataFrame) -> DataFrame:
    """One row: whether there is a source of the language whose functions can be counted."""
    return sources.agg(F.coalesce(F.bool_or(F.col("language") == MEASURED_LANGUAGE), F.lit(False)).alias("can_place"))


def instrumentation_plan(symbols: DataFrame, statement: str, skipped: list[str]) -> DataFrame:
    """(id, reason, brace) of the counted kinds of ``symbols`` (id, kind, language, is_test, path, text: what the declaration spans).

    Reasons, the first that holds: not_classified, language_not_supported, test, skipped_path, no_body, const_fn,
    already_counts; a function without a reason gets the statement after the bracket at byte ``brace`` of its text.
    """
    marker = statement.strip().rstrip(";").strip()
    own = symbols.where(F.col("kind").isin(*MEASURED_KINDS)).withColumn("_b", code_text.body_braces_of("text"))
    head, body = F.substring(F.col("text"), F.lit(1), F.col("_b")), F.substring(F.col("text"), F.col("_b") + 1, F.length("text"))
    left_out = F.lit(False)
    for prefix in skipped:
        left_out = left_out | F.col("path").startswith(prefix)
    reason = (
        F.when(F.col("language").isNull(), "not_classified").when(F.col("language") != MEASURED_LANGUAGE, "language_not_supported").when(F.col("text").isNull(), "not_classified")
        .when(F.col("is_test"), "test").when(left_out, "skipped_path").when(F.col("_b").isNull(), "no_body").when(head.rlike(r"(^|\s)const\s+fn(\s|$)"), "const_fn").when(F.contains(body, F.lit(marker)), "already_counts")
    )
    return own.select("id", reason.alias("reason"), F.when(reason.isNull(), F.octet_length(head)).alias("brace"))


def count_kinds(rows: DataFrame, planned: DataFrame | None) -> DataFrame:
    """Counted lines (symbol, at) with count_kind: several_lines where the function has more than one, entry_calls on a
    planned line of just this function, own_counter off the plan, unknown without a function, a line or a plan."""
    lines = F.when(F.col("symbol").isNotNull(), F.count("*").over(Window.partitionBy("symbol")))
    out = rows.withColumn("_lines", lines)
    if planned is None:
        kind = F.lit("unknown")
    else:
        per = planned.groupBy("at").agg(F.count("*").alias("_n"), F.max("symbol").alias("_s"))
        out = out.join(per, "at", "left")
        kind = F.when(F.col("_n").isNull(), "own_counter").when((F.col("_n") == 1) & (F.col("_s") == F.col("symbol")), "entry_calls").otherwise("unknown")
    kind = F.when(F.col("symbol").isNull() | F.col("at").isNull(), "unknown").when(F.col("_lines") > 1, "several_lines").otherwise(kind)
    return out.select(*rows.columns, kind.alias("count_kind"))


def call_pool(occurrences: DataFrame) -> DataFrame:
    """Calls ``object.method()`` of functions and methods outside tests, but for ``self.m()``: occurrences (id, kind, label, path, owner_kind, owner_name)."""
    own = (F.col("kind") == "method_call_observed") & F.col("owner_kind").rlike("function|method")
    tests = F.col("path").rlike(r"(^|/)tests?/|test_|_test\.|/benches/") | F.col("owner_name").contains("test")
    return occurrences.where(own & ~tests & F.col("label").rlike(r"^[A-Za-z_][\w.]*\.\w+\(") & ~F.col("label").rlike(r"^self\.\w+\("))


def sample_classes(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """(call_id, category) of answers (call_id, resolution, relation, targets: array of label and kind) by truth (call_id, target, bodies, relation):
    right, false_link, false_candidates, ambiguous, no_candidate.  ``bodies`` lists what may run where no single target is right."""
    t = truth.select("call_id", F.col("target").alias("_t"), F.col("bodies").alias("_bodies"), F.coalesce("relation", F.lit("")).alias("_r"))
    j = answers.join(t, "call_id").withColumn("_shown", F.transform("targets", lambda x: x["label"]))
    any_body, several = F.arrays_overlap("_shown", "_bodies"), F.col("_bodies").isNotNull()
    right = F.coalesce(F.array_contains("_shown", F.col("_t")), F.lit(False))
    linked = F.col("resolution").isin(*LINKED)
    decorates = F.col("_r") == "decorates"
    made = (F.size("targets") == 1) & F.get(F.col("targets"), F.lit(0))["kind"].isin(*INSTANTIATED)
    wrong_relation = (decorates != (F.coalesce("relation", F.lit("")) == "decorates")) | (~decorates & made & (F.coalesce("relation", F.lit("")) != "instantiates"))
    category = (
        F.when(F.col("resolution") == "no_candidate_in_project", "no_candidate")
        .when(several & (F.col("resolution") == "above_candidate_limit"), "ambiguous").when(several & (F.col("resolution") == "homonym"), F.when(any_body, "ambiguous").otherwise("false_candidates")).when(several, "false_link")
        .when(F.col("resolution") == "above_candidate_limit", F.when(F.col("_t").isNotNull(), "ambiguous").otherwise("false_candidates"))
        .when(F.col("resolution") == "homonym", F.when(right, "ambiguous").otherwise("false_candidates"))
        .when(linked & wrong_relation, "false_link").when(linked, F.when((F.size("_shown") == 1) & right, "right").otherwise("false_link"))
    )
    return j.select("call_id", category.alias("category"))


def fact_severities(calls: DataFrame, truth: DataFrame) -> DataFrame:
    """(fact_id, worst) of facts that rest on calls (fact_id, call_id, resolution, labels; a null resolution: no answer) by truth (call_id, target): the worst of their calls."""
    j = calls.join(truth.select("call_id", F.col("target").alias("_t")), "call_id", "left")
    right = F.coalesce(F.array_contains("labels", F.col("_t")), F.lit(False))
    none = F.col("resolution").isNull() | F.col("resolution").isin("no_candidate_in_project", "above_candidate_limit")
    level = F.when(none, 0).when(F.col("resolution") == "homonym", F.when(right, 2).otherwise(3)).otherwise(F.when((F.size("labels") == 1) & right, 1).otherwise(3))
    worst = j.groupBy("fact_id").agg(F.max(level).alias("_w"))
    return worst.select("fact_id", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("_w") + 1).alias("worst"))


def level_states(cases: DataFrame, now: DataFrame) -> DataFrame:
    """(id, state) of cases (id, resolution, candidates, targets: as recorded; aim, aim_resolution, was_right) against what is found now (id, resolution, candidates, targets): not_found, on_target, on_target_before, as_recorded, changed."""
    n = now.select("id", F.col("resolution").alias("_r"), F.col("candidates").alias("_c"), F.array_sort("targets").alias("_t"))
    j = cases.join(n, "id", "left")
    same = (F.col("_r") == F.col("resolution")) & F.col("_c").eqNullSafe(F.col("candidates")) & (F.col("_t") == F.array_sort("targets"))
    reached = (F.size("_t") == 1) & (F.get(F.col("_t"), F.lit(0)) == F.col("aim")) & (F.col("_r") == F.col("aim_resolution"))
    state = F.when(F.col("_r").isNull(), "not_found").when(reached, F.when(F.col("was_right"), "on_target_before").otherwise("on_target")).when(same, "as_recorded").otherwise("changed")
    return j.select("id", state.alias("state"))


def counted_text() -> Column:
    """A count in words, by what its line can be said to be (calls, at, count_kind)."""
    n, line = F.format_number("calls", 0), F.regexp_extract("at", r":(\d+)$", 1)
    kind = F.col("count_kind")
    return (
        F.when(kind == "entry_calls", F.concat(n, F.lit(" calls"))).when(kind == "own_counter", F.concat(n, F.lit(" passes of line "), line, F.lit(", by the project's own counter")))
        .when(kind == "several_lines", F.concat(n, F.lit(" passes of line "), line, F.lit(", one of several that are counted"))).otherwise(F.concat(F.lit("an observed count of "), n))
    )


def hotspot_report(stats: DataFrame, symbols: DataFrame, planned: DataFrame, links: DataFrame) -> DataFrame:
    """Counted lines (path, line, calls, cpu_ms) with the innermost function that holds each (symbols: path, start_line, end_line, symbol), the kind
    of its count by the plan (at, symbol), and how many counted functions call it (links: caller, target)."""
    held = intervals.holder(stats.select("path", "line").distinct(), symbols, "path", "line", "symbol").withColumnRenamed("holder", "symbol")
    rows = stats.join(held, ["path", "line"], "left").withColumn("at", F.concat_ws(":", "path", "line"))
    rows = count_kinds(rows.select("path", "line", "at", "symbol", "calls", "cpu_ms"), planned)
    counted = rows.where("symbol is not null").select(F.col("symbol").alias("caller")).distinct()
    callers = links.where("caller <> target").select("caller", "target").distinct().join(counted, "caller", "left_semi").groupBy(F.col("target").alias("symbol")).agg(F.count("*").alias("n_callers"))
    return rows.join(callers, "symbol", "left").fillna(0, ["n_callers"])
