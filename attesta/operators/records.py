"""Latest-of, event-log folds, set comparisons, ordered unions and budgets over records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.session import let_workers_import
from attesta.storage import save

#: Budgets of evidence selection, and the rank of roles.
BUDGET_BYTES, MAX_ITEMS, OWNER_ADDITIONS, LISTED_WRITES, GATHERED, LACUNA_ADDS = 6144, 16, 8, 20, 16, 10
ROLE_RANKS = {"target": 0, "origin": 1, "cost": 2, "path": 3, "support": 4, "constraint": 5}


# -- latest of -------------------------------------------------------------------------------


def chronology(started: str = "started", record_id: str = "id") -> list[Column]:
    """Descending order of executions: a well-formed ``YYYYMMDD-HHMMSS`` start, then the folder's number, then the id; a malformed start comes first in time."""
    good = F.when(F.col(started).rlike(r"^\d{8}-\d{6}$"), F.col(started))
    number = F.expr(f"try_cast(split({record_id}, '-')[0] as bigint)")
    return [good.desc_nulls_last(), number.desc_nulls_last(), F.col(record_id).desc()]


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def baseline(executions: DataFrame, keys: list[str]) -> DataFrame:
    """Per command: the latest run without change and instrumentation that succeeded."""
    ok = executions.where("change is null and instrumentation is null and succeeded > 0")
    return latest(ok, keys, chronology())


def numbered(rows: DataFrame, order: list[str], column: str) -> DataFrame:
    """``rows`` with their number (from 1) in a total order: ranges of it are numbered each in its task, from where the ranges before end."""
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    ranged = save(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = sizes.select("_range", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return ranged.join(F.broadcast(starts), "_range").withColumn(column, place).drop("_range", "_before")


def sequential_ids(rows: DataFrame, order: list[str], prefix: str = "F", after: int = 0) -> DataFrame:
    """``rows`` with the ids F1, F2, ... in a total order, going on after ``after``."""
    return numbered(rows, order, "_n").withColumn("id", F.concat(F.lit(prefix), (F.col("_n") + after).cast("string"))).drop("_n")


def quota_sample(rows: DataFrame, row_id: str, stratum: str, file: str, quotas: DataFrame) -> DataFrame:
    """Per stratum ``quota`` rows in order of the id's hash: the first of each file before second ones of any."""
    h = F.sha2(F.col(row_id).cast("string"), 256)
    in_file = F.row_number().over(Window.partitionBy(stratum, file).orderBy(h))
    ranked = rows.withColumn("_f", in_file).withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy((F.col("_f") > 1).cast("int"), h)))
    return ranked.join(quotas, stratum).where(F.col("_n") <= F.col("quota")).drop("_f", "_n", "quota")


# -- event logs ------------------------------------------------------------------------------


def fact_status(events: DataFrame, quotes_hold: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """(id, kind, status) of each promoted fact of a log (seq, event, id, kind): revoked after its last promotion, then applied or proposed for a CHANGE, then current or stale by ``quotes_hold`` (id, holds)."""
    promoted = events.where("event = 'promoted'").groupBy("id").agg(F.max("seq").alias("_p"), F.max_by("kind", "seq").alias("kind"))
    revoked = events.where("event = 'revoked'").groupBy("id").agg(F.max("seq").alias("_r"))
    j = promoted.join(revoked, "id", "left").join(quotes_hold.select("id", "holds"), "id", "left")
    if applied is not None:
        j = j.join(applied.select("id", "applied"), "id", "left")
    else:
        j = j.withColumn("applied", F.lit(None).cast("boolean"))
    change = F.when(F.coalesce("applied", F.lit(False)), "applied").otherwise("proposed")
    status = F.when(F.col("_r") > F.col("_p"), "revoked").when(F.col("kind") == "CHANGE", change).when(F.coalesce("holds", F.lit(False)), "current").otherwise("stale")
    return j.select("id", "kind", status.alias("status"))


def active_fact(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the last promoted fact that no later event revokes."""
    revoked = events.where("event = 'revoked'").groupBy("id").agg(F.max("seq").alias("_r"))
    live = events.where("event = 'promoted'").join(revoked, "id", "left").where("_r is null or _r < seq").drop("_r")
    return latest(live, keys, [F.desc("seq")])


def approvals(log: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands (name, sha256) with the time of the latest approval of just that hash, null if there is none."""
    last = log.groupBy("name", "sha256").agg(F.max("approved").alias("approved"))
    return commands.join(last, ["name", "sha256"], "left")


def is_applied(changes: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, applied): every non-empty added line (id, path, line) is a line of its file."""
    present = lines.select("path", "line", F.lit(True).alias("_there")).distinct()
    j = changes.where(F.trim("line") != "").join(present, ["path", "line"], "left")
    return j.groupBy("id").agg(F.bool_and(F.col("_there").isNotNull()).alias("applied"))


def promotion_gates(claims: DataFrame, checks: DataFrame, links: DataFrame, notes: DataFrame) -> DataFrame:
    """claims (id, kind) with the gates mechanical (no issue), link (hash matches), note (a person wrote one), and promoted: all three."""
    j = claims.join(checks.groupBy("id").agg(F.count("*").alias("_i")), "id", "left").join(links.select("id", "matches"), "id", "left").join(notes.select("id", F.col("note")), "id", "left")
    mechanical, link, note = F.coalesce("_i", F.lit(0)) == 0, F.coalesce("matches", F.lit(False)), F.trim(F.coalesce("note", F.lit(""))) != ""
    return j.select("id", "kind", mechanical.alias("mechanical"), link.alias("link"), note.alias("note"), (mechanical & link & note).alias("promoted"))


def measure_states(commands: DataFrame, approved: DataFrame, runs: DataFrame) -> DataFrame:
    """(name, state) of commands (name, sha256): not_approved, not_run, stale (only runs of another hash), failed, available."""
    a = approved.select("name", "sha256", F.lit(True).alias("_a")).distinct()
    r = runs.groupBy("name").agg(F.max("succeeded").alias("_any"))
    same = runs.groupBy("name", "sha256").agg(F.max("succeeded").alias("_ok"))
    j = commands.join(a, ["name", "sha256"], "left").join(r, "name", "left").join(same, ["name", "sha256"], "left")
    state = F.when(F.col("_a").isNull(), "not_approved").when(F.col("_any").isNull(), "not_run").when(F.col("_ok").isNull(), "stale").when(F.col("_ok") == 0, "failed").otherwise("available")
    return j.select("name", state.alias("state"))


# -- comparison of record sets ---------------------------------------------------------------


def same_rows(a: DataFrame, b: DataFrame, ignoring: list[str] | None = None) -> DataFrame:
    """One row: missing (in a, not b), extra (in b, not a) and equal, counting repeated rows."""
    a, b = a.drop(*(ignoring or [])), b.drop(*(ignoring or []))
    signed = a.withColumn("_s", F.lit(1)).unionByName(b.select(*a.columns).withColumn("_s", F.lit(-1)))
    balance = signed.groupBy(*a.columns).agg(F.sum("_s").alias("_s"))
    part = lambda sign: F.coalesce(F.sum(F.greatest(F.col("_s") * sign, F.lit(0))), F.lit(0)).cast("long")
    both = balance.agg(part(1).alias("missing"), part(-1).alias("extra"))
    return both.withColumn("equal", (F.col("missing") == 0) & (F.col("extra") == 0))


def changed(recorded: DataFrame, current: DataFrame, key: str, sha: str) -> DataFrame:
    """(key, state): same, changed, unavailable (recorded only) or added (current only)."""
    r, c = recorded.select(key, F.col(sha).alias("_r")), current.select(key, F.col(sha).alias("_c"))
    j = r.join(c, key, "full_outer")
    state = F.when(F.col("_c").isNull(), "unavailable").when(F.col("_r").isNull(), "added").when(F.col("_r") == F.col("_c"), "same").otherwise("changed")
    return j.select(key, state.alias("state"))


def copy_check(edition: DataFrame, copy: DataFrame, touched: DataFrame) -> DataFrame:
    """(path, state) of files that the change didn't touch: same, line_ends (equal but for CRLF), different, missing, extra.  Both have path and content."""
    sha = F.sha2("content", 256)
    plain = F.sha2(F.replace("content", F.lit("\r\n"), F.lit("\n")), 256)
    e = edition.select("path", sha.alias("_e"), plain.alias("_en"))
    c = copy.select("path", sha.alias("_c"), plain.alias("_cn"))
    j = e.join(c, "path", "full_outer").join(touched.select("path"), "path", "left_anti")
    state = F.when(F.col("_c").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_e") == F.col("_c"), "same").when(F.col("_en") == F.col("_cn"), "line_ends").otherwise("different")
    return j.select("path", state.alias("state"))


def partition_issues(parts: dict[str, DataFrame], key: str, suggested: DataFrame) -> DataFrame:
    """Keys that are not in just one of the parts, or suggested and in none: (key, issue)."""
    every = reduce(DataFrame.unionByName, [df.select(key, F.lit(name).alias("part")) for name, df in parts.items()])
    n = every.groupBy(key).agg(F.count("*").alias("n"))
    several = n.where("n > 1").select(key, F.lit("several").alias("issue"))
    absent = suggested.select(key).distinct().join(n, key, "left_anti").select(key, F.lit("absent").alias("issue"))
    return several.unionByName(absent)


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unknown_ids(references: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return references.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def project_digest(files: DataFrame) -> DataFrame:
    """One row: the hash of the sorted lines ``sha256  path``, each with a line feed.  The lines pass one task as a sorted stream and are not collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashlib.sha256()
        for batch in batches:
            h.update("".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode())
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], names=["digest"])

    let_workers_import(files.sparkSession)
    lines = files.select(F.concat("sha256", F.lit("  "), "path").alias("line"))
    return lines.repartition(1).sortWithinPartitions("line").mapInArrow(run, "digest string")


# -- unions and budgets ----------------------------------------------------------------------


def with_reasons(candidates: DataFrame, key: str) -> DataFrame:
    """Rows (ordinal, key, reason) of one key as one: where it was first seen, and its distinct reasons in order; ``chosen`` drives the others out."""
    first = candidates.groupBy(key, "reason").agg(F.min("ordinal").alias("ordinal"))
    lists = first.groupBy(key).agg(F.min("ordinal").alias("ordinal"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "reason"))), lambda x: x["reason"]).alias("reasons"))
    return lists.withColumn("reasons", F.when(F.array_contains("reasons", "chosen"), F.array(F.lit("chosen"))).otherwise(F.col("reasons")))


def absorbed(suggestions: DataFrame, key: str) -> DataFrame:
    """Suggestions (ordinal, key, provenance, data, reasons) folded in order: first provenance, last data, union of reasons in order."""
    each = suggestions.groupBy(key).agg(
        F.min_by("provenance", "ordinal").alias("provenance"), F.max_by("data", "ordinal").alias("data"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "reasons"))), lambda x: x["reasons"]))).alias("reasons"),
    )
    return each


def role_of(reasons: Column, is_test: Column, ran: Column) -> Column:
    """(role, rank) of a candidate: the best among its reasons; a test stays a test."""

    def one(r: Column) -> Column:
        pick = F.when(r == "chosen", F.struct(F.lit(0).alias("rank"), F.lit("target").alias("role")))
        pick = pick.when(r.isin("owner_type", "field_writer", "trait_impl"), F.struct(F.lit(1).alias("rank"), F.lit("origin").alias("role")))
        pick = pick.when(r == "header", F.struct(F.lit(1).alias("rank"), F.lit("support").alias("role")))
        pick = pick.when(r.isin("called", "called_measured") & ran, F.struct(F.lit(2).alias("rank"), F.lit("cost").alias("role")))
        pick = pick.when(r == "caller", F.struct(F.lit(3).alias("rank"), F.lit("path").alias("role")))
        return pick.otherwise(F.struct(F.lit(4).alias("rank"), F.lit("support").alias("role")))

    best = F.array_min(F.transform(reasons, one))
    none = F.struct(F.lit(4).alias("rank"), F.lit("support").alias("role"))
    return F.when(is_test, F.struct(F.lit(5).alias("rank"), F.lit("constraint").alias("role"))).otherwise(F.coalesce(best, none))


def greedy(
    items: DataFrame, keys: list[str], order: list[Column], size: str, budget: int, max_items: int | None = None, always: Column | None = None, never: Column | None = None, batch: int = 256
) -> DataFrame:
    """Per key, items in order as long as they fit: one that doesn't is skipped and the next is tried.

    ``taken`` says which; ``always`` ones are taken whatever they use, ``never``
    ones left.  A round folds the next ``batch`` items of each key that may
    still be taken, so no list is longer; what no longer fits is never seen again.
    """
    flags = items.withColumn("_always", always if always is not None else F.lit(False)).withColumn("_never", never if never is not None else F.lit(False))
    rows = save(flags.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0))).withColumn("_row", F.monotonically_increasing_id()), "items")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("count"), F.array().cast("array<bigint>").alias("taken"))

    def fits(used: Column, count: Column, x: Column) -> Column:
        return (used + x <= budget) & (F.lit(True) if max_items is None else count < max_items)

    def step(acc: Column, x: Column) -> Column:
        take = x["_always"] | (fits(acc["used"], acc["count"], x["_size"]) & ~x["_never"])
        return F.when(take, F.struct((acc["used"] + x["_size"]).alias("used"), (acc["count"] + 1).alias("count"), F.array_append(acc["taken"], x["_row"]).alias("taken"))).otherwise(acc)

    w = Window.partitionBy(*keys).orderBy(*order, "_row")
    rest, state, chosen = rows.where(F.col("_always") | (~F.col("_never") & fits(F.lit(0), F.lit(0), F.col("_size")))), None, []
    while True:
        ranked = rest.withColumn("_n", F.row_number().over(w))
        lists = ranked.where(F.col("_n") <= batch).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", "_size", "_always", "_never", "_row"))).alias("xs"))
        lists = lists.withColumn("_s", start) if state is None else lists.join(state, keys, "left").withColumn("_s", F.coalesce("_s", start))
        folded = save(lists.withColumn("_f", F.aggregate("xs", F.struct(F.col("_s.used").alias("used"), F.col("_s.count").alias("count"), F.array().cast("array<bigint>").alias("taken")), step)).select(*keys, "_f"), "folded")
        chosen.append(folded.select(F.explode("_f.taken").alias("_row")))
        state = folded.select(*keys, F.struct(F.col("_f.used").alias("used"), F.col("_f.count").alias("count"), F.array().cast("array<bigint>").alias("taken")).alias("_s"))
        left = ranked.where(F.col("_n") > batch).drop("_n").join(state, keys)
        rest = save(left.where(F.col("_always") | fits(F.col("_s.used"), F.col("_s.count"), F.col("_size"))).drop("_s"), "items")
        if rest.isEmpty():
            break
    taken = reduce(DataFrame.unionByName, chosen).withColumn("_t", F.lit(True))
    return rows.join(taken, "_row", "left").withColumn("taken", F.coalesce("_t", F.lit(False))).drop("_row", "_t", "_always", "_never", "_size")


def evidence_selection(candidates: DataFrame, keys: list[str], budget: int = BUDGET_BYTES, max_items: int = MAX_ITEMS) -> DataFrame:
    """Candidates (reasons, is_test, calls, counted, bytes, ordinal) with role, rank, taken and left_out.

    Targets always go, tests never, and a counted function that did not run
    stays out from rank 2 on; the rest by rank and then by calls while it fits.
    """
    ran = F.coalesce("calls", F.lit(0.0)) > 0
    c = candidates.withColumn("_role", role_of(F.col("reasons"), F.col("is_test"), ran)).withColumn("role", F.col("_role.role")).withColumn("rank", F.col("_role.rank")).drop("_role")
    cold = (F.col("rank") >= 2) & F.col("counted") & (F.coalesce("calls", F.lit(0.0)) == 0)
    test = F.col("rank") == 5
    out = greedy(c, keys, [F.col("rank"), F.coalesce("calls", F.lit(0.0)).desc(), F.col("ordinal")], "bytes", budget, max_items, always=F.col("rank") == 0, never=test | cold)
    why = F.when(F.col("taken"), None).when(test, "test").when(cold, "did_not_run").otherwise("no_room")
    return out.withColumn("left_out", why)


def capped(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` per key, with ``truncated``: whether there were more."""
    n = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("_all", F.count("*").over(Window.partitionBy(*keys)))
    return n.where(F.col("_n") <= k).withColumn("truncated", F.col("_all") > k).drop("_n", "_all")


def grouped_gaps(gaps: DataFrame, key: str, shown: int = 3) -> DataFrame:
    """One gap per key: the count of its sites, and the first three (path, line)."""
    return gaps.groupBy(key).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(F.struct("path", "line"))), 1, shown).alias("sites"))


def grouped_fields(fields: DataFrame, by: list[str], members: list[str]) -> DataFrame:
    """Fields of one classification as one row; ``expanded_fields`` undoes it without loss."""
    return fields.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*members))).alias("members"))


def expanded_fields(groups: DataFrame) -> DataFrame:
    return groups.withColumn("_m", F.explode("members")).select(*(c for c in groups.columns if c != "members"), "_m.*")
