"""Checks that a package's parts follow from its sources: units, classes of fields, hashes, links and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import code_text
from attesta.functions import text as T


def units(cards: DataFrame, sources: DataFrame) -> DataFrame:
    """Cards (card_id, path, start_line, end_line) with the text of their window, its hash, and an error where there is none."""
    j = cards.join(sources.select("path", T.split_lines(F.col("content")).alias("_ls")), "path", "left")
    text = T.window_of_lines(F.col("_ls"), F.col("start_line"), F.col("end_line"))
    error = F.when(F.col("_ls").isNull(), "no_source").otherwise(T.window_error(F.col("_ls"), F.col("start_line"), F.col("end_line")))
    return j.select(*cards.columns, text.alias("text"), F.sha2(text, 256).alias("sha256"), error.alias("error"))


def unit_issues(recorded: DataFrame, derived: DataFrame) -> DataFrame:
    """(card_id, issue): one unit a card and one card a unit, equal hashes, equal texts."""
    r = recorded.groupBy("card_id").agg(F.count("*").alias("_n"), F.min("sha256").alias("_rs"), F.min("text").alias("_rt"))
    j = r.join(derived.select("card_id", F.col("sha256").alias("_ds"), F.col("text").alias("_dt"), F.lit(True).alias("_d")), "card_id", "full_outer")
    issue = F.when(F.col("_d").isNull(), "no_card").when(F.col("_n").isNull(), "no_unit").when(F.col("_n") > 1, "several_units").when(~F.col("_rs").eqNullSafe(F.col("_ds")), "hash").when(~F.col("_rt").eqNullSafe(F.col("_dt")), "text")
    return j.select("card_id", issue.alias("issue")).where("issue is not null")


def classified_leaves(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, path, issue): leaves of a JSON column ``value`` without a class (path, class), with several, and classes that match no leaf."""
    leaves = documents.select("doc_id", F.explode(code_text.leaves_of("value")).alias("l")).select("doc_id", F.col("l.path").alias("path")).distinct()
    n = classes.groupBy("path").agg(F.count_distinct("class").alias("n"))
    j = leaves.join(n, "path", "left")
    bad = j.where("n is null or n > 1").select("doc_id", "path", F.when(F.col("n").isNull(), "unclassified").otherwise("several").alias("issue"))
    unused = classes.select("path").distinct().join(leaves.select("path").distinct(), "path", "left_anti")
    return bad.unionByName(unused.select(F.lit(None).cast(documents.schema["doc_id"].dataType).alias("doc_id"), "path", F.lit("absent").alias("issue")))


def addressed(records: DataFrame) -> DataFrame:
    """records (name, content) with holds: the name is the content's hash."""
    return records.withColumn("holds", F.col("name").eqNullSafe(F.sha2("content", 256)))


def link_state(links: DataFrame, queries: DataFrame) -> DataFrame:
    """Links (id, sha256) against the bytes that were sent (id, content): linked or input_rejected."""
    j = links.join(queries.select("id", F.sha2("content", 256).alias("_s")), "id", "left")
    return j.select("id", F.when(F.col("sha256").eqNullSafe(F.col("_s")), "linked").otherwise("input_rejected").alias("state"))


def measure_divergence(asked: DataFrame, selected: DataFrame) -> DataFrame:
    """(id, state) of measures at the question and at the selection: same, diverges, not_comparable (one is absent), not_applicable (both are)."""
    j = asked.select("id", F.col("sha256").alias("_a")).join(selected.select("id", F.col("sha256").alias("_b")), "id", "full_outer")
    state = F.when(F.col("_a").isNull() & F.col("_b").isNull(), "not_applicable").when(F.col("_a").isNull() | F.col("_b").isNull(), "not_comparable").when(F.col("_a") == F.col("_b"), "same").otherwise("diverges")
    return j.select("id", state.alias("state"))


def replay_state(recorded: DataFrame, again: DataFrame, builder: str) -> DataFrame:
    """(id, state) of suggestions (id, builder, input_sha256, output_sha256): suggestion_missing, builder_differs, input_differs, output_differs, reproduced."""
    a = again.select("id", F.col("input_sha256").alias("_i"), F.col("output_sha256").alias("_o"), F.lit(True).alias("_h"))
    j = recorded.join(a, "id", "left")
    state = F.when(F.col("_h").isNull(), "suggestion_missing").when(F.col("builder") != builder, "builder_differs").when(F.col("input_sha256") != F.col("_i"), "input_differs").when(F.col("output_sha256") != F.col("_o"), "output_differs").otherwise("reproduced")
    return j.select("id", state.alias("state"))


def addition_issues(additions: DataFrame, known: DataFrame, per_round: int) -> DataFrame:
    """(round, id, issue) of additions (round, id): unknown, repeated in a later round, or over the room of a round."""
    seen = F.count("*").over(Window.partitionBy("id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1))
    place = F.row_number().over(Window.partitionBy("round").orderBy("id"))
    j = additions.withColumn("_seen", seen).withColumn("_p", place).join(known.select("id", F.lit(True).alias("_k")).distinct(), "id", "left")
    issue = F.when(F.col("_k").isNull(), "unknown").when(F.col("_seen") > 0, "repeated").when(F.col("_p") > per_round, "over_room")
    return j.select("round", "id", issue.alias("issue")).where("issue is not null")


def response_state(responses: DataFrame) -> DataFrame:
    """(id, state) of recorded answers of a model service (status, content): ok, empty, malformed, rejected, unavailable."""
    body = F.col("content")
    json_ok = F.try_parse_json(body).isNotNull()
    state = F.when(F.col("status").isNull() | (F.col("status") >= 500), "unavailable").when(F.col("status") >= 400, "rejected").when(F.trim(F.coalesce(body, F.lit(""))) == "", "empty").when(~json_ok, "malformed").otherwise("ok")
    return responses.select("id", state.alias("state"))


def result_shape(results: DataFrame) -> DataFrame:
    """(id, shape) of execution results (exit_code, signal, error): exited, signaled, start_failed, or invalid if not just one is given."""
    given = F.col("exit_code").isNotNull().cast("int") + F.col("signal").isNotNull().cast("int") + F.col("error").isNotNull().cast("int")
    shape = F.when(given != 1, "invalid").when(F.col("exit_code").isNotNull(), "exited").when(F.col("signal").isNotNull(), "signaled").otherwise("start_failed")
    return results.select("id", shape.alias("shape"))


def builder_identity(c):  # noqa: ANN001, ANN201
    """``name version (commit)`` as a struct; null parts where the text has another form."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"^(\S+) (\S+) \(([0-9a-f]{7,40})\)$", i), F.lit(""))
    return F.struct(part(1).alias("name"), part(2).alias("version"), part(3).alias("commit"))
