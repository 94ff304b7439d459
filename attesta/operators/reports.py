"""What is written for a reader or a model: requests, model files, notes, limits, contexts, and counters of what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import intervals, records

#: What a note says of each role.
NOTE_ROLES = {
    "target": "alvo da mudança", "origin": "origem: declara ou escreve o que um alvo lê", "cost": "custo: rodou na medição, é chamado por um alvo",
    "path": "caminho: chama um alvo", "support": "apoio: tipo ou topo de arquivo para compreender os alvos", "constraint": "restrição",
}


def io_counters(reads: DataFrame) -> DataFrame:
    """(category, calls, bytes) of reads (category, bytes)."""
    return reads.groupBy("category").agg(F.count("*").alias("calls"), F.sum("bytes").alias("bytes"))


def request_bodies(queries: DataFrame, structured: bool = True) -> DataFrame:
    """(id, body, issue) of requests to a model service for queries (id, model, query: JSON): the query goes as it stands, with its response schema as the format where there is one; no_model, malformed and bad_schema have no body."""
    q = F.try_parse_json("query")
    at = lambda path, kind: F.try_variant_get(q, path, kind)
    question, steps = at("$.question", "string"), at("$.instructions", "array<string>")
    whole = (F.trim(F.coalesce(question, F.lit(""))) != "") & (F.schema_of_variant(F.try_variant_get(q, "$.evidence", "variant")).startswith("OBJECT")) & (F.size(steps) > 0) & F.forall(steps, lambda s: F.trim(s) != "")
    given = F.try_variant_get(q, "$.response_schema", "variant")
    bad_schema = F.lit(structured) & given.isNotNull() & ~F.coalesce(at("$.response_schema.type", "string") == "object", F.lit(False))
    issue = F.when(F.trim(F.coalesce("model", F.lit(""))) == "", "no_model").when(~F.coalesce(whole, F.lit(False)), "malformed").when(bad_schema, "bad_schema")
    plain = F.concat(F.lit('{"model":'), F.to_json(F.struct(F.col("model").alias("m"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("model").alias("m")))) - 6), F.lit(',"prompt":'), F.to_json(F.struct(F.col("query").alias("q"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("query").alias("q")))) - 6), F.lit(',"stream":false'))
    schema = F.when(F.lit(structured) & given.isNotNull(), F.concat(F.lit(',"format":'), F.to_json(given))).otherwise("")
    return queries.select("id", F.when(issue.isNull(), F.concat(plain, schema, F.lit("}"))).alias("body"), issue.alias("issue"))


def rendered_models(tasks: DataFrame, profiles: DataFrame, languages: list[str]) -> DataFrame:
    """(name, text) of a model file for each task (task, kind, num_predict, system) of each profile of its kind (profile, kind, base, parameters: map) in each language."""
    j = tasks.join(profiles, "kind").withColumn("language", F.explode(F.array(*map(F.lit, languages))))
    entries = F.array_sort(F.map_entries("parameters"))
    lines = F.concat(F.array(F.concat(F.lit("FROM "), "base")), F.transform(entries, lambda e: F.concat(F.lit("PARAMETER "), e["key"], F.lit(" "), e["value"])), F.array(F.concat(F.lit("PARAMETER num_predict "), F.col("num_predict").cast("string"))))
    name = F.concat("task", F.lit("-"), "profile", F.when(F.col("language") == "en", "-en").otherwise(""))
    return j.select(name.alias("name"), F.concat(F.array_join(lines, "\n"), F.lit('\n\nSYSTEM """\n'), "system", F.lit('"""\n')).alias("text"))


def note_lines(selected: DataFrame) -> DataFrame:
    """(id, note) of selected parts (id, name, path, start_line, end_line, role, calls): the role of each in words, with its calls where they were measured."""
    role = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in NOTE_ROLES.items() for x in kv)), F.col("role")), F.col("role"))
    calls = F.when(F.col("calls").isNotNull(), F.concat(F.lit("; "), F.col("calls").cast("string"), F.lit(" chamadas na medição"))).otherwise("")
    place = F.concat("path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return selected.select("id", F.concat(F.lit("Papel de "), "name", F.lit(" ("), place, F.lit("): "), role, calls, F.lit(".")).alias("note"))


def tagged_limits(reports: DataFrame, profile_lines: int) -> DataFrame:
    """(id, place, text, producer, input, rule, provenance) of the limit lines of search reports (id, limits, with_targets, with_callees, with_owners, version, extractor), by where a report puts each."""
    rows = reports.withColumn("_last", F.size("limits") - 1).select("*", F.posexplode("limits").alias("place", "text"))
    callees = F.col("with_targets") & F.col("with_callees") & (F.col("place") == F.col("_last"))
    step, owner = F.col("with_targets") & (F.col("place") == 0), F.col("with_targets") & (F.col("place") == 1) & F.col("with_owners")
    tests = ~F.col("with_targets") & (F.col("place") >= profile_lines)
    by = lambda c, s, o, t, other: F.when(callees, c).when(step, s).when(owner, o).when(tests, t).otherwise(other)
    return rows.select(
        "id", "place", "text", by("callees", "step_kind", "owner_step", "exclude_tests", "profile_search").alias("producer"), by("request", "route", "request", "request", "edition_profile").alias("input"),
        by(F.lit(None).cast("string"), F.col("version"), F.col("version"), F.col("version"), F.col("extractor")).alias("rule"), by("system_fixed", "system_fixed", "system_generated", "system_fixed", "system_fixed").alias("provenance"),
    )


def edition_facts(selection: DataFrame, symbols: DataFrame, heads: DataFrame) -> DataFrame:
    """Selected ids with what the edition says of them: of a declaration (symbols: id, name, path, kind, start_line, end_line, bytes), or of a file's head (heads: path, end_line, bytes) where the id is ``header:`` and its path; neither gives nulls."""
    s = symbols.select("id", *(F.col(c).alias(f"_{c}") for c in ("name", "path", "kind", "start_line", "end_line", "bytes")))
    h = heads.select(F.concat(F.lit("header:"), "path").alias("id"), F.col("path").alias("_hp"), F.col("end_line").alias("_he"), F.col("bytes").alias("_hb"))
    j = selection.select("id").distinct().join(s, "id", "left").join(h, "id", "left")
    first = F.when(F.col("_hp").isNotNull(), F.lit(1).cast("long"))
    return j.select("id", F.coalesce("_name", "_hp").alias("name"), F.coalesce("_path", "_hp").alias("path"), F.coalesce("_kind", F.when(F.col("_hp").isNotNull(), "header")).alias("kind"), F.coalesce("_start_line", first).alias("start_line"), F.coalesce("_end_line", "_he").alias("end_line"), F.coalesce("_bytes", "_hb").alias("bytes"))


def context_blocks(windows: DataFrame, sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, path, start_line, end_line, excerpt, n_symbols) of windows (id, path, start_line, end_line) of sources (path, lines): empty lines at the end go, a window without a line goes, symbols (path, start_line, end_line) that fit inside are counted."""
    j = windows.join(sources.select("path", "lines"), "path")
    text = T.trimmed_window(F.col("lines"), F.col("start_line"), F.col("end_line"))
    kept = j.withColumn("excerpt", text).where("excerpt is not null and excerpt <> ''")
    kept = kept.withColumn("end_line", (F.col("start_line") + F.size(F.split("excerpt", "\n")) - 1).cast("long")).drop("lines")
    inner = symbols.select("path", F.col("start_line").alias("start"), (F.col("end_line") + 1).alias("end"))
    outer = kept.select("id", "path", F.col("start_line").alias("start"), (F.col("end_line") + 1).alias("end"))
    n = intervals.containers(inner, outer, "path").groupBy(F.col("outer_id").alias("id")).agg(F.count("*").alias("n_symbols"))
    return kept.join(n, "id", "left").fillna(0, ["n_symbols"]).select("id", "path", "start_line", "end_line", "excerpt", "n_symbols")


def measure_detail(executions: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, the latest instrumented execution with what it inserted and printed, as recorded."""
    return records.latest(executions.where("instrumentation is not null"), keys, records.chronology())
