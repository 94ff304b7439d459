"""Mechanical checks of claims against the exact evidence they cite; each finding is a row (claim_id, code)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import code_text
from attesta.functions import text as T

#: The kinds of claims.
KINDS = ("FACT", "INFERENCE", "HYPOTHESIS", "LACUNA")


def quote_holds(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations (path, start_line, end_line, quote) with holds: the quote is exactly these lines of the source (path, lines); nothing is searched elsewhere."""
    j = citations.join(sources.select("path", "lines"), "path", "left")
    return j.withColumn("holds", F.coalesce(T.window_of_lines(F.col("lines"), F.col("start_line"), F.col("end_line")) == F.col("quote"), F.lit(False))).drop("lines")


def citation_issues(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Codes of citations (claim_id, evidence_id, path, start_line, end_line, quote) against evidence blocks (id, path, start_line, end_line, lines)."""
    e = evidence.select(F.col("id").alias("evidence_id"), F.col("path").alias("_path"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"), "lines")
    j = citations.join(e, "evidence_id", "left")
    at = F.col("start_line") - F.col("_s") + 1
    inside = (F.col("start_line") >= F.col("_s")) & (F.col("end_line") <= F.col("_e")) & (F.col("start_line") <= F.col("end_line"))
    exact = T.window_of_lines(F.col("lines"), at, F.col("end_line") - F.col("_s") + 1) == F.col("quote")
    code = F.when(F.col("_path").isNull(), "unknown_evidence").when(F.col("path") != F.col("_path"), "wrong_path").when(~inside, "outside_evidence").when(~F.coalesce(exact, F.lit(False)), "quote_differs")
    return j.select("claim_id", code.alias("code")).where("code is not null")


def claim_issues(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Codes of claims (id, kind, text, premises, verification_plan) themselves and of what they cite."""
    n = citations.groupBy(F.col("claim_id").alias("id")).agg(F.count("*").alias("_n"), F.count_distinct("evidence_id", "start_line", "end_line").alias("_d"))
    seen = claims.select(F.col("id").alias("premise")).distinct()
    premises = claims.select("id", F.explode("premises").alias("premise"))
    lost = premises.join(seen, "premise", "left_anti").groupBy("id").agg(F.count("*").alias("_lost"))
    twice = F.count("*").over(Window.partitionBy("id")) > 1
    j = claims.withColumn("_twice", twice).join(n, "id", "left").join(lost, "id", "left")
    cited, size = F.coalesce("_n", F.lit(0)), F.size(F.coalesce("premises", F.array().cast("array<string>")))
    code = lambda condition, name: F.when(condition, name)
    codes = F.array_compact(
        F.array(
            code(~F.col("kind").isin(*KINDS), "unknown_kind"),
            code(F.col("_twice"), "repeated_id"),
            code(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_text"),
            code(F.col("kind").isin("FACT", "HYPOTHESIS") & (cited == 0), "no_citation"),
            code((F.col("kind") == "LACUNA") & (cited > 0), "lacuna_cites"),
            code(F.col("_n") > F.col("_d"), "repeated_citation"),
            code((F.col("kind") == "INFERENCE") & (size == 0), "no_premises"),
            code((F.col("kind") != "INFERENCE") & (size > 0), "premises_not_allowed"),
            code(F.col("_lost") > 0, "unknown_premise"),
            code(F.exists(F.coalesce("premises", F.array().cast("array<string>")), lambda p: p == F.col("id")), "own_premise"),
            code((F.col("kind") == "HYPOTHESIS") & (F.trim(F.coalesce("verification_plan", F.lit(""))) == ""), "no_plan"),
            code((F.col("kind") != "HYPOTHESIS") & F.col("verification_plan").isNotNull(), "plan_not_allowed"),
        )
    )
    return j.select(F.col("id").alias("claim_id"), F.explode(codes).alias("code")).distinct()


def _any(rows: DataFrame, key: str, **tests: Column) -> DataFrame:
    """Per key, whether any row passes each test."""
    return rows.groupBy(key).agg(*(F.max(F.coalesce(t, F.lit(False)).cast("int")).alias(name) for name, t in tests.items()))


def location_issues(claims: DataFrame, citations: DataFrame, evidence: DataFrame, symbols: DataFrame, required: bool = False, precise: bool = False) -> DataFrame:
    """(claim_id, code) of the places that claims give: claims (id, kind, evidence_id, path, symbol_name, declaration_line, operation_start_line, operation_end_line; no evidence_id: no place),
    citations (claim_id, evidence_id, path, start_line, end_line), evidence (id, path), symbols (evidence_id, name, declaration_line, end_line)."""
    e = evidence.select(F.col("id").alias("evidence_id"), F.col("path").alias("_path")).dropDuplicates(["evidence_id"])
    s = symbols.groupBy("evidence_id", F.col("name").alias("symbol_name"), "declaration_line").agg(F.min("end_line").alias("_end"))
    j = claims.join(e, "evidence_id", "left").join(s, ["evidence_id", "symbol_name", "declaration_line"], "left")
    c = citations.select(F.col("claim_id").alias("id"), F.col("evidence_id").alias("_ce"), F.col("path").alias("_cp"), F.col("start_line").alias("_cs"), F.col("end_line").alias("_cl"))
    mine = j.join(c, "id").where("_ce = evidence_id and _cp = _path")
    at, first, last = F.col("declaration_line"), F.col("operation_start_line"), F.col("operation_end_line")
    covered = _any(mine, "id", _decl=(F.col("_cs") <= at) & (F.col("_cl") >= at), _op=(F.col("_cs") <= first) & (F.col("_cl") >= last))
    j = j.join(covered, "id", "left")
    fact, placed, known, found = F.col("kind") == "FACT", F.col("evidence_id").isNotNull(), F.col("_path").isNotNull(), F.col("_end").isNotNull()
    body = F.col("_end") - at
    judged = placed & fact & known
    whole = (first <= at + 1) & (last >= F.col("_end"))
    codes = [
        F.when(~placed & fact & F.lit(required), "missing_location"),
        F.when(placed & ~fact, "location_requires_fact"),
        F.when(placed & fact & ~known, "location_unknown_evidence"),
        F.when(judged & (F.col("path") != F.col("_path")), "location_wrong_path"),
        F.when(judged & ~found, "location_unknown_symbol"),
        F.when(judged & found & ((first < at) | (last > F.col("_end")) | (last < first)), "location_operation_out_of_range"),
        F.when(judged & found & F.lit(precise) & (body > 0) & (first == at), "location_operation_includes_declaration"),
        F.when(judged & found & F.lit(precise) & ~((body > 0) & (first == at)) & (body > 1) & whole, "location_operation_is_whole_body"),
        F.when(judged & found & (F.coalesce("_decl", F.lit(0)) == 0), "location_declaration_not_cited"),
        F.when(judged & found & (F.coalesce("_op", F.lit(0)) == 0), "location_operation_not_cited"),
    ]
    return j.select(F.col("id").alias("claim_id"), F.explode(F.array_compact(F.array(*codes))).alias("code")).distinct()


def boundary_holds(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """symbols with holds: the name stands at its column of its declaration line, as a whole word."""
    j = symbols.join(sources.select("path", "lines"), "path", "left")
    line = F.get("lines", F.col("declaration_line") - 1)
    at = F.substring(line, F.col("name_column"), F.length("name"))
    whole = ~F.substring(line, F.col("name_column") + F.length("name"), F.lit(1)).rlike(r"^\w")
    return j.withColumn("holds", F.coalesce((at == F.col("name")) & whole, F.lit(False))).drop("lines")


def strict_text_issues(claims: DataFrame, citations: DataFrame, evidence: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(claim_id, code) of what claims' texts say beyond what they cite: claims (id, kind, text), citations (claim_id, evidence_id, path, start_line, end_line), evidence (id, start_line, lines), symbols (evidence_id, name).

    text_cites_uncited_line: a line that is mentioned and that no citation covers; text_quotes_uncited_code: code in
    backticks that is no cited path or evidence and does not stand in the cited lines (of a LACUNA, a name that the
    evidence shows passes); text_line_lacks_named_code: a sentence that names cited identifiers and lines, on none of
    which any of these stands.
    """
    c = citations.select(F.col("claim_id").alias("id"), "evidence_id", F.col("path").alias("_cp"), F.col("start_line").alias("_cs"), F.col("end_line").alias("_cl"))
    e = evidence.select(F.col("id").alias("evidence_id"), F.col("start_line").alias("_es"), F.col("lines").alias("_ls"))
    cited = c.join(e, "evidence_id", "left").withColumn("_span", T.window_of_lines(F.col("_ls"), F.col("_cs") - F.col("_es") + 1, F.col("_cl") - F.col("_es") + 1))
    lines = claims.select("id", F.explode(F.array_distinct(T.mentioned_lines(F.col("text")))).alias("line"))
    seen = lines.join(c, "id", "left").groupBy("id", "line").agg(F.max(F.col("line").between(F.col("_cs"), F.col("_cl")).cast("int")).alias("_in"))
    uncited = seen.where("coalesce(_in, 0) = 0").select("id").distinct()
    whole = cited.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_cs", "_span")))["_span"], "\n").alias("_cited"), F.collect_set("_cp").alias("_paths"), F.collect_set(F.col("evidence_id").cast("string")).alias("_ids"))
    every = evidence.agg(F.array_distinct(F.flatten(F.collect_set(T.identifiers(F.array_join("lines", "\n"))))))  # of one context
    spans = claims.select("id", "kind", F.explode(F.array_distinct(T.backticked(F.col("text")))).alias("_raw")).withColumn("span", F.trim("_raw")).where("span <> ''").join(whole, "id", "left")
    bare = F.regexp_replace("span", r"\(\)$", "")
    shown = (F.col("kind") == "LACUNA") & bare.rlike(r"^\w+((::|\.)\w+)*$") & F.array_contains(F.col("_names"), F.regexp_extract(bare, r"(\w+)$", 1))
    told = F.coalesce(F.array_contains("_paths", F.col("span")) | F.array_contains("_ids", F.col("span")), F.lit(False)) | T.appears(F.col("span"), F.coalesce("_cited", F.lit("")))
    quoted = spans.withColumn("_names", every.scalar()).where(~told & ~F.coalesce(shown, F.lit(False))).select("id").distinct()
    subjects = c.join(symbols.select("evidence_id", "name"), "evidence_id").groupBy("id").agg(F.collect_set("name").alias("_subjects")) if symbols is not None else None
    rows = cited.select("id", F.posexplode_outer(F.split("_span", "\n")).alias("_i", "_line"), "_cs").select("id", (F.col("_cs") + F.col("_i")).alias("line"), T.identifiers(F.col("_line")).alias("_on")).where("line is not null")
    said = claims.select("id", F.posexplode(T.sentences(F.col("text"))).alias("_s", "sentence")).join(uncited, "id", "left_anti")
    words = rows.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("_on"))).alias("_words"))
    said = said.join(words, "id").withColumn("named", F.array_intersect(T.identifiers(F.col("sentence")), F.col("_words"))).withColumn("line", F.explode(T.mentioned_lines(F.col("sentence"))))
    if subjects is not None:
        said = said.join(subjects, "id", "left").withColumn("_new", F.size(F.array_except("named", F.coalesce("_subjects", F.array().cast("array<string>")))) > 0)
    else:
        said = said.withColumn("_new", F.size("named") > 0)
    placed = said.where("_new").join(rows, ["id", "line"], "left").groupBy("id", "_s").agg(F.max(F.coalesce(F.arrays_overlap("named", "_on"), F.lit(False)).cast("int")).alias("_hit"))
    lacking = placed.where("_hit = 0").select("id").distinct()
    of = lambda df, code: df.select(F.col("id").alias("claim_id"), F.lit(code).alias("code"))
    return of(uncited, "text_cites_uncited_line").unionByName(of(quoted, "text_quotes_uncited_code")).unionByName(of(lacking, "text_line_lacks_named_code"))


def _containing(evidence: DataFrame) -> DataFrame:
    return evidence.select(F.col("path").alias("_p"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"), F.col("lines").alias("_ls"))


def patch_issues(claims: DataFrame, citations: DataFrame, evidence: DataFrame, allowed: bool = True) -> DataFrame:
    """(claim_id, code) of the patches (unified diffs) of claims (id, kind, patch) against evidence (id, path, start_line, end_line, lines) and citations (claim_id, path, start_line, end_line)."""
    p = claims.where("patch is not null")
    of = lambda df, code: df.select(F.col("id").alias("claim_id"), F.lit(code).alias("code"))
    if not allowed:
        return of(p, "patch_not_allowed")
    kind = of(p.where("kind <> 'HYPOTHESIS'"), "patch_requires_hypothesis")
    own = p.where("kind = 'HYPOTHESIS'").withColumn("_hs", code_text.marked_hunks_of("patch"))
    hunks = own.select("id", F.posexplode("_hs").alias("_n", "h")).select("id", "_n", "h.*").withColumn("n_old", F.size("old_lines"))
    bad = ~F.col("ok") | ~F.col("changes")
    malformed = own.where(F.size("_hs") == 0).select("id").unionByName(hunks.where(bad).select("id"))
    e = _containing(evidence)
    j = hunks.where(~bad).join(e, F.col("path") == F.col("_p"), "left")
    inside = F.coalesce((F.col("_s") <= F.col("old_start")) & (F.col("old_start") + F.col("n_old") <= F.col("_e") + 1), F.lit(False))
    there = F.slice("_ls", F.greatest(F.col("old_start") - F.col("_s") + 1, F.lit(1)).cast("int"), F.col("n_old"))
    per = j.groupBy("id", "_n", "path", "old_start", "n_old", "removed").agg(
        F.max(F.col("_p").isNotNull().cast("int")).alias("_path"), F.max(inside.cast("int")).alias("_in"), F.max(F.when(inside, (there == F.col("old_lines")).cast("int"))).alias("_fits")
    )
    anchors = per.where("_in = 1").withColumn("_pure", F.size("removed") == 0)
    numbers = F.when(F.col("_pure"), F.sequence(F.col("old_start"), F.col("old_start") + F.greatest(F.col("n_old"), F.lit(1)) - 1)).otherwise(F.col("removed"))
    each = anchors.select("id", "_n", "path", "_pure", F.explode(numbers).alias("line"))
    c = citations.select(F.col("claim_id").alias("id"), "path", F.col("start_line").alias("_cs"), F.col("end_line").alias("_cl"))
    cited = each.join(c, ["id", "path"], "left").groupBy("id", "_n", "_pure", "line").agg(F.max(F.coalesce(F.col("line").between(F.col("_cs"), F.col("_cl")), F.lit(False)).cast("int")).alias("_c"))
    uncited = cited.groupBy("id", "_n", "_pure").agg(F.max("_c").alias("_any"), F.min("_c").alias("_all")).where("(_pure and _any = 0) or (not _pure and _all = 0)")
    parts = [kind, of(malformed, "patch_malformed"), of(per.where("_path = 0"), "patch_unknown_path"), of(per.where("_path = 1 and _in = 0"), "patch_outside_evidence"), of(per.where("_in = 1 and _fits = 0"), "patch_does_not_apply"), of(uncited, "patch_changes_uncited_lines")]
    return reduce(DataFrame.unionByName, parts).distinct()


def edit_issues(claims: DataFrame, edits: DataFrame, citations: DataFrame, evidence: DataFrame, symbols: DataFrame, allowed: bool = True) -> DataFrame:
    """(claim_id, code) of edits (claim_id, edit_no, op, path, start_line, end_line, new_lines) of claims (id, kind, has_edits) against evidence (path, start_line, end_line, lines), citations (claim_id, path, start_line, end_line) and symbols (path, declaration_line, end_line).

    All sides grow with the claims, and rows made of a small file are many times its size, which is what Spark goes by: no side is broadcast.
    """
    of = lambda df, code: df.select(F.col("id").alias("claim_id"), F.lit(code).alias("code"))
    with_edits = claims.where("has_edits")
    if not allowed:
        return of(with_edits, "edits_not_allowed")
    kind = of(with_edits.where("kind <> 'HYPOTHESIS'"), "edits_require_hypothesis")
    own = with_edits.where("kind = 'HYPOTHESIS'").select("id")
    rows = own.join(edits.withColumnRenamed("claim_id", "id").hint("merge"), "id")
    empty = own.join(rows.select("id").hint("merge"), "id", "left_anti")
    replaces = F.col("op").isin("replace", "rewrite")
    shape = F.col("op").isin("replace", "rewrite", "insert_before", "insert_after") & (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (replaces | (F.col("end_line") == F.col("start_line")))
    shape = shape & ~F.exists("new_lines", lambda x: x.contains("\n") | x.contains("\r"))
    good = rows.where(shape)
    j = good.join(_containing(evidence).hint("merge"), F.col("path") == F.col("_p"), "left")
    inside = F.coalesce((F.col("_s") <= F.col("start_line")) & (F.col("end_line") <= F.col("_e")), F.lit(False))
    old = F.slice("_ls", F.greatest(F.col("start_line") - F.col("_s") + 1, F.lit(1)).cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int"))
    keys = ["id", "edit_no", "op", "path", "start_line", "end_line", "new_lines"]
    per = j.groupBy(*keys).agg(F.max(F.col("_p").isNotNull().cast("int")).alias("_path"), F.max(inside.cast("int")).alias("_in"), F.max(F.when(inside, old)).alias("_old"))
    placed = per.where("_in = 1")
    lines = placed.where("op = 'replace'").select("id", "edit_no", "path", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    c = citations.select(F.col("claim_id").alias("id"), "path", F.col("start_line").alias("_cs"), F.col("end_line").alias("_cl"))
    cited = lines.join(c.hint("merge"), ["id", "path"], "left").groupBy("id", "edit_no", "line").agg(F.max(F.coalesce(F.col("line").between(F.col("_cs"), F.col("_cl")), F.lit(False)).cast("int")).alias("_c"))
    same = F.when(replaces, F.col("_old") == F.col("new_lines")).otherwise(F.size("new_lines") == 0)
    text = lambda x: F.array_join(x, "\n")
    removed = F.when(replaces, T.bracket_balance(text("_old"))).otherwise(T.bracket_balance(F.lit("")))
    s = symbols.select(F.col("path").alias("_sp"), F.col("declaration_line").alias("_sd"), F.col("end_line").alias("_se"))
    marks = placed.where("op = 'rewrite'").join(s.hint("merge"), F.col("path") == F.col("_sp"), "left").groupBy("id", "edit_no").agg(F.count("_sp").alias("_n"), F.max(((F.col("start_line") <= F.col("_sd")) & (F.col("end_line") == F.col("_se"))).cast("int")).alias("_whole"))
    previous = F.lag("end_line").over(Window.partitionBy("id", "path").orderBy("start_line", "end_line", "edit_no"))
    crossing = rows.withColumn("_before", previous).where(F.col("start_line") <= F.col("_before"))
    parts = [
        kind, of(empty, "edits_malformed"), of(rows.where(~shape), "edits_malformed"), of(per.where("_path = 0"), "edits_unknown_path"), of(per.where("_path = 1 and _in = 0"), "edits_outside_evidence"),
        of(cited.where("_c = 0"), "edits_change_uncited_lines"), of(placed.where(same), "edits_no_change"), of(marks.where("_n > 0 and coalesce(_whole, 0) = 0"), "edits_rewrite_not_whole_declaration"),
        of(placed.where(removed != T.bracket_balance(text("new_lines"))), "edits_unbalanced"), of(crossing, "edits_overlap"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def unique_run(quotes: DataFrame, evidence_lines: DataFrame) -> DataFrame:
    """Quotes (id, evidence_id, quote) placed where their lines stand just once in the evidence (evidence_id, line_no, text): id, start_line, end_line."""
    q = quotes.withColumn("_ls", F.split("quote", "\n"))
    each = q.select("id", "evidence_id", F.size("_ls").alias("n"), F.posexplode("_ls").alias("_i", "text"))
    hits = each.join(evidence_lines, ["evidence_id", "text"]).withColumn("start_line", F.col("line_no") - F.col("_i"))
    runs = hits.groupBy("id", "n", "start_line").agg(F.count_distinct("_i").alias("m")).where("m = n")
    alone = runs.withColumn("_c", F.count("*").over(Window.partitionBy("id"))).where("_c = 1")
    return alone.select("id", "start_line", (F.col("start_line") + F.col("n") - 1).alias("end_line"))


def compared_answers(claims: DataFrame) -> DataFrame:
    """Each distinct content against each answer: content, answer_id, shared (the number of answers that have it) and state.

    ``claims`` has a row for each cited range (answer_id, kind, path, start_line,
    end_line; all null for a claim that cites nothing).  Rows of one answer and
    ``claim_id`` are one claim; without that column each row is a claim.  Content
    is the kind, the ``symbol`` (where there is such a column) and the sorted
    distinct ranges, not the wording.  The state is equal where the answer has
    the content, partial where it has a claim on the same symbol of which some
    range overlaps one of the content's, or with the same ranges and another
    kind, else absent.
    """
    symbol = F.col("symbol").cast("string") if "symbol" in claims.columns else F.lit(None).cast("string")
    one = F.struct("path", "start_line", "end_line")
    ranges = F.sort_array(F.collect_set(F.when(F.col("path").isNotNull(), one)))
    rows = claims.withColumn("symbol", symbol)
    if "claim_id" in claims.columns:
        c = rows.groupBy("answer_id", "claim_id", "kind", "symbol").agg(ranges.alias("ranges"))
    else:
        c = rows.select("answer_id", "kind", "symbol", F.array_compact(F.array(F.when(F.col("path").isNotNull(), one))).alias("ranges"))
    c = c.withColumn("content", F.sha2(F.to_json(F.struct("kind", "symbol", "ranges")), 256))
    contents = c.groupBy("content").agg(F.count_distinct("answer_id").alias("shared"), F.first("kind").alias("kind"), F.first("symbol").alias("symbol"), F.first("ranges").alias("ranges"))
    has = c.select("answer_id", "content").distinct()
    equal = has.select("content", "answer_id", F.lit(2).alias("level"))
    each = contents.select("content", "symbol", F.explode("ranges").alias("r")).select("content", "symbol", "r.*")
    other = each.join(has, "content").select("answer_id", F.col("symbol").alias("_y"), F.col("path").alias("_p"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e")).distinct()
    near = each.join(other, F.col("symbol").eqNullSafe(F.col("_y")) & (F.col("path") == F.col("_p")) & (F.col("start_line") <= F.col("_e")) & (F.col("_s") <= F.col("end_line")))
    kinds = contents.join(has, "content").select("answer_id", F.col("kind").alias("_k"), F.col("symbol").alias("_y"), F.col("ranges").alias("_r"))
    turned = contents.select("content", "kind", "symbol", "ranges").join(kinds, F.col("symbol").eqNullSafe(F.col("_y")) & (F.col("ranges") == F.col("_r")) & ~F.col("kind").eqNullSafe(F.col("_k")))
    partial = near.select("content", "answer_id").unionByName(turned.select("content", "answer_id")).withColumn("level", F.lit(1))
    found = equal.unionByName(partial).groupBy("content", "answer_id").agg(F.max("level").alias("level"))
    answers = c.select("answer_id").distinct().agg(F.collect_set("answer_id").alias("all"))  # the answers of one question are few
    grid = contents.select("content", "shared").withColumn("all", answers.scalar()).select("content", "shared", F.explode("all").alias("answer_id"))
    state = F.when(F.col("level") == 2, "equal").when(F.col("level") == 1, "partial").otherwise("absent")
    return grid.join(found, ["content", "answer_id"], "left").select("content", "answer_id", "shared", state.alias("state"))


def outcome(claims: DataFrame, issues: DataFrame) -> DataFrame:
    """Per answer: usable changes (HYPOTHESIS without an issue), lacunas, and the codes found."""
    i = issues.groupBy(F.col("claim_id").alias("id")).agg(F.collect_set("code").alias("codes"))
    j = claims.join(i, "id", "left")
    return j.groupBy("answer_id").agg(
        F.sum(((F.col("kind") == "HYPOTHESIS") & F.col("codes").isNull()).cast("int")).alias("usable"),
        F.sum((F.col("kind") == "LACUNA").cast("int")).alias("lacunas"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("codes", F.array().cast("array<string>")))))).alias("codes"),
    )
