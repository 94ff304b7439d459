"""Property graphs as tables: building, projection, and bounded walks as iterated joins.

A walk is a loop over layers (their number is bounded by an argument); each
layer is one join of the frontier with the edges and an anti-join with what has
been seen.  The edges and each layer are stored in the shared folder, so none is
computed twice.  Limits on nodes are applied in a total order that is stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.storage import drop, save

#: Limits of the walks.
NEIGHBORHOOD_DEPTH, NEIGHBORHOOD_NODES, NEIGHBORHOOD_EDGES, LABEL_BYTES = 3, 128, 256, 256
WALK_DEPTH, WALK_NODES, CHAIN_CALLS, CANDIDATE_CAP, REEXPORT_HOPS = 6, 300, 6, 8, 3
SETTLED = ("unique", "import", "receiver", "type", "trait_default")


def edge_id(*fields: str) -> Column:
    """The identity of an edge: a hash of every other field."""
    return F.concat(F.lit("edge:"), F.sha2(F.to_json(F.struct(*fields)), 256))


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates()


def categories(nodes: DataFrame, symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes with category source, symbol or occurrence, by the record set that holds their id."""
    sym, src = symbols.select(F.col("id").alias("_sym")).distinct(), sources.select(F.col("id").alias("_src")).distinct()
    found = nodes.join(sym, F.col("id") == F.col("_sym"), "left").join(src, F.col("id") == F.col("_src"), "left")
    category = F.when(F.col("_sym").isNotNull(), "symbol").when(F.col("_src").isNotNull(), "source").otherwise("occurrence")
    return found.withColumn("category", category).drop("_sym", "_src")


def neutral(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose kind becomes ``observes`` where they end in an occurrence and aren't name candidates; one for one."""
    of = nodes.select(F.col("id").alias("_id"), F.col("category").alias("_category"))
    joined = edges.join(of, F.col("to") == F.col("_id"), "left")
    kind = F.when((F.col("_category") == "occurrence") & (F.col("kind") != "name_candidate"), "observes").otherwise(F.col("kind"))
    return joined.withColumn("kind", kind).drop("_id", "_category")


def name_candidates(occurrences: DataFrame, symbols: DataFrame, allowed: DataFrame, cap: int | None = CANDIDATE_CAP) -> tuple[DataFrame, DataFrame]:
    """Candidate edges (occ_id, sym_id) and, for occurrences with more than ``cap``, their count alone.

    ``allowed`` lists (language, occ_kind, sym_kind).  If any match is declared
    at the top level of the occurrence's own file, only such matches count.
    Names are counted before any pair is made where nothing is file-scoped, so a
    name with very many declarations costs no pairs beyond the cap.
    """
    s = symbols.select(F.col("id").alias("sym_id"), "name", F.col("language").alias("_lang"), F.col("kind").alias("sym_kind"), F.col("source_id").alias("_src"), "top_level")
    allowed = allowed.select(F.col("language").alias("_al"), F.col("occ_kind").alias("_ok"), F.col("sym_kind").alias("_sk"))
    kinds = s.join(allowed, (F.col("_lang") == F.col("_al")) & (F.col("sym_kind") == F.col("_sk")))
    per_name = kinds.groupBy("name", "_lang", "_ok").agg(F.count("*").alias("_all"))
    local = kinds.where("top_level").groupBy("name", "_lang", "_ok", "_src").agg(F.count("*").alias("_local"))
    o = occurrences.where("candidate is not null").select(F.col("id").alias("occ_id"), "candidate", "language", F.col("kind").alias("occ_kind"), "source_id")
    on = [F.col("candidate") == F.col("name"), F.col("language") == F.col("_lang"), F.col("occ_kind") == F.col("_ok")]
    counted = o.join(per_name, on).drop("name", "_lang", "_ok")
    counted = counted.join(local, [*on, F.col("source_id") == F.col("_src")], "left").drop("name", "_lang", "_ok", "_src")
    total = F.coalesce("_local", "_all")
    counted = counted.withColumn("n", total).withColumn("_is_local", F.col("_local").isNotNull())
    few = counted if cap is None else counted.where(F.col("n") <= cap)
    pairs = few.join(kinds, on).where(~F.col("_is_local") | (F.col("top_level") & (F.col("_src") == F.col("source_id"))))
    above = counted.where(F.lit(cap is not None) & (F.col("n") > (cap or 0))).select("occ_id", F.col("n").alias("ambiguous_candidates"))
    return pairs.select("occ_id", "sym_id"), above


def candidate_lists(occurrences: DataFrame, symbols: DataFrame, allowed: DataFrame, columns: tuple[str, ...] = (), cap: int = CANDIDATE_CAP) -> DataFrame:
    """``occurrences`` with ``candidates``, those of ``name_candidates`` as an array of (sym_id, sym_kind, source, top_level and ``columns`` of the symbol), null if there are none or over ``cap``, and their number ``n``.

    Occurrences are shuffled once: the symbols of a name are listed, up to the cap,
    before the join; only names beyond it are looked up by file, too.
    """
    allowed = allowed.select(F.col("language").alias("_al"), F.col("occ_kind").alias("_ok"), F.col("sym_kind").alias("_sk"))
    item = F.struct(F.col("id").alias("sym_id"), F.col("kind").alias("sym_kind"), F.col("source_id").alias("source"), "top_level", *columns)
    s = symbols.select("name", F.col("language").alias("_lang"), F.col("kind").alias("_kind"), item.alias("_item"))
    names = ["name", "_lang", "_ok"]
    kinds = s.join(allowed, (F.col("_lang") == F.col("_al")) & (F.col("_kind") == F.col("_sk"))).select(*names, "_item").withColumn("_all", F.count("*").over(Window.partitionBy(*names)))
    listed = kinds.groupBy(*names).agg(F.max("_all").alias("_all"), F.collect_list(F.when(F.col("_all") <= cap, F.col("_item"))).alias("_list"))
    local = kinds.where((F.col("_all") > cap) & F.col("_item.top_level")).groupBy(*names, F.col("_item.source").alias("_src")).agg(F.count("*").alias("_local"), F.collect_list("_item").alias("_own"))
    usable = F.col("candidate").isNotNull() & F.col("kind").isNotNull() & F.col("language").isNotNull()
    on = [F.col("candidate") == F.col("name"), F.col("language") == F.col("_lang"), F.col("kind") == F.col("_ok")]
    own = F.filter("_list", lambda x: x["top_level"] & (x["source"] == F.col("source_id")))
    picked = F.when(F.size(own) > 0, own).otherwise(F.col("_list"))
    nothing = F.lit(None).cast(listed.schema["_list"].dataType)
    few = occurrences.where(usable).join(listed, on, "left").where(F.coalesce("_all", F.lit(0)) <= cap).select(*occurrences.columns, picked.alias("candidates"))
    few = few.select(*occurrences.columns, "candidates", F.when(F.col("candidates").isNotNull(), F.size("candidates").cast("long")).alias("n"))
    above = listed.where(F.col("_all") > cap).select(*names, "_all")
    many = occurrences.where(usable).join(above, on).drop(*names)
    many = many.join(local, [*on, F.col("source_id") == F.col("_src")], "left").select(*occurrences.columns, F.when(F.col("_local") <= cap, F.col("_own")).alias("candidates"), F.coalesce("_local", "_all").alias("n"))
    rest = occurrences.where(~F.coalesce(usable, F.lit(False))).select("*", nothing.alias("candidates"), F.lit(None).cast("long").alias("n"))
    return few.unionByName(many).unionByName(rest)


def candidate_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("from").agg(F.count("*").alias("candidates"))


def neighborhood(edges: DataFrame, nodes: DataFrame, seed: DataFrame, depth: int = 3, max_nodes: int | None = NEIGHBORHOOD_NODES) -> DataFrame:
    """(id, layer) of nodes within ``depth`` undirected steps of the seeds; nodes of kind ``source`` are not walked through.

    Over ``max_nodes``, nodes of smaller layer and then of smaller id stay.
    """
    both = edges.select(F.col("from").alias("a"), F.col("to").alias("b")).union(edges.select("to", "from"))
    leaves = nodes.where("kind = 'source'").select(F.col("id").alias("a"))
    return _layers(both.join(leaves, "a", "left_anti"), seed, depth, max_nodes)


def used_by(edges: DataFrame, seed: DataFrame, depth: int = 2, max_nodes: int | None = WALK_NODES) -> DataFrame:
    """Backwards from symbols: (id, layer) of those whose bodies hold an occurrence that names one of the layer before.

    ``edges`` has kinds name_candidate (occurrence to symbol) and observes
    (symbol to occurrence).  Over ``max_nodes``, smaller layers and ids stay.
    """
    named = edges.where("kind = 'name_candidate'").select(F.col("from").alias("occ"), F.col("to").alias("used"))
    owned = edges.where("kind = 'observes'").select(F.col("from").alias("user"), F.col("to").alias("occ"))
    uses = named.join(owned, "occ").select("used", "user").distinct()
    return _layers(uses.select(F.col("used").alias("a"), F.col("user").alias("b")), seed, depth, max_nodes)


def calls_from(resolved: DataFrame, seed: DataFrame, depth: int = 2, max_nodes: int | None = WALK_NODES) -> tuple[DataFrame, DataFrame]:
    """Forwards over settled calls: (id, layer), and the calls of these that are not followed with their reason.

    ``resolved`` has caller, occ_id, target, how.  A call of how ``homonym`` is
    reported and not followed.
    """
    steps = resolved.where(F.col("how").isin("chosen", *SETTLED)).select(F.col("caller").alias("a"), F.col("target").alias("b")).distinct()
    found = _layers(steps, seed, depth, max_nodes)
    reason = F.when(F.col("how") == "above_limit", "above_candidate_limit").when(F.col("how") == "no_candidate", "no_candidate_in_project").otherwise(F.col("how"))
    open_ = resolved.where(~F.col("how").isin("chosen", *SETTLED)).join(found.select(F.col("id").alias("caller")), "caller", "left_semi")
    return found, open_.select("caller", "occ_id", reason.alias("reason")).distinct()


def _layers(steps: DataFrame, seed: DataFrame, depth: int, max_nodes: int | None) -> DataFrame:
    stored = save(steps.select("a", "b").distinct(), "steps")
    found = frontier = save(seed.select("id", F.lit(0).alias("layer")).distinct(), "layer")
    for layer in range(1, depth + 1):
        step = frontier.join(stored, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        frontier = save(step.join(found, "id", "left_anti").withColumn("layer", F.lit(layer)), "layer")
        found = found.unionByName(frontier)
    drop(stored)
    return found if max_nodes is None else found.orderBy("layer", "id").limit(max_nodes)


def reach(entries: DataFrame, steps: DataFrame, calls: int = CHAIN_CALLS) -> DataFrame:
    """Chains of up to ``calls`` steps from each entry (entry, a, b), none through a node twice: entry, node, length, path."""
    chains = entries.select("entry", F.col("b").alias("node"), F.lit(1).alias("length"), F.array("a", "b").alias("path"))
    chains = every = save(chains, "chains")
    stored = save(steps.select(F.col("a").alias("node"), F.col("b").alias("next")).distinct(), "steps")
    for _ in range(1, calls):
        more = chains.join(stored, "node").where(~F.array_contains("path", F.col("next")))
        chains = save(more.select("entry", F.col("next").alias("node"), (F.col("length") + 1).alias("length"), F.array_append("path", F.col("next")).alias("path")), "chains")
        every = every.unionByName(chains)
    drop(stored)
    return every


def shortest_chains(chains: DataFrame) -> DataFrame:
    """One chain per (entry, node): the shortest, then the one of least path."""
    best = Window.partitionBy("entry", "node").orderBy("length", "path")
    return chains.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def follow(names: DataFrame, exports: DataFrame, hops: int = REEXPORT_HOPS) -> DataFrame:
    """(module, name) followed through re-exports (module, name, to_module, to_name) up to ``hops`` times: module, name, at_module, at_name, hops."""
    e = exports.select(F.col("module").alias("_m"), F.col("name").alias("_n"), "to_module", "to_name")
    at = names.select("module", "name", F.col("module").alias("at_module"), F.col("name").alias("at_name"), F.lit(0).alias("hops"))
    for _ in range(hops):
        j = at.join(e, (F.col("at_module") == F.col("_m")) & (F.col("at_name") == F.col("_n")), "left")
        moved = F.col("_m").isNotNull()
        at = j.select("module", "name", F.coalesce("to_module", "at_module").alias("at_module"), F.coalesce("to_name", "at_name").alias("at_name"), (F.col("hops") + moved.cast("int")).alias("hops"))
    return at
