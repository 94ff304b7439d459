"""Chat formatting that is proved by its own parser, in SQL expressions alone.

A rendered turn is ``<|turn|>``, a flag, the role, a line feed, the text and
``<|end|>`` with a line feed.  The flag is ``=`` for a text as it stands and
``&`` for an escaped one.  ``parse`` is the grammar's deterministic reader.
Each turn is first rendered as it stands and parsed again; only if that does
not give the same turn back is it rendered with ``&`` and ``<`` escaped, which
is compared once more.  A turn that no rendering preserves would raise an error
(none exists: escaped texts hold no control string).

Defined results: a null role or text is empty; turns are in the order of turn,
role and text, nulls first; repeated rows are turns of their own; rows without
a conv_id form one conversation; further columns are ignored; an empty table
gives an empty result.  One conversation is one string, so its turns meet in
one task; they are rendered before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Text under the loss mask is that of these roles.
TRAINED = ("assistant",)


def _escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&#10;"), F.lit("\n")), F.lit("&amp;"), F.lit("&"))


def _render(flag: str, role: Column, text: Column) -> Column:
    header = F.replace(_escape(role), F.lit("\n"), F.lit("&#10;"))
    return F.concat(F.lit(TURN + flag), header, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text, escaped, well_formed)."""

    def turn(piece: Column) -> Column:
        header = F.substring_index(piece, "\n", 1)
        rest = F.substring(piece, F.length(header) + 2, F.length(piece))
        body = F.substring_index(rest, END, 1)
        escaped = F.substring(header, 1, 1) == "&"
        return F.struct(
            _unescape(F.substring(header, F.lit(2), F.length(header))).alias("role"),
            F.when(escaped, _unescape(body)).otherwise(body).alias("text"),
            escaped.alias("escaped"),
            (rest == F.concat(body, F.lit(END + "\n"))).alias("well_formed"),
        )

    pieces = F.split(formatted, r"<\|turn\|>")
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def _gives_back(rendered: Column, role: Column, text: Column) -> Column:
    turns = parse(rendered)
    first = turns[0]
    return (F.size(turns) == 1) & first["well_formed"] & (first["role"] == role) & (first["text"] == text)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans.

    ``loss_spans`` has for each turn, in order, the code points [start, end) of
    its text in ``formatted``, whether the loss covers it, and whether it is
    escaped there.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    clean = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.col("role").alias("r"), F.col("text").alias("t"))
    plain = _render("=", F.col("role"), F.col("text"))
    tried = clean.withColumn("plain", plain).withColumn("is_plain", _gives_back(F.col("plain"), F.col("role"), F.col("text")))
    escaped = _render("&", F.col("role"), _escape(F.col("text")))
    chosen = tried.withColumn("rendered", F.when(F.col("is_plain"), F.col("plain")).otherwise(escaped))
    proved = F.col("is_plain") | _gives_back(F.col("rendered"), F.col("role"), F.col("text"))
    checked = chosen.select(
        "conv_id", "turn", "role", "r", "t", "is_plain", F.when(proved, F.col("rendered")).otherwise(F.raise_error(F.lit("a turn can't be rendered"))).alias("rendered")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "r", "t")
    before = F.coalesce(F.sum(F.length("rendered")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = checked.withColumn("at", before.cast("long"))
    body = F.col("at") + F.length(F.substring_index("rendered", "\n", 1)) + 1
    span = F.struct(
        body.alias("start"), (F.col("at") + F.length("rendered") - len(END) - 1).alias("end"), F.col("role").isin(*TRAINED).alias("trained"), (~F.col("is_plain")).alias("escaped")
    )
    rows = placed.select("conv_id", F.struct("at", "rendered", span.alias("span")).alias("x"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return whole.select("conv_id", F.size("xs").cast("long").alias("n_turns"), F.array_join("xs.rendered", "").alias("formatted"), F.col("xs.span").alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, parsed from ``formatted``, and ``loss_text``: what ``loss_spans`` cut out of ``formatted`` for the loss, unescaped, joined."""
    parsed = formatted.withColumn("turns", parse(F.col("formatted")))
    cut = lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    own = F.transform(F.filter("loss_spans", lambda s: s["trained"]), lambda s: F.when(s["escaped"], _unescape(cut(s))).otherwise(cut(s)))
    return parsed.withColumn("loss_text", F.array_join(own, ""))
