"""Scalar functions on text as Column expressions: nothing here leaves the JVM.

Offsets and limits that say *bytes* are UTF-8 bytes, as all spans of the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accents that search folds, and what they fold to.
ACCENTED = "áàâãäéêèëíìîïóòôõöúùûüç"
FOLDED = "aaaaaeeeeiiiiooooouuuuc"

#: Words that no question searches for.
STOP_WORDS = "a o as os de da do das dos e em no na nos nas um uma para por que qual quais onde como the of in to from with is does how where".split()


def sha256_hex(c: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of a string's UTF-8 bytes or of binary."""
    return F.sha2(c, 256)


def spaced_identifiers(c: Column) -> Column:
    """A space where an identifier's next word begins: ``aB`` and ``1B`` before B, ``ABc`` before Bc."""
    return F.regexp_replace(c, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")


def tokens(c: Column) -> Column:
    """Search tokens: identifiers split, lower case, accents folded, combining marks dropped, the rest is white space.  Null gives none."""
    lowered = F.translate(F.lower(spaced_identifiers(F.coalesce(c, F.lit("")))), ACCENTED, FOLDED)
    return F.regexp_extract_all(F.regexp_replace(lowered, "[\\u0300-\\u036f]", ""), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def lf(c: Column) -> Column:
    """Line ends as LF."""
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def split_lines(c: Column) -> Column:
    """Lines at LF, one CR before it dropped, without an empty last one."""
    lines = F.split(lf(c), "\n")
    last = F.regexp_replace(F.element_at(lines, -1), "\r$", "")
    body = F.slice(lines, F.lit(1), F.size(lines) - 1)
    return F.when(last == "", body).otherwise(F.concat(body, F.array(last)))


def window_of_lines(lines: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1, inclusive) joined by LF; null where the range is not wholly there."""
    ok = (start >= 1) & (end >= start) & (end <= F.size(lines))
    return F.when(ok, F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n"))


def window_error(lines: Column, start: Column, end: Column) -> Column:
    """Why ``window_of_lines`` is null, or null."""
    return F.when(start < 1, "line_zero").when(end < start, "reversed").when(end > F.size(lines), "past_the_end")


def trimmed_window(lines: Column, start: Column, end: Column) -> Column:
    """As ``window_of_lines``, without empty lines at its end."""
    return F.regexp_replace(window_of_lines(lines, start, end), "\n+$", "")


def cut_bytes(c: Column, limit: int) -> Column:
    """The longest beginning of at most ``limit`` UTF-8 bytes that ends at a character."""
    raw = F.encode(c, "UTF-8")

    def continues(at: int) -> Column:
        return F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("int").between(0x80, 0xBF)

    size = F.when(~continues(limit + 1), limit).when(~continues(limit), limit - 1).when(~continues(limit - 1), limit - 2).otherwise(limit - 3)
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.decode(F.substring(raw, F.lit(1), F.greatest(size, F.lit(0))), "UTF-8"))


def tail(c: Column, n: int = 4000) -> Column:
    """The last ``n`` characters."""
    return F.right(c, F.lit(n))


def last_segment(c: Column) -> Column:
    """What follows the last ``::`` or ``.`` of a path, generic arguments aside."""
    return F.regexp_extract(F.regexp_replace(c, "<.*$", ""), r"([^:.]*)$", 1)


def trailing_identifier(c: Column) -> Column:
    return F.regexp_extract(c, r"(\w+)$", 1)


def impl_parts(label: Column) -> Column:
    """``impl Trait for Type`` or ``impl Type`` as (type, trait), each without generic arguments."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(label, r"^impl\s*(<[^>]*>)?\s*", ""), "<.*?>", ""), r"\s+where\b.*$", "")
    both = F.split(bare, r"\s+for\s+", 2)
    return F.struct(last_segment(F.trim(F.element_at(both, -1))).alias("type"), F.when(F.size(both) == 2, last_segment(F.trim(both[0]))).alias("trait"))


def bracket_balance(c: Column) -> Column:
    """Open minus closed, of (), [] and {}."""
    count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return F.struct((count("(") - count(")")).alias("round"), (count("[") - count("]")).alias("square"), (count("{") - count("}")).alias("curly"))


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))


def backticked(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("`([^`]+)`"), F.lit(1))


def sentences(c: Column) -> Column:
    """Parts that end with a full stop, question or exclamation mark before white space, or at a line end."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), F.trim), lambda s: s != "")


def mentioned_lines(c: Column) -> Column:
    """Numbers written after *line(s)* or *linha(s)*."""
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"\b(?:lines?|linhas?)\s+(\d{1,9})"), F.lit(1)), lambda x: x.cast("int"))


def lacuna_names(c: Column) -> Column:
    """Names that a lacuna's text gives: in backticks, ``A::b``, ``name()`` and CamelCase, each once."""
    found = F.regexp_extract_all(c, F.lit(r"`([^`]+)`|([A-Za-z_]\w*(?:::\w+)+)|([A-Za-z_]\w*)\(\)|\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+)\b"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[`()]", "")))


def fenced(c: Column) -> Column:
    """The content of the only code fence, or the text itself if there is none."""
    inside = F.regexp_extract_all(c, F.lit(r"(?s)```[a-zA-Z]*\n(.*?)\n?```"), F.lit(1))
    return F.when(F.size(inside) == 1, inside[0]).when(F.size(inside) == 0, c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def appears(cited: Column, span: Column) -> Column:
    """Whether the pieces of ``cited`` between ellipses come one after another in ``span``, white space collapsed."""
    pieces = F.filter(F.transform(F.split(collapse(cited), r"\s*(?:\.\.\.|…)\s*"), F.trim), lambda p: p != "")
    whole = collapse(span)

    def after(rest: Column, piece: Column) -> Column:
        at = F.position(piece, rest)
        return F.when(at > 0, F.substring(rest, at + F.length(piece), F.length(rest)))

    return (F.size(pieces) > 0) & F.aggregate(pieces, whole, after).isNotNull()


def diff_files(c: Column) -> Column:
    """Paths that a unified diff writes to."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?m)^\+\+\+ b/(.+)$"), F.lit(1)))


def percent_decoded(c: Column) -> Column:
    return F.try_url_decode(c)


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def input_suspicion(query_bytes: Column, prompt_tokens: Column, num_ctx: Column) -> Column:
    """``over_context`` if bytes / 3.5 exceed the context, ``truncated`` if there are over 6 bytes a token, else null."""
    return F.when(query_bytes / 3.5 > num_ctx, "over_context").when(query_bytes > 6.0 * prompt_tokens, "truncated")


def owner_forms(name: Column) -> Column:
    """Forms a person may write an owned name in: whole, without generic arguments, and the last part."""
    return F.array_distinct(F.array(name, F.regexp_replace(name, "<[^>]*>", ""), last_segment(name)))


def path_is_safe(path: Column) -> Column:
    """Relative, with no backslash, colon, ``.`` or ``..`` part, and no empty part."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: (p == "") | (p == ".") | (p == ".."))
    return (F.length(path) > 0) & ~path.contains("\\") & ~path.contains(":") & ~bad


def language_of(path: Column) -> Column:
    """By extension; what is not listed is ``auxiliary``: kept and hashed, never parsed."""
    extension = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.when(extension == "py", "python").when(extension == "rs", "rust").otherwise("auxiliary")


def identifier_column(line: Column, name: Column) -> Column:
    """The character (from 1) where an identifier stands in a line as a whole word, 0 if it doesn't."""
    return F.regexp_instr(line, F.concat(F.lit(r"(?<!\w)\Q"), name, F.lit(r"\E(?!\w)")))


def is_annotation(line: Column) -> Column:
    """A line of a decorator, an attribute, a comment or white space: what may stand above a declaration."""
    return line.rlike(r"^\s*($|@|#|//|/\*|\*)")


def modelfile_parameter(c: Column, name: str) -> Column:
    """A parameter's value in a model file's text; null if it isn't set."""
    return F.nullif(F.regexp_extract(c, rf"(?mi)^PARAMETER[ \t]+{name}[ \t]+(.+?)[ \t]*$", 1), F.lit(""))


def modelfile_system(c: Column) -> Column:
    """The system text of a model file, with or without triple quotes; null if there is none."""
    quoted = F.regexp_extract(c, r'(?si)(?:^|\n)SYSTEM[ \t]+"""(.*?)"""', 1)
    plain = F.regexp_extract(c, r"(?mi)^SYSTEM[ \t]+(.+?)[ \t]*$", 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.when(~c.rlike(r'(?mi)^SYSTEM[ \t]+"""'), F.nullif(plain, F.lit(""))))


def with_system(c: Column, system: Column) -> Column:
    """A model file's text with another system text, which is added where there is none."""
    new = F.concat(F.lit('SYSTEM """'), system, F.lit('"""'))
    around = F.split(c, r'(?si)(?<![^\n])SYSTEM[ \t]+(?:""".*?"""|[^\n]*)', 2)
    added = F.concat(F.regexp_replace(c, r"\n+\z", ""), F.lit("\n"), new, F.lit("\n"))
    return F.when(F.size(around) == 2, F.concat(around[0], new, F.get(around, F.lit(1)))).otherwise(added)
