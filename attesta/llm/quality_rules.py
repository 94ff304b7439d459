"""Quality rules kept in a ledger of bits.

``measure`` reads each whole text once.  ``with_ledger`` evaluates every rule
once on the measurements and stores one failure bit for each, so later
questions are bit operations on two integers and never touch the text again:
``apply_policy`` gives a versioned policy's verdict and ``ablations`` counts,
from one small histogram of ledgers, what each rule of a policy decides alone.

Defined results: a null or empty text measures 0 everywhere and fails
``few_words``; repeated rows are judged alike; further columns are kept, but
columns named as a measurement, ``failed_rules`` or ``kept`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.arrowtools import frees, small_batches
from attesta.llm.wordhash import Block, blocks, span_hashes, windows, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: Column


def rules() -> list[Rule]:
    c = F.col
    found = [
        ("few_words", c("n_words") < 50),
        ("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        ("many_symbols", 5 * c("n_symbols") > c("n_words")),
        ("repeated_lines", 2 * c("n_dup_lines") > c("n_lines")),
        ("long_words", c("word_chars") > 25 * c("n_words")),
        ("short_words", c("word_chars") < 2 * c("n_words")),
        ("shouting", 2 * c("n_capitals") > c("word_chars")),
    ]
    return [Rule(i, name, fails) for i, (name, fails) in enumerate(found)]


#: The bits that each policy enforces, by version.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "full-1": ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "long_words", "short_words", "shouting"),
}


def mask_of(names: tuple[str, ...]) -> int:
    bits = {r.name: 1 << r.bit for r in rules()}
    return sum(bits[n] for n in names)


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _again(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, whether its row has the value more than once, and whether it is not the first of them."""
    order = np.lexsort((value, row))
    same = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
    later = np.zeros(len(row), bool)
    several = np.zeros(len(row), bool)
    later[order[1:][same]] = True
    several[order[1:][same]] = True
    several[order[:-1][same]] = True
    return several, later


def measure_block(block: Block) -> dict[str, np.ndarray]:
    data, bounds = block.data, block.bounds
    w = words(block)
    n = len(w.start)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    in_word = np.cumsum(inside)[:-1] > 0
    out = {"n_words": w.per_row.astype(np.int64), "word_chars": _sums(in_word & ((data & 0xC0) != 0x80), bounds), "n_symbols": _sums(_SYMBOL[data], bounds), "n_capitals": _sums(_CAPITAL[data], bounds)}

    runs, run_bounds = windows(span_hashes(block, w.start, w.end), w.bounds, 3, short=False)
    per_row = np.diff(run_bounds)
    run_row = np.repeat(np.arange(block.n_rows), per_row)
    several, _ = _again(run_row, runs)
    at = np.flatnonzero(several) - np.repeat(run_bounds[:-1], per_row)[several] + w.bounds[run_row[several]]
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[at + k] = True
    out["n_repeat_words"] = _sums(covered[:n], w.bounds)

    breaks = np.flatnonzero(data == 0x0A)
    start = np.concatenate([bounds[:-1], breaks + 1])
    end = np.concatenate([breaks, bounds[1:]])
    start, end = np.sort(start), np.sort(end)
    row = np.searchsorted(bounds[1:], start, "right")
    # The line that ends a row begins before the row's bound; an empty last line of a row would be counted to the next.
    row = np.minimum(row, block.n_rows - 1)
    has_word = np.searchsorted(w.start, end, "left") > np.searchsorted(w.start, start, "left")
    start, end, row = start[has_word], end[has_word], row[has_word]
    _, later = _again(row, span_hashes(block, start, end))
    out["n_dup_lines"] = np.bincount(row[later], minlength=block.n_rows).astype(np.int64)
    out["n_lines"] = np.bincount(row, minlength=block.n_rows).astype(np.int64)
    return out


def measure(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with the columns of ``MEASURES``, and without the text unless it is to be kept."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in MEASURES and (keep_text or c != text)]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{m} long" for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for b in blocks(table.column(text)):
                part = table.slice(b.first, b.n_rows).select(keep)
                found = measure_block(b)
                for m in MEASURES:
                    part = part.append_column(m, pa.array(found[m], pa.int64()))
                yield from part.combine_chunks().to_batches()

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(frees(run), schema)


def with_ledger(measured: DataFrame) -> DataFrame:
    """Adds ``failed_rules``: bit b is set if the rule of that bit fails."""
    bits = [F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed_rules", total.cast("long"))


def apply_policy(ledger: DataFrame, policy: str = "full-1") -> DataFrame:
    """Adds ``kept``: no rule that the policy enforces has failed."""
    return ledger.withColumn("kept", F.col("failed_rules").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0)


def ablations(ledger: DataFrame, policy: str = "full-1") -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that the policy keeps without it."""
    mask = mask_of(POLICIES[policy])
    counts = ledger.groupBy(F.col("failed_rules").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rows = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules() if mask & (1 << r.bit)]
    each = counts.withColumn("r", F.explode(F.array(*rows))).select("bits", "n", "r.rule", "r.bit")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(count(failed).alias("n_failed"), count(failed & (rest == 0)).alias("n_failed_alone"), count(rest == 0).alias("n_kept_without"))
