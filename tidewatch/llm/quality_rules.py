"""Quality rules as a short-circuit cascade of native expressions.

Every rule is a Boolean expression over the text. A bounded sample tells what a
rule costs and how much it rejects; rules then run in descending order of
rejections per cost, and a document stops at the first rule that rejects it
(``CASE WHEN`` evaluates its branches lazily). The verdict, a conjunction, does
not depend on that order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, count_of, let, text_of, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return (F.length(text) - count_of(text, WHITE)).cast("long")


def n_symbols(text: Column) -> Column:
    return count_of(text, SYMBOLS).cast("long")


def lines(text: Column) -> Column:
    """Lines (cut at line feeds) that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(starts: Column, width: int) -> Column:
    """Words covered by windows of ``width`` words at ascending ``starts``."""
    gaps = F.transform(starts, lambda s, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - s, F.lit(width))))
    return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)


def _repeated_starts(hashes: Column) -> Column:
    """Ascending positions whose value occurs at another position too."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(
        pairs,
        lambda p: F.sort_array(F.transform(F.filter(p, lambda x, i: F.coalesce(F.when(i > 0, F.get(p, i - 1)["h"]) == x["h"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])),
    )


def repeat_words(w: Column, width: int = 3) -> Column:
    """Words of the array ``w`` inside windows of ``width`` words that occur twice or more in it.

    Windows compare by a 64-bit hash. The windows are sorted with their positions only where
    the number of different hashes has shown a repeat.
    """
    windows = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, width))))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(_repeated_starts(h), lambda s: _covered(s, width)))).cast("long")


def n_repeat_words(text: Column, width: int = 3) -> Column:
    return let(words(text), lambda w: repeat_words(w, width))


def n_upper(text: Column) -> Column:
    """Capital letters A-Z."""
    return F.octet_length(F.regexp_replace(text, "[^A-Z]++", ""))


MEASURES = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
    "n_lines": lambda text: F.size(lines(text)),
    "n_upper": n_upper,
    "n_exclamations": lambda text: count_of(text, "!"),
}


class Measures:
    """Measures of a text by name: a column that is already there, else the expression that computes it."""

    def __init__(self, text: Column, ready=()):
        self.text, self.ready = text, set(ready)

    def __getitem__(self, name: str) -> Column:
        return F.col(name) if name in self.ready else MEASURES[name](self.text)


@dataclass(frozen=True)
class Rule:
    """``rejects(measures)`` is true for a text to drop."""

    name: str
    rejects: Callable[[Measures], Column]


#: The rules with their production thresholds.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", lambda m: 100 * m["n_symbols"] > 20 * m["n_words"]),
    Rule("shouting", lambda m: 100 * m["n_upper"] > 30 * m["word_chars"]),
    Rule("exclamations", lambda m: 100 * m["n_exclamations"] > 50 * m["n_words"]),
    Rule("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("word_length", lambda m: (10 * m["word_chars"] > 120 * m["n_words"]) | (10 * m["word_chars"] < 25 * m["n_words"])),
)


def ordered(docs: DataFrame, rules=RULES, column: str = "text", sample_rows: int = 500, sample_chars: int = 20_000) -> list[tuple[Rule, float, float]]:
    """Rules with cost (seconds on the sample) and selectivity (share rejected), by rejections per cost, most first.

    The sample is a bounded parameter: ``sample_rows`` rows of one in eight by hash, of which the first
    ``sample_chars`` characters serve for timing. It only orders the rules; verdicts never use it.
    """
    spark = docs.sparkSession
    text = text_of(docs, column)
    rows = docs.where(F.pmod(F.xxhash64(text), F.lit(8)) == 0).select(F.left(text, F.lit(sample_chars)).alias("t")).limit(sample_rows).collect()
    if not rows:
        return [(rule, 0.0, 0.0) for rule in rules]
    sample = spark.createDataFrame(rows, "t string").coalesce(1)

    def timed(condition: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hits = sample.agg(F.count_if(condition)).first()[0]
        return time.perf_counter() - began, hits

    floor = min(timed(F.col("t") == "\0")[0] for _ in range(2))
    found = []
    for rule in rules:
        took, hits = timed(rule.rejects(Measures(F.col("t"))))
        found.append((rule, max(took - floor, 1e-3), hits / len(rows)))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def cascade(measures: Measures, rules) -> Column:
    """Name of the first rule, in the given order, that rejects the text; null if none does."""
    verdict = F
    for rule in rules:
        verdict = verdict.when(rule.rejects(measures), F.lit(rule.name))
    return verdict.otherwise(F.lit(None).cast("string"))


def quality_filter(docs: DataFrame, rules=RULES, column: str = "text", **sampling) -> DataFrame:
    """Documents that no rule rejects, with all their columns.

    A null text counts as empty, and an empty text has too few words. An empty table stays empty.
    Repeated rows are judged one by one; extra columns of any name pass through.
    """
    order = [rule for rule, _, _ in ordered(docs, rules, column, **sampling)]
    return docs.where(cascade(Measures(text_of(docs, column)), order).isNull())


def quality_report(docs: DataFrame, rules=RULES, column: str = "text", **sampling) -> DataFrame:
    """doc_id, the base measures, ``base_failed`` and the cascade's verdict ``kept`` for each document.

    Measures are those of the whole text, however long; a null or empty text has none of anything and fails. Repeated rows are judged one by one, an
    empty table gives no rows, other columns are left out, whatever their names.
    """
    order = [rule for rule, _, _ in ordered(docs, rules, column, **sampling)]
    text = text_of(docs, column)
    # One let binds the words for both measures that need them.
    counted = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    base = (
        docs.select(docs["doc_id"], text.alias("text"), counted.alias("counted"), word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"))
        .withColumns({"n_words": F.col("counted.n"), "n_repeat_words": F.col("counted.r")})
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )
    ready = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(Measures(F.col("text"), ready), order).isNull())
    return base.select("doc_id", *ready, "base_failed", kept.alias("kept"))
