"""Quality rules: a threshold table compiled into one projection of built-in functions.

Words are ``[^\\x20\\x09-\\x0D]+``.  Null text has no words, no symbols and no lines, so it fails.  Columns
pass through untouched, but for those named as in ``MEASURES``, ``base_failed`` or ``kept``, which are replaced.  Repeated
rows and ids are judged each for itself, texts of any length whole; an empty table gives no rows.  Equal windows are
found by the 64-bit hash of their words' hashes inside one text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORD_SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Very common words of the four languages.
STOP_WORDS = (
    "the of and to in is that for on with as are was be this at it by from or an a "
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la que el en y a los se del las un por con no una su para es al lo como más "
    "le et les des du une est dans qui ce il au sur pas plus ne se je sont avec"
).split()
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document passes if the measure lies in [low, high] (None: no bound)."""

    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("symbols_per_word", high=0.2),
    Rule("stop_word_ratio", low=0.02),
    Rule("mean_word_length", low=2.0, high=14.0),
    Rule("dup_line_ratio", high=0.5),
    Rule("words_per_line", low=1.5),
    Rule("neighbour_repeat_ratio", high=0.3),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_neighbour_repeats", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once: a lambda's variable is never inlined by the optimizer."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    cut = F.trim(text, F.lit(WORD_SPACE))
    return F.when(F.length(cut) > 0, F.split(cut, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _repeat_words(words: Column, window: int) -> Column:
    def from_hashes(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), from_sorted))

    def from_sorted(pairs: Column) -> Column:
        same = F.filter(pairs, lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]))
        begin = F.sort_array(F.transform(same, lambda p: p["i"]))
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(begin, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(window), x - a["last"])).alias("n")), lambda a: a["n"])

    def from_words(hashes: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(hashes) - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window))), from_hashes)

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), from_words))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of ``MEASURES`` (long)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def counts(words: Column) -> Column:
        stop = F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))
        twice = F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1)))
        return F.struct(F.size(words).cast("long").alias("n_words"), stop.cast("long").alias("n_stop_words"), twice.cast("long").alias("n_neighbour_repeats"), _repeat_words(words, WINDOW).cast("long").alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(WORD_SPACE))) > 0)
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    clear = [c for c in docs.columns if c not in MEASURES]
    found = docs.select(  # the columns of ``docs`` in one struct, so that no name can clash
        F.struct(*[F.col(f"`{c}`") for c in clear]).alias("row"),
        let(words_of(text), counts).alias("of_words"),
        line_counts.alias("of_lines"),
        F.length(F.translate(text, WORD_SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    part = dict.fromkeys(("n_words", "n_neighbour_repeats", "n_stop_words", "n_repeat_words"), "of_words") | dict.fromkeys(("n_lines", "n_dup_lines"), "of_lines")
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in clear], *[F.col(f"{part[m]}.{m}" if m in part else m).alias(m) for m in MEASURES])


def ratio(name: str) -> Column:
    n, d = {
        "symbols_per_word": ("n_symbols", "n_words"),
        "stop_word_ratio": ("n_stop_words", "n_words"),
        "mean_word_length": ("word_chars", "n_words"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"),
        "words_per_line": ("n_words", "n_lines"),
        "neighbour_repeat_ratio": ("n_neighbour_repeats", "n_words"),
    }[name]
    return F.col(n) / F.greatest(F.col(d), F.lit(1))


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean over the measures: all rules pass."""
    out = F.lit(True)
    for r in rules:
        value = ratio(r.measure)
        if r.low is not None:
            out = out & (value >= F.lit(float(r.low)))
        if r.high is not None:
            out = out & (value <= F.lit(float(r.high)))
    return out


def base_failed(min_words: int = 20, repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with measures, ``base_failed`` and ``kept``."""
    found = measures(docs, text_col).withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
