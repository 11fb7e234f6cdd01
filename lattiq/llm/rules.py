"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

The statistics of a text come from built-in functions alone, row by row: nothing is shuffled, and no text leaves its
task. Each rule of the table names a statistic or a ratio and the least and the most that it may be; compile() turns
the table into one expression that lists the rules a document fails.

The words of 3-word windows found twice or more are counted by sorting a text's windows by (hash, words, place), so
equal windows become neighbours: n log n steps for n words, however often a window repeats.

Defined cases: a null text is the empty text, with no words and no lines; it fails the base rule (fewer than 50 words),
as do all texts of fewer than 50 words; rows that repeat and rows without a doc_id are rows like others; an empty table
gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

#: White space as in common.WORD, and the characters that count as symbols.
SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"

#: Frequent function words of the languages that the rules are meant for; a parameter of quality_rules().
STOP_WORDS = {
    "en": "a and are as at be by for from in is it of on that the this to was with",
    "de": "als auf das dem den der des die ein eine für im in ist mit nicht sich und von zu",
    "es": "al con de del el en es la las lo los no para por que se su un una y",
    "fr": "au avec dans de des du en est et la le les ou par pas pour que qui sur un une",
}

BASE_WORDS, BASE_REPEATS = 50, 50


@dataclass(frozen=True)
class Rule:
    """What a statistic must lie between, bounds included; None leaves a side open."""

    name: str
    statistic: str
    least: float | None = None
    most: float | None = None

    def holds(self) -> Column:
        value = F.col(self.statistic)
        out = F.lit(True)
        if self.least is not None:
            out = out & (value >= self.least)
        if self.most is not None:
            out = out & (value <= self.most)
        return out


#: The threshold table. Ratios: code points a word; symbols, exclamation marks and stop words a word; share of lines.
RULES = (
    Rule("word_length", "mean_word", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("exclamations", "exclamation_ratio", None, 0.2),
    Rule("stop_words", "stop_ratio", 0.03, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_ratio", None, 0.3),
)


def _words(text: Column) -> Column:
    """The words of a text: what lies between white space, without the empty strings at both ends."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _windows(words: Column) -> Column:
    """All 3-word windows as (hash, words, place), in this order, so that equal ones are neighbours."""
    def window(w, i):
        second, third = F.get(words, i + 1), F.get(words, i + 2)
        return F.struct(F.xxhash64(w, second, third).alias("h"), w.alias("a"), second.alias("b"), third.alias("c"), i.alias("i"))

    return F.sort_array(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), window))


def _same(s: Column, t: Column) -> Column:
    return F.coalesce((s["h"] == t["h"]) & (s["a"] == t["a"]) & (s["b"] == t["b"]) & (s["c"] == t["c"]), F.lit(False))


def _found_twice(windows: Column) -> Column:
    """Places of the windows that have an equal neighbour, in ascending order."""
    twice = F.filter(windows, lambda s, k: _same(s, F.get(windows, k - 1)) | _same(s, F.get(windows, k + 1)))
    return F.sort_array(F.transform(twice, lambda s: s["i"]))


def _covered(places: Column) -> Column:
    """Words in the windows that start at these places: 3 each, less what overlaps with the window before."""
    gaps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), lambda p, q: F.least(F.coalesce(q - p, F.lit(3)), F.lit(3)))
    return F.aggregate(gaps, F.lit(0), lambda total, g: total + g).cast("long")


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def statistics(docs: DataFrame, stop_words: dict[str, str] = STOP_WORDS) -> DataFrame:
    """doc_id with the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios of the rules."""
    stops = sorted({w for line in stop_words.values() for w in line.split()})
    rows = only(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("doc_id", "text", _words(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.withColumn("windows", _windows(F.col("words"))).withColumn("places", _found_twice(F.col("windows")))
    n = F.size("words").cast("long")
    n_lines = F.size("lines")
    rows = rows.select(
        "doc_id",
        n.alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("places")).alias("n_repeat_words"),
        n_lines.cast("long").alias("n_lines"),
        _count_of(F.col("text"), "!").alias("n_exclamations"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•]"))).cast("long").alias("n_bullets"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipses"),
    )

    def ratio(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))

    return rows.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_exclamations", "n_words").alias("exclamation_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_bullets", "n_lines").alias("bullet_ratio"),
        ratio("n_ellipses", "n_lines").alias("ellipsis_ratio"),
    )


def compile(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of statistics() fails, as one array expression."""
    return F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: dict[str, str] = STOP_WORDS) -> DataFrame:
    """One row per row of docs (doc_id, text): the statistics, base_failed, the failed rules, and kept."""
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATS * F.col("n_words"))
    judged = statistics(docs, stop_words).select("*", base.alias("base_failed"), compile(rules).alias("failed"))
    return judged.select("*", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
