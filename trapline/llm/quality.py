"""Quality rules whose thresholds follow the documents: quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.shared import SPACES, without, written

# A document is an outlier if a measure lies beyond the quartiles of its language and source
# by more than so many interquartile ranges and by more than the measure's slack.
FENCE = 3.0
SLACK = {"mean_word_chars": 1.0, "symbol_share": 0.2, "dup_line_share": 0.2, "repeat_share": 0.2}
# Measures that may also be too low.
TWO_SIDED = ("mean_word_chars",)
# Relative rank error of the sketches is one over this.
ACCURACY = 10_000

MIN_WORDS = 50
_SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
_SYMBOLS = tuple("#*$%&|<>")


def _beside(array: str, i: Column) -> Column:
    """Window at place ``i``; null beyond the ends."""
    return F.get(F.col(array), i)["window"]


def measure(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of whole texts.

    Repeated words are those in windows of three words found twice or more.  Windows
    are compared by 64-bit hashes within one text.  Equal windows meet by sorting (window,
    place), in proportion to n log n for any text; each place of a repeated window then covers
    three words, less where the next one begins earlier.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(lang_col).alias("lang"),
        F.col(source_col).alias("source"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    keys = ["doc_id", "lang", "source"]
    split = rows.select(
        *keys,
        F.filter(F.split("text", SPACES, -1), lambda word: word != "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.char_length("text") - F.char_length(without(F.col("text"), _SPACES))).alias("spaces"),
        F.char_length("text").alias("chars"),
        F.char_length(without(F.col("text"), _SYMBOLS)).alias("plain"),
    )
    counted = split.select(
        *keys,
        F.size("words").cast("long").alias("n_words"),
        (F.col("chars") - F.col("spaces")).cast("long").alias("word_chars"),
        (F.col("chars") - F.col("plain")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda word: F.xxhash64(word)).alias("hashes"),
    )
    numbers = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    windowed = counted.select(
        *keys,
        *numbers,
        F.when(
            F.size("hashes") > 3,
            F.transform(
                F.slice("hashes", F.lit(1), F.size("hashes") - 2),
                lambda word, i: F.xxhash64(word, F.get(F.col("hashes"), i + 1), F.get(F.col("hashes"), i + 2)),
            ),
        ).alias("windows"),
    )
    ordered = windowed.select(
        *keys,
        *numbers,
        F.when(
            F.size("windows") > F.size(F.array_distinct("windows")),
            F.sort_array(
                F.transform("windows", lambda window, i: F.struct(window.alias("window"), i.alias("place")))
            ),
        ).alias("ordered"),
    )
    placed = ordered.select(
        *keys,
        *numbers,
        F.sort_array(
            F.filter(
                F.transform(
                    "ordered",
                    lambda one, i: F.when(
                        one["window"].eqNullSafe(_beside("ordered", i - 1))
                        | one["window"].eqNullSafe(_beside("ordered", i + 1)),
                        one["place"],
                    ),
                ),
                lambda place: place.isNotNull(),
            )
        ).alias("places"),
    )
    covered = F.transform(
        "places", lambda place, i: F.least(F.lit(3), F.coalesce(F.get(F.col("places"), i + 1) - place, F.lit(3)))
    )
    return placed.select(
        *keys,
        *numbers,
        F.coalesce(F.aggregate(covered, F.lit(0), lambda total, words: total + words), F.lit(0))
        .cast("long")
        .alias("n_repeat_words"),
    )


# Each measure is a part of a whole.
MEASURES = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
}


def _share(name: str) -> Column:
    """Part of whole; null where the whole is none."""
    part, whole = MEASURES[name]
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fences(measures: DataFrame, fence: float = FENCE) -> DataFrame:
    """(lang, source, low and high fence of each measure), one row per language and source.

    Quartiles come from mergeable sketches, combined before the shuffle, of rows
    that pass the base rules.
    """
    grouped = measures.filter(~base_failed()).groupBy("lang", "source")
    quartiles = grouped.agg(
        *(F.percentile_approx(_share(name), [0.25, 0.75], ACCURACY).alias(name) for name in MEASURES)
    )
    bounds = []
    for name, slack in SLACK.items():
        low, high = F.col(name)[0], F.col(name)[1]
        reach = F.greatest(F.lit(fence) * (high - low), F.lit(slack))
        bounds.append((high + reach).alias(f"{name}_high"))
        if name in TWO_SIDED:
            bounds.append((low - reach).alias(f"{name}_low"))
    return quartiles.select("lang", "source", *bounds)


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    fence: float = FENCE,
) -> DataFrame:
    """One row per row of ``docs``: the base measures, base_failed, kept, and which measures lie outside.

    A document is kept if it passes the base rules and none of its measures is
    an outlier among the documents of its language and source.  Cases: a null
    text counts as empty and fails the base rules; null languages or sources are
    groups like others; a share of nothing is null and not an outlier; in a
    group of equal documents the slack keeps all; rows that share an id are each
    judged; an empty table gives no rows.  Other columns of ``docs`` are not read.

    Texts are measured once; the measures are written, sketched and joined with
    the fences.  There is one row of fences per language and source, joined
    without a hint: small tables are broadcast by size, others joined with
    hot groups split at run time.
    """
    measures = written(measure(docs, id_col, text_col, lang_col, source_col), "quality-measures")
    limits = fences(measures, fence).select(
        F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "*"
    ).drop("lang", "source")
    joined = measures.join(
        limits, measures.lang.eqNullSafe(limits.of_lang) & measures.source.eqNullSafe(limits.of_source), "left"
    )
    outside = []
    for name in MEASURES:
        value = _share(name)
        beyond = value > F.col(f"{name}_high")
        if name in TWO_SIDED:
            beyond = beyond | (value < F.col(f"{name}_low"))
        outside.append(F.when(beyond, F.lit(name)))
    verdict = joined.withColumn("outliers", F.concat_ws(",", *outside)).withColumn("base_failed", base_failed())
    return verdict.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("outliers") == "")).alias("kept"),
        "outliers",
    )
