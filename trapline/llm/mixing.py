"""Mixing to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.llm.shared import SPACES, without, written

# Rounds of raking at most; each fits every margin once.
ROUNDS = 8
# The margins fit when a round scales no cell by more than this.
FITTED = 1e-13
MARGINS = ("source", "lang", "topic")
# A margin's default target: tokens to this power, scaled to one.  1 leaves the corpus as it
# is, 0 makes all values equal.
TEMPERATURE = 0.7
# Share of the corpus's tokens to draw.
BUDGET = 0.5
# Rounds in which cells that are drawn whole hand on what they cannot give.
CALIBRATION = 6


def topic(text: Column) -> Column:
    """Kind of content by its marks: symbols, table or exclaim if these are a twentieth of all characters, else prose; or empty."""
    chars = F.char_length(text)

    def many(*marks: str) -> Column:
        return 20 * (chars - F.char_length(without(text, marks))) >= chars

    return (
        F.when(chars == 0, "empty")
        .when(many("#", "$", "%", "&", "*"), "symbols")
        .when(many("|"), "table")
        .when(many("!"), "exclaim")
        .otherwise("prose")
    )


def measured(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang"
) -> DataFrame:
    """(doc_id, source, lang, topic, tokens): tokens are words; missing labels become empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        topic(text).alias("topic"),
        F.size(F.filter(F.split(text, SPACES, -1), lambda word: word != "")).cast("long").alias("tokens"),
    )


def targets(cells: DataFrame, margin: str, wanted: Mapping[str, float] | None, temperature: float) -> DataFrame:
    """(value of the margin, share): shares of one, by ``wanted`` or else by tokens to the power of ``temperature``.

    Values that are not wanted get no share; wanted ones that do not occur leave theirs to the others.
    """
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("tokens")).filter("tokens > 0")
    if wanted is None:
        weighed = sums.select(margin, F.pow("tokens", F.lit(float(temperature))).alias("weight"))
    else:
        if any(share < 0 for share in wanted.values()):
            raise ValueError("shares must not be negative")
        pairs = [F.struct(F.lit(v).alias(margin), F.lit(float(w)).alias("weight")) for v, w in wanted.items()]
        given = cells.sparkSession.range(1).select(F.inline(F.array(*pairs)))
        weighed = sums.select(margin).join(given, margin)
    total = weighed.agg(F.sum("weight")).first()[0] or 1.0
    return weighed.select(margin, (F.col("weight") / F.lit(total)).alias("share"))


def rake(cells: DataFrame, shares: Mapping[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Cells (source, lang, topic, tokens) with ``weight``: tokens fitted to the margins' shares of all tokens.

    In turn, for every margin, weights are scaled so that the margin's sums fit, until they all do.
    There is one row per combination that occurs; a sum is taken over the cells of one value, and each
    round is written.
    """
    total = F.lit(float(cells.agg(F.sum("tokens")).first()[0] or 0))
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    for margin, share in shares.items():
        fitted = fitted.join(share.withColumnRenamed("share", f"share_{margin}"), margin, "left")
    for _ in range(rounds):
        moved = F.lit(0.0)
        for margin in shares:
            sums = F.sum("weight").over(Window.partitionBy(margin))
            scale = F.coalesce(F.when(sums > 0, F.col(f"share_{margin}") * total / sums), F.lit(0.0))
            fitted = fitted.withColumn("scale", scale).withColumn("weight", F.col("weight") * F.col("scale"))
            moved = F.greatest(moved, F.when(F.col("weight") > 0, F.abs(F.col("scale") - 1)).otherwise(0.0))
            fitted = fitted.withColumn("moved", moved)
            moved = F.col("moved")
        fitted = written(fitted.drop("scale"), "mix-round")
        if (fitted.agg(F.max("moved")).first()[0] or 0.0) <= FITTED:
            break
        fitted = fitted.drop("moved")
    return fitted.select(*MARGINS, "tokens", "weight")


def calibrate(fitted: DataFrame, budget: float = BUDGET, rounds: int = CALIBRATION) -> DataFrame:
    """(source, lang, topic, probability): weights over tokens, scaled so that ``budget`` of all tokens is expected.

    No probability exceeds 1; what such cells cannot give, the others do in proportion.
    """
    total = float(fitted.agg(F.sum("tokens")).first()[0] or 0)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    scale = 0.0
    for _ in range(rounds):
        whole = F.lit(scale) * ratio >= 1
        sums = fitted.agg(
            F.sum(F.when(whole, F.col("tokens").cast("double"))).alias("taken"),
            F.sum(F.when(~whole, F.col("weight"))).alias("open"),
        ).first()
        if not sums.open:
            break
        scale = max(scale, (budget * total - (sums.taken or 0.0)) / sums.open)
    return fitted.select(*MARGINS, F.least(F.lit(1.0), F.lit(scale) * ratio).alias("probability"))


def draw(id_col: str = "doc_id") -> Column:
    """A number from 0 to 1 that follows from the id alone."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(
    docs: DataFrame,
    wanted: Mapping[str, Mapping[str, float]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    temperature: float = TEMPERATURE,
    budget: float = BUDGET,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic, tokens, probability, kept.

    ``wanted`` gives shares of tokens by source, lang or topic; a margin without them gets shares of its tokens to the
    power of ``temperature``.  Whether a document is drawn depends on its id and its cell's probability alone,
    so a repeated run, or a repeated task, draws the same.

    Cases: a null text counts as empty; null labels are the value ""; documents without
    words have cells without tokens and, like values that are not wanted, are not drawn; rows that share an
    id are drawn together where their cells agree; all rows without an id have one draw; an empty table
    gives no rows.  Other columns of ``docs`` are not read.

    Documents are measured once and combined into cells before the shuffle.  The cells are joined
    back without a hint: broadcast by their size, or shuffled with hot cells split at run time.
    """
    if not 0 < budget <= 1:
        raise ValueError("budget must be more than 0 and at most 1")
    rows = written(measured(docs, id_col, text_col, source_col, lang_col), "mix-documents")
    cells = written(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    shares = {margin: targets(cells, margin, (wanted or {}).get(margin), temperature) for margin in MARGINS}
    chances = written(calibrate(rake(cells, shares, rounds), budget), "mix-chances")
    found = rows.join(chances, list(MARGINS))
    return found.select("doc_id", *MARGINS, "tokens", "probability", (draw() < F.col("probability")).alias("kept"))
