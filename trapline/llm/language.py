"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.shared import slices, written

# Hash buckets of n-grams; with at most MAX_LANGUAGES the matrix is bounded by 32 MB.
BUCKETS = 1 << 16
MAX_LANGUAGES = 64
# The classifier is fitted on about so many documents of each language at most.
SAMPLE_PER_LANGUAGE = 4_000
# N-grams of 1 to 3 characters.
ORDERS = 3
SMOOTHING = 0.5
UNKNOWN = "und"
# A text is of the language predicted if its n-grams are likely enough there: down to as far below this
# quantile of the labelled texts of that language as the quantile lies below their median.
LOW_FIT = 0.05

_DRAWS = 1 << 30


def hashed_ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the lower-cased texts, and where the n-grams of each text begin.

    Every text must have a character.  The n-grams of a text stand together: one
    slot per character and order.  Where an n-gram would reach beyond its text,
    the slot holds the shorter n-gram at the text's end, so no slot is empty and no
    n-gram mixes two texts.
    """
    lowered = [text.lower() for text in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(text) for text in lowered])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    left = np.repeat(starts + lengths, lengths) - np.arange(len(points))  # characters to the end of the text
    mixed = np.empty((len(points), ORDERS), np.uint32)
    mixed[:, 0] = (points + np.uint32(1)) * np.uint32(0x9E3779B1)
    for order in range(1, ORDERS):
        mixed[:, order] = mixed[:, order - 1]
        longer = np.flatnonzero(left > order)
        mixed[longer, order] = (mixed[longer, order - 1] ^ points[longer + order]) * np.uint32(0x85EBCA6B) + np.uint32(
            order
        )
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0xC2B2AE35) >> np.uint32(16)).ravel(), starts * ORDERS


def _labelled_counts(sample: DataFrame) -> DataFrame:
    """(lang, bucket, n) over the texts of (lang, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for langs, texts in slices(batches, 1):
            for lang in set(langs):
                own = [text for label, text in zip(langs, texts) if label == lang]
                found = np.bincount(hashed_ngrams(own)[0], minlength=BUCKETS)
                totals[lang] = totals[lang] + found if lang in totals else found
        for lang, counts in totals.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen)), pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    counted = sample.mapInArrow(task, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log probabilities of n-gram buckets by language, and log priors."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray):
        self.languages = languages
        smoothed = counts + SMOOTHING
        self.by_bucket = np.ascontiguousarray(np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).T)
        self.prior = np.log(documents / documents.sum())

    def judge(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, its probability, and mean log probability of the n-grams in it; every text must have a character."""
        buckets, starts = hashed_ngrams(texts)
        likely = np.add.reduceat(self.by_bucket[buckets], starts, axis=0)
        scores = likely + self.prior
        best = scores.argmax(axis=1)
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        sizes = np.diff(np.append(starts, len(buckets)))
        fits = likely[np.arange(len(texts)), best] / sizes
        return [self.languages[i] for i in best], (1 / odds.sum(axis=1)).tolist(), fits.tolist()


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Fit on rows (doc_id, text, lang); rows without text or lang are left out.

    Priors count all rows.  The n-gram counts come from a sample by hash of the id, about
    ``per_language`` rows of each language.  What reaches the driver is one
    row per language and bucket, within ``languages`` times ``BUCKETS``.
    """
    labelled = labelled.filter("lang IS NOT NULL AND text != ''")
    found = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(languages + 1).collect()
    if len(found) > languages:
        raise ValueError(f"more than {languages} languages")
    if not found:
        return LanguageModel([], np.zeros((0, BUCKETS)), np.zeros(0))
    names = [row.lang for row in found]
    limit = F.lit(0)
    for row in found:
        share = min(_DRAWS, per_language * _DRAWS // row.n)
        limit = F.when(F.col("lang") == row.lang, F.lit(share)).otherwise(limit)
    drawn = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(_DRAWS)) < limit).select("lang", "text")
    counts = np.zeros((len(names), BUCKETS))
    sums = written(_labelled_counts(drawn), "language-counts").toArrow()
    at = {name: i for i, name in enumerate(names)}
    rows = np.array([at[name] for name in sums["lang"].to_pylist()], int)
    counts[rows, sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return LanguageModel(names, counts, np.array([row.n for row in found], float))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (probability of that language, 0 to 1).

    Whole texts are scored, from nothing but the text.  Cases: a null text or
    one without a letter is ``und`` with score 0, and so is every text if the
    model has no language; ties go to the first language by name; rows that
    share an id are each scored; a null id stays null; an empty table gives no
    rows.  Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).alias("lang"))
    return judged(rows, rows.sparkSession.sparkContext.broadcast(model)).select("doc_id", "lang_pred", "score")


def judged(rows: DataFrame, shared: Broadcast[LanguageModel]) -> DataFrame:
    """As ``predict``, over rows (doc_id, text, lang), with lang as given and ``fit``.

    ``fit`` is the mean log probability of the n-grams in the predicted language.  It does not grow with the length of a text as the odds between languages do; it is null for ``und``.
    """
    # So many characters at a time that the gathered log probabilities stay within some 50 MB.
    most = max(1 << 12, (1 << 21) // max(1, len(shared.value.languages)) // ORDERS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for doc_ids, texts, given in slices(batches, 1, most):
            langs, scores, fits = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            usable = [i for i, text in enumerate(texts) if known.languages and any(map(str.isalpha, text or ""))]
            if usable:
                for i, lang, score, fit in zip(usable, *known.judge([texts[i] for i in usable])):
                    langs[i], scores[i], fits[i] = lang, score, fit
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(given, pa.string()),
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(fits, pa.float64()),
                ],
                names=["doc_id", "lang", "lang_pred", "score", "fit"],
            )

    columns = rows.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"))
    return columns.mapInArrow(task, "doc_id long, lang string, lang_pred string, score double, fit double")


def held_out(id_col: str = "doc_id"):
    """Rows never learnt from: CRC-32 of the id as text leaves remainder 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> DataFrame:
    """Fit on the rows of ``docs`` that are not held out, predict all of them.

    Columns: doc_id, held_out, lang_pred, score.  Cases as in ``predict``; a row without an
    id is not learnt from.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    model = fit(rows.filter(F.col("doc_id").isNotNull() & ~held_out()), per_language)
    found = predict(rows, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5
) -> DataFrame:
    """As ``identify``, with ``fit``, the ``least_fit`` of the predicted language, and ``known``.

    Foreign and junk texts have a most probable language too, and its probability is near 1 for any long
    text.  So a text is known only if, besides a probability of ``least``, its fit is not far below that of the texts
    which are labelled and predicted as that language (held-out ones among them, for the model
    fits those that it has learnt better).  A language without such texts has no least fit.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    shared = rows.sparkSession.sparkContext.broadcast(fit(rows.filter(F.col("doc_id").isNotNull() & ~held_out())))
    found = written(judged(rows, shared), "language-fits")
    shared.destroy()
    spread = F.percentile_approx("fit", [LOW_FIT, 0.5], 10_000)
    fits = found.filter("lang = lang_pred").groupBy("lang_pred").agg(spread.alias("fits"))
    fits = fits.select("lang_pred", (2 * F.col("fits")[0] - F.col("fits")[1]).alias("least_fit"))
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
    known = known & F.coalesce(F.col("fit") >= F.col("least_fit"), F.lit(True))
    return found.join(fits, "lang_pred", "left").select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "fit", "least_fit", known.alias("known")
    )
