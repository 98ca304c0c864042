"""A corpus from documents to packed training sequences, stage by stage.

Every stage reads what its predecessor kept and drops rows by the decisions of one
operator; all but the last return the columns of ``documents``.  Decisions are made for each
id and text, so null ids and ids of several texts do not share one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm.exact_dedup import exact_dedup
from trapline.llm.language import known_language
from trapline.llm.mixing import mix
from trapline.llm.near_dedup import near_dedup
from trapline.llm.packing import pack
from trapline.llm.shared import table, written

# A document stays if its language is told with this probability.
LEAST_SCORE = 0.5
# Share of the remaining tokens that the mix draws.
MIX_BUDGET = 0.9


def _fresh(docs: DataFrame, name: str) -> str:
    """The name, or one made from it, that no column of ``docs`` has."""
    taken = {column.lower() for column in docs.columns}
    while name in taken:
        name += "_"
    return name


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{name}`") for name in docs.columns]


def _digest(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _ambiguous(docs: DataFrame, name: str) -> DataFrame | None:
    """Ids that stand for several texts, in a column of this name, written; None if there are none."""
    texts = F.xxhash64(F.coalesce("text", F.lit("")))
    ids = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("of"), texts.alias("hash"))
    several = ids.groupBy("of").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).filter("low != high")
    several = written(several.select(F.col("of").alias(name)), "pipeline-ambiguous")
    return None if several.isEmpty() else several


class Keys:
    """Keys by which a stage tells documents apart, in columns of their own whatever the table's are called.

    A key is the id where that tells, else a hash of id and text from 2^62 up.
    """

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.key, self.gone, self.several = (_fresh(docs, f"pipeline_{name}") for name in ("key", "gone", "several"))
        self.ambiguous = _ambiguous(docs, self.several)

    def add(self, rows: DataFrame, digest: Column) -> DataFrame:
        """Rows with doc_id and their key."""
        doc_id = F.col("doc_id").cast("long")
        hashed = F.xxhash64(digest, doc_id).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        if self.ambiguous is None:
            return rows.withColumn(self.key, F.when(doc_id.isNull(), hashed).otherwise(doc_id))
        joined = rows.join(self.ambiguous, F.col("doc_id") == F.col(self.several), "left")
        unclear = doc_id.isNull() | F.col(self.several).isNotNull()
        return joined.withColumn(self.key, F.when(unclear, hashed).otherwise(doc_id)).drop(self.several)

    def documents(self) -> DataFrame:
        return self.add(self.docs, _digest())

    def without(self, keyed: DataFrame, gone: DataFrame) -> DataFrame:
        """Documents but those whose key is in ``gone``, which are fewer: few are broadcast by their size, many shuffle."""
        gone = gone.select(F.col(self.key).alias(self.gone))
        return keyed.join(gone, F.col(self.key) == F.col(self.gone), "left_anti").select(_columns(self.docs))

    def only(self, keyed: DataFrame, verdicts: DataFrame) -> DataFrame:
        """Documents but those whose key has no verdict (doc_id: the key, kept) that holds; the keys that go are written and joined."""
        gone = verdicts.groupBy(F.col("doc_id").alias(self.key)).agg(F.max("kept").alias("kept")).filter("NOT kept")
        return self.without(keyed, written(gone.select(self.key), "pipeline-gone"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: told with LEAST_SCORE, in words that are usual in it.

    Cases: texts that are null, empty or without a letter go; a null lang is not learnt from; null ids and ids of several
    texts are judged text by text; repeated rows stay or go together; an empty table stays empty; other columns, whatever their names, stay.
    """
    keys = Keys(docs)
    keyed = keys.documents()
    verdicts = known_language(keyed, keys.key, least=LEAST_SCORE)
    return keys.only(keyed, verdicts.withColumn("kept", F.col("known")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one that ``exact_dedup`` keeps; of rows with the same id and text one remains.

    Cases: a null text equals an empty one; a null id stays only where no row of its text has one; an
    empty table stays empty; other columns, whatever their names, stay, and of rows with the same id and text the greatest row remains.
    """
    keys = Keys(docs)
    copies = exact_dedup(docs).filter("group_size > 1")
    found = keys.add(copies, F.col("text_sha256")).groupBy(keys.key)
    found = found.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("NOT kept OR n > 1")
    found = written(found, "pipeline-copies")
    keyed = keys.documents()
    single = keys.without(keyed, found)
    repeated = found.filter("kept").select(F.col(keys.key).alias(keys.gone))
    if repeated.isEmpty():
        return single
    rows = keyed.join(repeated, F.col(keys.key) == F.col(keys.gone), "left_semi")
    # Reduced on the map side first, so a row that is repeated very often is no hot key.
    one = rows.groupBy(keys.key).agg(F.max(F.struct(*_columns(docs))).alias(keys.several)).select(f"{keys.several}.*")
    return single.unionByName(one)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Cases: texts without words are near nothing; null ids and ids of several texts are documents each; repeated rows stay or
    go together; an empty table stays empty; other columns, whatever their names, stay.
    """
    keys = Keys(docs)
    keyed = keys.documents()
    if keys.ambiguous is not None:
        keyed = written(keyed, "pipeline-keyed")  # read in several steps
    return keys.only(keyed, near_dedup(keyed, keys.key))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target weights.

    Cases: null labels are a value of their own; documents without words are not drawn; null ids and ids of several texts are
    drawn text by text, repeated rows together; an empty table stays empty; other columns, whatever their names, stay.
    """
    keys = Keys(docs)
    keyed = keys.documents()
    return keys.only(keyed, mix(keyed, id_col=keys.key, budget=MIX_BUDGET))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows, with the checksum of their ids.

    Cases: a null or empty text is its end token; a null id stays null; rows that share an id, or are repeated, are packed each; an
    empty table gives no rows; other columns are not read.
    """
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    # Written here, as who writes the result takes batches of Spark's default size.
    return written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pipeline-pieces")


STAGES = [
    ("language", language),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mixing),
    ("packing", packing),
]

# Neither the classifier nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
