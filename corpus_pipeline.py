"""The corpus pipeline: five stages over ``documents``, each written and read again by the caller.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``docs``, whatever they are called. ``run`` applies them in order.
Texts are taken whole, however long; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundplan.llm import decontaminate, packing, quality, repeats, simhash
from groundplan.llm.common import table, written

#: Bytes of a repeated string; a passage of over 50 words is longer than that.
REPEAT_BYTES = 200


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like others; equal texts get equal scores, so repeated
    rows stay or go together. Without labels every document stays.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays, that of the smallest id.

    Texts without a word, null ones included, are one group. Of rows with equal ids and
    texts one stays; rows without an id all stay.
    """
    return simhash.one_of_each(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of REPEAT_BYTES that occur more than once are cut out of all texts.

    All rows stay, with every occurrence cut; so repeated rows that are long enough are
    left with an empty text. Null texts stay null. A column ``n_chars`` is set to the new length.
    """
    cut = repeats.cut(docs, REPEAT_BYTES)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go.

    Rows of one id go together; null and empty texts hold no passage and stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left, a row for each piece of one.

    A null or empty text is its end mark alone; repeated rows are packed as often as they come.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("repeat_dedup", repeat_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: A trained classifier and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
