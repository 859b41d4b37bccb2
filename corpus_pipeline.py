"""A training-corpus pipeline: five stages over ``documents``, each one operator of judgeloom.llm over all that is left.

Every stage takes nulls in any column, empty and very long texts, repeated rows and further columns, whatever their names;
an empty table gives no rows. All but the last return the columns they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgeloom.llm import decontaminate, language, packing, simhash, substring
from judgeloom.llm.common import read_table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language identification rejects: null texts, texts without a letter, and texts far from every known language.

    It learns from rows with a lang; where there are none, every row goes.
    """
    return language.known_only(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates (five words, a similarity of 0.8 or more).

    Null, empty and blank texts are one group. Of rows that repeat id and text all stay or all go; a row without an id stays
    only where its group has no other, and once.
    """
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated windows out of the texts; n_chars follows the text, null for a null one.

    A repeated row is another document, so what it repeats goes from all copies; a text may become empty, and stays a row.
    """
    found = substring.cut(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more lies in benchmark passages; null and empty texts are clean."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents' pieces into bins; the last stage, so it returns the pieces.

    Texts without words are one piece in no bin; repeated rows and rows without an id are packed each.
    """
    return packing.pack_texts(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify),
    ("near_duplicates", near_duplicates),
    ("substrings", repeated_passages),
    ("decontamination", contaminated),
    ("packing", pack),
]

#: No SQL has the fitted language model, the seeded fingerprints or the packing order; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are a table in the shared folder before the next one reads them."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
