"""Exact stratified samples and the reports about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seeded_order(key: str, seed: int):
    return F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")), 256)


def labels_of(rows: DataFrame, stratum: str) -> DataFrame:
    """The distinct labels that aren't null, sorted."""
    return rows.select(stratum).filter(F.col(stratum).isNotNull()).distinct().orderBy(stratum)


def stratified_sample(rows: DataFrame, stratum: str, key: str, target: int, seed: int = 42, strict: bool = True) -> DataFrame:
    """target // labels rows of each label without replacement, the same for the same seed; with their place in the shuffle.

    Errors: a share under one row, and (``strict``) a label with too few rows. Each task keeps its best rows of a label
    before the shuffle, so a large label isn't gathered.
    """
    counts = {r[stratum]: r["n"] for r in rows.filter(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count("*").alias("n")).collect()}
    each = target // len(counts) if counts else 0
    if each < 1:
        raise ValueError(f"target {target} is under one row a label")
    if strict and min(counts.values()) < each:
        raise ValueError(f"a label has fewer than {each} rows")
    order = Window.partitionBy(stratum).orderBy("shuffle_key", key)
    ranked = rows.filter(F.col(stratum).isNotNull()).withColumn("shuffle_key", seeded_order(key, seed)).withColumn("stratum_rank", F.row_number().over(order))
    return ranked.filter(F.col("stratum_rank") <= each)


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return rows.orderBy(seeded_order(key, seed))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def distinct_over(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: how many values occur in any of the columns."""
    values = rows.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("v"))
    return values.agg(F.countDistinct("v").alias("n_distinct"))
