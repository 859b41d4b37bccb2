"""Agreement of repeated verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consistency(votes: DataFrame, keys: list[str], verdict: str = "verdict", anchor: str = "anchor") -> DataFrame:
    """(keys, run_count, agreement_rate, vote_entropy, unique_verdict_count, flip_rate) of every key.

    Votes are counted by verdict first, with a map-side combine, so a key with many votes shuffles one row a task and
    verdict. vote_entropy is in bits; flip_rate is the share of verdicts that differ from the key's anchor.
    """
    counted = votes.groupBy(*keys, verdict).agg(F.count("*").alias("n"), F.sum((F.col(verdict) != F.col(anchor)).cast("long")).alias("flips"))
    total = F.sum("n")
    return counted.groupBy(*keys).agg(
        total.cast("long").alias("run_count"), (F.max("n") / total).alias("agreement_rate"),
        (F.log2(total.cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / total).alias("vote_entropy"),
        F.count("*").alias("unique_verdict_count"), (F.sum("flips") / total).alias("flip_rate"),
    )


def item_rollup(records: DataFrame) -> DataFrame:
    """The item aggregate: dominant verdict (ties in the order A, B, tie) and mean uncertainty of each item, bias and model."""
    keys = ["example_id", "question_id", "bias_name", "model_name"]
    order = F.when(F.col("verdict") == "A", 0).when(F.col("verdict") == "B", 1).otherwise(2)
    by = records.groupBy(*keys, "verdict").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in ("entropy", "msp", "verbalized_uncertainty")], *[F.count(c).alias(f"n_{c}") for c in ("entropy", "msp", "verbalized_uncertainty")]
    )
    mean = lambda c: (F.sum(f"s_{c}") / F.nullif(F.sum(f"n_{c}"), F.lit(0))).alias(f"mean_{c}")
    return by.groupBy(*keys).agg(
        F.sum("n").alias("run_count"), F.max_by("verdict", F.struct(F.col("n"), -order)).alias("dominant_verdict"), mean("entropy"), mean("msp"), mean("verbalized_uncertainty"), (F.max("n") / F.sum("n")).alias("agreement_rate")
    )
