"""Judge backends: requests in, verdicts and label probabilities out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import strict_verdict
from ..functions.uncertainty import normalized, one_hot

#: A judge gets a batch (prompt_text, seed, temperature) and returns (raw_text, p_a, p_b, p_tie); probabilities may be null.
Judge = Callable[[pd.DataFrame], pd.DataFrame]


def requests(prompts: DataFrame, consistency_runs: int = 5, sampling_temperature: float = 0.7) -> DataFrame:
    """One greedy request (seed 0, temperature 0) and the sampled ones (seeds from 0 on) for every prompt."""
    if consistency_runs < 1:
        raise ValueError("consistency_runs must be 1 or more")
    sampled = f"transform(sequence(0, {consistency_runs - 1}), s -> named_struct('kind', 'sampled', 'seed', s, 'temperature', {float(sampling_temperature)}D))"
    return prompts.select("*", F.inline(F.expr(f"concat(array(named_struct('kind', 'greedy', 'seed', 0, 'temperature', 0.0D)), {sampled})")))


def judged_by(asked: DataFrame, load: Callable[[], Judge], keys: list[str]) -> DataFrame:
    """Answers from a Python judge, loaded once a task, in Arrow batches. Filter before: each row costs a call.

    The requests of one prompt stay together, for engines that cache prefixes. The result must be written before it is
    read twice, or calls are repeated.
    """
    slim = asked.select(*keys, "kind", "seed", "temperature", "prompt_text")
    given = [T.StructField("raw_text", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in ("p_a", "p_b", "p_tie")]
    schema = T.StructType([*slim.drop("prompt_text").schema.fields, *given])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = load()
        for pdf in batches:
            answer = judge(pdf[["prompt_text", "seed", "temperature"]])
            yield pd.concat([pdf.drop(columns="prompt_text"), answer[["raw_text", "p_a", "p_b", "p_tie"]].set_index(pdf.index)], axis=1)

    return with_verdicts(slim.mapInPandas(run, schema))


def replayed(asked: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Answers recorded in a table of (keys, kind, seed, raw_text, p_a, p_b, p_tie)."""
    return with_verdicts(asked.drop("prompt_text").join(answers, [*keys, "kind", "seed"]))


def with_verdicts(answers: DataFrame) -> DataFrame:
    """Adds the verdict, and makes the probabilities sum to 1.

    An answer without any probability gets the one-hot ones of its verdict. One with some has 0 for the labels that it
    leaves out. Probabilities without mass are an error.
    """
    labels = (("p_a", "A"), ("p_b", "B"), ("p_tie", "tie"))
    some = F.coalesce(*(F.col(c) for c, _ in labels)).isNotNull()
    given = {c: F.when(some, F.coalesce(c, F.lit(0.0))) for c, _ in labels}
    out = answers.withColumns(given)
    out = out.withColumn("verdict", strict_verdict(F.coalesce("raw_text", F.lit("")), F.col("p_a"), F.col("p_b"), F.col("p_tie")))
    hot = one_hot(F.col("verdict"))
    whole = [F.coalesce(F.col(c), hot[k]) for c, k in labels]
    return out.withColumns(dict(zip((c for c, _ in labels), normalized(whole))))
