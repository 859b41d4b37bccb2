"""Adapters from the driver's tables to the engine's inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import argmax_label
from ..functions.uncertainty import logit_metrics, softmax

TEMPERATURE = 0.05
RUNS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _score(k: int):
    return F.get("embedding", F.lit(k)).cast("double")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector: pair_id, human_winner, and the vector."""
    winner = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("tie")), F.col("label") % 3 + 1)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair_id"), winner.alias("human_winner"), "embedding")


def slot(k: int) -> dict:
    """Verdict and probabilities of the judgment whose log-scores are three dimensions from 3 * k on."""
    a, b, t = softmax([_score(3 * k + j) for j in range(3)], TEMPERATURE)
    return {"p_a": a, "p_b": b, "p_tie": t}


def judged(spark: SparkSession, sf_dir: str, variants: list[str]) -> DataFrame:
    """One row for each vector and variant, with verdict, probabilities, metrics and the agreement of its sampled runs."""
    rows = scored(spark, sf_dir)
    each = [F.struct(F.lit(v).alias("variant_id"), *[c.alias(n) for n, c in slot(k).items()]) for k, v in enumerate(variants)]
    out = rows.select("pair_id", F.col("pair_id").alias("source_row_index"), "human_winner", _agreement().alias("agreement_rate"), F.inline(F.array(*each)))
    out = out.withColumn("verdict", argmax_label(F.col("p_a"), F.col("p_b"), F.col("p_tie")))
    return out.withColumns(logit_metrics(F.col("p_a"), F.col("p_b"), F.col("p_tie")))


def _run(k: int):
    return argmax_label(*[_score(9 + 3 * k + j) for j in range(3)])


def _agreement():
    """Share of the commonest verdict among the sampled runs of a vector, inside the row."""
    runs = [_run(k) for k in range(RUNS)]
    counts = [sum((F.when(r == x, 1).otherwise(0) for r in runs[1:]), F.when(runs[0] == x, 1).otherwise(0)) for x in ("A", "B", "tie")]
    return F.greatest(*counts) / F.lit(float(RUNS))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, verdict, anchor) of every sampled run; the anchor is the greedy verdict of the first slot."""
    rows = scored(spark, sf_dir).select("pair_id", argmax_label(*[_score(j) for j in range(3)]).alias("anchor"), F.array(*[_run(k) for k in range(RUNS)]).alias("r"))
    return rows.select("pair_id", "anchor", F.explode("r").alias("verdict"))


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with two assistant turns as pairs: the messages before the first, and the first two as responses."""
    message = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(message)), lambda x: x["m"]).alias("messages"))
    own = F.filter("messages", lambda m: m["role"] == "assistant")
    place = F.array_position(F.transform("messages", lambda m: m["role"]), "assistant").cast("int")
    out = whole.filter(F.size(own) >= 2).select(
        F.col("conv_id").alias("source_row_index"), F.col("conv_id").cast("string").alias("pair_id"), "messages", F.slice("messages", F.lit(1), place - 1).alias("prompt_messages"),
        own[0]["content"].alias("response_a"), own[1]["content"].alias("response_b"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("tie")), (F.col("conv_id") % 3 + 1).cast("int")).alias("human_winner"),
    )
    return out.withColumns({"model_a": F.lit("model-a"), "model_b": F.lit("model-b")})


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(message)), lambda x: x["m"]).alias("messages"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as votes: the type is the verdict, the user the key, the user's first type the anchor."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("verdict"), "ts", "event_id")
    first = events.groupBy("user_id").agg(F.min_by("verdict", F.struct("ts", "event_id")).alias("anchor"))
    return events.join(first, "user_id")




def scratch(spark: SparkSession, label: str) -> str:
    """A fresh place in the shared folder; on one machine, where none is named, in its temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base.rstrip('/') or 'file://' + tempfile.mkdtemp(prefix='judgeloom-')}/judgeloom/{label}-{uuid.uuid4().hex}"


def csv_of(rows: DataFrame, order: str, path: str) -> str:
    """``rows`` in one CSV file, in order, every cell as it is."""
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    rows.orderBy(order).coalesce(1).drop(order).write.options(**plain).csv(path)
    return path


def comparison_csv(spark: SparkSession, sf_dir: str) -> str:
    """The pairs of ``conversation_pairs`` as a file with odd headers, cells and winners, some rows unusable."""
    k = F.col("source_row_index")
    winner = F.element_at(F.array(*map(F.lit, ("Model_A", "2", " tie ", "nobody"))), (k % 4 + 1).cast("int"))
    rows = conversation_pairs(spark, sf_dir).select(
        k.alias("_k"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" c"), k.cast("string"), F.lit(" "))).alias("ID"), F.lit("unused").alias("pair_id"), F.when(k % 3 > 0, (k % 3).cast("string")).otherwise("").alias("Turn ID"),
        winner.alias("HUMAN-WINNER"), F.when(k % 2 == 0, " m ").otherwise("").alias("Model A Name"), F.to_json("prompt_messages").alias("question"), F.lit("unused").alias("prompt"),
        F.concat(F.lit(' "so", '), "response_a", F.lit("\nend\\ ")).alias("Response A"), F.when(k % 11 == 0, "  ").otherwise(F.col("response_b")).alias("answer_b"),
    )
    return csv_of(rows, "_k", scratch(spark, "csv"))


def conversation_csv(spark: SparkSession, sf_dir: str) -> str:
    """Whole conversations against altered ones: every other one differs from the first message on, the rest in the last."""
    first = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.when((F.col("conv_id") % 2 == 0) & (i == 0), F.lit("else")).otherwise(m["content"]).alias("content")))
    other = F.when(F.size("messages") > 0, F.concat(F.slice(first, F.lit(1), F.size("messages") - 1), F.array(F.struct(F.lit(" Assistant ").alias("role"), F.concat(F.lit("other "), F.col("conv_id").cast("string")).alias("content")))))
    rows = messages(spark, sf_dir).select(F.col("conv_id").alias("_k"), F.col("conv_id").alias("question_id"), F.lit("left").alias("preference"), F.to_json("messages").alias("Chat A"), F.to_json(F.struct(other.alias("turns"))).alias("messages_b"))
    return csv_of(rows, "_k", scratch(spark, "csv"))


def answers(asked: DataFrame) -> DataFrame:
    """Recorded answers to requests, by arithmetic on the pair's number: some without probabilities, some with a part of them."""
    k = F.col("source_row_index")
    turn = (k + F.when(F.col("variant_id") == "swapped", 1).otherwise(0) + F.when(F.col("kind") == "sampled", F.col("seed") * F.col("seed")).otherwise(0)) % 3
    given = lambda c: F.when(k % 4 > 0, c.cast("double"))
    return asked.select(
        "source_row_index", "variant_id", "kind", "seed", F.element_at(F.array(*map(F.lit, (" a", "Both", "tie"))), (turn + 1).cast("int")).alias("raw_text"),
        given(k % 7 + 1).alias("p_a"), given(k % 5 + 1).alias("p_b"), F.when(k % 4 > 1, k % 3 + 1).cast("double").alias("p_tie"),
    )
