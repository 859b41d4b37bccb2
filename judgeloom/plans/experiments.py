"""Experiments: judged variants to pair summaries, summaries and run records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import digest_column, payload_digest
from ..functions.uncertainty import logit_metrics
from ..operators.consistency import consistency
from ..operators.judge import Judge, judged_by, requests
from ..operators.prompts import chat_hash, chat_prompt, expand_cues
from ..operators.sinks import write_jsonl, write_summary
from ..sources.pairs import expand_swaps, load_pairs


def _of(variant: str, value: Column | str) -> Column:
    return F.max(F.when(F.col("variant_id") == variant, F.col(value) if isinstance(value, str) else value))


def with_metrics(judged: DataFrame) -> DataFrame:
    return judged.withColumns(logit_metrics(F.col("p_a"), F.col("p_b"), F.col("p_tie")))


def position_pairs(judged: DataFrame) -> DataFrame:
    """One row a pair from its original and swapped rows, by one aggregation; keyed by source_row_index, as ids may repeat.

    ``judged``: source_row_index, pair_id, variant_id, verdict, response_id_a, response_id_b, agreement_rate and metrics.
    """
    response = F.when(F.col("verdict") == "A", F.col("response_id_a")).when(F.col("verdict") == "B", F.col("response_id_b"))
    columns = [_of(v, x).alias(f"{v}_{n}") for n, x in (("verdict", "verdict"), ("response_id", response)) for v in ("original", "swapped")]
    columns += [_of("original", c).alias(f"original_{c}") for c in ("entropy", "msp", "margin", "agreement_rate")]
    columns += [_of("swapped", c).alias(f"swapped_{c}") for c in ("entropy", "agreement_rate")]
    out = judged.groupBy("source_row_index", "pair_id").agg(*columns)
    usable = (F.col("original_verdict") != "tie") & (F.col("swapped_verdict") != "tie")
    flip = usable & (F.col("original_response_id") != F.col("swapped_response_id"))
    return out.withColumn("position_flip", F.coalesce(flip, F.lit(False))).select(
        "source_row_index", "pair_id", "original_verdict", "swapped_verdict", "original_response_id", "swapped_response_id", "position_flip",
        "original_entropy", "original_msp", "original_margin", "original_agreement_rate", "swapped_entropy", "swapped_agreement_rate",
    )


def position_summary(pairs: DataFrame) -> DataFrame:
    usable = F.count_if((F.col("original_verdict") != "tie") & (F.col("swapped_verdict") != "tie"))
    flips = F.count_if("position_flip")
    return pairs.agg(F.count("*").alias("total_pairs_loaded"), usable.alias("usable_pairs_for_flip"), flips.alias("flip_count"), F.try_divide(flips, usable).alias("flip_rate"))


def cue_pairs(judged: DataFrame, family: str) -> DataFrame:
    """One row a pair from its control, congruent and incongruent rows.

    ``judged``: source_row_index, pair_id, human_winner, variant_id, verdict, cue_target, agreement_rate and entropy.
    """
    sides = (f"{family}_congruent", f"{family}_incongruent")
    columns = [_of(v, c).alias(f"{v}_{c}") for c in ("verdict", "entropy", "agreement_rate") for v in ("control", *sides)] + [_of(v, "cue_target").alias(f"{v}_cue_target") for v in sides]
    out = judged.groupBy("source_row_index", "pair_id", "human_winner").agg(*columns)
    more = {}
    for v in sides:
        more[f"{v}_delta_entropy"] = F.col(f"{v}_entropy") - F.col("control_entropy")
        more[f"{v}_cue_follow"] = F.col(f"{v}_verdict") == F.col(f"{v}_cue_target")
        more[f"{v}_shift_from_control"] = F.col(f"{v}_verdict") != F.col("control_verdict")
    each = lambda suffix, *first: [*first, *[f"{v}_{suffix}" for v in sides]]
    return out.withColumns(more).select(
        "source_row_index", "pair_id", "human_winner", *each("verdict", "control_verdict"), *each("entropy", "control_entropy"), *each("delta_entropy"),
        *each("agreement_rate", "control_agreement_rate"), *each("cue_target"), *each("cue_follow"), *each("shift_from_control"),
    )


def cue_summary(pairs: DataFrame, family: str) -> DataFrame:
    """Means skip nulls; rates are over all evaluated pairs, null without any."""
    sides = (f"{family}_congruent", f"{family}_incongruent")
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return pairs.agg(
        F.count("*").alias("total_pairs_evaluated"), F.avg("control_entropy").alias("mean_control_entropy"), *[F.avg(f"{v}_entropy").alias(f"mean_{v}_entropy") for v in sides],
        *[F.avg(f"{v}_delta_entropy").alias(f"mean_{v}_delta_entropy") for v in sides], *[rate(f"{v}_cue_follow").alias(f"{v}_cue_follow_rate") for v in sides],
        *[rate(f"{v}_shift_from_control").alias(f"{v}_shift_rate") for v in sides],
    )


KEYS = ["source_row_index", "variant_id"]


def run_records(examples: DataFrame, judged: DataFrame, spec: dict, bias_name: str) -> DataFrame:
    """Nested run records: one row for each example and condition, with its greedy verdict and the consistency of its runs."""
    rows = examples.join(judged, KEYS)
    text = lambda c: F.lit(c).cast("string")
    logit = F.struct("entropy", "msp", "margin", "normalized_entropy")
    again = F.struct(F.col("run_count").cast("int").alias("run_count"), "agreement_rate", "vote_entropy", F.col("unique_verdict_count").cast("int").alias("unique_verdict_count"), "flip_rate")
    response = F.when(F.col("verdict") == "A", F.col("response_id_a")).when(F.col("verdict") == "B", F.col("response_id_b"))
    record = digest_column({"example_id": F.col("example_id"), "model_name": F.lit(spec["model_name"]), "variant_id": F.col("variant_id"), "seed": F.lit(0), "prompt_hash": F.col("prompt_hash")})
    spec_struct = F.struct(
        *[text(spec.get(k)).alias(k) for k in ("dataset_name", "dataset_split", "model_name", "backend_name")], text(bias_name).alias("bias_name"), text("choice_only").alias("output_mode"),
        F.array(F.lit("logit"), F.lit("consistency")).alias("uncertainty_methods"), F.lit(spec["consistency_runs"]).alias("consistency_runs"), F.lit(float(spec["temperature"])).alias("temperature"),
    )
    condition = F.struct(
        text(bias_name).alias("bias_type"), "variant_id", F.col("cue_target"), F.col("cue_congruency"), F.col("cue_text"), text(None).alias("decoy_anchor"), F.create_map().cast("map<string,string>").alias("metadata")
    )
    verbal = F.struct(F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("double").alias("uncertainty"))
    return rows.select(
        record.alias("record_id"), F.current_timestamp().alias("created_at"), spec_struct.alias("spec"), "example_id", "question_id", condition.alias("condition"), F.lit(0).alias("seed"), "verdict",
        F.col("verdict").alias("raw_output"), "prompt_hash", F.struct(logit.alias("logit"), verbal.alias("verbalized"), again.alias("consistency")).alias("uncertainty"),
        F.create_map(F.lit("A"), "p_a", F.lit("B"), "p_b", F.lit("tie"), "p_tie").alias("raw_prompt_logprobs"),
        F.struct("pair_id", "variant_id", response.alias("underlying_response_id"), F.substring("prompt_text", 1, 200).alias("prompt_preview")).alias("metadata"),
    )


def run_experiment(spark: SparkSession, csv_path: str, output_dir: str, family: str, load: Callable[[], Judge], *, model_name: str = "judge", limit: int | None = None, consistency_runs: int = 5, sampling_temperature: float = 0.7, engine: dict | None = None) -> dict:
    """A whole experiment: ``position``, or a cue family (``authority``, ``bandwagon``). Returns the summary.

    ``engine`` has further options that the judge was loaded with; the summary names them.

    Usable rows are filtered and expanded, ties dropped from cue families, before any judge call. Judgments are written
    once to ``output_dir``/judgments and read from there, so a lost task costs its own calls and all outputs agree. Only
    keys, verdicts and probabilities are shuffled to the summaries; prompts are not.
    """
    if consistency_runs < 1:
        raise ValueError("consistency_runs must be 1 or more")
    usable = load_pairs(spark, csv_path, limit)
    none = F.lit(None).cast("string")
    if family == "position":
        examples = expand_swaps(usable).withColumns({"cue_target": none, "cue_congruency": F.lit("none"), "cue_text": none})
    else:
        same = expand_swaps(usable).filter("variant_id = 'original'").drop("variant_id", "example_id")
        examples = expand_cues(same, family).withColumn("example_id", F.concat("pair_id", F.lit(":"), "variant_id"))
    cue_text = None if family == "position" else F.col("cue_text")
    examples = examples.withColumn("prompt_text", chat_prompt(family, F.col("prompt_messages"), F.col("answer_a"), F.col("answer_b"), cue_text))
    examples = examples.withColumn("prompt_hash", chat_hash(family, F.col("example_id"), F.col("prompt_text"), cue_text))
    judged_by(requests(examples, consistency_runs, sampling_temperature), load, KEYS).write.mode("overwrite").parquet(f"{output_dir}/judgments")
    judgments = spark.read.parquet(f"{output_dir}/judgments")
    greedy = with_metrics(judgments.filter("kind = 'greedy'")).drop("kind", "seed", "temperature", "raw_text")
    votes = judgments.filter("kind = 'sampled'").select(*KEYS, "verdict").join(greedy.select(*KEYS, F.col("verdict").alias("anchor")), KEYS)
    judged = greedy.join(consistency(votes, KEYS), KEYS)
    spec = {"dataset_name": csv_path.rstrip("/").rsplit("/", 1)[-1], "dataset_split": f"{family}_stratified", "model_name": model_name, "backend_name": "callable", "consistency_runs": consistency_runs, "temperature": sampling_temperature}
    write_jsonl(run_records(examples, judged, spec, family), f"{output_dir}/run_records")
    slim = examples.drop("prompt_messages", "prompt_text", "prompt_hash", "answer_a", "answer_b", "cue_text").join(judged, KEYS)
    pairs = position_pairs(slim) if family == "position" else cue_pairs(slim, family)
    write_jsonl(pairs.drop("source_row_index"), f"{output_dir}/pair_summary")
    summary = position_summary(pairs) if family == "position" else cue_summary(pairs, family)
    about = {"model_name": model_name, "csv_path": csv_path, "output_dir": output_dir, "consistency_runs": consistency_runs, "sampling_temperature": float(sampling_temperature), **(engine or {})}
    about |= {"raw_records_path": f"{output_dir}/run_records", "pair_summary_path": f"{output_dir}/pair_summary"}
    return write_summary(summary.select(*[F.lit(v).alias(k) for k, v in about.items()], "*"), f"{output_dir}/{family}_summary.json")


def demo_record(spark: SparkSession) -> DataFrame:
    """One whole run record: a control judgment of B, seed 0, by hand."""
    probs = {"A": 0.18, "B": 0.77, "tie": 0.05}
    text = lambda c: F.lit(c).cast("string")
    spec = {"dataset_name": "demo", "dataset_split": "train", "model_name": "demo-judge", "backend_name": "manual", "bias_name": "control", "output_mode": "choice_only"}
    spec_struct = F.struct(*[text(v).alias(k) for k, v in spec.items()], F.array(F.lit("logit")).alias("uncertainty_methods"), F.lit(1).alias("consistency_runs"), F.lit(0.0).alias("temperature"))
    condition = {"bias_type": "control", "variant_id": "control", "cue_target": None, "cue_congruency": "none", "cue_text": None, "decoy_anchor": None}
    logit = F.struct(*[c.alias(n) for n, c in logit_metrics(*[F.lit(p) for p in probs.values()]).items()])
    verbal = F.struct(F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("double").alias("uncertainty"))
    empty = F.create_map().cast("map<string,string>")
    return spark.range(1).select(
        F.lit(payload_digest({"example_id": "demo-q1", "seed": 0})).alias("record_id"), F.current_timestamp().alias("created_at"), spec_struct.alias("spec"), F.lit("demo-q1").alias("example_id"), F.lit("1").alias("question_id"),
        F.struct(*[text(v).alias(k) for k, v in condition.items()], empty.alias("metadata")).alias("condition"), F.lit(0).alias("seed"), F.lit("B").alias("verdict"), F.lit("B").alias("raw_output"),
        F.lit(payload_digest({"prompt": "Judge which response is better. Reply with A, B, or tie."})).alias("prompt_hash"),
        F.struct(logit.alias("logit"), verbal.alias("verbalized"), F.lit(None).cast("struct<run_count:int,agreement_rate:double,vote_entropy:double,unique_verdict_count:int,flip_rate:double>").alias("consistency")).alias("uncertainty"),
        F.create_map(*[F.lit(x) for pair in probs.items() for x in pair]).alias("raw_prompt_logprobs"), empty.alias("metadata"),
    )
