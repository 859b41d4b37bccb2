"""Command line: experiments, the sampled data set and a demo record."""

from __future__ import annotations

import argparse
import importlib
import inspect
import json
import sys
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.sampling import distinct_over, shuffled, stratified_sample, value_counts
from .operators.sinks import write_csv
from .plans.experiments import demo_record, run_experiment

# The columns of a sampled data set.
SAMPLE_COLUMNS = ["question_id", "model_a", "model_b", "winner", "turn", "conversation_a", "conversation_b"]


# Commands, flags and defaults of the command line, down to where a parser is returned.
def _experiment(parser: argparse.ArgumentParser, family: str) -> None:
    parser.add_argument("--data-path", required=True)
    parser.add_argument("--output-dir", default=f"outputs/{family}")
    parser.add_argument("--judge", required=True, help="module:function that loads a judge once a task")
    parser.add_argument("--model-name", default="judge")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--consistency-runs", type=int, default=5)
    parser.add_argument("--sampling-temperature", type=float, default=0.7)
    parser.add_argument("--tensor-parallel-size", type=int, default=1)
    parser.add_argument("--max-model-len", type=int, default=8192)
    parser.add_argument("--gpu-memory-utilization", type=float, default=0.9)


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("judgeloom", description=__doc__)
    commands = parser.add_subparsers(dest="command")
    commands.add_parser("schema-demo", help="print one run record")
    for family in ("position", "authority", "bandwagon"):
        _experiment(commands.add_parser(f"run-{family}"), family)
    sample = commands.add_parser("prepare-sample", help="equal numbers of rows for each winner, as CSV")
    sample.add_argument("--data-path", required=True, help="Parquet or JSON with the sample's columns")
    sample.add_argument("--output-path", required=True)
    sample.add_argument("--target-size", type=int, default=200)
    sample.add_argument("--seed", type=int, default=42)
    return parser


def demo(spark: SparkSession) -> dict:
    """A whole run record as plain values."""
    row = demo_record(spark).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()
    return json.loads(row[0])


def prepare_sample(spark: SparkSession, data_path: str, output_path: str, target_size: int, seed: int) -> None:
    rows = spark.read.json(data_path) if data_path.endswith((".json", ".jsonl")) else spark.read.parquet(data_path)
    texts = {c: F.to_json(c) for c, kind in rows.dtypes if kind.startswith(("array", "struct"))}
    keyed = rows.withColumns(texts).withColumn("_key", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in SAMPLE_COLUMNS]), 256))
    picked = shuffled(stratified_sample(keyed, "winner", "_key", target_size, seed), "_key", seed).select(SAMPLE_COLUMNS)
    write_csv(picked, output_path)
    value_counts(picked, "winner").show()
    distinct_over(picked, "model_a", "model_b").show()


def loader(judge: str, options: dict) -> Callable:
    """The function that ``module:function`` names, with those of the options that it takes."""
    module, _, name = judge.partition(":")
    load = getattr(importlib.import_module(module), name)
    takes = inspect.signature(load).parameters.values()
    every = any(p.kind is p.VAR_KEYWORD for p in takes)
    known = {p.name for p in takes}
    return partial(load, **{k: v for k, v in options.items() if every or k in known})


def main(argv: Sequence[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command is None:
        build_parser().print_help()
        return 0
    spark = SparkSession.builder.appName("judgeloom").getOrCreate()
    if args.command == "schema-demo":
        print(json.dumps(demo(spark), indent=2))
    elif args.command == "prepare-sample":
        prepare_sample(spark, args.data_path, args.output_path, args.target_size, args.seed)
    else:
        engine = {name: getattr(args, name) for name in ("tensor_parallel_size", "max_model_len", "gpu_memory_utilization")}
        load = loader(args.judge, {"model_name": args.model_name, **engine})
        options = {"model_name": args.model_name, "limit": args.limit, "consistency_runs": args.consistency_runs, "sampling_temperature": args.sampling_temperature, "engine": engine}
        print(json.dumps(run_experiment(spark, args.data_path, args.output_dir, args.command.removeprefix("run-"), load, **options), indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
