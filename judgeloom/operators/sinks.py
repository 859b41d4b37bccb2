"""Writers of records and summaries."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of JSON Lines files, nulls kept, all but ASCII escaped, an earlier one replaced."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").option("writeNonAsciiCharacterAsCodePoint", "true").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def summary_object(summary: DataFrame) -> dict:
    """The one row of a summary."""
    row = summary.first()
    return {k: v.isoformat() if isinstance(v, datetime) else v for k, v in row.asDict(recursive=True).items()}


def write_summary(summary: DataFrame, path: str) -> dict:
    """The one row of a summary as an indented JSON object in one file, on whatever file system ``path`` names."""
    found = summary_object(summary)
    write_object(summary.sparkSession, found, path)
    return found


def write_object(spark: SparkSession, found: dict, path: str) -> None:
    """An indented ASCII JSON object as one file, an earlier one replaced; folders above it are made."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).create(place, True)
    try:
        stream.write(bytearray(json.dumps(found, indent=2).encode("ascii")))
    finally:
        stream.close()
