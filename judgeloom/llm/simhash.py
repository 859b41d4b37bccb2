"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kind_of, read_table, row_key, slices, written
from .covering import BITS, SEED, covering_masks
from .graph import components
from .shingles import SIMILARITY, WORDS, near_copies


def _fingerprint(text: bytes, words: int) -> int:
    w = text.lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles = [b" ".join(w)]
    elif words == 3:
        shingles = [b" ".join(x) for x in zip(w, w[1:], w[2:])]
    else:
        shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], "<u8")
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[i : i + (1 << 14)].view(np.uint8), bitorder="little")
        total += bits.reshape(-1, BITS).sum(0, dtype=np.int32)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint as a signed 64-bit integer) of every row of (doc_id, text).

    A-Z are lower-cased, words end at ASCII white space; a bit is set if it is set in more than half of the seeded
    XXH64 values of the shingles of ``words`` words, repeats included. A shorter text is one shingle; a null, empty or
    blank text has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = [_fingerprint((t or "").encode(), words) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(np.array(marks, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of(docs)}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Buckets of so many fingerprints at most are compared pair by pair, larger ones by hubs.
SMALL = 32


def links(nodes: DataFrame, radius: int = 2, small: int = SMALL) -> DataFrame:
    """Edges (a, b) that connect exactly what fingerprints within ``radius`` bits connect. ``nodes``: distinct ``fp``.

    The covering tables bring every pair within reach into one bucket, and a pair that met by chance costs one
    comparison there. A bucket of more than ``small`` fingerprints is not compared: its members meet at hubs, the words
    within ``radius``/2 flips of a fingerprint in the bits that the bucket's mask hides. Two fingerprints within the
    radius share a hub, and all that share one are within the radius. So a bucket that holds a third of all rows costs a
    fixed number of hubs for each member, its pairs are never listed, and a hub itself has at most 65 members for a
    radius of 2. ``radius`` must be even.
    """
    if radius % 2 or not 2 <= radius <= 4:
        raise ValueError("radius must be 2 or 4")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    keyed = nodes.select("fp", F.inline(tables))
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(keyed.join(shared, ["t", "key"]), "buckets")
    pairs = "filter(flatten(transform(xs, (x, i) -> transform(slice(xs, i + 2, size(xs)), y -> struct(x as a, y as b)))), p -> bit_count(p.a ^ p.b) <= {})"
    compared = met.filter(F.col("n") <= small).groupBy("t", "key").agg(F.collect_list("fp").alias("xs")).select(F.inline(F.expr(pairs.format(radius))))
    hidden = F.element_at(F.array(*[F.lit(_signed(~m & ((1 << 64) - 1))) for m in masks]), F.col("t") + 1)
    near = met.filter(F.col("n") > small).groupBy("fp").agg(F.bit_or(hidden).alias("open"))
    flips = F.expr(f"filter(transform(sequence(0, {BITS - 1}), i -> if(getbit(open, i) = 1, shiftleft(1L, i), 0L)), x -> x <> 0L)")
    near = near.select("fp", flips.alias("flips"))
    hubs = F.expr("concat(array(fp), transform(flips, x -> fp ^ x))")
    if radius == 4:
        hubs = F.expr("array_distinct(concat(array(fp), transform(flips, x -> fp ^ x), flatten(transform(flips, x -> transform(flips, y -> fp ^ x ^ y)))))")
    at = near.select("fp", F.explode(hubs).alias("hub"))
    least = at.groupBy("hub").agg(F.min("fp").alias("low"), F.collect_set("fp").alias("all")).filter("size(all) > 1")
    return compared.union(least.select(F.col("low").alias("a"), F.explode("all").alias("b")).filter("a <> b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of (doc_id, text): components of fingerprints within ``radius`` bits.

    component_id is the smallest doc_id that can be reached, the row's own included. Fingerprint zero (null, empty and
    blank texts) links like any other. Rows with a null doc_id have a fingerprint and take part in linking; a component
    of such rows alone has a null component_id. Repeated rows come back repeated. No rows give no rows. Other columns
    of ``docs`` are not looked at.
    """
    marks = written(fingerprints(docs, words), "fingerprints")
    nodes = marks.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "roots")
    best = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = rooted.join(best, "root").select("fp", "component_id")
    return marks.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near copies: the one of the smallest doc_id; all columns stay.

    Groups are those of ``near_copies``: SimHash fingerprints, covering masks, and a check on the whole sets. A row with a
    null doc_id stays only where its whole group has none, and then one row does. Rows that repeat the smallest doc_id and
    its text stay together: they are one document to the rule.
    """
    best = near_copies(docs, words, similarity).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("x"))
    best = best.select(F.col("x.doc_id").alias("_kept_id"), F.col("x.th").alias("_kept_th"))
    rows = docs.withColumn("_jl_th", row_key())
    kept = rows.join(best, rows["doc_id"].eqNullSafe(best["_kept_id"]) & (rows["_jl_th"] == best["_kept_th"]), "left_semi")
    nameless = kept.filter("doc_id is null").dropDuplicates(["_jl_th"])
    return kept.filter("doc_id is not null").union(nameless).drop("_jl_th")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document: three words a shingle, links at two bits or fewer."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
