"""Groups of near copies: shingle sets of a Jaccard similarity, SimHash candidates under covering masks, and an exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_WORDS, hash_words, kind_of, mix, row_key, slices, written
from .covering import SEED, TINY, meetings, set_prints
from .graph import components

WORDS = 5
SIMILARITY = 0.8
#: Sets that a task holds, and sets that pass by them, at most on average.
QUERIES, PASSING = 512, 1024
#: Draws whose nearest nodes are compared before all else.
FIRST = 16

_SETS = "th long, node long, prints binary, tiny boolean"


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, one text after another, and their bounds.

    Words end at ASCII white space and A-Z are lower-cased. A text of fewer words is one shingle; one without has none.
    """
    h, bounds = hash_words(column, LOWER_WORDS)
    n = np.diff(bounds)
    parts, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    # A text of k words makes shingles of min(k, words).
    for width in [w for w in np.unique(np.minimum(n, words)).tolist() if w]:
        of = np.flatnonzero(np.minimum(n, words) == width)
        count = n[of] - width + 1
        text = np.repeat(of, count)
        at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + bounds[text]
        grams = np.full(len(text), width, np.uint64)
        for k in range(width):
            grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + h[at + k])
        parts.append(grams)
        texts.append(text)
    grams, text = np.concatenate(parts), np.concatenate(texts)
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[new], text[new]
    return grams, np.searchsorted(text, np.arange(len(n) + 1))


def set_digests(grams: np.ndarray, bounds: np.ndarray) -> list[int]:
    digests = np.array([xxhash.xxh3_64_intdigest(grams[a:b].tobytes(), SEED) for a, b in zip(bounds.tolist(), bounds[1:].tolist())], np.uint64)
    return digests.view(np.int64)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grams, bounds = shingle_sets(batch.column(2), words)
            prints, tiny = pa.array(set_prints(grams, bounds), pa.binary()), pa.array(np.diff(bounds) <= TINY)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(set_digests(grams, bounds)), prints, tiny], ["doc_id", "th", "node", "prints", "tiny"])

    return run


def _grams(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grams, bounds = shingle_sets(batch.column(1), words)
            sets = [grams[a:b].tobytes() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], ["node", "grams"])

    return run


def _compare(similarity: float):
    """Rows (task, side, node, grp, grams), sorted by task and side, to links (a, b).

    The sets of side 0 of a task are held, ``QUERIES`` at most; those of side 1 pass by, and each is compared with all
    that are held. A node without a group (null) is one of its own. A link comes only where it connects two groups that no
    link of the task has connected before, so there are fewer links than groups in a task, however many pairs are alike.
    """

    def root(of: dict, x: tuple) -> tuple:
        while of.setdefault(x, x) != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, index, joined = None, [], None, {}
        for batch in slices(batches, "grams"):
            a, b = [], []
            for row_task, side, node, grp, packed in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if row_task != task:
                    task, held, index, joined = row_task, [], None, {}
                grams = np.frombuffer(packed, "<u8")
                group = (node, None) if grp is None else (None, grp)
                if side == 0:
                    held.append((node, group, grams))
                    continue
                if index is None:
                    sizes = np.array([len(h[2]) for h in held], np.int64)
                    flat = np.concatenate([np.zeros(0, np.uint64), *(h[2] for h in held)])
                    order = np.argsort(flat, kind="stable")
                    index = flat[order], np.repeat(np.arange(len(held)), sizes)[order], sizes
                flat, owner, sizes = index
                low, high = np.searchsorted(flat, grams, "left"), np.searchsorted(flat, grams, "right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(held))
                for k in np.flatnonzero((common > 0) & (common >= similarity * (len(grams) + sizes - common) - 1e-9)).tolist():
                    mine, other = root(joined, group), root(joined, held[k][1])
                    if mine != other:
                        joined[mine] = other
                        a.append(node)
                        b.append(held[k][0])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _links(asked: DataFrame, passing: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """The links between the rows of ``asked`` and ``passing`` (task, node, grp) that have a task in common."""
    rows = asked.select("task", F.lit(0).alias("side"), "node", "grp").union(passing.select("task", F.lit(1).alias("side"), "node", "grp"))
    n = max(int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.join(grams, "node").select("task", "side", "node", "grp", "grams")
    return rows.repartition(n, "task").sortWithinPartitions("task", "side").mapInArrow(_compare(similarity), "a long, b long")


def _part(n: Column, each: int) -> Column:
    return F.pmod(F.xxhash64("node"), F.ceil(n / each).cast("long"))


def _chosen(sets: DataFrame, texts: DataFrame, met: DataFrame, words: int) -> DataFrame:
    """(node, grams) of the nodes of ``met``, each from one of its texts."""
    rep = sets.join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("x"))
    rep = rep.select("node", F.col("x.doc_id").alias("_id"), F.col("x.th").alias("_th"))
    chosen = texts.join(rep, texts["doc_id"].eqNullSafe(rep["_id"]) & (texts["th"] == rep["_th"])).select("node", "text")
    return written(chosen.mapInArrow(_grams(words), "node long, grams binary").dropDuplicates(["node"]), "grams")


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, th, root) of every row of (doc_id, text): equal roots for texts that pairs of ``similarity`` or more connect.

    The similarity is Jaccard's, of the sets of shingles of ``words`` words. Texts with equal sets are one node; those
    without words are one as well. Nodes that meet under covering masks of SimHash fingerprints make a bucket; a pair at 0.8
    meets in none of the draws with a probability of about 1e-6, one above with less. First every node is compared with the
    nearest of each of its buckets in ``FIRST`` draws, and what is linked is a group. Then, in all buckets that still hold
    several groups, every node outside the largest is a query against all of the bucket. So all pairs of a bucket that could
    connect two groups are compared on their whole sets; those inside a group are not. Work is dealt in tasks of ``QUERIES``
    and ``PASSING`` sets at most, however large a bucket is.
    """
    texts = docs.select("doc_id", row_key().alias("th"), "text")
    sets = written(texts.mapInArrow(_sets(words), f"doc_id {kind_of(docs)}, {_SETS}"), "shingle-sets")
    prints, n = sets.filter("prints is not null").select("node", "prints", "tiny").dropDuplicates(["node"]), sets.count()
    met = written(meetings(prints.withColumn("grp", F.col("node")), n, FIRST), "buckets")
    pairs = met.select(F.greatest("node", "near").alias("low"), F.least("node", "near").alias("node"), "n").filter("low <> node").groupBy("low", "node").agg(F.max("n").alias("of"))
    pairs = pairs.select("low", "node", F.xxhash64("low", _part(F.col("of"), PASSING)).alias("task"), F.lit(None).cast("long").alias("grp"))
    first = written(_links(pairs.select("task", F.col("low").alias("node"), "grp").distinct(), pairs, _chosen(sets, texts, met, words), similarity), "links")

    groups = components(first).withColumnRenamed("node", "_node")
    grouped = prints.join(groups, F.col("node") == F.col("_node"), "left").select("node", "prints", "tiny", F.coalesce("root", "node").alias("grp"))
    rest = written(meetings(grouped, n), "open-buckets")
    grams = _chosen(sets, texts, rest, words)
    sizes = rest.groupBy("t", "key", "grp").agg(F.count("*").alias("k"))
    several = sizes.groupBy("t", "key").agg(F.sum("k").alias("n"), F.max(F.struct("k", "grp")).alias("top"))
    several = several.select("t", "key", F.ceil((F.col("n") - F.col("top.k")) / QUERIES).alias("blocks"), F.ceil(F.col("n") / PASSING).alias("parts"), F.col("top.grp").alias("top"))
    rest = written(rest.select("t", "key", "node", "grp").join(several, ["t", "key"]), "queries")
    block, part = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node"), F.col("parts"))
    asked = rest.filter("grp <> top").select("*", F.explode(F.expr("sequence(0L, parts - 1)")).alias("k")).select(F.xxhash64("t", "key", block, "k").alias("task"), "node", "grp")
    passing = rest.select("*", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("k")).select(F.xxhash64("t", "key", "k", part).alias("task"), "node", "grp")
    second = _links(asked, passing, grams, similarity)

    roots = components(first.union(second)).withColumnRenamed("node", "_node")
    return sets.join(roots, F.col("node") == F.col("_node"), "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))
