"""Best-fit packing under conflicts of source and duplicate cluster."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kind_of, read_table, slices, written

CAPACITY = 2048
#: Pieces that are packed together, about; a group of them is one task's state.
GROUP = 4096


class Bins:
    """Open bins ordered by what is left in them, each with bitmaps of the sources and duplicate clusters it holds.

    ``levels[r]`` has the bins with r left, and bit r of ``filled`` says that there are any. The search for a piece goes
    from the level of its length to the next filled level above until a bin is compatible: that is the tightest one. Bins
    of one level are tried in the order they came there.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels: dict[int, dict[int, None]] = {}
        self.filled = 0
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _take(self, b: int) -> None:
        level = self.levels[self.left[b]]
        del level[b]
        if not level:
            self.filled &= ~(1 << self.left[b])

    def _put(self, b: int) -> None:
        if self.left[b]:
            self.levels.setdefault(self.left[b], {})[b] = None
            self.filled |= 1 << self.left[b]

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin of a piece and its offset in it. ``source`` and ``cluster`` are bitmaps of one bit, or 0 for none."""
        above = self.filled >> length
        level = length
        while above:
            step = (above & -above).bit_length() - 1
            level += step
            for b in self.levels[level]:
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    self._take(b)
                    at = self.capacity - self.left[b]
                    self.left[b] -= length
                    self.sources[b] |= source
                    self.clusters[b] |= cluster
                    self._put(b)
                    return b, at
            above >>= step + 1
            level += 1
        self.left.append(self.capacity - length)
        self.sources.append(source)
        self.clusters.append(cluster)
        self._put(len(self.left) - 1)
        return len(self.left) - 1, 0


def pack_group(rows: Iterable[tuple[int, object, object]], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Bins and offsets for pieces (length, source, cluster) in the order given. A null source or cluster has no conflicts."""
    bins = Bins(capacity)
    bits: tuple[dict, dict] = ({}, {})
    out = []
    for length, *labels in rows:
        maps = [0 if x is None else 1 << known.setdefault(x, len(known)) for x, known in zip(labels, bits)]
        out.append(bins.place(length, *maps))
    return out


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n, cluster, row) of every row of ``docs`` (doc_id, source, text), written once for all later readers.

    n counts the words between ASCII white space and one mark that ends the document; it is 0 for a text without words.
    cluster is a digest of the text in lower case with single spaces: rows that differ in case and spacing alone share
    it, and a text without words has none. row tells repeated rows apart. Texts are read by this step alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [(t or "").lower().encode().split() for t in batch.column(2).to_pylist()]
            n = pa.array([len(w) + 1 if w else 0 for w in words], pa.int64())
            cluster = pa.array([hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in words], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), n, cluster, batch.column(3)], ["doc_id", "source", "n", "cluster", "row"])

    rows = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row"))
    return written(rows.mapInArrow(run, f"doc_id {kind_of(docs)}, source {kind_of(docs, 'source')}, n long, cluster binary, row long"), "measured")


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_offset, source) of every piece of every row of ``docs`` (doc_id, source, text).

    Lengths and duplicate clusters are those of ``measured``. A row longer than ``capacity`` is cut into full bins of its
    own and a rest. Rests and shorter rows are dealt into groups of about ``group`` by a hash of the row, whatever its
    source, cluster, id or text, so neither a hot source nor copies of one row make a large group. Within a group the
    pieces go, longest first and by cluster and id among equals, each into the fullest bin that it fits and that holds
    neither its source nor its cluster. A row without words, or a null text, is one piece of length 0 in no bin (null). A
    null source has no conflicts, and a null doc_id is packed like any other. Repeated rows are packed each, and conflict.
    No rows give no rows. Other columns of ``docs`` are not looked at.
    """
    rows = measured(docs)
    n = max(1, -(-rows.count() // group))
    whole = rows.filter(F.col("n") >= capacity).select("doc_id", "source", "row", F.explode(F.expr(f"sequence(0L, n div {capacity} - 1)")).alias("k"))
    whole = whole.select(
        "doc_id", F.col("k").cast("int").alias("piece"), (F.col("k") * capacity).alias("start"), F.lit(capacity).alias("length"), F.concat_ws("-", F.lit("full"), "row", "k").alias("bin_id"), F.lit(0).alias("bin_offset"), "source",
    )
    none = rows.filter("n = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("int").alias("bin_offset"), "source")
    rest = rows.filter(F.col("n") % capacity > 0).select("doc_id", F.expr(f"cast(n div {capacity} as int)").alias("piece"), (F.col("n") - F.col("n") % capacity).alias("start"), (F.col("n") % capacity).cast("int").alias("length"), "source", "cluster", "row")
    dealt = rest.withColumn("g", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(n)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("cluster", "ascending"), ("doc_id", "ascending"), ("row", "ascending")])
        places = pack_group(zip(*(table.column(c).to_pylist() for c in ("length", "source", "cluster"))), capacity)
        bins = [f"{g}-{b}" for g, (b, _) in zip(table.column("g").to_pylist(), places)]
        table = table.select(["doc_id", "piece", "start", "length", "source"])
        table = table.add_column(4, "bin_id", pa.array(bins, pa.string()))
        return table.add_column(5, "bin_offset", pa.array([at for _, at in places], pa.int32()))

    small = dealt.groupBy("g").applyInArrow(run, f"doc_id {kind_of(rows)}, piece int, start long, length int, bin_id string, bin_offset int, source {kind_of(rows, 'source')}")
    return small.unionByName(whole).unionByName(none)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all of ``documents`` in bins of ``CAPACITY`` words; nulls and repeated rows as in ``pack_texts``."""
    return pack_texts(read_table(spark, sf_dir, "documents"))
