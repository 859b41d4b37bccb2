"""What the operators of this folder share: tables, the shared folder, and vectorised word hashing."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_dir: list[str] = []
_swept: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of this process where that is unset and all runs on one machine.

    On a cluster it must be set: executors would write to their own disks, and the driver would read a part of the rows.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="judgeloom-"))
    return f"file://{_own_dir[0]}"


def run_dir(spark: SparkSession) -> str:
    """Where this application's tables and files go. They are removed when the driver's process ends, or by ``clear``."""
    own = spark.sparkContext.applicationId
    if own not in _swept:
        _swept.add(own)
        atexit.register(clear, spark)
    return f"{shared_dir(spark)}/judgeloom/{own}"


def clear(spark: SparkSession) -> None:
    """Removes all that this application has written to the shared folder; results that are still to be read need it."""
    context = spark.sparkContext
    if context._jsc is not None:  # not stopped yet
        place = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/judgeloom/{context.applicationId}")
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table written once to the shared folder: lineage ends here and every later reader sees the same rows."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kind_of(rows: DataFrame, column: str = "doc_id") -> str:
    """The type of a column as schema text: ids are of whatever type the table has."""
    return rows.schema[column].dataType.simpleString()


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def row_key(text: str = "text") -> Column:
    """With doc_id, tells rows apart that share an id but not the text; also set for null texts."""
    return F.xxhash64(F.col(text))


def sampled(docs: DataFrame, each: int, group: Column | None = None, only: DataFrame | None = None) -> DataFrame:
    """(grp, text): of each group ``each`` distinct rows (doc_id, text) at most, those of least hash; null ids are left out.

    ``only`` (mark) has the ids to choose from. The hashes that are ranked are a share of a group's that holds about four
    samples; where copies leave too few different rows in it, the share grows. Copies are combined before any shuffle and
    come once, so neither the ranking nor the driver, which receives the keys of the sample, sees a hot row twice.
    """
    grp = F.lit("") if group is None else group
    keyed = docs.filter("doc_id is not null").select(grp.alias("grp"), "doc_id", "text", row_key().alias("th"))
    keyed = keyed.withColumn("h", F.pmod(F.xxhash64("doc_id", "th"), F.lit(1 << 30)))
    keys = keyed.select("grp", "h", "doc_id", "th")
    if only is not None:
        keys = keys.join(only, keys["doc_id"] == only["mark"], "left_semi")
    sizes = {r.grp: r.n for r in keys.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    shares = {g: min(1.0, 4 * each / n) for g, n in sizes.items()}
    order = Window.partitionBy("grp").orderBy("h", "doc_id", "th")
    found: list[tuple] = []
    while shares:
        limit = F.lit(0.0)
        for g, share in shares.items():
            limit = F.when(F.col("grp") == g, F.lit(share * (1 << 30))).otherwise(limit)
        ranked = keys.filter(F.col("h") < limit).distinct().withColumn("k", F.row_number().over(order)).filter(F.col("k") <= each)
        got = [(r.grp, r.doc_id, r.th) for r in ranked.select("grp", "doc_id", "th").collect()]
        counts = Counter(g for g, *_ in got)
        done = {g for g, share in shares.items() if share >= 1 or counts[g] >= each}
        found += [r for r in got if r[0] in done]
        shares = {g: min(1.0, 8 * share) for g, share in shares.items() if g not in done}
    fields = [T.StructField(f"_{c}", keyed.schema[c].dataType) for c in ("grp", "doc_id", "th")]
    ids = docs.sparkSession.createDataFrame(found, T.StructType(fields))
    same = [F.col(c) == F.col(f"_{c}") for c in ("grp", "doc_id", "th")]
    rows = keyed.join(F.broadcast(ids), same, "left_semi")  # each keys a group
    return rows.dropDuplicates(["grp", "doc_id", "th"]).select("grp", "text")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer text comes alone."""
    for batch in batches:
        offsets = text_offsets(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def packed_text(df: DataFrame) -> DataFrame:
    """``df`` with ``text`` as zstd frames, null where it is null: half the bytes in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts = pa.array([None if t is None else pack(t.encode()) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.record_batch([texts if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in df.schema]))


def unpacked_texts(column: pa.Array) -> Iterator[bytes | None]:
    unpack = zstandard.ZstdDecompressor().decompress
    for x in column.to_pylist():
        yield None if x is None else unpack(x)


#: Tasks that add up what the tasks over a table have summed; one adds up theirs.
ADDERS = 16


def summed(rows: DataFrame, of_task: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """The sum over all tasks of the one array of doubles that each makes of its rows, or None where none makes any.

    Arrays travel packed and are added up in two steps on the executors: the driver receives one, whatever the table's size.
    """

    def packed(total: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([zstandard.ZstdCompressor(level=1).compress(total.astype("<f8").tobytes())], pa.binary())], ["part"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_threads()
        total = of_task(batches)
        if total is not None:
            yield packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<f8")
                total = part.copy() if total is None else total + part
        if total is not None:
            yield packed(total)

    got = rows.mapInArrow(first, "part binary").repartition(ADDERS).mapInArrow(add, "part binary").repartition(1).mapInArrow(add, "part binary").collect()
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(got[0].part), "<f8") if got else None


def text_offsets(column: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)


#: Words end at ASCII white space only; bytes stay as they are, and NUL is a byte of words, hashed as 256.
SPACE_WORDS = np.arange(256, dtype=np.uint16)
SPACE_WORDS[0] = 256
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = 0
#: The same, A-Z as a-z.
LOWER_WORDS = SPACE_WORDS.copy()
LOWER_WORDS[0x41:0x5B] = SPACE_WORDS[0x61:0x7B]
#: Words of a-z, 0-9 and everything beyond ASCII, in lower case.
ALNUM_WORDS = np.zeros(256, np.uint8)
ALNUM_WORDS[0x30:0x3A] = np.arange(0x30, 0x3A)
ALNUM_WORDS[0x61:0x7B] = np.arange(0x61, 0x7B)
ALNUM_WORDS[0x41:0x5B] = np.arange(0x61, 0x7B)
ALNUM_WORDS[0x80:] = np.arange(0x80, 0x100)

_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers.append(np.cumprod(out, dtype=np.uint64))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hash_words(column: pa.Array, lut: np.ndarray, tails: bool = False) -> tuple[np.ndarray, ...]:
    """A 64-bit hash of every word of a column of texts, and the bounds of each text's words; with ``tails`` also the last bytes.

    The last three bytes of a word, the first one repeated in a shorter word, are one number.

    ``lut`` maps a byte to 0 (ends a word) or to the byte that is hashed. Nulls have no words. Equal words have equal
    hashes in every process; a hash is only ever a hint or a feature, never the proof that two words are equal.
    """
    offsets = text_offsets(column)
    n = int(offsets[-1] - offsets[0])
    if n == 0:
        return (np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64), *([np.zeros(0, np.uint64)] * tails))
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    value = lut[data]
    word = value != 0
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value.astype(np.uint64) * up[:n], out=sums[1:])
    found = mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)
    if not tails:
        return found
    last = [value[np.maximum(ends - k, starts)].astype(np.uint64) for k in (1, 2, 3)]
    return *found, last[0] + (last[1] << np.uint64(9)) + (last[2] << np.uint64(18))


def worker_threads() -> None:
    """One thread for each Python worker: Spark already runs one worker a core."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
