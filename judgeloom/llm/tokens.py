"""Token ids as Arrow stream files of equal-length sequences and masks."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, kind_of, packed_text, read_table, row_key, slices, text_offsets, unpacked_texts, worker_threads, written

END_ID = 2
SEQUENCE = 2048
#: Sequences of a record batch. Every batch but a file's last has as many, so all of them are equally long in bytes.
BATCH = 64
#: Units of text whose ids a worker keeps; beyond that the older half goes. Longer units are not kept.
CACHE = 450_000
CACHED_BYTES = 64
#: Bytes of text of a shard, that is of a file, on average.
SHARD_TEXT = 24 << 20

_byte = np.arange(256)
#: Bytes that only a character other than white space can begin with or be.
_DARK = ((_byte > 0x20) & (_byte < 0x7F)) | ((_byte >= 0xC3) & (_byte <= 0xF4) & ~np.isin(_byte, [0xE1, 0xE2, 0xE3]))
_PRINTED = (_byte > 0x20) & (_byte < 0x7F)
_LETTER = np.isin(_byte, [*range(0x41, 0x5B), *range(0x61, 0x7B)])
_MARK = _PRINTED & ~_LETTER


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut so that the ids of the units, one after the other, are those of the whole texts.

    Under the split pattern of byte-level BPE files a token holds a space at its start only, and letters are apart
    from digits and marks. So a token always begins at a space before a visible character, at a digit or mark behind a
    letter, and on both sides of a single line end between visible characters.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    dark = np.zeros(n + 1, bool)  # the next byte is visible
    dark[: n - 1] = _DARK[data[1:]]
    cut[:n] = (data == 0x20) & dark[:n]
    cut[offsets[1:][offsets[1:] > 0] - 1] = False  # what follows belongs to another text
    line = np.flatnonzero((data[1:] == 0x0A) & _PRINTED[data[:-1]] & dark[1:n]) + 1
    cut[line] = cut[line + 1] = True
    cut[1:n] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    cut[offsets] = True
    cut[n] = False
    return np.flatnonzero(cut)


class CachedTokenizer:
    """A byte-level BPE file of the tokenizers library, with the ids of units that were seen before.

    A batch is cut into units without a loop over them; each distinct unit is looked up once, and the library encodes
    those that are new. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, cache: int = CACHE):
        worker_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache = cache
        self.units: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def _ids_of(self, units: list[bytes]) -> list[bytes]:
        found = list(map(self.units.get, units))
        new: dict[bytes, bytes] = {}
        missing = []
        for k in [k for k, x in enumerate(found) if x is None]:
            seen = self.old.get(units[k])
            if seen is None:
                missing.append(k)
            else:
                found[k] = new[units[k]] = seen
        kind = "H" if self.dtype.itemsize == 2 else "I"
        for a in range(0, len(missing), 4096):
            part = missing[a : a + 4096]
            coded = self.tokenizer.encode_batch_fast([units[k].decode() for k in part], add_special_tokens=False)
            for k, ids in zip(part, [array(kind, e.ids).tobytes() for e in coded]):
                found[k] = ids
                if len(units[k]) <= CACHED_BYTES:
                    new[units[k]] = ids
        if len(self.units) + len(new) > self.cache:
            self.old, self.units = self.units, {}
        self.units.update(new)
        return found

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts, one text after the other, and the bounds of each; a null text has none."""
        offsets = text_offsets(column)
        base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        if not size:
            return np.zeros(0, self.dtype), np.zeros(len(column) + 1, np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[base : base + size]
        starts = unit_starts(data, offsets - base)
        bounds = pa.py_buffer(np.append(starts, size).astype(np.int64))
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        packed = self._ids_of(units.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(packed), self.dtype)
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // self.dtype.itemsize
        first = np.cumsum(lengths) - lengths
        unit = units.indices.to_numpy()
        n = lengths[unit]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[unit] - (ends - n), n) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(starts, offsets - base)]


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> CachedTokenizer:
    return CachedTokenizer(path)


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else pa.fs.FileSystem.from_uri(f"file://{path.removeprefix('file:')}")


def file_schema(sequence: int, dtype: np.dtype) -> pa.Schema:
    """input_ids and mask (1: an id, 0: padding), both fixed-size lists of whole bytes, so neither is copied to be read."""
    ids = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    return pa.schema([("input_ids", pa.list_(ids, sequence)), ("mask", pa.list_(pa.uint8(), sequence))])


class ShardWriter:
    """Documents one after the other into one stream file; the last sequence is padded.

    Only whole batches of ``BATCH`` sequences are written before the file is closed.
    """

    def __init__(self, sink, sequence: int, dtype: np.dtype):
        self.schema, self.sequence, self.dtype = file_schema(sequence, dtype), sequence, dtype
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.ids: list[np.ndarray] = []
        self.held = 0
        self.n_tokens = 0

    def add(self, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.held += len(ids)
        self.n_tokens += len(ids)
        size = BATCH * self.sequence
        if self.held >= size:
            flat = np.concatenate(self.ids)
            whole = len(flat) // size * size
            for first in range(0, whole, size):
                self._put(flat[first : first + size])
            self.ids, self.held = [flat[whole:].copy()], len(flat) - whole

    def _put(self, ids: np.ndarray) -> None:
        size = -(-len(ids) // self.sequence) * self.sequence
        mask = np.zeros(size, np.uint8)
        mask[: len(ids)] = 1
        padded = np.zeros(size, self.dtype)
        padded[: len(ids)] = ids
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (padded, mask)]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.ids))
        self.writer.close()


@dataclass(frozen=True)
class TokenFiles:
    """A folder of stream files; ``manifest`` has (shard, path, n_tokens, n_docs, first) of each, in order of doc_id.

    Beside each file, ``.docs`` behind its name, stands a stream of (doc_id, end): where each document ends in the file.
    """

    manifest: DataFrame
    sequence: int
    doc_kind: str = "bigint"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, sequence: int = SEQUENCE) -> TokenFiles:
    """The ids of every row of (doc_id, text), each followed by ``end_id``, in ascending doc_id order, as files at ``path``.

    Rows are range-partitioned by doc_id (null first; ties by the text's hash, then as they lie in the input) into shards
    of ``SHARD_TEXT`` bytes on average, so neither null ids nor copies of one row make a large shard. A shard is written
    as one file under a temporary name and renamed: a task that runs again replaces its own file by the same bytes. Null
    and empty texts are the end id alone. No rows make no files. Other columns are ignored. A vocabulary of 65,536 ids or
    fewer is stored in 16 bits. Texts are shuffled as zstd frames.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(total // SHARD_TEXT) + 1, spark.sparkContext.defaultParallelism)
    order = [F.col("doc_id").asc_nulls_first(), F.col("th"), F.col("row")]
    rows = packed_text(docs.select("doc_id", "text", row_key().alias("th"), F.monotonically_increasing_id().alias("row")))
    shards = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        fs, folder = _open(path)
        name, temporary = f"{folder}/shard-{shard:06d}.arrows", f"{folder}/_{shard:06d}-{task.taskAttemptId()}"
        coder = tokenizer_of(vocabulary)
        n_docs = at = 0
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(temporary) as sink, fs.open_output_stream(f"{temporary}.docs") as doc_sink:
            writer, places = ShardWriter(sink, sequence, coder.dtype), None
            for batch in _unpacked(batches):
                schema = pa.schema([("doc_id", batch.schema.field(0).type), ("end", pa.int64())])
                places = places or pa.ipc.new_stream(doc_sink, schema)
                ids, bounds = coder.encode(batch.column(1))
                writer.add(np.insert(ids, bounds[1:], end_id))
                ends = at + bounds[1:] + np.arange(1, len(bounds))
                places.write_batch(pa.record_batch([batch.column(0), pa.array(ends, pa.int64())], schema=schema))
                n_docs, at = n_docs + batch.num_rows, int(ends[-1])
            writer.close()
            if places:
                places.close()
        if not n_docs:
            fs.delete_file(temporary)
            fs.delete_file(f"{temporary}.docs")
            return
        fs.move(f"{temporary}.docs", f"{name}.docs")
        fs.move(temporary, name)
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([f"{path}/shard-{shard:06d}.arrows"]), pa.array([writer.n_tokens], pa.int64()), pa.array([n_docs], pa.int64())], ["shard", "path", "n_tokens", "n_docs"])

    made = written(shards.mapInArrow(run, "shard int, path string, n_tokens long, n_docs long"), "token-files")
    # One row a file: sums before each file within a thousand files, and of the thousands before.
    made = made.withColumn("block", (F.col("shard") / 1000).cast("int"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = made.groupBy("block").agg(F.sum("n_tokens").alias("n")).select(F.col("block").alias("_block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return TokenFiles(made.join(blocks, F.col("block") == F.col("_block")).select("shard", "path", "n_tokens", "n_docs", first.alias("first")), sequence, kind_of(docs))


def _unpacked(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) of rows with packed texts, in batches of about ``limit`` bytes of text."""
    for batch in batches:
        ids, texts, size, first = batch.column(0), [], 0, 0
        for k, text in enumerate(unpacked_texts(batch.column(1))):
            texts.append(text)
            size += len(text or b"")
            if size >= limit or k == batch.num_rows - 1:
                yield pa.record_batch([ids.slice(first, len(texts)), pa.array(texts, pa.binary())], ["doc_id", "text"])
                texts, size, first = [], 0, k + 1


def _source(path: str):
    fs, name = _open(path)
    return pa.memory_map(name) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(name)


def open_shard(path: str) -> Iterator[pa.RecordBatch]:
    """The batches of one file, without a copy where it is on a local disk (mapped) and as they come elsewhere."""
    with _source(path) as source, pa.ipc.open_stream(source) as reader:
        yield from reader


class TokenFile:
    """Random access to the sequences of one file: all batches but the last are equally long, so a place is computed.

    Opening reads the schema and the first batch's head. A sequence is a view of the mapped file where the file is local.
    """

    def __init__(self, path: str):
        self.source = _source(path)
        reader = pa.ipc.open_stream(self.source)
        self.schema, self.first = reader.schema, self.source.tell()
        self.sequence = self.schema.field("input_ids").type.list_size
        one = pa.ipc.read_message(self.source) if self.first < self.source.size() else None
        self.step = self.source.tell() - self.first

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence ``k``; IndexError beyond the last."""
        at = self.first + k // BATCH * self.step
        if k < 0 or at >= self.source.size():
            raise IndexError(k)
        self.source.seek(at)
        message = pa.ipc.read_message(self.source)
        if message is None or message.type != "record batch":
            raise IndexError(k)
        batch = pa.ipc.read_record_batch(message, self.schema)
        if k % BATCH >= batch.num_rows:
            raise IndexError(k)
        ids, mask = (_flat(batch.column(c).slice(k % BATCH, 1)) for c in (0, 1))
        return ids, mask


def sequence_at(path: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``k`` of a file and its mask, without reading any other batch."""
    return TokenFile(path)[k]


def _flat(column: pa.FixedSizeListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=True)


def read_documents(files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, from their ids and masks and the places of ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts, at = open_shard(path), 0  # ids of the file before ``held``
                held = np.zeros(0, np.uint32)
                for places in open_shard(f"{path}.docs"):
                    ends = places.column(1).to_numpy()
                    chunks = [held]
                    have = at + len(held)
                    while have < ends[-1]:
                        part = next(parts)
                        ids, mask = _flat(part.column(0)), _flat(part.column(1))
                        chunks.append((ids if mask[-1] else ids[mask > 0]).astype("<u4"))
                        have += len(chunks[-1])
                    held = np.concatenate(chunks)
                    starts = np.append(at, ends[:-1])
                    crc = [zlib.crc32(held[a - at : b - at]) for a, b in zip(starts.tolist(), ends.tolist())]
                    held, at = held[ends[-1] - at :], int(ends[-1])
                    yield pa.record_batch([places.column(0), pa.array(first + starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = files.manifest.select("path", "first")
    n = max(1, min(files.manifest.count(), 10 * files.manifest.sparkSession.sparkContext.defaultParallelism))
    return listed.repartition(n).mapInArrow(run, f"doc_id {files.doc_kind}, start long, n_tokens long, ids_crc32 long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files; nulls and ties as in ``write_tokens``."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return read_documents(write_tokens(read_table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), path))
