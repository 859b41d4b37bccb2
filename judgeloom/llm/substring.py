"""Duplicate passages by relative Lempel-Ziv parsing against reference blocks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, hash_words, kind_of, mix, packed_text, read_table, row_key, slices, unpacked_texts, written

WINDOW = 35
#: Words of an anchor: the passage whose hash is least among those of a window names the reference block it goes to.
ANCHOR = 8
#: Beyond this many passages of one anchor, or 3 blocks of words, its windows are dealt out by their own content.
HOT = 2000
#: Words of a reference block; a block ends with the anchor in hand, so it holds 4 times as many at most.
BLOCK_WORDS = 200_000
#: Words of passages that a task receives, about; there are as many tasks as that takes.
TASK_WORDS = 16_000_000
#: Factors of the parse end after 2**(DEPTH + 1) - 1 words; the next begins where they end.
DEPTH = 6

_RUNS = "th long, anchor long, first int, windows int, n int"
_PARTS = "th long, first int, last int, words string"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out if span == width else np.minimum(out[: len(out) - (width - span)], out[width - span :])


def anchored_runs(h: np.ndarray, bounds: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one anchor: (text, first window, windows, anchor, 2 if the anchor occurs again in it).

    Equal windows have equal anchors, wherever they stand.
    """
    empty = np.zeros(0, np.int64)
    if len(h) < window:
        return empty, empty, empty, np.zeros(0, np.uint64), empty
    grams = np.zeros(len(h) - anchor + 1, np.uint64)
    for k in range(anchor):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - anchor + 1 + k]
    grams = mix(grams)
    wide = window - anchor + 1
    least = _least(grams, wide)  # of the window that starts at each word
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = np.arange(len(least)) + window <= bounds[text[: len(least)] + 1]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (least[1:] != least[:-1]) | (text[1 : len(least)] != text[: len(least) - 1])
    first = np.flatnonzero(new)
    if not len(first):
        return empty, empty, empty, np.zeros(0, np.uint64), empty
    ends = np.flatnonzero(whole & ~np.append(whole[1:] & ~new[1:], False)) + 1
    windows = ends - first
    value = least[first]
    seen = np.zeros(len(first), np.int64)
    short = np.flatnonzero(windows <= wide)
    seen[windows > wide] = 2
    for k in range(2 * wide - 1):
        short = short[windows[short] + wide - 1 > k]
        seen[short] += grams[first[short] + k] == value[short]
    return text[first], first - bounds[text[first]], windows, value, np.minimum(seen, 2)


def _find_runs(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, bounds = hash_words(batch.column(2), SPACE_WORDS)
            text, first, windows, value, n = anchored_runs(h, bounds, window, anchor)
            at = pa.array(text)
            columns = [batch.column(0).take(at), batch.column(1).take(at), value.view(np.int64), first.astype(np.int32), windows.astype(np.int32), n.astype(np.int32)]
            yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["doc_id", "th", "anchor", "first", "windows", "n"])

    return run


def _passages(window: int, most: int = 200_000):
    """Texts and their repeated runs to passages for the reference blocks, and spans that are settled already.

    A run of a hot anchor goes window by window under the hash of the window itself. Of the equal hot windows that one
    task meets, one goes on and stands for all; the others are settled, neighbours as one span. So a window reaches a block
    once a task at most, and a passage that many rows share makes a span or two a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, list] = {}  # hot window: where it was first met, and whether it is settled
        out: list[tuple] = []
        done: dict[tuple, list[tuple[int, int]]] = {}  # row: its settled spans, neighbours joined

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            out.extend((zlib.crc32(f"{row}{first}".encode()), *row, first, last, None) for row, spans in done.items() for first, last in spans)
            done.clear()
            columns = zip(*out) if out else [[]] * 6
            types = [pa.int64(), kind, pa.int64(), pa.int32(), pa.int32(), pa.string()]
            made = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["key", "doc_id", "th", "first", "last", "words"])
            out.clear()
            return made

        def settle(doc_id, th: int, first: int, last: int) -> None:
            spans = done.setdefault((doc_id, th), [])
            if spans and spans[-1][0] <= first <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], last))
            else:
                spans.append((first, last))

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            doc_ids, ths, all_runs = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for doc_id, th, text, runs in zip(doc_ids, ths, unpacked_texts(batch.column(2)), all_runs):
                w = text.split()
                for x in runs:
                    first, end = x["first"], x["first"] + x["windows"]
                    if not x["hot"]:
                        out.append((x["anchor"], doc_id, th, first, end + window - 1, b" ".join(w[first : end + window - 1]).decode()))
                        continue
                    for i in range(first, end):
                        words = b" ".join(w[i : i + window])
                        key = hashlib.blake2b(words, digest_size=16).digest()
                        place = (doc_id, th, i, i + window)
                        if key not in met:
                            met[key] = [place, False]
                            out.append((int.from_bytes(key[:8], "little", signed=True), *place, words.decode()))
                        else:
                            settle(*place)
                            if not met[key][1]:
                                met[key][1] = True
                                settle(*met[key][0])
                    if len(met) > most:
                        met.clear()
                if len(out) + len(done) > 5000:
                    yield flush(kind)
        if out or done:
            yield flush(kind)

    return run


class ReferenceBlock:
    """A suffix index over passages, and the greedy parse of each passage against all of them but itself.

    Suffix ranks come from prefix doubling over exact word numbers, so equal ranks are equal words. ``longest[i]`` is the
    length of the longest factor that starts at i and also starts elsewhere in the block (at most 2**(depth+1) - 1 words).
    """

    def __init__(self, passages: list[list[bytes]], depth: int = DEPTH):
        numbers: dict[bytes, int] = {}
        flat: list[int] = []
        self.starts = [0]
        for words in passages:
            flat.extend([numbers.setdefault(w, len(numbers)) for w in words])
            flat.append(-1)
            self.starts.append(len(flat))
        ids = np.array(flat, np.int64)
        stops = np.flatnonzero(ids < 0)
        ids[stops] = len(numbers) + np.arange(len(stops))  # each end is a word of its own: no factor crosses it
        n = len(ids)
        ranks = [ids]
        for k in range(depth):
            step = 1 << k
            after = np.zeros(n, np.int64)
            after[:-step] = ranks[-1][step:] + 1 if step < n else 0
            order = np.argsort(pair := ranks[-1] * (n + 2) + after)
            got = pair[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(got[1:] != got[:-1])])
            ranks.append(rank)
        a, b = order[:-1], order[1:]
        same = np.zeros(n - 1, np.int64)
        for k in range(depth, -1, -1):
            i, j = a + same, b + same
            fits = np.maximum(i, j) < n
            hit = fits & (ranks[k][np.where(fits, i, 0)] == ranks[k][np.where(fits, j, 0)])
            same += hit << k
        self.longest = np.zeros(n, np.int64)
        self.longest[a] = same
        self.longest[b] = np.maximum(self.longest[b], same)

    def duplicate_spans(self, window: int) -> list[list[tuple[int, int]]]:
        """For each passage the merged word spans that windows of ``window`` words found elsewhere cover."""
        n, longest = len(self.longest), self.longest
        jump = (np.arange(n) + np.maximum(longest, 1)).tolist()
        factors: list[int] = []
        for first, end in zip(self.starts, self.starts[1:]):
            i = first
            while i < end - 1:
                factors.append(i)
                i = jump[i]
        at = np.array(factors, np.int64)
        cover = np.zeros(n + 1, np.int64)
        long = at[longest[at] >= window]  # factors long enough are duplicates as they stand
        np.add.at(cover, long, 1)
        np.add.at(cover, long + longest[long], -1)
        # A window that no factor holds spans one factor's end, and begins in the factor before it: check those starts.
        near = np.zeros(n + 1, np.int64)
        np.add.at(near, np.maximum(at - window + 1, 0), 1)
        np.add.at(near, at, -1)
        across = np.flatnonzero((np.cumsum(near)[:n] > 0) & (longest >= window))
        np.add.at(cover, across, 1)
        np.add.at(cover, across + window, -1)
        covered = np.cumsum(cover)[:n] > 0
        edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
        begins, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        out: list[list[tuple[int, int]]] = [[] for _ in self.starts[1:]]
        for p, b, e in zip((np.searchsorted(self.starts, begins, "right") - 1).tolist(), begins.tolist(), ends.tolist()):
            out[p].append((b - self.starts[p], e - self.starts[p]))
        return out


def _parse_blocks(window: int, block_words: int):
    """Passages, sorted by key, to (doc_id, th, first, last): block after block of bounded size is indexed and parsed.

    A hot window's key can fill more than a block; the last passage of a block that ends within a key stays as a
    reference for the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, kind = 0, None

        def parse(rows: list[tuple]) -> pa.RecordBatch:
            found = [
                (doc_id, th, first + b, first + e)
                for (_, doc_id, th, first, _), spans in zip(rows, ReferenceBlock([r[4] for r in rows]).duplicate_spans(window))
                for b, e in spans
            ]
            return spans_batch(found)

        def spans_batch(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found) if found else [[]] * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [kind, pa.int64(), pa.int32(), pa.int32()])], ["doc_id", "th", "first", "last"])

        for batch in batches:
            settled, kind = [], batch.schema.field(1).type
            for key, doc_id, th, first, last, words in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if words is None:
                    settled.append((doc_id, th, first, last))
                    continue
                if size > block_words and held and (key != held[-1][0] or size > 4 * block_words):
                    yield parse(held)
                    held = held[-1:] if key == held[-1][0] else []
                    size = sum(len(r[4]) for r in held)
                held.append((key, doc_id, th, first, words.encode().split()))
                size += len(held[-1][4])
            if settled:
                yield spans_batch(settled)
        if held:
            yield parse(held)

    return run


def duplicate_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, th, spans): for each row with any, the sorted word spans [first, last) that repeated windows cover.

    ``th`` is ``row_key()`` of the text. Every window goes to the block of its anchor, with its neighbours of the same
    anchor as one passage, so equal windows always meet; only anchors that occur twice send passages at all.
    """
    if not 1 <= anchor <= window:
        raise ValueError("an anchor has 1 word at least and not more than a window")
    texts = docs.filter(F.length("text") > 0).select("doc_id", row_key().alias("th"), "text")
    runs = written(texts.mapInArrow(_find_runs(window, anchor), f"doc_id {kind_of(docs)}, {_RUNS}"), "runs")
    often = runs.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("passages"), F.sum(F.col("windows").cast("long") + (window - 1)).alias("size")).filter("total > 1")
    often = written(often.select("anchor", "size", ((F.col("passages") > hot) | (F.col("size") > 3 * block_words)).alias("hot")), "anchors")
    size = often.agg(F.sum("size")).first()[0] or 0
    wanted = runs.join(often.drop("size"), "anchor").groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "windows", "anchor", "hot")).alias("runs"))
    w = wanted.withColumnsRenamed({"doc_id": "_jl_id", "th": "_jl_th"})
    packed = packed_text(texts)
    sent = packed.join(w, packed.doc_id.eqNullSafe(w["_jl_id"]) & (packed.th == w["_jl_th"])).select("doc_id", "th", "text", "runs")
    passages = sent.mapInArrow(_passages(window), f"key long, doc_id {kind_of(docs)}, {_PARTS}")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // TASK_WORDS), 1)
    found = passages.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_parse_blocks(window, block_words), f"doc_id {kind_of(docs)}, th long, first int, last int")
    return found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))


def _with_spans(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, ``text`` packed, with ``_jl_spans``, null where nothing repeats."""
    spans = written(duplicate_spans(docs, **options), "spans").withColumnsRenamed({"doc_id": "_jl_id", "th": "_jl_th", "spans": "_jl_spans"})
    packed = packed_text(docs.withColumn("_jl_row", row_key()))
    return packed.join(spans, packed["doc_id"].eqNullSafe(spans["_jl_id"]) & (F.col("_jl_row") == spans["_jl_th"]), "left").drop("_jl_id", "_jl_th", "_jl_row")


def _kept(text: bytes | None, spans: list | None) -> tuple[int, int, bytes]:
    w = (text or b"").split()
    if not spans:
        return len(w), 0, b" ".join(w)
    kept, at = [], 0
    for s in spans:
        if s["last"] > at:
            kept += w[at : s["first"]]
            at = s["last"]
    kept += w[at:]
    return len(w), len(w) - len(kept), b" ".join(kept)


def removal(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row: what is left when every repeated window is cut out.

    Null, empty and blank texts have no words, and the digest of the empty text. A repeated row, null doc_id or not, is
    another document: what it repeats goes from all copies. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_kept(t, s) for t, s in zip(unpacked_texts(batch.column(1)), batch.column(2).to_pylist())]
            yield pa.record_batch(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    found = _with_spans(docs.select("doc_id", "text"), **options).select("doc_id", "text", "_jl_spans")
    return found.mapInArrow(run, f"doc_id {kind_of(docs)}, n_words long, n_removed long, kept_sha256 string")


def cut(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, their repeated windows cut out of ``text``.

    A text that loses words becomes its kept words with one space between; any other stays as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            spans = batch.column(batch.schema.get_field_index("_jl_spans")).to_pylist()
            texts = [_kept(t, s)[2].decode() if s else None if t is None else t.decode() for t, s in zip(unpacked_texts(batch.column(at)), spans)]
            names = [x for x in batch.schema.names if x != "_jl_spans"]
            yield pa.record_batch([pa.array(texts, pa.string()) if x == "text" else batch.column(batch.schema.get_field_index(x)) for x in names], names)

    return _with_spans(docs, **options).mapInArrow(run, docs.schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document; nulls, copies and repeated rows as in ``removal``."""
    return removal(read_table(spark, sf_dir, "documents"))
