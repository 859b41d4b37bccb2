"""Benchmark decontamination with suffix arrays over shards of the training texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, kind_of, read_table, row_key, slices, text_offsets, written

WINDOW = 13
#: Bytes of benchmark text that a worker holds at once. A larger benchmark is searched block by block, a pass each.
BLOCK_BYTES = 8 << 20
#: Bytes of training text in a shard.
SHARD_BYTES = 4 << 20

_LOWER = bytes(x or 0x20 for x in ALNUM_WORDS.tolist())


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


class TestSuffixes:
    """The suffixes of a block of benchmark items, cut at ``window`` words, sorted; equal ones are one window.

    Word numbers begin at 1. An item of fewer words than ``window`` is one window as a whole. ``starts[w]`` and
    ``starts[w + 1]`` bound the places of window w in ``place``, and ``item_of`` names the item of a place.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.items: list[str] = []
        flat: list[int] = []
        firsts, ends, needs = [], [], []
        for item_id, text in items:
            w = [self.numbers.setdefault(x, len(self.numbers) + 1) for x in words_of(text)]
            if w:
                self.items.append(item_id)
                firsts.append(len(flat))
                flat += w
                ends.append(len(flat))
                needs.append(min(window, len(w)))
        self.first = np.array(firsts, np.int64)
        need_of = np.array(needs, np.int64)
        ids = np.array(flat + [0] * window, np.int64)
        item = np.repeat(np.arange(len(firsts)), np.array(ends, np.int64) - self.first)
        at = np.arange(len(flat))
        whole = at + need_of[item] <= np.array(ends, np.int64)[item]
        at, need = at[whole], need_of[item[whole]]
        words = np.where(np.arange(window) < need[:, None], ids[at[:, None] + np.arange(window)], 0)
        self.keys, first, which = np.unique(_keys(words), return_index=True, return_inverse=True)
        self.words, self.need = words[first], need[first]
        order = np.argsort(which, kind="stable")
        self.place, self.starts = at[order], np.searchsorted(which[order], np.arange(len(self.keys) + 1))
        self.item_of = item[self.place]
        self.window_at = np.full(len(flat) + 1, -1, np.int64)  # the window that begins at each place
        self.window_at[at] = which
        #: A match has as many words as this at least, so training suffixes that begin otherwise can be left out.
        self.lead = int(min(3, self.need.min())) if len(self.need) else 1
        self.leads = np.unique(self._lead(self.words)) if len(self.need) else np.zeros(0, np.int64)

    def _lead(self, words: np.ndarray) -> np.ndarray:
        code = np.zeros(len(words), np.int64)
        for k in range(self.lead):
            code = code * (len(self.numbers) + 1) + words[:, k]  # wraps at most alike on both sides
        return code

    def occurrences(self, window: int) -> np.ndarray:
        """The places of a window."""
        return self.place[self.starts[window] : self.starts[window + 1]]


def _keys(words: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like the rows."""
    return np.ascontiguousarray(words.astype(">u4")).view(f"S{4 * words.shape[1]}").ravel()


def search(test: TestSuffixes, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows of ``test`` occur in a shard: (text, first word, window), sorted by text and place.

    The shard's suffix array holds the suffixes that begin like some test suffix, cut at ``window`` words. Each distinct
    test window is found in it by binary search, as a range. A training suffix lies in one range for each length of a
    window at most, so there are never more results than words times lengths, however often either side repeats.
    """
    get = test.numbers.get
    flat: list[int] = []
    bounds = [0]
    for w in texts:
        flat += [get(x, 0) for x in w]
        flat.append(0)
        bounds.append(len(flat))
    window, n = test.window, len(flat)
    ids = np.array(flat + [0] * window, np.int32)
    lead, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(test.lead):
        lead = lead * (len(test.numbers) + 1) + ids[k : n + k]
        known &= ids[k : n + k] > 0
    start = np.flatnonzero(known)
    start = start[np.isin(lead[start], test.leads)]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    suffix = ids[start[:, None] + np.arange(window)]
    suffix *= np.cumprod(suffix > 0, axis=1, dtype=np.int32)  # ends with the text, and at words that no item has
    keys = _keys(suffix)
    order = np.argsort(keys, kind="stable")
    start, keys = start[order], keys[order]
    # All training suffixes that begin with the words wanted stand between those words and their last continuation.
    top = test.words.copy()
    short = np.flatnonzero(test.need < window)
    top[short, test.need[short]] = 0xFFFFFFFF
    low, high = np.searchsorted(keys, test.keys, "left"), np.searchsorted(keys, _keys(top), "right")
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    at = start[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    order = np.lexsort((which, at))
    at, which = at[order], which[order]
    text = np.searchsorted(bounds, at, "right") - 1
    return text, at - np.array(bounds)[text], which


def longest_matches(test: TestSuffixes, first: list[int], window: list[int]) -> list[dict]:
    """The longest verbatim matches of one text, from where its windows occur: first, last, item_id, item_first.

    A match goes on from one place to the next as long as some place of an item goes on with it, and ends where none
    does; the next begins there. Of several places the first is named.
    """
    at: dict[int, list[int]] = {}
    for i, w in zip(first, window):
        at.setdefault(i, []).append(w)
    out, covered = [], -1
    for begin in sorted(at):
        for w in at[begin]:
            need = int(test.need[w])
            if need == test.window and begin <= covered:
                continue  # inside a match that goes on
            alive, end = test.occurrences(w), begin
            if need == test.window:
                while True:
                    on = [x for x in at.get(end + 1, ()) if test.need[x] == need]
                    further = alive[test.window_at[alive + 1] == on[0]] if on else alive[:0]
                    if not len(further):
                        break
                    alive, end = further + 1, end + 1
                covered = end
            place = int(alive[0]) - (end - begin)
            item = int(np.searchsorted(test.first, place, "right")) - 1
            out.append({"first": begin, "last": end + need, "item_id": test.items[item], "item_first": place - int(test.first[item])})
    return out


class _Index:
    """The block that this worker searched last: later tasks find its index ready."""

    token = None
    test: TestSuffixes


def _test_of(held, window: int) -> TestSuffixes:
    token, items = held.value
    if _Index.token != (token, window):
        _Index.test, _Index.token = TestSuffixes(items, window), (token, window)
    return _Index.test


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in slices(batches, "text", limit):
        offsets = text_offsets(batch.column(batch.schema.get_field_index("text")))
        more = int(offsets[-1] - offsets[0])
        if held and size + more > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _hits(test: TestSuffixes, column: pa.Array) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]], tuple]:
    """For each text its words, the merged spans of words hit, and its items; last what ``search`` found."""
    texts = [words_of(t) for t in column.to_pylist()]
    found = text, first, window = search(test, texts)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if len(text):
        last = first + test.need[window]
        reach = np.maximum.accumulate(last + text * (1 << 40)) - text * (1 << 40)  # of all that begin before, in the same text
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (first[1:] > reach[:-1])
        begins = np.flatnonzero(new)
        for t, a, b in zip(text[begins].tolist(), first[begins].tolist(), reach[np.append(begins[1:], len(text)) - 1].tolist()):
            spans[t].append((a, b))
        pair = np.unique(text * len(test.keys) + window)
        t, w = pair // len(test.keys), pair % len(test.keys)
        n = test.starts[w + 1] - test.starts[w]
        at = np.repeat(test.starts[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair = np.unique(np.repeat(t, n) * len(test.items) + test.item_of[at])
        for k, i in zip((pair // len(test.items)).tolist(), (pair % len(test.items)).tolist()):
            items[k].append(test.items[i])
    return [len(w) for w in texts], spans, items, found


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark's distinct items in parts of about ``block_bytes`` of text at most; an item that is larger is a part of its own."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").filter(F.length("text") > 0)
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    return [named] if n == 1 else [named.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _held(part: DataFrame):
    """One block of the benchmark as a broadcast; the block's bytes were counted."""
    return part.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sorted((r.item_id, r.text) for r in part.distinct().collect())))


_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_MATCH = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("item_id", pa.string()), ("item_first", pa.int64())]))
_FOUND = "n_words long, spans array<struct<first: long, last: long>>, items array<string>, matches array<struct<first: long, last: long, item_id: string, item_first: long>>"


def _searched(docs: DataFrame, part: DataFrame, window: int, with_matches: bool) -> DataFrame:
    """``docs`` (doc_id, th, text) without the text but with what one block of the benchmark finds in it."""
    held = _held(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = _test_of(held, window)
        for batch in _shards(batches, SHARD_BYTES):
            n_words, spans, items, (text, first, which) = _hits(test, batch.column(2))
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)) if with_matches else []
            matches = [longest_matches(test, first[a:b].tolist(), which[a:b].tolist()) for a, b in zip(cuts, cuts[1:])] if with_matches else [[]] * batch.num_rows
            spans = [[{"first": a, "last": b} for a, b in s] for s in spans]
            columns = [pa.array(n_words, pa.int64()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string())), pa.array(matches, _MATCH)]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], ["doc_id", "th", "n_words", "spans", "items", "matches"])

    return docs.mapInArrow(run, f"doc_id {kind_of(docs)}, th long, {_FOUND}")


def _covered(spans: str) -> Column:
    """Words that the sorted spans cover."""
    return F.expr(f"aggregate({spans}, struct(0L as n, 0L as reach), (x, s) -> struct(x.n + greatest(0L, s.last - greatest(x.reach, s.first)) as n, greatest(x.reach, s.last) as reach), x -> x.n)")


def _found(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, with_matches: bool) -> DataFrame:
    """(doc_id, th, n_words, spans, items, matches) of every row of ``docs``.

    A benchmark of one block is searched in one pass that shuffles nothing. A larger one takes a pass for each block, so
    no worker ever holds more than one; only rows with hits are written, and joined to the rows at the end.
    """
    rows = docs.select("doc_id", row_key().alias("th"), "text")
    first, *more = _blocks(benchmark, block_bytes)
    out = _searched(rows, first, window, with_matches)
    if not more:
        return out
    kept = ["spans", "items", "matches"]
    parts = [written(_searched(rows, part, window, with_matches).filter("size(spans) > 0").dropDuplicates(["doc_id", "th"]), "hits") for part in (first, *more)]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.union(part)
    hits = hits.groupBy("doc_id", "th").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in kept))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), *kept)
    empty = _searched(rows, benchmark.limit(0), window, False).select("doc_id", "th", "n_words")
    joined = empty.join(hits, empty["doc_id"].eqNullSafe(hits["_id"]) & (empty["th"] == hits["_th"]), "left")
    none = lambda c: F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c)
    return joined.select("doc_id", "th", "n_words", F.array_sort(none("spans")).alias("spans"), none("items"), none("matches"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, matches) of every row of ``docs``; a match has first, last, item_id and item_first.

    Matches are the longest verbatim ones, a window long at least, or a whole item that is shorter. Places count words,
    [first, last). Rows with a null item_id go under the name "null"; null, empty and wordless items have no windows;
    without any item every text is clean.
    """
    found = _found(docs, benchmark, window, block_bytes, True)
    return found.select("doc_id", "n_words", _covered("spans").alias("n_hit"), "matches")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    A row is contaminated if any word is hit and 20 times the words hit are as many as its words at least. Null, empty
    and wordless texts are clean, with the digest of the empty text. Repeated rows come back repeated, and so do rows with
    a null doc_id. No rows give no rows; without any item every text is clean. Other columns of either table are ignored.
    """
    items = F.array_sort(F.array_distinct(F.col("items")))
    found = _found(docs, benchmark, window, block_bytes, False).select("doc_id", "n_words", _covered("spans").alias("n_hit"), items.alias("items"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are, whatever their names.

    Null, empty and wordless texts stay, and so do rows with a null doc_id and repeated rows, as far as they are clean.
    No rows give no rows; without any item all rows stay.
    """
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) > 1:
        hit = _found(docs, benchmark, window, block_bytes, False)
        hit = hit.withColumn("n_hit", _covered("spans")).filter((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(F.col("doc_id").alias("_jl_id"), F.col("th").alias("_jl_th")).distinct()
        rows = docs.withColumn("_jl_row", row_key())
        return rows.join(hit, rows["doc_id"].eqNullSafe(hit["_jl_id"]) & (rows["_jl_row"] == hit["_jl_th"]), "left_anti").drop("_jl_row")
    held = _held(blocks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = _test_of(held, window)
        for batch in _shards(batches, SHARD_BYTES):
            n_words, spans, _, _ = _hits(test, batch.column(batch.schema.get_field_index("text")))
            n_hit = [sum(b - a for a, b in s) for s in spans]
            yield batch.filter(pa.array([not (h > 0 and 20 * h >= n) for h, n in zip(n_hit, n_words)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all of ``documents`` against all of ``benchmark``; nulls, repeated rows and empty tables as in ``report``."""
    return report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
