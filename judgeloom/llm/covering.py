"""Covering locality-sensitive hashing: masks that hide any few bits, and what meets under them on several fingerprints.

One radius that is sure to reach a Jaccard similarity of 0.8 takes too many masks: of 64 bits of a fingerprint some ten
differ there, up to twenty in the tail. So the masks of a smaller radius are laid over many draws of bits, and a pair need
be within that radius in one draw.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

BITS = 64
SEED = 42
#: Fingerprints of a set, each of ``BITS`` bits and a seed of its own.
PRINTS = 16
#: Draws of bits from all fingerprints of a set: ``SHARED`` that all masks keep, ``COVERED`` that the masks lie over.
DRAWS, SHARED, COVERED = 48, 4, 48
#: Draws of sets of up to ``TINY`` hashes: four in five differ in more bits (0.19) than larger sets of that similarity (0.15 at most), by ties.
TINY, TINY_DRAWS = 5, 192
#: Two draws that differ in so many of the covered bits meet for certain, and others by chance.
RADIUS = 6
#: Sets that met stay together where they differ in so many bits, of a draw and a fingerprint, at most. At a similarity of
#: 0.8 those that meet differ in 15, with a deviation of 3.4 and anew in each draw; those that met by chance in some 45.
APART = 20
#: More sets than these under one key are one cluster without a look at each pair.
SMALL = 64
#: Pairs that are looked at together.
PAIRS = 1 << 20
#: Sets of a task, as long as the shared bits suffice to part them.
EACH = 1 << 14

_TABLES = "task int, word long, mark long, node long, grp long"
_MET = "t int, key long, node long, grp long, near long, n long"


def covering_masks(radius: int, bits: int = BITS, codes: np.ndarray | None = None) -> list[int]:
    """2**(radius+1) - 1 masks of which at least one hides any given ``radius`` bits.

    Bit i has a non-zero code m(i) of radius+1 bits, and mask v keeps the bits with an odd parity of m(i) & v. Any
    ``radius`` codes are orthogonal to some non-zero v, and that mask hides all of them: two words that differ in
    ``radius`` bits or fewer agree under it. That is certain, not just likely, and whatever the codes are.
    """
    n = (1 << (radius + 1)) - 1
    codes = 1 + np.arange(bits) % n if codes is None else codes
    odd = np.bitwise_count(np.arange(1, n + 1)[:, None] & codes) % 2 == 1
    return [sum(1 << i for i in np.flatnonzero(row).tolist()) for row in odd]


@cache
def draw_masks() -> np.ndarray:
    """The masks of a draw: the shared bits come first and are in each. Of 100 lists of codes, that whose masks keep most bits at least."""
    lists = np.random.default_rng(SEED).integers(1, 1 << (RADIUS + 1), (100, COVERED))
    kept = np.bitwise_count(np.arange(1, 1 << (RADIUS + 1))[:, None] & lists[:, None, :]) % 2
    codes = lists[kept.sum(2, dtype=np.int64).min(1).argmax()]
    return np.array([m << SHARED | (1 << SHARED) - 1 for m in covering_masks(RADIUS, COVERED, codes)], np.uint64)


@cache
def drawn_bits() -> np.ndarray:
    """(TINY_DRAWS, BITS): places of bits in the fingerprints of a set; those beyond ``SHARED`` + ``COVERED`` are not drawn (-1)."""
    rng = np.random.default_rng(SEED)
    out = np.full((TINY_DRAWS, BITS), -1)
    for draw in out:
        draw[: SHARED + COVERED] = rng.choice(PRINTS * BITS, SHARED + COVERED, replace=False)
    return out


def set_prints(grams: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """SimHash fingerprints of sets of 64-bit hashes, ``PRINTS`` of each: a bit is set if it is in over half of the set's seeded hashes."""
    rng = np.random.default_rng(SEED)
    factors, shifts = rng.integers(0, 1 << 63, (2, PRINTS), np.int64).astype(np.uint64)
    factors, out = 2 * factors + np.uint64(1), []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        total = np.zeros(PRINTS * BITS, np.int64)
        for i in range(a, b, 255):  # sums that fit a byte
            h = mix(grams[i : min(i + 255, b), None] * factors + shifts)
            total += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
        out.append(np.packbits(2 * total > b - a, bitorder="little").tobytes() if b > a else None)
    return out


def _tables(splits: int, draws: int | None):
    """Rows (node, prints, tiny, grp) to a row for each draw: the task, the draw's bits, and a fingerprint to tell chance from likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = drawn_bits()[:draws]
        for batch in batches:
            n, node, grp = batch.num_rows, batch.column(0).to_numpy(), batch.column(3).to_numpy()
            tiny = batch.column(2).to_numpy(zero_copy_only=False)
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, PRINTS * BITS // 8)
            plain = np.concatenate([np.unpackbits(prints, axis=1, bitorder="little"), np.zeros((n, 1), np.uint8)], 1)
            for t, draw in enumerate(bits):
                of = slice(None) if t < DRAWS else np.flatnonzero(tiny)
                word = np.ascontiguousarray(np.packbits(plain[of][:, draw], axis=1, bitorder="little")).view("<u8").ravel()
                mark = np.ascontiguousarray(prints.view("<i8")[of, t % PRINTS])
                task = (t * (1 << SHARED) + (word & np.uint64(splits - 1)).astype(np.int64)).astype(np.int32)
                yield pa.record_batch([pa.array(task), pa.array(word.view(np.int64)), pa.array(mark), pa.array(node[of]), pa.array(grp[of])], ["task", "word", "mark", "node", "grp"])

    return run


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least labels of what is connected, once i and j are."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(label, up := label[label]):
            label = up


def clusters(word: np.ndarray, mark: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A label and a neighbour for every row.

    Labels are equal for rows that agree under a mask and are no more than ``APART`` bits apart, and whom those connect.
    The neighbour is the nearest that was seen, the row itself where there was none. Of a key with more than ``SMALL``
    rows all are connected, and seen in a line only.
    """
    n = len(word)
    label, place, best = np.arange(n), np.arange(n, dtype=np.uint64), np.full(n, 1 << 50) + np.arange(n)
    upper = np.uint64(0xFFFFFFFF00000000)

    def seen(i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        apart = np.bitwise_count(word[i] ^ word[j]).astype(np.int64) + np.bitwise_count(mark[i] ^ mark[j])
        i, j, apart = (x[apart <= most] for x in (i, j, apart))
        if not len(i):
            return label
        np.minimum.at(best, i, apart << 40 | j)
        np.minimum.at(best, j, apart << 40 | i)
        return _merge(label, i, j)

    for m in masks if n > 1 else []:
        keyed = ((word & m) * np.uint64(0x9E3779B97F4A7C15) & upper) | place
        keyed.sort()
        at = np.flatnonzero((keyed[1:] ^ keyed[:-1]) < 1 << 32)
        if not len(at):
            continue
        row = (keyed & ~upper).astype(np.int64)
        length = np.diff(np.flatnonzero(np.diff(at, append=n + 1) > 1), prepend=-1)
        long = np.repeat(length >= SMALL, length)
        if long.any():
            label = seen(row[at[long]], row[at[long] + 1], 2 * BITS)
        # Each row of a shorter run with all after it; ``at`` has a row's place once for its run's next row.
        rest = (np.cumsum(length).repeat(length) - np.arange(len(at)))[~long]
        at, total = at[~long], np.cumsum(rest)
        for some in np.split(np.arange(len(at)), np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS))) if len(at) else []:
            count = rest[some]
            i = at[some].repeat(count)
            label = seen(row[i], row[i + 1 + np.arange(len(i)) - (np.cumsum(count) - count).repeat(count)], APART)
    return label, best & (1 << 40) - 1


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)] for batch in batches if batch.num_rows]
    if not parts:
        return
    columns = [np.concatenate(x) for x in zip(*parts)]
    del parts
    order = np.lexsort((columns[3], columns[0]))
    task, word, mark, node, grp = (x[order] for x in columns)
    del columns
    bounds = np.flatnonzero(np.diff(task, prepend=-1)).tolist()
    for a, b in zip(bounds, [*bounds[1:], len(task)]):
        label, near = clusters(word[a:b].view(np.uint64), mark[a:b].view(np.uint64), draw_masks())
        several = np.zeros(b - a, bool)  # by label: a member is of another group than the one whose number is the label
        several[label[grp[a:b] != grp[a:b][label]]] = True
        met = np.flatnonzero(several[label])
        size = np.bincount(label, minlength=b - a)[label[met]]
        out = [task[a:b][met], label[met], node[a:b][met], grp[a:b][met], node[a:b][near[met]], size]
        yield pa.record_batch([pa.array(x) for x in out], ["t", "key", "node", "grp", "near", "n"])


def meetings(prints: DataFrame, rows: int, draws: int | None = None) -> DataFrame:
    """(t, key, node, grp, near, n): the clusters (t, key) of nodes that meet under the covering masks of a draw, n nodes each.

    ``prints`` (node, prints, tiny, grp) has every node once, ``rows`` of them at most. Clusters within one group are left
    out. ``near`` is the node's nearest in the cluster. A task holds the nodes that agree in the shared bits of a draw, or in
    as many of these as keep it at ``EACH`` nodes; a node comes once for each draw at most, or for each of the first ``draws``.
    """
    splits = 1
    while splits < 1 << SHARED and rows > splits * EACH:
        splits *= 2
    n = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), (draws or DRAWS) * splits if splits > 1 else 1)
    return prints.mapInArrow(_tables(splits, draws), _TABLES).repartition(n, F.col("task")).mapInArrow(_meet, _MET)
