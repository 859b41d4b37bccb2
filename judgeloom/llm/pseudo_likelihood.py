"""Masked pseudo-likelihood: every word of a document predicted from the words on both sides of it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, hash_words, kind_of, mix, read_table, slices, summed, worker_threads, written

#: Classes that the network tells apart: the commonest words one each, all others by how they end.
SINGLE, SPELLED = 48, 48
CLASSES = SINGLE + SPELLED
#: Words around that have an embedding of their own; all others share as many by how they end. One stands for a text's edge.
KNOWN, SHARED = 2048, 256
EDGE = KNOWN + SHARED
DIM = 16
#: Words on each side.
SIDE = 2
#: Words whose counts every worker holds, at most: the commonest. The counts of all others stay in a table and are joined.
TABLE = 1 << 17
#: Rounds of training. Each word of the corpus is an example in one of them, by a hash of its text up to it.
ROUNDS = 2
RATE = 0.1
STEP = 8192
_OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]


@dataclass(frozen=True)
class WindowNetwork:
    """P(word | window) = P(class | h) n(word) / n(class), where h = tanh of the weighted sum of the window's embeddings.

    n counts all of the corpus, so every word that it holds has a probability of its own, however rare it is.
    """

    hashes: np.ndarray  # sorted hashes of the commonest words
    rank: np.ndarray  # their places in order of commonness
    log_n: np.ndarray  # the logarithms of their counts
    embed: np.ndarray  # (EDGE + 1, DIM)
    place: np.ndarray  # (2 * SIDE, DIM)
    top: np.ndarray  # (CLASSES, DIM)
    bias: np.ndarray  # (CLASSES,)
    log_class: np.ndarray  # logarithms of n(class)

    def read(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """For the words of a column of texts: hashes, bounds of the texts, classes, log counts (nan: not held) and windows."""
        h, bounds, tail = hash_words(column, ALNUM_WORDS, tails=True)
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        held = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        rank = np.where(held, self.rank[at], TABLE) if len(self.hashes) else np.full(len(h), TABLE)
        log_n = np.where(held, self.log_n[at], np.nan) if len(self.hashes) else np.full(len(h), np.nan)
        end = mix(tail + np.uint64(1))
        cls = np.where(rank < SINGLE, rank, SINGLE + (end % np.uint64(SPELLED)).astype(np.int64))
        ids = np.where(rank < KNOWN, rank, KNOWN + (end % np.uint64(SHARED)).astype(np.int64))
        return h, bounds, cls, log_n, windows(ids, bounds)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        s = self.embed[context[:, 0]] * self.place[0]
        for k in range(1, context.shape[1]):
            s += self.embed[context[:, k]] * self.place[k]
        return np.tanh(s)

    def class_logs(self, cls: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log P(class | window) of each word."""
        out = np.empty(len(cls))
        for a in range(0, len(cls), STEP):
            z = self.hidden(context[a : a + STEP]) @ self.top.T + self.bias
            z -= z.max(1, keepdims=True)
            picked = z[np.arange(len(z)), cls[a : a + STEP]]
            out[a : a + STEP] = picked - np.log(np.exp(z, out=z).sum(1))
        return out

    def gradient(self, cls: np.ndarray, context: np.ndarray, into: "Sums") -> None:
        """Adds the gradients of -log P(class | window) over the words, and a diagonal of their curvature, to ``into``."""
        for a in range(0, len(cls), STEP):
            x, y = context[a : a + STEP], cls[a : a + STEP]
            n = len(y)
            h = self.hidden(x)
            z = h @ self.top.T + self.bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            total = p.sum(1, keepdims=True)
            into.loss += float((np.log(total[:, 0]) - z[np.arange(n), y]).sum())
            p /= total
            wide = np.concatenate([h, np.ones((n, 1), h.dtype)], axis=1)
            into.spread += wide.T @ wide
            p[np.arange(n), y] -= 1
            into.top += p.T @ wide
            back = (p @ self.top) * (1 - h * h)
            into.back_curve += (back * back).sum(0)
            into.n += n
            columns = np.ascontiguousarray(back.T)
            for k in range(x.shape[1]):
                at = x[:, k]
                into.place[k] += (back * self.embed[at]).sum(0)
                into.place_curve[k] += ((back * self.embed[at]) ** 2).sum(0)
                for d in range(DIM):
                    into.embed[k, :, d] += np.bincount(at, columns[d], EDGE + 1)
                into.seen[k] += np.bincount(at, minlength=EDGE + 1)

    def moved(self, g: "Sums", rate: float) -> "WindowNetwork":
        """The network after one step on the sums ``g``.

        The weights of the classes go to the minimum of a quadratic bound of their loss, which half the spread of the hidden
        values bends: that step never overshoots. Embeddings and places move by ``rate`` of a damped diagonal Newton step.
        """
        if not g.n:
            return self
        old = np.concatenate([self.top, self.bias[:, None]], axis=1)
        new = old - 2 * np.linalg.solve(g.spread + 1e-4 * g.n * np.eye(DIM + 1), g.top.T).T
        curve = g.back_curve / g.n
        embed_g = (g.embed * self.place[:, None, :]).sum(0)
        embed_c = (g.seen[:, :, None] * (self.place**2 * curve)[:, None, :]).sum(0)
        f32 = lambda x: x.astype(np.float32)
        return replace(
            self, top=f32(new[:, :DIM]), bias=f32(new[:, DIM]), embed=f32(self.embed - np.clip(rate * embed_g / (embed_c + 20 * curve + 1e-9), -0.05, 0.05)),
            place=f32(self.place - np.clip(rate * g.place / (g.place_curve + 1e-9 + 1e-3 * g.n), -0.05, 0.05)),
        )


class Sums:
    """Sums over words, kept in double precision: the same, but for rounding, however the words are dealt."""

    PARTS = {"n": (), "loss": (), "top": (CLASSES, DIM + 1), "embed": (2 * SIDE, EDGE + 1, DIM), "place": (2 * SIDE, DIM),
             "spread": (DIM + 1, DIM + 1), "back_curve": (DIM,), "place_curve": (2 * SIDE, DIM), "seen": (2 * SIDE, EDGE + 1)}

    def __init__(self, flat: np.ndarray | None = None):
        at = 0
        for name, shape in self.PARTS.items():
            size = int(np.prod(shape))
            part = np.zeros(shape) if flat is None else flat[at : at + size].reshape(shape)
            setattr(self, name, part if shape else float(part))
            at += size

    def flat(self) -> np.ndarray:
        return np.concatenate([np.ravel(getattr(self, p)) for p in self.PARTS])


@dataclass(frozen=True)
class PseudoLikelihood:
    """A network, and the table (word, n) of the counts of all words."""

    network: WindowNetwork
    counts: DataFrame


def windows(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(words, 2 * SIDE): the numbers around each word, the word itself left out; EDGE beyond a text's ends."""
    shift = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * SIDE + SIDE
    at = np.arange(len(ids)) + shift
    padded = np.full(len(ids) + SIDE * len(bounds), EDGE, np.int64)
    padded[at] = ids
    return np.stack([padded[at + k] for k in _OFFSETS], axis=1)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word's hash occurs in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=8 << 20):
            h, n = np.unique(hash_words(batch.column(0), ALNUM_WORDS)[0], return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, most: int = TABLE) -> list[tuple[int, int]]:
    """(word, n) of the words that occur often enough for ``most`` of them at most, commonest first.

    The bar is read off a histogram of counts on a logarithmic scale, so neither one task nor the driver sees more words.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 16)
    bars = sorted(((r.step, r.words) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    words, bar = 0, None
    for at, more in bars:
        if words + more > most:
            break
        words, bar = words + more, at
    rows = [] if bar is None else counts.filter(step >= bar).collect()
    return sorted(((r.word, r.n) for r in rows), key=lambda r: (-r[1], r[0]))


_PAIRS = (2 * SIDE, EDGE + 1, CLASSES)


def start(docs: DataFrame) -> PseudoLikelihood:
    """A network whose weights come from counts of all words: how often each class stands at each place beside each word.

    The embeddings are the leading singular vectors of those counts' log ratios.
    """
    counts = written(word_counts(docs), "word-counts")
    common = commonest(counts)
    hashes = np.array([w for w, _ in common], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    flat32 = lambda *shape: np.zeros(shape, np.float32)
    empty = WindowNetwork(hashes[order], np.arange(len(common))[order], np.log(np.array([n for _, n in common], np.float64))[order], flat32(EDGE + 1, DIM), flat32(2 * SIDE, DIM), flat32(CLASSES, DIM), flat32(CLASSES), np.zeros(CLASSES))
    held = docs.sparkSession.sparkContext.broadcast(empty)  # TABLE words at most

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in slices(batches):
            _, _, cls, _, context = held.value.read(batch.column(0))
            if len(cls):
                total = np.zeros(_PAIRS, np.int64) if total is None else total
                for k in range(2 * SIDE):
                    total[k] += np.bincount(context[:, k] * CLASSES + cls, minlength=(EDGE + 1) * CLASSES).reshape(_PAIRS[1:])
        return None if total is None else total.ravel()

    pairs = summed(docs.select("text"), count)
    return PseudoLikelihood(empty if pairs is None else _drawn(empty, pairs.reshape(_PAIRS)), counts)


def _drawn(empty: WindowNetwork, pairs: np.ndarray) -> WindowNetwork:
    n_class = pairs[0].sum(0)
    share = (n_class + 0.5) / (n_class + 0.5).sum()
    seen = pairs.sum(2, keepdims=True)
    ratio = np.log((pairs + 50 * share) / (seen + 50) / share)  # 0 for words never seen there
    weight = np.sqrt(pairs.sum((0, 2)) + 1)
    mean = (ratio * seen).sum(0) / np.maximum(seen.sum(0), 1)
    u, s, v = np.linalg.svd(mean * weight[:, None], full_matrices=False)
    u, s, v = u[:, :DIM], np.maximum(s[:DIM], 1e-9), v[:DIM]
    place = np.stack([np.einsum("xd,xc,dc->d", u, r * weight[:, None], v) / s for r in ratio])
    embed = u * s / weight[:, None]
    scale = 0.25 / np.maximum(np.abs(embed).max(0), 1e-9)
    f32 = lambda x: np.asarray(x, np.float32)
    # Neighbours tell much the same, so each counts for half.
    return replace(empty, embed=f32(embed * scale), place=f32(place), top=f32(0.5 * v.T / scale), bias=f32(np.log(share)), log_class=np.log(np.maximum(n_class, 1)))


def _round(docs: DataFrame, network: WindowNetwork, k: int, rounds: int, rate: float) -> WindowNetwork:
    """The network after a step on the sum of the gradients of every word whose turn round ``k`` is."""
    held = docs.sparkSession.sparkContext.broadcast(network)

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        g = Sums()
        for batch in slices(batches):
            h, bounds, cls, _, context = held.value.read(batch.column(0))
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
            prefix = upto[1:] - np.repeat(upto[bounds[:-1]], np.diff(bounds))
            turn = np.flatnonzero(mix(prefix) % np.uint64(rounds) == k)
            held.value.gradient(cls[turn], context[turn], g)
        return g.flat() if g.n else None

    total = summed(docs.select("text"), add)
    return network if total is None else network.moved(Sums(total), rate)


def train(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> PseudoLikelihood:
    """A network trained on all words of all rows of (text); the same, but for rounding, however the rows are dealt.

    Its counts and its first weights come from all words, and each word gives its gradient in one of the rounds. Null and
    empty texts have no words; repeated rows count each. Without any word all scores are of no words too.
    """
    model = start(docs)
    network = model.network
    for k in range(rounds):
        network = _round(docs, network, k, rounds, rate)
    return replace(model, network=network)


_SCHEMA = "row long, n_tokens long, known double, rare array<long>"


def score(docs: DataFrame, model: PseudoLikelihood) -> DataFrame:
    """(doc_id, n_tokens, sum_logprob, mean_logprob) of every row of (doc_id, text).

    The sum adds log P(word | the SIDE words before and after it) over all words of the text. Null, empty and wordless
    texts have no tokens, the sum 0 and a null mean. A word that the corpus lacks counts as half a one. Repeated rows, and
    rows with a null doc_id, come back each and score alike; ties play no role. No rows give no rows. Other columns of
    ``docs`` are not looked at. The counts of rare words are joined to the rows that hold them.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.network)  # TABLE words and a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_threads()
        m = held.value
        for batch in slices(batches):
            h, bounds, cls, log_n, context = m.read(batch.column(2))
            rare = np.flatnonzero(np.isnan(log_n))
            logs = m.class_logs(cls, context) - m.log_class[cls] + np.nan_to_num(log_n)
            total = np.concatenate([[0.0], np.cumsum(logs)])
            words = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, bounds), pa.int32()), pa.array(h[rare].view(np.int64)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(bounds), pa.int64()), pa.array(total[bounds[1:]] - total[bounds[:-1]], pa.float64()), words], ["doc_id", "row", "n_tokens", "known", "rare"])

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    rows = written(rows.mapInArrow(run, f"doc_id {kind_of(docs)}, {_SCHEMA}"), "known-words")
    words = rows.filter("size(rare) > 0").select("row", F.explode("rare").alias("word"))
    counts = model.counts.select(F.col("word").alias("_word"), "n")
    found = words.join(counts, F.col("word") == F.col("_word"), "left").groupBy(F.col("row").alias("_row")).agg(F.sum(F.log(F.coalesce("n", F.lit(0.5)))).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0.0))
    out = rows.drop("rare").join(found, F.col("row") == F.col("_row"), "left")
    return out.select("doc_id", "n_tokens", total.alias("sum_logprob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_logprob"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, sum_logprob, mean_logprob) of every document under a network trained on all; nulls as in ``score``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs))
