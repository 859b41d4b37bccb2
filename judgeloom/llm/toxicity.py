"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, fold, hash_words, kind_of, read_table, row_key, sampled, slices, summed, worker_threads, written

#: The bounded sample of confirmed toxic rows that the classifiers are fitted on.
POSITIVES = 4000
#: The bounded sample of rows taken without their label that they start from; their risk is then taken over all rows.
UNLABELLED = 12000
#: Words of the samples that are counted over all rows, at most: those in the most sample rows.
CANDIDATES = 1 << 16
#: Steps along the gradient over all rows of which the one of least risk over all rows is kept.
STEPS = (0.0, 0.02, 0.1, 0.3)
#: A text that fills more than one row in so many counts as one row; there are at most as many such texts.
HOT = 10_000
#: Words that classifiers weigh, and the classifiers whose scores are averaged.
WORDS = 2048
CLASSIFIERS = 3


@dataclass(frozen=True)
class ToxicityModel:
    words: np.ndarray  # sorted hashes of the words weighed
    weights: np.ndarray  # (classifiers, words)
    bias: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        """Mean probability of the classifiers for each text, from which of the words occur in it."""
        text, word = occurrences(column, self.words)
        out = np.zeros(len(column))
        for w, b in zip(self.weights, self.bias):
            f = np.bincount(text, weights=w[word], minlength=len(column)) + b
            out += 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return out / max(1, len(self.bias))


def occurrences(column: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, number of a word that occurs in it), each once."""
    h, bounds = hash_words(column, ALNUM_WORDS)
    if not len(words) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    hit = np.flatnonzero(words[at] == h)
    text = np.searchsorted(bounds, hit, "right") - 1
    pair = np.unique(text * len(words) + at[hit])
    return pair // len(words), pair % len(words)


def step_of(p: np.ndarray, u: np.ndarray, w: np.ndarray, b: float, prior: float) -> np.ndarray:
    """The gradient, by the weights and last the bias, of the risk of ``nnpu``; of its second part taken negative where that is below zero."""
    narrow = w.astype(p.dtype)  # matrices keep their type: no copy for each product
    fp, fu = p @ narrow + b, u @ narrow + b
    sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    gp = (sp - 1) * prior / len(p)  # of the positives taken as positive
    gn, gu = -prior * sp / len(p), su / len(u)  # of the corrected negative part
    if negative < 0:
        gp, gn, gu = np.zeros_like(gp), -gn, -gu
    return np.append((gp + gn).astype(p.dtype) @ p + gu.astype(p.dtype) @ u, (gp + gn).sum() + gu.sum())


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, seed: int, rounds: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear classifier of least non-negative positive-unlabelled risk under the logistic loss.

    The risk is prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]): unlabelled rows count as negative, and what
    the positives among them add is taken off by the class prior. Where the second part falls below zero the classifier
    has begun to fit single rows, and the step goes against it.
    """
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 0.01, p.shape[1]), np.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        g = step_of(p, u, w, b, prior) + np.append(decay * w / 100, 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _sample_words(p: DataFrame, u: DataFrame) -> np.ndarray:
    """Sorted hashes of the words in three rows of the samples at least, ``CANDIDATES`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, bounds = hash_words(batch.column(0), ALNUM_WORDS)
            text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            words, n = np.unique(h[new], return_counts=True)
            yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    rows = p.select("text").union(u.select("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 3")
    return np.sort(np.array([r.word for r in rows.orderBy(F.desc("n"), "word").limit(CANDIDATES).collect()], np.int64).view(np.uint64))


def _features(rows: DataFrame, words: np.ndarray) -> np.ndarray:
    """A row of zeros and ones for each row of a bounded sample: which of the words occur in it."""
    held = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, word = occurrences(batch.column(0), held.value)
            sets = [x.astype("<u4").tobytes() for x in np.split(word, np.searchsorted(text, np.arange(1, batch.num_rows)))]
            yield pa.record_batch([pa.array(sets, pa.binary())], ["words"])

    got = sorted(r.words for r in rows.select("text").mapInArrow(run, "words binary").collect())
    out = np.zeros((len(got), len(words)), np.float32)
    for k, x in enumerate(got):
        out[k, np.frombuffer(x, "<u4")] = 1
    return out


def _weights(docs: DataFrame) -> dict[int, float]:
    """1 / copies of the texts that fill more than a ``HOT``-th of the rows."""
    counts = docs.select(row_key().alias("th")).groupBy("th").agg(F.count("*").alias("n"))
    bar = (docs.count() or 0) / HOT
    return {r.th: 1 / r.n for r in counts.filter((F.col("n") > 1) & (F.col("n") > bar)).collect()}


def _over_all(docs: DataFrame, light: dict[int, float], words: np.ndarray, size: int, add) -> np.ndarray:
    """The sum over all rows of what ``add(out, text, word, weight)`` adds up from the words that occur in a batch of them."""
    held = docs.sparkSession.sparkContext.broadcast((words, light))  # CANDIDATES words and HOT weights at most

    def of_task(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        words, light = held.value
        out = np.zeros(size)
        for batch in slices(batches):
            weight = np.array([light.get(k, 1.0) for k in batch.column(1).to_pylist()])
            text, word = occurrences(batch.column(0), words)
            add(out, text, word, weight)
        return out

    got = summed(docs.select("text", row_key().alias("th")), of_task)
    return np.zeros(size) if got is None else got


def _select(np_: np.ndarray, of_p: float, nu: np.ndarray, of_u: float, n: int) -> np.ndarray:
    """The places of the words whose share of positives stands out most from their share of all rows, by a two-sided z score."""
    share = (np_ + nu + 1) / (of_p + of_u + 2)
    z = np.abs((np_ + 0.5) / (of_p + 1) - (nu + 0.5) / (of_u + 1)) / np.sqrt(share * (1 - share) * (1 / (of_p + 1) + 1 / (of_u + 1)) + 1e-12)
    z[np_ + nu < 3] = 0
    best = np.lexsort((np.arange(len(z)), -z))[:n]
    chance = 1 + np.sqrt(2 * np.log(max(2, (np_ + nu >= 3).sum())))  # beyond the largest of as many scores of no meaning
    return np.sort(best[z[best] > chance])


def risk_sums(text: np.ndarray, word: np.ndarray, weight: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What rows taken as negative add for each of several classifiers (w, b): the loss, and its derivative by the value of each row."""
    f = np.zeros((len(b), len(weight)))
    for k in range(len(b)):
        f[k] = np.bincount(text, weights=w[k][word], minlength=len(weight)) + b[k]
    return (np.logaddexp(0, f) * weight).sum(1), weight / (1 + np.exp(-np.clip(f, -30, 30)))


def _settled(docs: DataFrame, light: dict[int, float], words: np.ndarray, x: np.ndarray, prior: float, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classifiers after a step along the gradient of their non-negative risk, both taken over all rows.

    One pass sums the gradient, another the risk of each of ``STEPS``, and each classifier takes its best: the risk over
    all rows never rises.
    """
    n, size = len(b), len(words)

    def gradient(out: np.ndarray, text: np.ndarray, word: np.ndarray, weight: np.ndarray) -> None:
        loss, s = risk_sums(text, word, weight, w, b)
        out[0] += weight.sum()
        out[1 : 1 + n] += loss
        parts = out[1 + n :].reshape(n, 2, size + 1)
        for k in range(n):
            parts[k, 0, :size] += np.bincount(word, weights=s[k][text], minlength=size)
            parts[k, 0, size] += s[k].sum()
            bent = s[k] * (1 - s[k] / np.maximum(weight, 1e-12))
            parts[k, 1, :size] += np.bincount(word, weights=bent[text], minlength=size)
            parts[k, 1, size] += bent.sum()

    got = _over_all(docs, light, words, 1 + n + 2 * n * (size + 1), gradient)
    rows, loss, parts = max(got[0], 1), got[1 : 1 + n] / max(got[0], 1), got[1 + n :].reshape(n, 2, size + 1) / max(got[0], 1)
    f = x @ w.T.astype(x.dtype) + b  # the positives are in hand
    s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    wide = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    tried_w, tried_b = np.zeros((len(STEPS), n, size)), np.zeros((len(STEPS), n))
    for k in range(n):
        gp, gn = prior * (s[:, k] - 1) @ wide / len(x), parts[k, 0] - prior * s[:, k] @ wide / len(x)
        negative = loss[k] - prior * np.logaddexp(0, f[:, k]).mean()
        g = gp + gn if negative >= 0 else -gn
        move = g / (parts[k, 1] + prior * (s[:, k] * (1 - s[:, k])) @ wide / len(x) + 1e-3)
        for j, step in enumerate(STEPS):
            tried_w[j, k], tried_b[j, k] = w[k] - step * move[:size], b[k] - step * move[size]
    all_w, all_b = tried_w.reshape(len(STEPS) * n, size), tried_b.ravel()

    def risk(out: np.ndarray, text: np.ndarray, word: np.ndarray, weight: np.ndarray) -> None:
        out += risk_sums(text, word, weight, all_w, all_b)[0]

    loss = _over_all(docs, light, words, len(all_b), risk) / rows
    f = x @ all_w.T.astype(x.dtype) + all_b
    total = prior * np.logaddexp(0, -f).mean(0) + np.maximum(0, loss - prior * np.logaddexp(0, f).mean(0))
    best = total.reshape(len(STEPS), n).argmin(0)
    return tried_w[best, np.arange(n)], tried_b[best, np.arange(n)]


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> ToxicityModel:
    """Classifiers from the rows of ``docs`` that ``labels`` (doc_id, toxic) confirms as toxic, against all rows of any label.

    The positives are a bounded sample, the distinct rows whose hashed keys are least. Another sample finds the words that
    may be weighed and where the classifiers start; which words stand out, the gradient and the risk are then taken over
    all rows, where copies that fill more than a ``HOT``-th of them count as one. The class prior is the share of 1 among
    the labels that are given, all of them counted. The driver receives counts of words, and of a sample row which of the
    words weighed it has, however long it is. Without a label of either kind all scores are 0.
    """
    none = ToxicityModel(np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0))
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not prior:
        return none
    prior = min(max(prior, 1e-4), 0.9)
    p = written(sampled(docs, positives, only=marks.filter("toxic = 1").select(F.col("doc_id").alias("mark"))), "positives")
    u = written(sampled(docs, unlabelled), "unlabelled")
    words = _sample_words(p, u)

    def count(out: np.ndarray, text: np.ndarray, word: np.ndarray, weight: np.ndarray) -> None:
        out[:-1] += np.bincount(word, weights=weight[text], minlength=len(words))
        out[-1] += weight.sum()

    light = _weights(docs)
    sure, seen = _over_all(p, {}, words, len(words) + 1, count), _over_all(docs, light, words, len(words) + 1, count)
    words = words[_select(sure[:-1], sure[-1], seen[:-1], seen[-1], WORDS)]
    x, y = _features(p, words), _features(u, words)
    if not len(x):
        return none
    fitted = []
    for k in range(CLASSIFIERS):
        rng = np.random.default_rng(k)
        half = lambda z: z[rng.permutation(len(z))[: max(1, len(z) * 4 // 5)]]  # noqa: B023, E731
        fitted.append(nnpu(half(x), half(y), prior, k))
    w, b = _settled(docs, light, words, x, prior, np.stack([w for w, _ in fitted]), np.array([b for _, b in fitted]))
    return ToxicityModel(words, w, b)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text). Null and empty texts have the score of a text without any word.

    Equal texts score alike, whatever their ids, null ones included; repeated rows come back repeated, and no rows give none.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # WORDS hashes, and as many weights a classifier

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_threads()
        for batch in slices(batches):
            yield pa.record_batch([batch.column(0), pa.array(held.value.scores(batch.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of(docs)}, score double")


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned; a null id is one."""
    return F.coalesce(fold(F.col(doc_id), 5) == 0, F.lit(True))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; nulls and repeated rows as in ``score``."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    learn = ~held_out()
    model = fit(docs.select("doc_id", "text").filter(learn), labels.select("doc_id", "toxic").filter(learn))
    found = score(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
