"""Language identification by nearest clustered TF-IDF centroid."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, kind_of, read_table, sampled, slices, text_offsets, worker_threads

#: Buckets that byte trigrams are hashed to.
BUCKETS = 4096
#: The bounded sample that centroids are fitted on: documents of a language, and of all languages together.
SAMPLE = 500
SAMPLE_ALL = 6000
CENTROIDS = 4
#: A document is rejected beyond this share of the similarity that all but one in a hundred sample documents reach.
REJECT = 0.2
UNKNOWN = "und"

_LETTERS = np.zeros(256, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def trigram_counts(column: pa.Array) -> np.ndarray:
    """(texts, BUCKETS) counts of byte trigrams of letters with a word's edges; null and letterless texts have none."""
    offsets = text_offsets(column)
    n, texts = int(offsets[-1] - offsets[0]), len(column)
    if not n:
        return np.zeros((texts, BUCKETS), np.float32)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    owner = np.repeat(np.arange(texts, dtype=np.int32), np.diff(offsets))
    padded = np.zeros(n + texts + 1, np.uint32)  # a gap before each text
    padded[np.arange(1, n + 1) + owner] = _LETTERS[data]
    own = np.zeros(n + texts + 1, np.int32)
    own[np.arange(1, n + 1) + owner] = owner
    middle = np.flatnonzero(padded[1:-1]) + 1
    code = (padded[middle - 1] * np.uint32(0x9E3779B1) + padded[middle] * np.uint32(0x85EBCA6B) + padded[middle + 1] * np.uint32(0xC2B2AE35)) >> np.uint32(20)
    counts = np.bincount(own[middle].astype(np.int64) * BUCKETS + code, minlength=texts * BUCKETS)
    return counts.reshape(texts, BUCKETS).astype(np.float32)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each, of length 1
    owner: np.ndarray  # the language of each
    floor: np.ndarray  # for each language, the similarity under which it rejects

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and cosine similarity of each text's nearest centroid; ties go to the first."""
        near = self.vectors(counts) @ self.centroids.T
        best = near.argmax(1)
        return self.owner[best], np.clip(near[np.arange(len(best)), best], 0, 1)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; each next start is the row farthest from those so far."""
    picks = [int((x @ x.mean(0)).argmax())]
    while len(picks) < min(k, len(x)):
        picks.append(int((x @ x[picks].T).max(1).argmin()))
    c = x[picks]
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        c = np.stack([x[of == j].sum(0) if (of == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def _document_counts(docs: DataFrame) -> np.ndarray:
    """In how many of all rows each bucket occurs; last, the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in _small(batches):
            total[:-1] += (trigram_counts(batch.column(0)) > 0).sum(0)
            total[-1] += batch.num_rows
        yield pa.record_batch([pa.array(np.arange(BUCKETS + 1), pa.int32()), pa.array(total)], ["bucket", "n"])

    out = np.zeros(BUCKETS + 1)
    for r in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE, clusters: int = CENTROIDS) -> LanguageModel:
    """Centroids of every language of the rows that ``learn`` marks and that have a text and a lang.

    Document frequencies count all those rows. Centroids are fitted on ``sample`` rows of each language, those whose
    hashed keys are least (``SAMPLE_ALL`` in all, 20 at least). Rows without a letter or an id are not learned from, and
    copies of a row count once among the sample.
    """
    known = docs.filter(learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())
    counts = _document_counts(known)
    idf = (np.log((1 + counts[-1]) / (1 + counts[:-1])) + 0.1).astype(np.float32)
    each = max(20, min(sample, SAMPLE_ALL // max(1, len(languages))))
    rows = sampled(known, each, F.col("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            packed = [x.tobytes() for x in np.minimum(trigram_counts(batch.column(1)), 65535).astype("<u2")]
            yield pa.record_batch([batch.column(0), pa.array(packed, pa.binary())], ["lang", "counts"])

    got = rows.mapInArrow(run, "lang string, counts binary").collect() if languages else []
    model = LanguageModel(languages, idf, np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.int64), np.zeros(len(languages)))
    centroids, owner, floor = [], [], np.zeros(len(languages))
    for k, name in enumerate(languages):
        packed = sorted(r.counts for r in got if r.lang == name)
        x = model.vectors(np.stack([np.frombuffer(p, "<u2").astype(np.float32) for p in packed]))
        centroids.append(_clusters(x, clusters))
        owner += [k] * len(centroids[-1])
        floor[k] = REJECT * np.quantile((x @ centroids[-1].T).max(1), 0.01)
    if centroids:
        model = LanguageModel(languages, idf, np.concatenate(centroids), np.array(owner), floor)
    return model


def predict(docs: DataFrame, model: LanguageModel, keep_columns: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row, or with ``keep_columns`` the rows that aren't rejected, as they are.

    The score is the cosine similarity to the nearest centroid. Null texts, texts without a letter, and all texts under a
    model without languages are ``und`` with score 0, and rejected; otherwise a text is rejected if it is farther from
    its nearest centroid than the language's floor. Repeated rows come back repeated.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats for each centroid

    def judged(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        m = held.value
        letters = np.array([any(map(str.isalpha, t)) if t else False for t in column.to_pylist()], bool)
        if not m.languages:
            letters[:] = False
            language, score = np.zeros(len(letters), np.int64), np.zeros(len(letters))
        else:
            language, score = m.nearest(trigram_counts(column))
        score = np.where(letters, score, 0.0)
        rejected = ~letters | (score < (m.floor[language] if m.languages else 1))
        return [m.languages[k] if ok else UNKNOWN for k, ok in zip(language.tolist(), letters.tolist())], score, rejected

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_threads()
        for batch in _small(batches):
            language, score, rejected = judged(batch.column(batch.schema.get_field_index("text")))
            if keep_columns:
                yield batch.filter(pa.array(~rejected))
            else:
                yield pa.record_batch([batch.column(0), pa.array(language, pa.string()), pa.array(score.astype(np.float64)), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    if keep_columns:
        return docs.mapInArrow(run, docs.schema)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of(docs)}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from; a null id is one."""
    return F.coalesce(fold(F.col(doc_id), 4) == 2, F.lit(True))


def known_only(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language the model of its own learning rows accepts, all columns as they are.

    Null and letterless texts go. Repeated rows, and rows with a null id, lang or source, are judged by their text alone.
    Without any row to learn from no row stays; no rows give no rows.
    """
    return predict(docs, fit(docs, ~held_out()), keep_columns=True)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document; nulls, ties and repeated rows as in ``predict``."""
    docs = read_table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
