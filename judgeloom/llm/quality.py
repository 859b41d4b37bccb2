"""Quality rules with risk-controlled thresholds."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kind_of, read_table, row_key, slices, written

#: Good documents rejected in a stratum by the cutoffs found: at most this share, but with a probability of DELTA at most.
ALPHA = 0.05
DELTA = 0.05

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACES = str.maketrans({c: None for c in "\x20\x09\x0a\x0b\x0c\x0d"})
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Each rule is a ratio of two base figures and the cutoffs tried for it, from the one that rejects least on. A document is
#: rejected if ratio > cutoff ("over") or ratio < cutoff ("under"). The cutoffs are fixed before any label is seen.
RULES = [
    ("symbols", "n_symbols", "n_words", "over", [round(1 - 0.02 * k, 2) for k in range(49)]),
    ("dup_lines", "n_dup_lines", "n_words", "over", [round(0.5 - 0.01 * k, 2) for k in range(50)]),
    ("repeats", "n_repeat_words", "n_words", "over", [round(0.5 - 0.01 * k, 2) for k in range(49)]),
    ("long_words", "word_chars", "n_words", "over", [round(40 - 0.5 * k, 1) for k in range(69)]),
    ("short_words", "word_chars", "n_words", "under", [round(1 + 0.1 * k, 1) for k in range(40)]),
]


def base_figures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    w = text.encode().split()
    seen: set[str] = set()
    dup = 0
    lines = text.split("\n")
    if len(lines) > 1:
        for line in lines:
            if line.translate(_SPACES) if line[:1] in " \t\r\x0b\x0c" or not line else True:
                dup += line in seen
                seen.add(line)
    repeated = 0
    triples = list(zip(w, w[1:], w[2:]))
    if len(set(triples)) < len(triples):
        often = Counter(triples)
        end = 0
        for i, t in enumerate(triples):
            if often[t] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    return len(w), len(text.translate(_SPACES)), len(_SYMBOLS.findall(text)), dup, repeated


def figures(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, th, the base figures) of every row of (doc_id, lang, text).

    The stratum of a null lang is ``none``; equal texts have equal ``th``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [base_figures(t) for t in batch.column(3).to_pylist()]
            yield pa.record_batch([*batch.columns[:3], *(pa.array([r[k] for r in rows], pa.int64()) for k in range(5))], ["doc_id", "stratum", "th", *_STATS])

    schema = f"doc_id {kind_of(docs)}, stratum string, th long, " + ", ".join(f"{c} long" for c in _STATS)
    return docs.select("doc_id", F.coalesce("lang", F.lit("none")), row_key(), "text").mapInArrow(run, schema)


def _base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rejects(above: str, below: str, side: str, cutoff):
    """Exact on both sides of the comparison: the ratio is never rounded for a document without words."""
    ratio = F.col(above) / F.when(F.col(below) > 0, F.col(below))
    return F.coalesce(ratio > cutoff if side == "over" else ratio < cutoff, F.lit(False))


def binomial_below(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials that succeed with p, exactly but for rounding."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.append(0.0, np.cumsum(np.log((n - i[1:] + 1) / i[1:]))) + i * np.log(p) + (n - i) * np.log1p(-p)
    return float(np.exp(logs.max()) * np.exp(logs - logs.max()).sum())


def binomial_upper(k: int, n: int, delta: float) -> float:
    """The exact upper confidence bound of a share of which k of n were seen: the p with P(X <= k) = delta."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if 0 < p < 1 and binomial_below(k, n, p) > delta:
            low = p
        else:
            high = p
    return high


def certified(k: int, n: int, share: float, delta: float) -> bool:
    """Whether the upper bound of k of n is ``share`` at most; P(X <= k) falls as p grows, so one value of it tells."""
    return k <= n * share and binomial_below(k, n, share) <= delta


def _level(above: str, below: str, side: str, tried: list[float]) -> Column:
    """The first cutoff that rejects a row, by its place among those tried; their number where none does."""
    return F.size(F.filter(F.array(*map(F.lit, tried)), lambda c: ~_rejects(above, below, side, c)))


def path_of(counts: list[dict]) -> list[tuple[int, int]]:
    """Steps (rule, cutoff) that tighten one rule each, from the ``good`` and ``bad`` rows that begin to be rejected at each ``level``.

    Each step takes the rule and the cutoff that reject the most bad rows more for each good one more. The path ends
    where no rule would reject another bad row.
    """
    size = max(len(r[4]) for r in RULES)
    new = np.zeros((2, len(RULES), size + 1))
    for c in counts:
        new[0, c["rule"], c["level"]] += c["good"]
        new[1, c["rule"], c["level"]] += c["bad"]
    at, path = [-1] * len(RULES), []
    while True:
        best = None
        for r, rule in enumerate(RULES):
            good, bad = (np.cumsum(new[k, r, at[r] + 1 : len(rule[4])]) for k in (0, 1))
            for k in np.flatnonzero(np.diff(bad, prepend=0)).tolist():
                key = (bad[k] / (good[k] + 0.5), bad[k], -r, -k)
                best = max(best, (key, r, at[r] + 1 + k)) if best else (key, r, at[r] + 1 + k)
        if best is None:
            return path
        path.append(best[1:])
        at[best[1]] = best[2]


def cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row for every _stratum with labels: its cutoff of each rule (_<rule>), and _n, _rejected and _bound of the holdout.

    Rows that the base rules fail are left out, and rows with one text count once: copies are not independent trials. A
    hash of the text deals the rest into two halves. The first draws a path, on which the rules reject ever more bad rows
    (``path_of``). On the good rows of the second, the holdout, the steps of the path are tested one after the other: all
    rules of a step together reject at most ``alpha`` of a stratum's good documents, by the exact binomial bound. The path
    is fixed before the holdout is looked at, and the first step that fails ends it, so its tests need no correction; over
    the strata ``delta`` is divided (Bonferroni), so all promises hold at once with a probability of 1 - delta. The last
    step that holds gives the cutoffs. A rule without one (null) rejects nothing in that stratum: one needs at least
    log(delta / strata) / log(1 - alpha) good holdout rows, and bad rows to tell from them. All labelled rows and all
    strata count; a row that is labelled both good and bad is bad. A stratum is one row, tested where it lies, and only
    the number of strata reaches the driver.
    """
    marks = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_mark")).agg(F.min((F.col("quality") == 1).cast("int")).alias("good"))
    levels = [_level(a, b, side, tried).alias(f"l{r}") for r, (_, a, b, side, tried) in enumerate(RULES)]
    held = stats.filter(~_base_failed()).join(marks, F.col("doc_id") == F.col("_mark")).select("stratum", "th", "good", *levels)
    held = written(held.groupBy("stratum", "th").agg(F.min("good").alias("good"), *(F.first(f"l{r}").alias(f"l{r}") for r in range(len(RULES)))).withColumn("half", F.pmod(F.xxhash64("th", F.lit(11)), F.lit(2))), "labelled")

    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"l{r}").alias("level")) for r in range(len(RULES))])).alias("x")
    seen = held.filter("half = 0").select("stratum", "good", each).groupBy("stratum", "x.rule", "x.level").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    seen = seen.groupBy("stratum").agg(F.collect_list(F.struct("rule", "level", "good", "bad")).alias("counts"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [path_of(c) for c in batch.column(1).to_pylist()]
            out = {"_stratum": batch.column(0), "path": pa.array([[{"rule": r, "cut": c} for r, c in p] for p in paths], pa.list_(pa.struct([("rule", pa.int32()), ("cut", pa.int32())])))}
            for r, rule in enumerate(RULES):  # the step that begins to reject a row of each level
                out[f"s{r}"] = pa.array([[next((i for i, x in enumerate(p) if x[0] == r and x[1] >= level), None) for level in range(len(rule[4]))] for p in paths], pa.list_(pa.int32()))
            yield pa.record_batch(out)

    steps = ", ".join(f"s{r} array<int>" for r in range(len(RULES)))
    paths = written(seen.mapInArrow(draw, f"_stratum string, path array<struct<rule: int, cut: int>>, {steps}"), "paths")
    step = F.least(*[F.expr(f"try_element_at(s{r}, l{r} + 1)") for r in range(len(RULES))])
    holdout = held.filter("half = 1 and good = 1").join(paths, F.col("stratum") == F.col("_stratum")).select("stratum", step.alias("step"))
    holdout = holdout.groupBy("stratum", "step").agg(F.count("*").alias("n")).groupBy("stratum").agg(F.collect_list(F.struct("step", "n")).alias("steps"))
    tested = paths.select("_stratum", "path").join(holdout, F.col("stratum") == F.col("_stratum"), "left").select("_stratum", "path", "steps")
    sure = delta / max(1, paths.filter("size(path) > 0").count())

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, path, steps in zip(*(c.to_pylist() for c in batch.columns)):
                n, at = sum(x["n"] for x in steps or ()), Counter({x["step"]: x["n"] for x in steps or () if x["step"] is not None})
                wrong, found = 0, {}
                for k, x in enumerate(path):
                    if not n or not certified(wrong + at[k], n, alpha, sure):
                        break
                    wrong += at[k]
                    found[x["rule"]] = x["cut"]
                bound = binomial_upper(wrong, n, sure) if found else None
                rows.append((name, n, wrong if found else None, bound, *(rule[4][found[r]] if r in found else None for r, rule in enumerate(RULES))))
            types = [pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * (1 + len(RULES))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types)], ["_stratum", "_n", "_rejected", "_bound", *(f"_{r[0]}" for r in RULES)])

    return tested.mapInArrow(test, "_stratum string, _n long, _rejected long, _bound double, " + ", ".join(f"_{name} double" for name, *_ in RULES))


def calibrate(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """The same as a report on the driver, for a number of strata that fits there: the cutoff of each (stratum, rule)."""
    rows = cutoffs(stats, labels, alpha, delta).collect()
    return {(r["_stratum"], name): r[f"_{name}"] for r in rows for name, *_ in RULES if r[f"_{name}"] is not None}


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, the base figures, base_failed, kept, stratum) of every row of ``docs`` (doc_id, lang, text).

    kept is false if a base rule fails, or a risk-controlled rule of the row's stratum rejects it. Null, empty and blank
    texts have no words and fail. Repeated rows are judged alike, and so are rows with a null doc_id. Labels that are null,
    repeated or of unknown rows do no harm; without labels the base rules stand alone. No rows give no rows. Other columns
    of either table are ignored.
    """
    stats = written(figures(docs.select("doc_id", "lang", "text")), "figures")
    table = cutoffs(stats, labels, alpha, delta)
    rejected = F.lit(False)
    for name, a, b, side, _ in RULES:
        rejected = rejected | F.coalesce(_rejects(a, b, side, F.col(f"_{name}")), F.lit(False))
    out = stats.join(table, F.col("stratum") == F.col("_stratum"), "left")  # broadcast or split by the table's size
    return out.select("doc_id", *_STATS, _base_failed().alias("base_failed"), (~(_base_failed() | rejected)).alias("kept"), "stratum")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on all of ``documents`` under cutoffs from all of ``labels``; nulls, copies and ties as in ``judged``."""
    return judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
