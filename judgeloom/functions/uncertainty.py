"""Label probabilities and the uncertainty that they show. Three-label forms stay in code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Token that stands for each label in a judge's first-token log-probabilities.
TOKENS = {"A": "A", "B": "B", "tie": "T"}


def softmax(scores: list[Column], temperature: float = 1.0) -> list[Column]:
    """Probabilities of log-scores, shifted by their maximum; a temperature of 0 or less is left out."""
    scaled = [s / F.lit(float(temperature)) if temperature > 0 else s for s in scores]
    top = F.greatest(*scaled)
    exps = [F.exp(s - top) for s in scaled]
    total = reduce(lambda x, y: x + y, exps)
    return [e / total for e in exps]


def normalized(values: list[Column]) -> list[Column]:
    """Values over their sum; an error where the sum isn't positive."""
    total = reduce(lambda x, y: x + y, values)
    return [F.when(total > 0, v / total).otherwise(F.raise_error(F.lit("label probabilities have no mass")).cast("double")) for v in values]


def entropy(probs: list[Column]) -> Column:
    """Bits, over positive probabilities; no normalisation."""
    return reduce(lambda x, y: x + y, [F.when(p > 0, -p * F.log2(p)).otherwise(F.when(p.isNotNull(), 0.0)) for p in probs])


def logit_metrics(a: Column, b: Column, t: Column) -> dict[str, Column]:
    """entropy, msp, margin and normalized_entropy of three label probabilities; null where there are none."""
    top = F.greatest(a, b, t)
    second = F.when((a >= b) & (a >= t), F.greatest(b, t)).when(b >= t, F.greatest(a, t)).otherwise(F.greatest(a, b))
    e = entropy([a, b, t])
    return {"entropy": e, "msp": top, "margin": top - second, "normalized_entropy": e / F.log2(F.lit(3.0))}


def logit_metrics_of_map(probs: Column) -> dict[str, Column]:
    """The same for a map of any number of labels; one label has margin and normalised entropy 0, none has nulls."""
    values = F.sort_array(F.map_values(probs), asc=False)
    some = F.size(values) > 0
    e = F.aggregate(F.filter(values, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))
    return {
        "entropy": F.when(some, e),
        "msp": F.when(some, F.try_element_at(values, F.lit(1))),
        "margin": F.when(F.size(values) == 1, F.lit(0.0)).when(some, F.try_element_at(values, F.lit(1)) - F.try_element_at(values, F.lit(2))),
        "normalized_entropy": F.when(F.size(values) == 1, F.lit(0.0)).when(some, e / F.log2(F.size(values).cast("double"))),
    }


def verbalized_metrics(confidence: Column) -> dict[str, Column]:
    """A confidence of 0 to 100, clamped, as a share; and what it leaves."""
    c = F.when(confidence.isNotNull(), F.least(F.greatest(confidence.cast("double"), F.lit(0.0)), F.lit(100.0)) / 100)
    return {"confidence": c, "uncertainty": 1 - c}


def label_probabilities(tokens: Column) -> dict[str, Column]:
    """Softmax over the labels found among an array of (token, logprob); each by its best spelling, absent ones 0, none null."""
    def best_of(token: str) -> Column:
        own = F.filter(tokens, lambda x: F.upper(strip(x["token"])) == token)
        return F.array_max(F.transform(own, lambda x: x["logprob"]))

    best = {k: best_of(t) for k, t in TOKENS.items()}
    top = F.greatest(*best.values())
    exps = {k: F.coalesce(F.exp(v - top), F.when(top.isNotNull(), F.lit(0.0))) for k, v in best.items()}
    total = reduce(lambda x, y: x + y, exps.values())
    return {k: v / total for k, v in exps.items()}


def one_hot(verdict: Column) -> dict[str, Column]:
    """What stands for the probabilities of a judge that gives none."""
    return {k: F.when(verdict == k, 1.0).otherwise(0.0) for k in TOKENS}
