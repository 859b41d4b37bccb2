"""Verdict labels: parsing, swapping, choosing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_letter, strip

LABELS = ("A", "B", "tie")
# The spellings of a winner.
WINNERS = {
    "A": ["a", "model_a", "response_a", "1", "left"],
    "B": ["b", "model_b", "response_b", "2", "right"],
    "tie": ["tie", "equal"],
}


def _case(pairs: list[tuple[Column, Column]]) -> Column:
    out = F
    for when, then in pairs:
        out = out.when(when, then)
    return out


def normalize_winner(raw: Column) -> Column:
    folded = F.lower(strip(raw))
    return _case([(folded.isin(names), F.lit(label)) for label, names in WINNERS.items()])


def swap_label(label: Column) -> Column:
    """A and B change places; anything else stays."""
    return F.when(label == "A", "B").when(label == "B", "A").otherwise(label)


def opposite_label(label: Column) -> Column:
    """The other of A and B; null for anything else."""
    return F.when(label == "A", "B").when(label == "B", "A")


def argmax_label(a: Column, b: Column, t: Column) -> Column:
    """The first of A, B, tie with the greatest probability."""
    return F.when((a >= b) & (a >= t), "A").when(b >= t, "B").otherwise("tie")


def parse_verdict(text: Column, a: Column, b: Column, t: Column) -> Column:
    """By the first letter of the stripped text in upper case (A, B, T); else by probability; null where there is none."""
    first = first_letter(text)
    return F.when(first.startswith("A"), "A").when(first.startswith("B"), "B").when(first.startswith("T"), "tie").when(a.isNotNull(), argmax_label(a, b, t))


def strict_verdict(text: Column, a: Column, b: Column, t: Column) -> Column:
    """As ``parse_verdict``, an error where there is no verdict."""
    return F.coalesce(parse_verdict(text, a, b, t), F.raise_error(F.concat(F.lit("no verdict in: "), F.coalesce(text, F.lit("")))))
