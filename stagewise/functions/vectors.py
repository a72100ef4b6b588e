"""Array Columns: class probabilities and gated feature rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordered stages; the position is the severity.
STAGES = ["Benign", "IAD", "LMEP", "IMP"]
SEVERITY = {s: i for i, s in enumerate(STAGES)}

GATE_EPSILON = 1e-8


def severity_of(stage: Column) -> Column:
    """Stage name to ordinal (0 for an unknown name)."""
    out = F.lit(0)
    for name, level in SEVERITY.items():
        out = F.when(stage == name, F.lit(level)).otherwise(out)
    return out.cast("int")


def stage_of(severity: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STAGES]), severity.cast("int") + 1)


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)


def argmax(p: Column) -> Column:
    """Index of the largest entry, the first one on a tie."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def pad(p: Column, n: int = len(STAGES)) -> Column:
    """Fill up with zeros on the right to exactly n entries."""
    return F.slice(F.concat(p, F.array_repeat(F.lit(0.0), n)), 1, n)


def evidence_gates(p: Column) -> Column:
    """(P(Benign), P(IAD), P(LMEP)) renormalised without the impact class."""
    head = F.slice(p, 1, 3)
    mass = F.element_at(p, 1) + F.element_at(p, 2) + F.element_at(p, 3) + F.lit(GATE_EPSILON)
    return F.transform(head, lambda v: v / mass)


def gated_stream(gate: Column, features: Column) -> Column:
    """[gate, gate*x1, gate*x2, ...]"""
    return F.concat(F.array(gate), F.transform(features, lambda v: v * gate))


def mean_of(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def one_hot_label(y: Column, n: int = len(STAGES)) -> Column:
    return F.array(*[(y == k).cast("double") for k in range(n)])


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda v: F.exp(v - F.array_max(scores)))
    mass = total(shifted)
    return F.transform(shifted, lambda v: v / mass)


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))
