"""Choice of an action from action values, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_max(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def last_max(values: Column) -> Column:
    return (F.size(values) - F.array_position(F.reverse(values), F.array_max(values))).cast("long")


def softmax(values: Column) -> Column:
    """Probabilities of action values, shifted by their maximum."""
    top = F.array_max(values)
    weights = F.transform(values, lambda x: F.exp(F.greatest(x - top, F.lit(-50.0))))
    mass = F.greatest(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x), F.lit(1e-12))
    return F.transform(weights, lambda w: w / mass)


def constrained_max(values: Column, likelihood: Column, share: float = 0.05) -> Column:
    """First greatest value among actions the behaviour takes often enough."""
    bound = F.array_max(likelihood) * F.lit(share)
    masked = F.zip_with(values, likelihood, lambda q, p: F.when(p >= bound, q).otherwise(F.lit(-1e9)))
    return first_max(masked)


def hash_uniform(*parts: Column) -> Column:
    """A reproducible number in [0, 1) from the md5 of the joined parts."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def gate_parts(q0: Column, q1: Column, q2: Column) -> dict:
    """Softmax terms of three values: weights, their sum, and the second weight.

    The greatest weight is exactly 1. Written without array functions, so that
    it stays in generated code.
    """
    top = F.greatest(q0, q1, q2)

    def weight(q: Column) -> Column:
        return F.exp(F.greatest(q - top, F.lit(-50.0)))

    weights = [weight(q) for q in (q0, q1, q2)]
    return {
        "weights": weights, "mass": weights[0] + weights[1] + weights[2],
        "second": weight(middle_of_three(q0, q1, q2))}


def last_of_three(a: Column, b: Column, c: Column) -> Column:
    return F.when((c >= a) & (c >= b), 2).when(b >= a, 1).otherwise(0).cast("long")


def first_of_three(a: Column, b: Column, c: Column) -> Column:
    return F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2).cast("long")


def middle_of_three(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
