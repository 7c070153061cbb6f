"""Vector and weight functions over array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 beside a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def truncated_cosine(a: Column, b: Column) -> Column:
    return F.greatest(cosine(a, b), F.lit(0.0))


def inverse_sigmoid(p: Column, eps: float = 1e-5) -> Column:
    clipped = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(clipped / (1 - clipped))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def one_hot_index(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def matches(a: Column, value: list[float], eps: float = 1e-5) -> Column:
    return F.forall(F.zip_with(a, F.array(*map(F.lit, value)), lambda x, y: F.abs(x - y) < eps), lambda x: x)


def match_weight(a: Column, values: list[tuple[list[float], float]], default: float, eps: float = 1e-5) -> Column:
    """Weight of the value that a equals within eps in every place; weights are scaled to a mean of 1."""
    mean = (sum(w for _, w in values) + default) / (len(values) + 1)
    out = F.lit(default / mean)
    for value, weight in reversed(values):
        out = F.when(matches(a, value, eps), weight / mean).otherwise(out)
    return out


def class_weight(label: Column, weights: list[float]) -> Column:
    """Weight of a class number, scaled to a mean of 1; 1 for a class without one."""
    mean = sum(weights) / len(weights)
    out = F.lit(1.0)
    for k, w in enumerate(weights):
        out = F.when(label == k, w / mean).otherwise(out)
    return out


def binary_weight(y: Column, w0: float, w1: float) -> Column:
    return y * w0 + (1 - y) * w1


def balanced_weight(y: Column, p: Column, scale: float = 1.0) -> Column:
    return scale * F.when(y == 1, F.exp(1 - p)).otherwise(F.exp(p))


def binary_cross_entropy(y: Column, p: Column, smoothing: float = 0.0, eps: float = 1e-7) -> Column:
    soft = y * (1 - smoothing) + 0.5 * smoothing
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(soft * F.ln(q) + (1 - soft) * F.ln(1 - q))


def categorical_cross_entropy(y: Column, p: Column, eps: float = 1e-7) -> Column:
    """Of a one-hot y and class shares p."""
    return -F.aggregate(F.zip_with(y, p, lambda a, b: a * F.ln(F.greatest(b, F.lit(eps)))), F.lit(0.0), lambda s, x: s + x)


def linear_arc_margin(cosine_of_class: Column, is_class: Column, margin: float = 0.5, scale: float = 30.0) -> Column:
    """Logit that falls linearly with the angle, from 1 to -1 over half a turn; the true class's angle is widened by
    the margin."""
    angle = F.acos(cosine_of_class) + F.when(is_class, margin).otherwise(0.0)
    return scale * (1 - 2 * angle / math.pi)


def arc_margin(cosine_of_class: Column, is_class: Column, margin: float = 0.5, cosine_margin: float = 0.0, scale: float = 30.0) -> Column:
    """Logit with an additive margin on the true class's angle. An angle that the margin would carry beyond half a turn
    loses margin * sin(margin) of its cosine instead; `cosine_margin` is taken off as well."""
    c = cosine_of_class
    widened = c * math.cos(margin) - F.sqrt(1 - c * c) * math.sin(margin)
    held = F.when(c > -math.cos(margin), widened).otherwise(c - margin * math.sin(margin)) - cosine_margin
    return scale * F.when(is_class, held).otherwise(c)


def softmax_cross_entropy(logits: Column, label: Column) -> Column:
    """Of an array of logits and the true class's number (from 0)."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.ln(total) + top - F.element_at(logits, label.cast("int") + 1)


def glu(values: Column, gates: Column) -> Column:
    return F.zip_with(values, gates, lambda v, g: v * sigmoid(g))


def hash_embedding(words: Column, dim: int) -> Column:
    """A text's vector by feature hashing: counts of md5 buckets, scaled to length 1. It stands in for a
    learned sentence encoder wherever one can be plugged in."""
    buckets = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dim)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    return l2_normalise(counts)
