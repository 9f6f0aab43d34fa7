"""Vector expressions on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``; a lambda would otherwise redo it for every element."""
    return F.transform(F.array(value), body)[0]


def unit(a: Column) -> Column:
    """Vector scaled to length 1; a zero vector is left as it is."""
    scaled = lambda length: F.transform(a, lambda x: x.cast("double") / length)
    return let(F.when(norm(a) > 0, norm(a)).otherwise(F.lit(1.0)), scaled)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity with floored norms, so that a zero vector scores 0."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(NORM_FLOOR)) * F.greatest(norm(b), F.lit(NORM_FLOOR)))


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    shifted = lambda top: F.transform(scores, lambda x: F.exp((x - top) / F.lit(float(temperature))))
    total = lambda exps: F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    normalised = lambda exps: let(total(exps), lambda t: F.transform(exps, lambda x: x / t))
    return let(let(F.array_max(scores), shifted), normalised)
