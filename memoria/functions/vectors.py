"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; null where it has none."""
    step = F.struct(F.sqrt(dot(v, v)).alias("norm"), v.alias("v"))
    # One pass holds the norm while the elements are divided by it.
    return F.element_at(F.transform(F.array(step), lambda s: F.when(s["norm"] > 0, F.transform(s["v"], lambda x: x.cast("double") / s["norm"]))), 1)


def int8_scale(unit_vector: Column) -> Column:
    return F.array_max(F.transform(unit_vector, F.abs)) / 127


def int8(unit_vector: Column, scale: Column) -> Column:
    """A unit vector as whole numbers of -127..127, halves rounded up; times scale they give it back. Take both from
    columns, not expressions, or each element computes them anew."""
    return F.transform(unit_vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x / scale + 0.5))).cast("int"))


def scaled_dot(q: Column, values: Column, scale: Column) -> Column:
    return dot(q, values) * scale
