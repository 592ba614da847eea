"""Array functions for activation vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT_EPS = 1.1920928955078125e-07


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine similarity; each norm counts at least ``eps``."""
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(eps)) * F.greatest(F.sqrt(dot(b, b)), F.lit(eps)))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unified_difference(fwd_var: Column, fwd_ref: Column, bwd_var: Column, bwd_ref: Column) -> Column:
    """Forward difference followed by backward difference."""
    return F.concat(difference(fwd_var, fwd_ref), difference(bwd_var, bwd_ref))


def rms_normalised(x: Column, eps: float = FLOAT_EPS) -> Column:
    scale = F.sqrt(dot(x, x) / F.size(x) + F.lit(eps))
    return F.transform(x, lambda v: v.cast("double") / scale)
