"""Vector and span features as higher-order array expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error-span severity weights; unknown severities weigh 1.0,
# a span without severity counts as minor, a span without confidence as 0.5.
SEVERITY_WEIGHT = {"minor": 1.0, "major": 2.0, "critical": 3.0}
UNKNOWN_SEVERITY_WEIGHT = 1.0
MISSING_CONFIDENCE = 0.5


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a, b) -> Column:
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def mean(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v.cast("double")) / F.size(_c(a))


def std_pop(a) -> Column:
    # the mean is bound as the only element of an array: computed once a row
    squares = F.transform(F.array(mean(a)), lambda m: F.aggregate(
        _c(a), F.lit(0.0), lambda acc, v: acc + (v.cast("double") - m) * (v.cast("double") - m)))
    return F.sqrt(squares[0] / F.size(_c(a)))


def span_count(spans) -> Column:
    return F.size(_c(spans))


def span_severity(spans) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in SEVERITY_WEIGHT.items() for x in kv])
    return F.aggregate(
        _c(spans), F.lit(0.0),
        lambda acc, s: acc + F.coalesce(weights[F.coalesce(s["severity"], F.lit("minor"))],
                                        F.lit(UNKNOWN_SEVERITY_WEIGHT)))


def span_confidence(spans) -> Column:
    """Mean confidence of the spans; 0.0 for an empty list."""
    total = F.aggregate(_c(spans), F.lit(0.0),
                        lambda acc, s: acc + F.coalesce(s["confidence"], F.lit(MISSING_CONFIDENCE)))
    return F.when(F.size(_c(spans)) > 0, total / F.size(_c(spans))).otherwise(F.lit(0.0))
