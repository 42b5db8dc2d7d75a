"""Score transforms as Spark columns, and their forms over a group."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """The number, or null if it is not finite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def unit_by_logistic(x: Column) -> Column:
    """[0, 1] kept, else the logistic; 0.5 if not finite."""
    v = finite(x)
    return F.when(v.isNull(), F.lit(0.5)).when(v.between(0, 1), v).otherwise(1 / (1 + F.exp(-v)))


def unit_by_shift(x: Column) -> Column:
    """As above, but [-1, 0) is shifted to (s + 1) / 2."""
    v = finite(x)
    return F.when(v.isNull(), F.lit(0.5)).when(v.between(0, 1), v).when(v.between(-1, 1), 0.5 * (v + 1)).otherwise(1 / (1 + F.exp(-v)))


def scaled_log_odds(x: Column, temperature: float) -> Column:
    u = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), unit_by_logistic(x)))
    return F.log(u / (1 - u)) / max(1e-3, temperature)


def calibrated(p: Column, scale: float = 1.0, bias: float = 0.0) -> Column:
    u = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return 1 / (1 + F.exp(-(F.log(u / (1 - u)) * scale + bias)))


def gaussian(residual: Column, sigma: float) -> Column:
    """The normal density; 0 for a scale that is not positive."""
    if sigma <= 0:
        return F.lit(0.0)
    return F.exp(-0.5 * F.pow(residual / sigma, F.lit(2))) / (sigma * F.sqrt(2 * F.pi()))


#: The public polynomials of the modified Bessel function I0, below and above 3.75.
BESSEL_SMALL = (1.0, 3.5156229, 3.0899424, 1.2067492, 0.2659732, 0.0360768, 0.0045813)
BESSEL_LARGE = (0.39894228, 0.01328592, 0.00225319, -0.00157565, 0.00916281, -0.02057706, 0.02635537, -0.01647633, 0.00392377)


def bessel_i0(x: Column) -> Column:
    def poly(y: Column, coefficients) -> Column:
        out = F.lit(0.0)
        for c in reversed(coefficients):
            out = out * y + c
        return out

    ax = F.abs(x)
    small, large = poly(F.pow(x / 3.75, F.lit(2)), BESSEL_SMALL), F.exp(ax) / F.sqrt(ax) * poly(3.75 / ax, BESSEL_LARGE)
    return F.when(ax < 3.75, small).otherwise(large)


def von_mises(angle_rad: Column, kappa: Column) -> Column:
    return F.when(kappa <= 0, 1 / (2 * F.pi())).otherwise(F.exp(kappa * F.cos(angle_rad)) / (2 * F.pi() * bessel_i0(kappa)))


def histogram_similarity(a: Column, b: Column) -> Column:
    """Cosine mapped to [0, 1]; 0.5 for empty or unlike shapes, 0.25 if only one has mass."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    unlike = (F.size(a) == 0) | (F.size(a) != F.size(b)) | ((na <= 1e-12) & (nb <= 1e-12))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * (dot(a, b) / F.greatest(F.lit(1e-12), na * nb) + 1)))
    return F.when(unlike, F.lit(0.5)).when((na <= 1e-12) | (nb <= 1e-12), F.lit(0.25)).otherwise(score)


def histogram_entropy(h: Column) -> Column:
    """0 to 1 relative to an even histogram; 1 without mass, 0 for a single bin."""
    total = F.aggregate(h, F.lit(0.0), lambda s, x: s + x.cast("double"))
    term = lambda s, x: s - F.when(x / total > 1e-12, x / total * F.log(x / total)).otherwise(F.lit(0.0))
    value = F.aggregate(h, F.lit(0.0), term) / F.log(F.size(h).cast("double"))
    return F.when((F.size(h) == 0) | (total <= 1e-12), F.lit(1.0)).when(F.size(h) == 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def histogram_concentration(h: Column) -> Column:
    """1 less the relative entropy: 1 for a single bin's mass, 0 for an even histogram or none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - histogram_entropy(h)))


def by_group(keys: list[str]):
    return Window.partitionBy(*keys)


def softmax(logit: str, keys: list[str]) -> Column:
    w = by_group(keys)
    e = F.exp(F.col(logit) - F.max(logit).over(w))
    return e / F.sum(e).over(w)


def minmax(score: str, keys: list[str]) -> Column:
    """0.5 throughout a flat group."""
    w = by_group(keys)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi - lo < 1e-9, F.lit(0.5)).otherwise((F.col(score) - lo) / (hi - lo))


def zscore_logistic(score: str, keys: list[str]) -> Column:
    w = by_group(keys)
    mean, std = F.avg(score).over(w), F.stddev_pop(score).over(w)
    return F.when(std < 1e-6, F.lit(0.5)).otherwise(1 / (1 + F.exp(-(F.col(score) - mean) / std)))


def rank_decay(score: str, keys: list[str], ties: list[Column]) -> Column:
    w = by_group(keys)
    rank = F.row_number().over(w.orderBy(F.col(score).desc(), *ties)) - 1
    return F.exp(-rank / F.greatest(F.lit(1.0), F.count(F.lit(1)).over(w) / 3.0))


def scaled_by_peak(value: str, keys: list[str], floor: float = 1e-3) -> Column:
    peak = F.max(value).over(by_group(keys))
    return F.when(peak <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(floor), F.least(F.lit(1.0), F.col(value) / peak)))


def source_family(match_id: str) -> Column:
    """exif, geoclip, retrieval:<source> (three parts or more), else retrieval. Case-sensitive."""
    m = F.coalesce(F.col(match_id), F.lit(""))
    name = F.trim(F.get(F.split(m, ":"), 1))
    return (
        F.when(m.startswith("exif:"), "exif")
        .when((m == "geoclip") | m.startswith("geoclip:"), "geoclip")
        .when(m.startswith("retrieval:") & (F.size(F.split(m, ":")) >= 3) & (name != ""), F.concat(F.lit("retrieval:"), name))
        .otherwise("retrieval")
    )
