"""Column functions: normalisation, log-space edits, radii, kernels, entropy.

Every function takes and returns Columns, so the whole expression stays in
generated code.  A missing pixel is NULL and stays NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.constants import NODATA


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sigmoid_normalise(x: Column, midpoint: float = -20.0, temperature: float = 0.18) -> Column:
    return sigmoid((x - F.lit(float(midpoint))) * F.lit(float(temperature)))


def cube_root_normalise(x: Column) -> Column:
    return F.cbrt(x)


def linear_normalise(x: Column, mean: float, std: float, max_value: float = 1.0) -> Column:
    return (x - F.lit(float(mean)) * F.lit(float(max_value))) / F.lit(float(std) * float(max_value))


def in_log_space(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Run ``fn`` on ``10**x`` and bring the result back to decades."""

    def wrapped(x: Column) -> Column:
        return safe_log10(fn(F.pow(F.lit(10.0), x)))

    return wrapped


def safe_log10(x: Column) -> Column:
    """log10 that gives NULL, not an error or NaN, outside its domain."""
    return F.when(x > 0, F.log10(x))


def brightness_contrast(x: Column, alpha: Column | float, beta: Column | float, log_space: bool = True) -> Column:
    """``alpha*x + beta`` without clipping; missing pixels stay missing."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    beta = beta if isinstance(beta, Column) else F.lit(float(beta))

    def edit(v: Column) -> Column:
        return v * alpha + beta

    return in_log_space(edit)(x) if log_space else edit(x)


def uniform_hash(*keys: Column) -> Column:
    """Uniform number in [0, 1) fixed by its keys, whatever the partitioning.

    The first 52 bits of the MD5 of the keys as text, joined by bars: any SQL engine gives the same number.
    """
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def normal_hash(*keys: Column) -> Column:
    """Standard normal number fixed by its keys (Box-Muller on two hashed uniforms)."""
    u1 = F.greatest(uniform_hash(*keys, F.lit("u1")), F.lit(1e-16))
    u2 = uniform_hash(*keys, F.lit("u2"))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def gauss_noise(x: Column, mean: float, var: float, *keys: Column) -> Column:
    """Add noise of the given mean and variance, one draw per key, without clipping."""
    return x + F.lit(float(mean)) + F.lit(math.sqrt(var)) * normal_hash(*keys)


def nodata_to_null(x: Column, nodata: float = NODATA) -> Column:
    return F.when(x != F.lit(nodata), x)


def null_to_zero(x: Column) -> Column:
    """Missing, NaN and infinite pixels become 0."""
    finite = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    return F.coalesce(finite, F.lit(0.0))


def band_difference(vv: Column, vh: Column) -> Column:
    return vv - vh


def band_mean(vv: Column, vh: Column) -> Column:
    return (vv + vh) / F.lit(2.0)


def range_rescale(x: Column, lo: Column, hi: Column, top: float = 255.0) -> Column:
    """``(x-lo)/(hi-lo)*top``; a missing pixel or an empty range gives 0."""
    return F.coalesce(F.try_divide(x - lo, hi - lo) * F.lit(float(top)), F.lit(0.0))


def length_to_log(x: Column) -> Column:
    return F.log(x + F.lit(1.0))


def log_to_length(x: Column) -> Column:
    return F.exp(F.greatest(x, F.lit(0.0))) - F.lit(1.0)


# --- kernels -----------------------------------------------------------------

# double precision machine epsilon: kernel values below it (times the peak) are cut to zero
DOUBLE_EPS = 2.220446049250313e-16
# single precision machine epsilon
FLOAT_EPS = 1.1920928955078125e-07
# 3x3 kernel of a point object: corner, edge and centre value
POINT_KERNEL = {2: 0.5, 1: 0.75, 0: 1.0}


def gaussian_value(dx: Column, dy: Column, sigma: Column) -> Column:
    """Round Gaussian at an offset, with its tiny tail cut to zero (the peak is 1)."""
    g = F.exp(-(dx * dx + dy * dy) / (F.lit(2.0) * sigma * sigma))
    return F.when(g < F.lit(DOUBLE_EPS), F.lit(0.0)).otherwise(g)


def disk_value(dx: Column, dy: Column, radius: Column, value: Column) -> Column:
    return F.when(dx * dx + dy * dy <= radius * radius, value).otherwise(F.lit(0.0))


def point_value(dx: Column, dy: Column) -> Column:
    ring = F.abs(dx) + F.abs(dy)
    inside = F.greatest(F.abs(dx), F.abs(dy)) <= 1
    value = F.when(ring == 0, POINT_KERNEL[0]).when(ring == 1, POINT_KERNEL[1]).otherwise(POINT_KERNEL[2])
    return F.when(inside, value).otherwise(F.lit(0.0))


def oval_gaussian_value(x: Column, y: Column, size_x: Column, size_y: Column, alpha: float) -> Column:
    """Gaussian with its own width per axis, centred at ``size // 2``, sigma ``alpha*size/6``."""
    mx, my = F.floor(size_x / 2), F.floor(size_y / 2)
    sx, sy = F.lit(alpha) * size_x / F.lit(6.0), F.lit(alpha) * size_y / F.lit(6.0)
    px, py = (x - mx).cast("double"), (y - my).cast("double")
    g = F.exp(-(px * px / (F.lit(2.0) * sx * sx) + py * py / (F.lit(2.0) * sy * sy)))
    return F.when(g < F.lit(FLOAT_EPS), F.lit(0.0)).otherwise(g)


def gaussian_radius(height: Column, width: Column, min_overlap: float = 0.7) -> Column:
    """Smallest of three radii for a wanted overlap, rounded up, at least 1.

    Each case (one corner in, both in, both out) is ``(b + sqrt(b^2 - 4ac)) / 2``.
    """

    def root(a: float, b: Column, c: Column) -> Column:
        return (b + F.sqrt(b * b - F.lit(4.0 * a) * c)) / F.lit(2.0)

    o = float(min_overlap)
    total, area = (height + width).cast("double"), (height * width).cast("double")
    one_in = root(1.0, total, area * F.lit((1 - o) / (1 + o)))
    both_in = root(4.0, total * 2, area * F.lit(1 - o))
    both_out = root(4.0 * o, total * F.lit(-2 * o), area * F.lit(o - 1))
    return F.greatest(F.lit(1), F.ceil(F.least(one_in, both_in, both_out))).cast("bigint")


def aspect_angle(width: Column, height: Column) -> Column:
    """45 degrees times the aspect ratio, measured from the longer side."""
    angle = F.lit(45.0) * F.least(width, height) / F.greatest(width, height)
    return F.when(width > height, F.lit(90.0) - angle).otherwise(angle)


def bisector_radius(width: Column, height: Column, min_overlap: float = 0.5) -> Column:
    """Radius from the box's aspect angle, rounded up, at least 1."""
    phi = F.radians(aspect_angle(width, height))
    a = F.sin(phi) * F.cos(phi)
    b = -(width * F.sin(phi) + height * F.cos(phi))
    c = width * height * F.lit((1 - min_overlap) / (1 + min_overlap))
    r = -(b + F.sqrt(b * b - F.lit(4.0) * a * c)) / (F.lit(2.0) * a)
    return F.greatest(F.lit(1), F.ceil(r)).cast("bigint")


def binary_entropy(logit: Column) -> Column:
    """Uncertainty of a yes/no score: ``-(p ln p + (1-p) ln(1-p))`` of its sigmoid."""
    soft = F.log1p(F.exp(-F.abs(logit)))
    log_p = -(F.greatest(-logit, F.lit(0.0)) + soft)
    log_q = -(F.greatest(logit, F.lit(0.0)) + soft)
    p = sigmoid(logit)
    return -(p * log_p + (F.lit(1.0) - p) * log_q)


def class_entropy(logits: Column) -> Column:
    """Uncertainty of a softmax over an array of logits."""
    top = F.array_max(logits)
    shifted = F.transform(logits, lambda v: v - top)
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, v: acc + F.exp(v))
    weighted = F.aggregate(shifted, F.lit(0.0), lambda acc, v: acc + F.exp(v) * v)
    return F.log(total) - weighted / total
