"""Scalar Column functions (inventory I1-I13). Pure JVM expressions, no UDFs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from journeyflow.schema import PROB_EPS, RATIO_EPS, SECONDS_PER_DAY, US_PER_DAY, US_PER_SEC

__all__ = [
    "col_",
    "seconds_between",
    "days_between",
    "calendar_parts",
    "cyclic",
    "log1p",
    "signed_log1p",
    "ceil_days",
    "safe_ratio",
    "clip_prob",
    "month_key",
    "hash_uniform",
    "hash_uniform_pair",
    "strip_prefix",
    "linspace",
    "sigmoid",
    "softmax2",
]


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_between(end_us: str | Column, start_us: str | Column, whole: bool = True, clamp: bool = True) -> Column:
    """Seconds from start to end. ``whole`` truncates toward zero like an integer duration."""
    diff = (col_(end_us) - col_(start_us)).cast("long")
    if whole:
        # remainder has the sign of the dividend, so this truncates toward zero
        out = ((diff - diff % F.lit(US_PER_SEC)) / F.lit(US_PER_SEC)).cast("long")
    else:
        out = diff / F.lit(float(US_PER_SEC))
    return F.greatest(out, F.lit(0)) if clamp else out


def days_between(end_us: str | Column, start_us: str | Column, clamp: bool = True) -> Column:
    """Fractional days between two microsecond instants (clamped at 0)."""
    out = (col_(end_us) - col_(start_us)) / F.lit(float(US_PER_DAY))
    return F.greatest(out, F.lit(0.0)) if clamp else out


def calendar_parts(ts: str | Column, prefix: str = "") -> list[Column]:
    """Hour, weekday (0 = Monday), month, day of year of a timestamp (UTC session)."""
    t = col_(ts)
    return [
        F.hour(t).alias(f"{prefix}hour"),
        F.weekday(t).alias(f"{prefix}weekday"),
        F.month(t).alias(f"{prefix}month"),
        F.dayofyear(t).alias(f"{prefix}dayofyear"),
    ]


def cyclic(value: str | Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) encoding of a periodic value."""
    angle = F.lit(2.0 * math.pi) * col_(value) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def log1p(value: str | Column) -> Column:
    """I4."""
    return F.log1p(col_(value).cast("double"))


def signed_log1p(value: str | Column) -> Column:
    """I4: sign(x) * log1p(|x|)."""
    v = col_(value).cast("double")
    return F.signum(v) * F.log1p(F.abs(v))


def ceil_days(seconds: str | Column) -> Column:
    """Whole days rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(col_(seconds) / F.lit(float(SECONDS_PER_DAY))).cast("int"))


def safe_ratio(num: str | Column, den: str | Column, eps: float = RATIO_EPS) -> Column:
    """Num / (den + eps)."""
    return col_(num).cast("double") / (col_(den).cast("double") + F.lit(eps))


def clip_prob(p: str | Column, eps: float = PROB_EPS) -> Column:
    """Clip a probability to [eps, 1 - eps]."""
    return F.least(F.greatest(col_(p).cast("double"), F.lit(eps)), F.lit(1.0 - eps))


def month_key(ts: str | Column) -> Column:
    """I8: month key ``YYYY-M<m>``."""
    t = col_(ts)
    return F.concat(F.year(t).cast("string"), F.lit("-M"), F.month(t).cast("string"))


def hash_uniform(key: str | Column, seed: int | str | Column) -> Column:
    """Stable uniform in [0, 1) from (key, seed).

    First 32 bits of md5(key || '|' || seed) / 2^32; DuckDB computes the same value from
    ``('0x' || substr(md5(x), 1, 8))::BIGINT / 4294967296.0``.
    """
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat(col_(key).cast("string"), F.lit("|"), s.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_uniform_pair(key: str | Column, seed: int) -> tuple[Column, Column]:
    """Two independent uniforms from (key, seed): the first and second 32-bit words of one md5."""
    text = F.concat(col_(key).cast("string"), F.lit("|"), F.lit(str(seed)))
    h = F.md5(text)
    u1 = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    u2 = F.conv(F.substring(h, 9, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return u1, u2


def strip_prefix(name: str | Column, prefix: str) -> Column:
    """Remove a leading prefix when present."""
    c = col_(name)
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def linspace(lo: str | Column, hi: str | Column, n: int) -> Column:
    """Array of ``n`` evenly spaced doubles from lo to hi (both ends included)."""
    lo_c, hi_c = col_(lo).cast("double"), col_(hi).cast("double")
    if n == 1:
        return F.array(lo_c)
    step = (hi_c - lo_c) / F.lit(float(n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo_c + i.cast("double") * step)


def sigmoid(x: str | Column) -> Column:
    """I13."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_(x).cast("double")))


def softmax2(a: str | Column, b: str | Column) -> Column:
    """Probability of the second class from two logits, computed stably."""
    return sigmoid(col_(b) - col_(a))
