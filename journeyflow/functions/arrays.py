"""Array Column functions (inventory J1-J9). Higher-order built-ins only (``transform``, ``filter``...).

They act on one row's array, so they never move data between rows. Operators build
bounded arrays first (e.g. keep the last 128 steps) and only then call these.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from journeyflow.schema import US_PER_SEC
from journeyflow.functions.scalar import col_

__all__ = [
    "journey_ends",
    "journey_ids",
    "journey_gaps",
    "journey_elapsed",
    "any_event",
    "count_where",
    "prefix_before",
    "keep_last",
    "keep_first",
    "distinct_size",
    "pad",
    "pad_mask",
    "array_mean",
    "count_upto",
    "array_median",
    "array_text",
]


def journey_ends(j: str | Column, ts: str = "event_timestamp", ev: str = "ed_id") -> list[Column]:
    """Length, first / last event id and first / last timestamp of a journey array."""
    a = col_(j)
    return [
        F.size(a).alias("n_actions"),
        F.element_at(a, 1)[ev].alias("first_ed_id"),
        F.element_at(a, -1)[ev].alias("last_ed_id"),
        F.element_at(a, 1)[ts].alias("start_time"),
        F.element_at(a, -1)[ts].alias("end_time"),
    ]


def _us(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def journey_ids(j: str | Column, ev: str = "ed_id") -> Column:
    """Event ids of a journey array."""
    return F.transform(col_(j), lambda x: x[ev])


def journey_gaps(j: str | Column, ts: str = "event_timestamp") -> Column:
    """Whole seconds since the previous step, 0 for the first step."""
    a = col_(j)
    return F.transform(
        a,
        lambda x, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(
            _trunc_seconds(_us(x[ts]) - _us(F.element_at(a, i)[ts]))
        ),
    )


def journey_elapsed(j: str | Column, ts: str = "event_timestamp") -> Column:
    """Whole seconds since the first step."""
    a = col_(j)
    return F.transform(a, lambda x: _trunc_seconds(_us(x[ts]) - _us(F.element_at(a, 1)[ts])))


def _trunc_seconds(diff_us: Column) -> Column:
    return ((diff_us - diff_us % F.lit(US_PER_SEC)) / F.lit(US_PER_SEC)).cast("long")


def any_event(j: str | Column, event_id: int, ev: str = "ed_id") -> Column:
    """The journey contains the event."""
    return F.exists(col_(j), lambda x: x[ev] == F.lit(event_id))


def count_where(a: str | Column, pred) -> Column:
    """Number of elements satisfying ``pred`` (a Column -> Column lambda)."""
    return F.size(F.filter(col_(a), pred))


def prefix_before(a: str | Column, value: int) -> Column:
    """Elements before the first occurrence of ``value`` (all when absent)."""
    arr = col_(a)
    pos = F.array_position(arr, F.lit(value))
    return F.when(pos == 0, arr).otherwise(F.slice(arr, F.lit(1), (pos - 1).cast("int")))


def keep_last(a: str | Column, n: int) -> Column:
    """The last ``n`` elements."""
    arr = col_(a)
    return F.when(F.size(arr) > n, F.slice(arr, (F.size(arr) - n + 1).cast("int"), F.lit(n))).otherwise(arr)


def keep_first(a: str | Column, n: int) -> Column:
    """The first ``n`` elements."""
    return F.slice(col_(a), F.lit(1), F.lit(n))


def distinct_size(a: str | Column) -> Column:
    """J7."""
    return F.size(F.array_distinct(col_(a)))


def pad(a: str | Column, n: int, side: str = "right", value=0) -> Column:
    """Pad with ``value`` to length ``n`` on the given side (arrays longer than n are unchanged)."""
    arr = col_(a)
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(arr), F.lit(0)).cast("int"))
    return F.concat(arr, fill) if side == "right" else F.concat(fill, arr)


def pad_mask(a: str | Column, n: int, side: str = "right", real=1, padv=0) -> Column:
    """Mask of length n: ``real`` at real positions, ``padv`` at padding."""
    arr = col_(a)
    k = F.least(F.size(arr), F.lit(n)).cast("int")
    reals = F.array_repeat(F.lit(real), k)
    pads = F.array_repeat(F.lit(padv), (F.lit(n) - k).cast("int"))
    return F.concat(reals, pads) if side == "right" else F.concat(pads, reals)


def array_mean(a: str | Column) -> Column:
    """Mean of a numeric array (NULL when empty)."""
    arr = col_(a)
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(F.size(arr) > 0, total / F.size(arr))


def array_median(a: str | Column) -> Column:
    """Linear median of a numeric array (NULL when empty)."""
    s = F.array_sort(col_(a))
    n = F.size(s)
    lo = F.element_at(s, ((n + 1) / 2).cast("int")).cast("double")
    hi = F.element_at(s, (n / 2 + 1).cast("int")).cast("double")
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, lo).otherwise((lo + hi) / 2.0)


def array_text(a: str | Column, digits: int | None = None) -> Column:
    """Array as comma-joined text (rounded first) so two engines can compare it."""
    arr = col_(a)
    if digits is not None:
        arr = F.transform(arr, lambda x: F.round(x.cast("double"), digits))
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")


def count_upto(values: str | Column, x: Column, most: int) -> Column:
    """How many elements of a sorted array are at most ``x``, by binary search; ``most`` bounds the array's size."""
    a = F.col(values) if isinstance(values, str) else values
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(most, 1).bit_length()))])
    n = F.size(a)

    def step(at: Column, more: Column) -> Column:
        return F.when((at + more <= n) & (F.get(a, at + more - 1) <= x), at + more).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)
