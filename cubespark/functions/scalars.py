"""Scalar functions: guarded logarithms, clock arithmetic, classes, projections and keyed random draws.

Nulls stay null everywhere; the logarithm of zero or less is null, as there is no missing value but null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(x), x)


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def log2_plus_one(x: Column) -> Column:
    return log2(1 + x)


def log10_plus_one(x: Column) -> Column:
    return log10(1 + x)


def ln_plus_one(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x))


def binarise(x: Column, above: float = 1.0) -> Column:
    return F.coalesce((x > above).cast("int"), F.lit(0))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded for output, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def seconds_of(clock: Column) -> Column:
    """Seconds since midnight of an 'HH:mm:ss' string."""
    part = F.split(clock, ":")
    return part[0].cast("int") * 3600 + part[1].cast("int") * 60 + part[2].cast("int")


def clock_of(seconds: Column) -> Column:
    """'HH:mm:ss' of seconds since midnight; whole days are dropped."""
    s = F.pmod(seconds.cast("long"), F.lit(86400))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def cyclic_seconds(seconds: Column, reference: str) -> Column:
    """Seconds after the reference clock: an earlier time of day belongs to the next day."""
    h, m, s = map(int, reference.split(":"))
    return F.pmod(seconds - (h * 3600 + m * 60 + s), F.lit(86400))


def slot_to_clock(slot: Column, slot_minutes: int, reference: str) -> Column:
    """The clock minute of a fractional slot, on a one-minute grid, halves to even."""
    h, m, s = map(int, reference.split(":"))
    return clock_of((h * 3600 + m * 60 + s) + F.bround(slot * slot_minutes) * 60)


def suffix(x: Column, mark: str = ".") -> Column:
    return F.substring_index(x, mark, -1)


def interval_class(x: Column, edges: list[Column], labels: list[str]) -> Column:
    """The label of the right-closed interval in which x lies; the outer intervals are open-ended. Null gives null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(x <= edge, label)
    return out.otherwise(labels[-1])


def equal_width_bin(x: Column, low: Column, high: Column, n: int) -> Column:
    """1-based equal-width bin; the upper end belongs to the last bin."""
    return F.least(F.width_bucket(x, low, high, F.lit(n)), F.lit(n).cast("long"))


def uniform(*key: Column | str, word: int = 0) -> Column:
    """A uniform draw in (0, 1) from the MD5 of the key's parts, joined by ':'. ``word`` 0 to 3 gives independent draws."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") if isinstance(k, Column) else F.lit(k) for k in key]).cast("binary"))
    part = F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("bigint")
    return (part + 0.5) / 4294967296.0


def standard_normal(*key: Column | str) -> Column:
    """A standard normal draw by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(*key))) * F.cos(2 * math.pi * uniform(*key, word=1))


def clamped_normal(mean: Column, deviation: Column, *key: Column | str, least: float = 0.001) -> Column:
    return F.greatest(mean + deviation * standard_normal(*key), F.lit(least))


# Fixed values of the Lambert-93 projection (EPSG:2154) on GRS80.
_E = 0.0818191910428158
_N, _C = 0.7256077650532670, 11754255.426096
_XS, _YS = 700000.0, 12655612.049876
_LON0 = math.radians(3)


def lambert93(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metric (x, y) of degrees of longitude and latitude."""
    phi = F.radians(lat)
    s = _E * F.sin(phi)
    iso = F.log(F.tan(math.pi / 4 + phi / 2)) - (_E / 2) * F.log((1 + s) / (1 - s))
    r, angle = _C * F.exp(-_N * iso), _N * (F.radians(lon) - _LON0)
    return _XS + r * F.sin(angle), _YS - r * F.cos(angle)
