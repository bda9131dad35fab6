"""Column expressions for integer, complex and tolerance arithmetic.

Complex values travel as a pair of columns ``(re, im)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

INT32_MIN = -(2 ** 31)


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))


def idiv(x, n) -> Column:
    """Exact integer division for operands of the same sign."""
    return F.call_function("div", _c(x), _c(n))


def floor_div(x, n) -> Column:
    """Floor division that stays exact above 2**53 and for negatives."""
    x = _c(x)
    return idiv(x - F.pmod(x, _c(n)), n)


# --- complex -----------------------------------------------------------------

def cmul(ar, ai, br, bi) -> tuple[Column, Column]:
    ar, ai, br, bi = map(_c, (ar, ai, br, bi))
    return ar * br - ai * bi, ar * bi + ai * br


def cmul_conj(ar, ai, br, bi) -> tuple[Column, Column]:
    """a * conj(b)."""
    ar, ai, br, bi = map(_c, (ar, ai, br, bi))
    return ar * br + ai * bi, ai * br - ar * bi


def conj(re, im) -> tuple[Column, Column]:
    return _c(re), -_c(im)


def power(re, im) -> Column:
    re, im = _c(re), _c(im)
    return re * re + im * im


def magnitude(re, im) -> Column:
    return F.hypot(_c(re).cast("double"), _c(im).cast("double"))


def angle(re, im) -> Column:
    return F.atan2(_c(im).cast("double"), _c(re).cast("double"))


def inverse_gain(re, im, keep_tiny: bool = False) -> tuple[Column, Column]:
    """conj(g)/|g|^2, so that applying a gain is a multiplication.

    A gain below 1e-12 in squared magnitude becomes identity.  The canonical
    loader (``keep_tiny``) only skips the division and keeps the tiny value.
    """
    re, im = _c(re).cast("double"), _c(im).cast("double")
    mag = power(re, im)
    tiny = mag < F.lit(1e-12)
    if keep_tiny:
        return (F.when(tiny, re).otherwise(re / mag), F.when(tiny, -im).otherwise(-im / mag))
    return F.when(tiny, 1.0).otherwise(re / mag), F.when(tiny, 0.0).otherwise(-im / mag)


# --- integers, quantising, indices ---------------------------------------------

def nearest_multiple(x, k: int) -> tuple[Column, Column]:
    """Closest multiple of ``k`` (halves away from zero) and the remainder."""
    x = _c(x).cast("long")
    half = idiv(F.abs(x) * 2 + k, 2 * k) * k
    closest = F.when(x < 0, -half).otherwise(half)
    return closest, x - closest


def quantise_int8(x) -> Column:
    """Round half to even and clip to the range of a signed byte."""
    return F.greatest(F.least(F.rint(_c(x)), F.lit(127.0)), F.lit(-128.0)).cast("int")


def fft_shift_index(k, n: int) -> Column:
    return F.pmod(_c(k) + n // 2, F.lit(n))


def round_up_32(n) -> Column:
    return F.shiftleft(F.shiftright(_c(n) + 31, 5), 5)


def baseline_index(i, j) -> Column:
    """Packed upper triangle by column, i <= j."""
    i, j = _c(i), _c(j)
    return idiv(j * (j + 1), 2) + i


def baseline_receivers(b, n: int) -> tuple[Column, Column]:
    """Inverse of :func:`baseline_index` for an array of ``n`` receivers.

    Searches the exact table of column starts, so no square root can misplace
    an index.
    """
    b = _c(b)
    starts = F.array(*[F.lit(j * (j + 1) // 2) for j in range(n)])
    j = (F.size(F.filter(starts, lambda s: s <= b)) - 1).cast("int")
    return (b - idiv(j * (j + 1), 2)).cast("int"), j


def baseline_id(ant_i, ant_j) -> Column:
    """External id 256*a+b, or the int32 minimum when either antenna is absent."""
    a, b = _c(ant_i), _c(ant_j)
    return F.when((a < 0) | (b < 0), F.lit(INT32_MIN)).otherwise(a * 256 + b).cast("int")


def baseline_antennas(bid) -> tuple[Column, Column]:
    b = _c(bid)
    return floor_div(b, 256).cast("int"), F.pmod(b, F.lit(256)).cast("int")


def cycle_fraction(n, period) -> Column:
    """Fraction of a period in [0, 1), negatives wrap."""
    x = _c(n).cast("double") / F.lit(float(period))
    return x - F.floor(x)


# --- report arithmetic ---------------------------------------------------------

def log10_floor(x, eps: float = 1e-12) -> Column:
    return F.log10(F.greatest(_c(x).cast("double"), F.lit(eps)))


# Real-time requirement: packets per second for one channel of one FPGA, bytes per packet.
REALTIME_PACKETS = 15500
REALTIME_BYTES = 2660


def realtime_gbps(channels, fpgas) -> Column:
    return (_c(channels) * _c(fpgas)).cast("double") * REALTIME_PACKETS * REALTIME_BYTES / 1e9


def relative_change(base, current) -> Column:
    base, current = _c(base), _c(current)
    return F.when(base.isNull() | current.isNull(), F.lit(None).cast("double")).when(
        base == 0, F.lit(0.0)).otherwise((current - base) / base)


def is_regression(change, threshold: float = 0.05) -> Column:
    return F.coalesce(_c(change) < -threshold, F.lit(False))


# Microseconds per unit, as profilers spell the units (fixed values).
_UNIT_US = {"ns": 1e-3, "nsecond": 1e-3, "us": 1.0, "usecond": 1.0,
            "ms": 1e3, "msecond": 1e3, "s": 1e6, "second": 1e6}


def to_microseconds(value, unit) -> Column:
    """Scale to microseconds; an unknown unit leaves the value as it is."""
    table = F.create_map(*[F.lit(v) for kv in _UNIT_US.items() for v in kv])
    return _c(value) * F.coalesce(F.element_at(table, F.lower(F.trim(_c(unit)))), F.lit(1.0))


def within_tolerance(a, b, absolute: float, relative: float = 0.0) -> Column:
    a, b = _c(a), _c(b)
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.abs(b))


# --- sky frequency, phases -------------------------------------------------------

SPEED_OF_LIGHT = 299792458.0


def channel_frequency_hz(channel, base_hz: float, bandwidth_hz: float) -> Column:
    return F.lit(float(base_hz)) + _c(channel).cast("double") * float(bandwidth_hz)


def mjd_utc(ts) -> Column:
    """Modified Julian date; the Unix epoch is 40587."""
    return F.lit(40587.0) + F.unix_micros(_c(ts).cast("timestamp")).cast("double") / 86400e6


def phasor(phase) -> tuple[Column, Column]:
    return F.cos(phase), F.sin(phase)


def steering_phase(freq_hz, l, m, n, east, north, up) -> Column:
    path = _c(l) * _c(east) + _c(m) * _c(north) + _c(n) * _c(up)
    return _c(freq_hz) * (-2.0 * math.pi / SPEED_OF_LIGHT) * path


def fine_delay_phase(k, n: int, coarse_hz, bandwidth_hz: float, delay_ns) -> Column:
    """Phase of fine bin ``k`` of ``n``; the upper half counts as negative offsets."""
    k = _c(k)
    signed = F.when(k < n // 2, k).otherwise(k - n).cast("double")
    freq = _c(coarse_hz) + signed / n * float(bandwidth_hz)
    return freq * (-2.0 * math.pi) * (_c(delay_ns) * 1e-9)
