"""Prosody arithmetic on columns: adjustments from measurements, calibration, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lo: float | Column, hi: float | Column) -> Column:
    """Null stays null."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.when(c.isNotNull(), F.least(F.greatest(c, as_col(lo)), as_col(hi)))


def pitch_percent(pitch: Column, base: Column, semitones: float = 1.3, lower: float = 0.7) -> Column:
    """M1: distance to the base in semitones, clipped to [-semitones * lower, semitones], as a percentage; 0 if unvoiced."""
    st = clip(12 * F.log2(pitch / base), -semitones * lower, semitones)
    return F.when((pitch > 0) & (base > 0), (F.pow(F.lit(2.0), st / 12) - 1) * 100).otherwise(0.0)


def volume_percent(base_db: Column, db: Column, limit: float = 10.0) -> Column:
    """M2."""
    return clip((F.pow(F.lit(10.0), (base_db - db) / 20) - 1) * 100, -limit, limit)


def rate_percent(words: Column, natural_s: Column, synthetic_s: Column, limit: float = 10.0, threshold_s: float = 1.0, floor_per_s: float = 2.0) -> Column:
    """M3: relative rate, amplified for slowing down and damped for speeding up in chunks beyond one
    second, minus a floor that grows with length; limits are lopsided beyond five seconds."""
    raw = F.when(words > 0, (synthetic_s / natural_s - 1) * 100).otherwise(0.0)
    slow, fast = F.when(natural_s <= 1, 1.0).otherwise(F.pow(natural_s, F.lit(1.5))), F.when(natural_s <= 1, 1.0).otherwise(F.sqrt(natural_s))
    scaled = F.when(raw < 0, raw * slow).otherwise(raw / fast) - F.greatest(F.lit(0.0), natural_s - threshold_s) * floor_per_s
    return clip(scaled, F.when(natural_s > 5, -limit * 1.5).otherwise(-limit), F.when(natural_s > 5, limit * 0.5).otherwise(limit))


def rate_ratio(words: Column, natural_s: Column, synthetic_s: Column) -> Column:
    """M4: 1 where there is nothing to compare."""
    return F.when((words > 0) & (synthetic_s > 0) & (natural_s > 0), synthetic_s / natural_s).otherwise(1.0)


def speaking_seconds(part_s: Column, pause_s: Column) -> Column:
    """M5."""
    return F.greatest(part_s - pause_s, F.lit(1e-4))


def pitch_difference_percent(natural: Column, synthetic: Column, is_pause: Column, limit: float = 100.0) -> Column:
    """M6: 0 for pauses and a synthetic pitch of 0."""
    return F.when(~is_pause & (synthetic != 0), clip((natural - synthetic) / synthetic * 100, -limit, limit)).otherwise(0.0)


def relative_pitch_percent(natural: Column, synthetic: Column, mean_natural: Column, mean_synthetic: Column) -> Column:
    """M7: (synthetic / its mean) over (natural / its mean), minus one; 0 where any of them is 0."""
    ok = (natural != 0) & (synthetic != 0) & (mean_natural != 0) & (mean_synthetic != 0)
    return F.when(ok, ((synthetic / mean_synthetic) / (natural / mean_natural) - 1) * 100).otherwise(0.0)


def rms_decibel(samples: Column, eps: float = 1e-6) -> Column:
    """M8: loudness of an array of samples; null for null and empty arrays."""
    mean = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x) / F.size(samples)
    return F.when(F.size(samples) > 0, 20 * F.log10(F.greatest(F.sqrt(mean), F.lit(eps))))


def loudness_percent(natural_db: Column, synthetic_db: Column, limit: float = 20.0) -> Column:
    """M8: relative difference of levels, clipped."""
    return F.when(synthetic_db != 0, clip((natural_db - synthetic_db) / F.abs(synthetic_db) * 100, -limit, limit)).otherwise(0.0)


def words_per_minute(words: Column, seconds: Column) -> Column:
    """M9: 0 without a duration."""
    return F.when(seconds > 0, words / (seconds / 60)).otherwise(0.0)


def rate_difference_percent(natural: Column, synthetic: Column, limit: float = 100.0) -> Column:
    """M9."""
    return F.when(synthetic != 0, clip((natural - synthetic) / synthetic * 100, -limit, limit)).otherwise(0.0)


def calibration_percent(natural: Column, synthetic: Column) -> Column:
    """(natural / synthetic - 1) in percent within [-50, 100]."""
    return F.when(synthetic > 0, clip((natural / synthetic - 1) * 100, -50, 100)).otherwise(0.0)


def damped_rate(rate: Column, cap: float = 2.0) -> Column:
    """Sign * |rate|^0.8, at most `cap`; null counts as 0."""
    r = F.coalesce(rate, F.lit(0.0))
    return F.least(F.signum(r) * F.pow(F.abs(r), F.lit(0.8)), F.lit(cap))


def damped_pitch(pitch: Column) -> Column:
    """Sign * sqrt |pitch|; null counts as 0."""
    p = F.coalesce(pitch, F.lit(0.0))
    return F.signum(p) * F.sqrt(F.abs(p))


def short_pause_ms(seconds: Column, divisor: float = 3.0, factor: float = 1.0, least: int = 1, most: int = 500) -> Column:
    """A pause in milliseconds over `divisor`, within limits; `most` where it is missing or 0."""
    ms = seconds * 1000 / divisor * factor
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds == 0), F.lit(most)).otherwise(F.floor(clip(ms, least, most))).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Null if an array is empty or of length 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.try_divide(dot, norm(a) * norm(b))


def voiced_median(f0: Column) -> Column:
    """Median of the voiced (above 0) frames of an array, 0 if there is none."""
    v = F.array_sort(F.filter(f0, lambda x: x > 0))
    n = F.size(v)
    mid = (F.element_at(v, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int")) + F.element_at(v, F.greatest(F.floor(n / 2) + 1, F.lit(1)).cast("int"))) / 2
    return F.when(n > 0, mid).otherwise(0.0)


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def every_kth(a: Column, k: int) -> Column:
    """Every k-th element of an array, from the first."""
    return F.filter(a, lambda x, i: i % k == 0)
