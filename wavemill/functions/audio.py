"""Decoded signals and frames as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_or_cut(x: Column, length: int) -> Column:
    """Exactly length samples: cut, or filled with zeros."""
    return F.concat(F.slice(x, 1, length), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(length) - F.size(x), F.lit(0))))


def at_least(x: Column, length: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(length) - F.size(x), F.lit(0))))


def chunks(x: Column, length: int, keep_rest: bool = True) -> Column:
    """Array of consecutive pieces; the rest is padded, or dropped."""
    n = F.ceil(F.size(x) / length) if keep_rest else F.floor(F.size(x) / length)
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0))), lambda i: pad_or_cut(F.slice(x, i * length + 1, length), length))
    return F.when(n > 0, pieces).otherwise(F.array().cast("array<array<float>>"))


def second_label(i: Column, minutes: bool = False) -> Column:
    end = ":00" if minutes else ""
    return F.concat(i.cast("string"), F.lit(end + "-"), (i + 1).cast("string"), F.lit(end))


def mono(channels: Column) -> Column:
    """Mean over the channels (array of arrays)."""
    n = F.size(channels)
    total = F.aggregate(F.slice(channels, 2, 1 << 30), F.transform(channels[0], lambda x: x.cast("double")), lambda s, c: F.zip_with(s, c, lambda a, b: a + b))
    return F.transform(total, lambda x: x / n)


def resample(x: Column, source: int, target: int) -> Column:
    """Linear interpolation to another rate."""
    n = F.floor(F.size(x) * F.lit(target) / F.lit(source)).cast("int")

    def at(i):
        p = i * (source / target)
        low = F.floor(p).cast("int")
        a, b = F.get(x, low), F.coalesce(F.get(x, low + 1), F.get(x, low))
        return a + (b - a) * (p - low)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)).otherwise(F.array().cast("array<double>"))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def scaled(x: Column, factor: float = 32768.0) -> Column:
    return F.transform(x, lambda v: v * factor)


def valid_audio(x: Column, rate: int, shortest: float = 0.1, longest: float = 300.0, quiet: float = 0.001) -> Column:
    """Not empty, all finite, of a fitting duration and loud enough."""
    seconds = F.size(x) / rate
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (F.size(x) > 0) & ~bad & seconds.between(shortest, longest) & (peak(x) >= quiet)


def silent(x: Column, shortest: int = 400) -> Column:
    return (F.size(x) <= shortest) | F.forall(x, lambda v: v == 0)


def bright_frames(means: Column) -> Column:
    return F.filter(means, lambda m: m > 1)


def frame_indices(frames: Column, fps: Column, most: int = 4) -> Column:
    """Which frames to look at: two at the thirds of a clip under 2 seconds, else up to most spread over the whole."""
    seconds = frames / fps
    n = F.least(F.lit(most), F.ceil(seconds).cast("int"))
    step = F.when(n > 1, frames / F.nullif(n - 1, F.lit(0))).otherwise(0.0)
    spread = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.least((i * step).cast("int"), frames.cast("int")))
    return F.when(seconds < 2, F.array((frames / 3).cast("int"), (frames * 2 / 3).cast("int"))).otherwise(spread)


def even_indices(frames: Column, count: int = 8) -> Column:
    """count whole positions from 0 to frames - 1 at even distances."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: (i * (frames - 1) / F.lit(max(count - 1, 1))).cast("int"))
