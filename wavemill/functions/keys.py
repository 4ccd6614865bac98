"""Clip keys: 'id (start-end)' with dots written as underscores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_text(x: Column) -> Column:
    """Text of a double in the form the keys use: 1.0, 0.0005, 1e-05, 10000000.0, 1e+16. Its digits are those of the JVM,
    which before version 19 writes a digit too many for a few values far beyond any time of a clip."""
    text = x.cast("string")
    mantissa = F.regexp_extract(text, r"\A(-?\d+\.\d+)E", 1)
    exponent = F.regexp_extract(text, r"E(-?\d+)\z", 1).try_cast("int")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(mantissa, r"[-.]", ""), r"0+\z", ""), r"\A\z", "0")
    n = F.length(digits)
    large = F.when(n > exponent + 1, F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, n))).otherwise(
        F.concat(F.rpad(digits, exponent + 1, F.lit("0")), F.lit(".0"))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    short = F.when(n > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(digits)
    far = F.concat(short, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    plain = F.when((exponent >= 0) & (exponent < 16), large).when((exponent < 0) & (exponent >= -4), small).otherwise(far)
    return F.when(F.isnan(x), "nan").when(text.contains("Infinity"), F.concat(sign, F.lit("inf"))).when(mantissa == "", text).otherwise(F.concat(sign, plain))


def clip_key(video_id: Column, start: Column, end: Column) -> Column:
    return F.concat(video_id, F.lit(" ("), F.replace(float_text(start), F.lit("."), F.lit("_")), F.lit("-"), F.replace(float_text(end), F.lit("."), F.lit("_")), F.lit(")"))


def clean_member(name: Column) -> Column:
    """A member name without 'tar/' and '.mp4', dots of its times as underscores."""
    name = F.when(name.startswith("tar/"), F.substring(name, 5, 1 << 30)).otherwise(name)
    name = F.when(name.endswith(".mp4"), F.substring(name, F.lit(1), F.length(name) - 4)).otherwise(name)
    return F.replace(name, F.lit("."), F.lit("_"))


def parse_clip(name: Column) -> Column:
    """struct(video_id, start, end) of a key or file name; its parts are null if it has another form."""
    form = r"\A(.+) \((\d+(?:[._]\d+)?)-(\d+(?:[._]\d+)?)\)(?:\.\w+)?\z"
    part = lambda i: F.replace(F.regexp_extract(name, form, i), F.lit("_"), F.lit(".")).try_cast("double")
    return F.struct(F.when(name.rlike(form), F.regexp_extract(name, form, 1)).alias("video_id"), part(2).alias("start"), part(3).alias("end"))


def section(start: Column, end: Column) -> Column:
    """Section argument of a downloader."""
    return F.format_string("*%.3f-%.3f", start, end)


def downloaded_name(name: Column) -> Column:
    """struct(video_id, start, end) of 'id start-end.ext', where a partial download ends in '.part'."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\.part\z", ""), r"\.[A-Za-z]\w*\z", "")
    parts = F.split(bare, " ")
    times = F.split(F.try_element_at(parts, F.lit(2)), "-")
    return F.struct(parts[0].alias("video_id"), F.try_element_at(times, F.lit(1)).try_cast("double").alias("start"), F.try_element_at(times, F.lit(2)).try_cast("double").alias("end"))
