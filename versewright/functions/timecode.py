"""Clock formats in integer milliseconds: LRC, SRT, QRC and TTML forms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pad(value: Column, width: int) -> Column:
    text = value.cast("bigint").cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def encode_ttml(ms: Column) -> Column:
    """``m:ss.mmm``; null and negative times are 0."""
    t = F.greatest(F.lit(0), F.coalesce(ms, F.lit(0)))
    return F.concat(F.floor(t / 60000).cast("bigint").cast("string"), F.lit(":"), _pad(F.floor(t / 1000) % 60, 2), F.lit("."), _pad(t % 1000, 3))


def encode_lrc(ms: Column) -> Column:
    """``mm:ss.cc``, rounded to the nearest hundredth (halves up)."""
    c = F.floor((F.greatest(F.lit(0), ms) + 5) / 10)
    return F.concat(_pad(F.floor(c / 6000), 2), F.lit(":"), _pad(F.floor(c / 100) % 60, 2), F.lit("."), _pad(c % 100, 2))


def encode_srt(ms: Column) -> Column:
    """``hh:mm:ss,mmm``."""
    t = F.greatest(F.lit(0), ms)
    return F.concat(_pad(F.floor(t / 3_600_000), 2), F.lit(":"), _pad(F.floor(t / 60000) % 60, 2), F.lit(":"), _pad(F.floor(t / 1000) % 60, 2), F.lit(","), _pad(t % 1000, 3))


def fraction_ms(digits: Column) -> Column:
    """One to three digits after the point as milliseconds; more digits are cut, none is 0."""
    return F.rpad(F.substring(F.coalesce(digits, F.lit("")), 1, 3), 3, "0").cast("bigint")


def decode_lrc(stamp: Column) -> Column:
    """Milliseconds of ``mm:ss``, ``mm:ss.f`` to ``.fff``, also with a colon before the fraction; null if it is none."""
    form = r"^\[?(\d+):(\d{1,2})(?:[.:](\d{1,3}))?\]?$"
    part = lambda i: F.regexp_extract(stamp, form, i)
    ms = part(1).try_cast("bigint") * 60000 + part(2).try_cast("bigint") * 1000 + fraction_ms(part(3))
    return F.when(stamp.rlike(form), ms)


def decode_ttml(value: Column) -> Column:
    """Milliseconds of clock forms (``h:mm:ss.f``, ``m:ss.f``, ``s.f``) and offsets (``h``, ``m``, ``s``, ``ms``); null if invalid."""
    v = F.trim(value)
    clock, offset, bare = r"^(?:(\d+):)?(\d+):(\d+)(?:\.(\d+))?$", r"^(\d+(?:\.\d+)?)(h|ms|m|s)$", r"^(\d+)(?:\.(\d+))?$"
    part = lambda form, i: F.regexp_extract(v, form, i)
    from_clock = F.coalesce(part(clock, 1).try_cast("bigint"), F.lit(0)) * 3_600_000 + part(clock, 2).try_cast("bigint") * 60000 + part(clock, 3).try_cast("bigint") * 1000 + fraction_ms(part(clock, 4))
    unit = F.element_at(F.create_map(*[F.lit(x) for x in ("h", 3_600_000, "m", 60000, "s", 1000, "ms", 1)]), part(offset, 2))
    from_offset = F.round(part(offset, 1).try_cast("decimal(20,6)") * unit).cast("bigint")
    from_bare = part(bare, 1).try_cast("bigint") * 1000 + fraction_ms(part(bare, 2))
    return F.when(v.rlike(clock), from_clock).when(v.rlike(offset), from_offset).when(v.rlike(bare), from_bare)


def display(ms: Column, digits: int = 0) -> Column:
    """``m:ss`` with 0, 2 or 3 digits of fraction, cut; negative or unknown times show as 0."""
    t = F.greatest(F.lit(0), F.coalesce(ms, F.lit(0)))
    out = F.concat(F.floor(t / 60000).cast("bigint").cast("string"), F.lit(":"), _pad(F.floor(t / 1000) % 60, 2))
    return F.concat(out, F.lit("."), F.substring(_pad(t % 1000, 3), 1, digits)) if digits else out
