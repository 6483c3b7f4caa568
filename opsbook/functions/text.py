"""Text forms of numbers, calendar lines and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_number(c: Column) -> Column:
    """Digits, one leading minus and the first decimal point: `ab-1.2.3x` is -1.23."""
    kept = F.regexp_replace(c, r"[^0-9.\-]", "")
    sign = F.when(kept.startswith("-"), "-").otherwise("")
    plain = F.regexp_replace(kept, "-", "")
    whole = F.substring_index(plain, ".", 1)
    rest = F.regexp_replace(F.substring(plain, F.length(whole) + 2, F.length(plain)), r"\.", "")
    return F.concat(sign, whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise("")).try_cast("double")


def format_sig(x: Column, digits: int = 7) -> Column:
    """So many significant digits, no trailing zeros, a space between thousands; 0 is `0`, never an exponent."""
    places = F.greatest(F.lit(0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))).cast("int")
    text = F.translate(F.call_function("format_number", x, places), ",", " ")
    short = F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(x == 0, "0").otherwise(short)


def ics_escape(c: Column) -> Column:
    """Calendar text: backslash, comma, semicolon and newline escaped."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for plain, escaped in ((",", "\\,"), (";", "\\;"), ("\r\n", "\\n"), ("\n", "\\n")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def ics_fold(c: Column, width: int = 74) -> Column:
    """Physical lines of at most width octets (4 or more), continued by CRLF and a space; no character is divided.

    The space that begins a continuation is not counted, so lines have 75 octets at most. Octets are read as Latin-1, one
    character each, so one pass finds the lines: as many octets as fit and are not followed by the rest of a character.
    """
    line = f"(?s)(?>.{{1,{width}}}(?![\\x80-\\xBF]))(?=.)"
    folded = F.regexp_replace(F.decode(c.cast("binary"), "ISO-8859-1"), line, "$0\r\n ")
    return F.encode(folded, "ISO-8859-1").cast("string")


def _degrees(v: Column, width: int, plus: str, minus: str) -> Column:
    size = F.round(F.abs(v) * 60, 1)
    whole = F.floor(size / 60).cast("int")
    return F.format_string(f"%0{width}d° %04.1f' %s", whole, size - whole * 60, F.when(v < 0, minus).otherwise(plus))


def format_position(lat: Column, lon: Column) -> Column:
    """Degrees and decimal minutes with hemispheres."""
    return F.concat(_degrees(lat, 2, "N", "S"), F.lit(" "), _degrees(lon, 3, "E", "W"))


def format_offset(minutes: Column) -> Column:
    """`UTC+01:00`."""
    size = F.abs(minutes)
    return F.format_string("UTC%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(size / 60).cast("int"), (size % 60).cast("int"))


def tile_key(lon: Column, lat: Column, size: float = 4) -> Column:
    return F.concat_ws("_", F.floor((lon + 180) / size).cast("string"), F.floor((lat + 90) / size).cast("string"))
