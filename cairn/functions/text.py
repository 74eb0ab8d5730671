"""Rule-based classification and cleaning of free text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cyrillic letters that look like Latin ones, and those.
LOOKALIKE_FROM = "авекмнорстух"
LOOKALIKE_TO = "abekmhopctyx"
#: Words that say which weighting a series has, in order of precedence.
WEIGHTING_MARKERS = [("flair", "Flair"), ("флаир", "Flair"), ("t1", "T1"), ("t2", "T2"), ("mprage", "T1"), ("mp-rage", "T1"), ("mp rage", "T1"), ("bravo", "T1"), ("spgr", "T1"), ("haste", "T2")]
#: Words that say that contrast was given, and those that say it was not, which win.
CONTRAST_MARKERS = ["+c", "+ c", "post c", "postc", "post-c", "ce t1", "t1 ce", "c+", "gd", "gado", "contrast", "контраст", "с контрастом"]
NO_CONTRAST_MARKERS = ["non contrast", "non-contrast", "pre contrast", "pre-contrast", "без контраста"]
#: The T1 time in milliseconds and the part of the Ernst angle below which a gradient echo shows proton density.
REFERENCE_T1_MS, ERNST_PART = 700.0, 0.5


def latinised(text: Column) -> Column:
    """Lower case, Cyrillic look-alikes as their Latin twins."""
    return F.translate(F.lower(text), LOOKALIKE_FROM, LOOKALIKE_TO)


def latinised_literal(marker: str) -> str:
    return marker.lower().translate(str.maketrans(LOOKALIKE_FROM, LOOKALIKE_TO))


def contains_any(text: Column, markers: list[str]) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(text, F.lit(latinised_literal(marker)))
    return found


def first_marker(text: Column, markers: list[tuple[str, str]], default: str) -> Column:
    """The name of the first marker that the latinised text contains."""
    low, out = latinised(text), F.lit(default)
    for marker, name in reversed(markers):
        out = F.when(F.contains(low, F.lit(latinised_literal(marker))), name).otherwise(out)
    return F.coalesce(out, F.lit(default))


def contrast_enhanced(text: Column, negative: list[str] = NO_CONTRAST_MARKERS, positive: list[str] = CONTRAST_MARKERS) -> Column:
    low = latinised(text)
    return F.coalesce(~contains_any(low, negative) & contains_any(low, positive), F.lit(False))


def weighting_from_physics(sequence: Column, variant: Column, acquisition: Column, tr: Column, te: Column, ti: Column, flip: Column) -> Column:
    """Weighting from times in milliseconds and the flip angle in degrees; zero stands for a missing value."""
    sequence, variant, volume = latinised(sequence), latinised(variant), F.contains(acquisition, F.lit("3"))
    has = lambda c, s: F.contains(c, F.lit(s))
    ernst = F.degrees(F.acos(F.exp(-tr / REFERENCE_T1_MS)))
    density = (flip > 0) & has(sequence, "gr") & ~has(sequence, "ir") & ~has(variant, "mp") & (flip < ernst * ERNST_PART)
    return (
        F.when(has(sequence, "ep") | has(variant, "tof"), "Unknown")
        .when((tr <= 0) | (te <= 0), "Unknown")
        .when((ti > 0) & (te >= 80) & (tr >= 2000), "Flair")
        .when(has(variant, "mp") & volume & (te < 30), "T1")
        .when((tr < 800) & (te < 30), F.when(density, "Unknown").otherwise("T1"))
        .when((tr >= 2000) & (te >= 80), "T2")
        .otherwise("Unknown")
    )


def message_shape(text: Column) -> Column:
    """Free-standing numbers as ``#``; numbers inside coordinates in parentheses stay."""
    return F.regexp_replace(text, r"(?<![\w(,])\d+(?![\w),])", "#")


def shortened(text: Column, width: int = 120) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)


def file_name(text: Column, default: str) -> Column:
    """A name for a folder: carets as blanks, other unsafe signs as ``_``, no dots or blanks at the ends."""
    safe = F.regexp_replace(F.replace(text, F.lit("^"), F.lit(" ")), r'[<>:"/\\|?*\x00-\x1f]', "_")
    safe = F.regexp_replace(safe, r"^[ .]+|[ .]+$", "")
    return F.coalesce(F.when(safe != "", safe), F.lit(default))


def quoted_csv(text: Column, sep: str = ";") -> Column:
    return F.when(F.contains(text, F.lit(sep)), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def short_number(secret: Column, short_below: int = 8) -> Column:
    return (F.length(secret) < short_below) & secret.rlike(r"^[0-9.]*[0-9][0-9.]*$")


def bare_number(token: Column) -> Column:
    return F.regexp_replace(token, r"^\.+|\.+$", "")


def numeric_tokens(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, r"[^0-9.]"), lambda t: t != ""), bare_number)


def leaks(value: Column, secret: Column, neutral: Column, short_below: int = 8) -> Column:
    """Whether a value gives a secret away: neutral secrets as the whole value only, short numbers as whole numeric
    tokens, all others anywhere, whatever the case."""
    return (
        F.when(neutral, F.lower(F.trim(value)) == F.lower(secret))
        .when(short_number(secret, short_below), F.array_contains(numeric_tokens(value), bare_number(secret)))
        .otherwise(F.contains(F.lower(value), F.lower(secret)))
    )
