"""Names, times, dates and distances of strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9_.\-]", "_")


def one_line(x: Column) -> Column:
    """Control characters become spaces."""
    return F.regexp_replace(x, r"[\x00-\x1F\x7F]", " ")


def normalised(x: Column) -> Column:
    """Lower case, cedilla forms to comma forms, punctuation to spaces, white space squeezed."""
    low = F.translate(F.lower(x), "şţ", "șț")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[!-/:-@\[-`{-~]", " "), r"[ \t\n\r]+", " "))


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance by length; 0 for two empty strings, 1 for a hypothesis against an empty reference."""
    return F.when(F.length(reference) == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))


def clock(seconds: Column) -> Column:
    """HH:MM:SS.cc of seconds."""
    cs = F.round(seconds * 100).cast("long")
    return F.format_string("%02d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def parsed_clock(x: Column) -> Column:
    """Seconds of HH:MM:SS.cc anywhere in a line; null if there is none."""
    g = lambda i: F.regexp_extract(x, r"(\d+):(\d\d):(\d\d(?:\.\d+)?)", i)
    return F.when(g(1) != "", g(1).cast("double") * 3600 + g(2).cast("double") * 60 + g(3).cast("double"))


def is_iso_date(x: Column) -> Column:
    """Whether a string is a date that reads back as itself."""
    return F.coalesce(F.date_format(F.try_to_date(x, "yyyy-MM-dd"), "yyyy-MM-dd") == x, F.lit(False))
