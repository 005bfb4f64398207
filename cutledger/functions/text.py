"""Text functions as column expressions (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that decide which terms count.
DIRECTIVE_STOP = ["a", "an", "and", "as", "for", "from", "in", "into", "make", "of", "on", "the", "to", "using", "use", "with"]
CASTING_STOP = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "per", "the", "to", "with", "shot", "shots"]
SILENCE_MARKERS = ["silence", "silences", "silent", "quiet", "dead air", "pauses", "pause"]
DEAD_MARKERS = ["dead moment", "dead time", "boring", "dull", "filler", "nothing happens", "uneventful"]
LOW_ENERGY_PHRASES = ["low energy", "no motion", "no movement", "nothing happens", "still frame", "static shot", "empty frame", "dead air"]
LOW_ENERGY_TOKENS = ["idle", "motionless", "uneventful", "silent"]
SUFFIXES = ["ing", "ers", "er", "ed", "es", "s"]
DIRECTIONS = ["left", "right", "up", "down", "forward", "backward", "back"]
SHOT_SIZES = ["extreme_close_up", "close_up", "medium", "wide", "extreme_wide"]
ENERGY = {"rising": 10, "building": 10, "high": 10, "steady": 5, "flat": 5, "mixed": 5, "falling": 0, "fading": 0, "low": 0}


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def directive_terms(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, of more than one character, stop words dropped, each once in order."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_distinct(F.filter(runs, lambda t: (F.length(t) > 1) & ~F.array_contains(strings(DIRECTIVE_STOP), t)))


def terms(text: Column, keep_stop: bool = False) -> Column:
    """ASCII runs of letters and digits of more than one character, as a set in order."""
    runs = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) > 1)
    return F.array_distinct(runs if keep_stop else F.filter(runs, lambda t: ~F.array_contains(strings(CASTING_STOP), t)))


def tokens(text: Column) -> Column:
    """Runs of letters and digits of more than two characters, lower-cased, with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda t: F.length(t) > 2)


def norm(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), "- ", "__")


def norm_context(text: Column) -> Column:
    """As ``norm``, but a dash stays."""
    return F.translate(F.lower(F.trim(text)), " ", "_")


def slug(text: Column) -> Column:
    return F.translate(text, "_", "-")


def stem(token: Column) -> Column:
    """Without the first of SUFFIXES that leaves three characters or more."""
    out = token
    for s in reversed(SUFFIXES):
        out = F.when(F.endswith(token, F.lit(s)) & (F.length(token) - len(s) >= 3), F.left(token, F.length(token) - len(s))).otherwise(out)
    return out


def haystack(*parts: Column) -> Column:
    """Lower-cased parts with underscores for blanks, joined by blanks; null and empty parts left out."""
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(F.transform(kept, lambda p: F.translate(F.lower(p), " ", "_")), " ")


def json_list(value: Column) -> Column:
    """A JSON list of strings; a scalar becomes a list of one, what can't be read an empty list."""
    return F.coalesce(F.from_json(value, "array<string>"), F.when(value.isNotNull() & (F.trim(value) != "") & ~F.trim(value).rlike(r"^[\[{]"), F.array(value)), F.array().cast("array<string>"))


def text_or(value: Column, other: Column) -> Column:
    return F.coalesce(F.when(F.trim(value) != "", value), other)
