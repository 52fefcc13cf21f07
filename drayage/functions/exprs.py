"""Keys of values on freight bills, and what counts as missing. Cleaners and tests are in ``shapes``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as missing, by who asks.
MISSING = {
    "calibration": ["", "none", "null", "n/a", "unknown"],
    "rescue": ["", "none", "null", "n/a", "unknown", "—"],
    "evaluation": ["", "none", "null", "n/a", "na", "-", "unknown", "missing"],
}
# Devanagari digits, and the letters that glyph repair reads as digits.
INDIC_DIGITS = "०१२३४५६७८९"


def is_missing(c: Column, policy: str = "calibration") -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(MISSING[policy])


def collapse(c: Column) -> Column:
    """Key of entity matching: lower case, letters, digits and ``&``."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9&]+", "")


def party_key(c: Column) -> Column:
    """Key of party guards: without ``&``."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def indic_digits(c: Column) -> Column:
    return F.translate(c, INDIC_DIGITS, "0123456789")


def glyph_repair(c: Column) -> Column:
    """O, I, l, S, Z beside a digit become 0, 1, 1, 5, 2; all at once, so a repaired letter repairs no neighbour."""
    marks = "\ue000\ue001\ue002\ue003"
    for letters, mark in zip(("[Oo]", "[Il]", "S", "Z"), marks):
        c = F.regexp_replace(c, rf"(?<=[0-9]){letters}|{letters}(?=[0-9])", mark)
    return F.translate(c, marks, "0152")


def letters_only_stub(c: Column) -> Column:
    """Too short to be a name: three letters at most."""
    return F.length(F.regexp_replace(c, "[^A-Za-z]", "")) <= 3
