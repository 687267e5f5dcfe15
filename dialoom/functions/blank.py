"""The blank tests and the trimming rules, each under its own name because they differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Possessive, so that long runs of white space are read once.
BLANK_PATTERN = r"(?Ui)^\s*+(?:nan|none|\[\]|\{\})?\s*+$"


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of any Unicode kind."""
    return F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++$", "")


def is_blank(c: Column) -> Column:
    """Wide test: null, white space, ``nan``, ``none``, ``[]`` or ``{}`` in any letter case. Never null."""
    return F.coalesce(c.rlike(BLANK_PATTERN), F.lit(True))


def normalise_value(c: Column) -> Column:
    """Narrow rule: trimmed text; null, ``none`` and ``nan`` become the empty string, ``[]`` stays."""
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(F.lower(s).isin("none", "nan"), F.lit("")).otherwise(s)


def is_valid_payload(c: Column) -> Column:
    """Payload rule: null, empty, ``nan`` and ``[]`` are invalid; ``none`` counts as present."""
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    return ~s.isin("", "nan", "[]")
