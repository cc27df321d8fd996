"""Words and bare forms.

A word is a maximal run of letters or digits in the lower-cased text; the bare
form of a value is its words joined without anything between.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
_GAP = r"[^\p{L}\p{N}]+"


def words_of(text: str | None) -> list[str]:
    """The words of ``text``; none for null."""
    return WORD.findall(text.lower()) if text else []


def words(text: Column) -> Column:
    """The words of a text column as an array, null as empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAP), lambda w: w != "")


def bare(value: Column) -> Column:
    """The bare form of a value; may be empty."""
    return F.regexp_replace(F.lower(value), _GAP, "")


def bare_set(values: Column) -> Column:
    """Sorted distinct non-empty bare forms of an array; null array as empty."""
    forms = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: bare(F.coalesce(v, F.lit(""))))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda v: v != "")))
