"""Similarities of sets and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def jaccard(a, b) -> Column:
    """|intersection| / |union| of two arrays as sets, -1 if either is empty or null."""
    a, b = _col(a), _col(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(F.coalesce(a, F.array())) < 1) | (F.size(F.coalesce(b, F.array())) < 1), F.lit(-1.0)).otherwise(both / F.size(F.array_union(a, b)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.transform(F.array(value), body)[0]


def max_jaccard(a, b) -> Column:
    """The highest Jaccard similarity of a set of ``a`` and a set of ``b`` (arrays of distinct arrays), at least 0.

    Two sets are intersected only if their sizes allow more than the best so far.
    """
    a, b = (F.filter(_col(x), lambda x: F.size(x) > 0) for x in (a, b))

    def better(top: Column, x: Column, y: Column) -> Column:
        sizes = F.size(x) + F.size(y)
        ratio = _let(F.size(F.array_intersect(x, y)), lambda both: both / (sizes - both))
        return F.when(F.least(F.size(x), F.size(y)) > top * F.greatest(F.size(x), F.size(y)), F.greatest(top, ratio)).otherwise(top)

    return _let(b, lambda others: F.aggregate(a, F.lit(0.0), lambda top, x: F.aggregate(others, top, lambda t, y: better(t, x, y))))


def overlaps(a, b) -> Column:
    """Whether two arrays share an element."""
    return F.coalesce(F.arrays_overlap(_col(a), _col(b)), F.lit(False))


def same_set(a, b) -> Column:
    return F.array_sort(F.array_distinct(_col(a))) == F.array_sort(F.array_distinct(_col(b)))


def idf(total, df) -> Column:
    """ln(total / df + 1)."""
    return F.log(_col(total) / _col(df) + 1)


def distance_weight(d1, d2) -> Column:
    """exp(-(d1 + d2) / 2)."""
    return F.exp(-(_col(d1) + _col(d2)) / 2)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine of two vectors; NaN if one is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(float("nan"))).otherwise(dot(a, b) / norm)


def tfidf_distance(i, j, a, b) -> Column:
    """Euclidean distance of two vectors, 99 if both indexes are -1."""
    d = F.sqrt(F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    return F.when((_col(i) == -1) & (_col(j) == -1), F.lit(99.0)).otherwise(d)


def contiguous(positions) -> Column:
    """Whether an array of integers rises by exactly one at every step; false below two entries."""
    p = _col(positions)
    return (F.size(p) > 1) & F.forall(F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda y, x: y - x), lambda d: d == 1)


def flat(nested) -> Column:
    """The non-null elements of an array of arrays."""
    return F.filter(F.flatten(F.filter(_col(nested), lambda x: x.isNotNull())), lambda x: x.isNotNull())


def lookup(mapping: dict, key, default) -> Column:
    """A constant dictionary lookup with a default."""
    entries = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return F.coalesce(F.try_element_at(entries, _col(key)), F.lit(default))


#: Similarity functions by name, for SQL-like configuration.
REGISTRY = {"jaccard": jaccard, "max_jaccard": max_jaccard, "cosine": cosine, "dot": dot, "overlaps": overlaps, "same_set": same_set}
