"""String functions as Column expressions; all accept nulls and return null for them unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.config import STOP_WORDS

TOKEN = r"[A-Za-z\p{Nd}]+"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(s) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(_col(s), r"(?U)^\s+|\s+$", "")


def normalize(s) -> Column:
    """Stripped, lower case, hyphens dropped, underscores as spaces."""
    return F.replace(F.replace(F.lower(strip(s)), F.lit("-"), F.lit("")), F.lit("_"), F.lit(" "))


def equivalence_key(s) -> Column:
    """The key of exact name matching: lower case, underscores as spaces, hyphens dropped, not stripped."""
    return F.replace(F.replace(F.lower(_col(s)), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(""))


def tokens(s, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words in order with repetitions, without stop words (case-sensitive); null as empty."""
    found = F.regexp_extract_all(F.coalesce(_col(s), F.lit("")), F.lit(TOKEN), F.lit(0))
    if not stop:
        return found
    listed = F.split(F.lit(" ".join(stop)), " ")  # folded to one literal
    return F.filter(found, lambda t: ~F.array_contains(listed, t))


def without_stop_words(s, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.array_join(tokens(s, stop), " ")


def char_ngrams(s, n: int) -> Column:
    """The character n-grams of the text padded with n - 1 NULs on both sides; length + n - 1 of them."""
    pad = "\0" * (n - 1)
    padded = F.concat(F.lit(pad), F.coalesce(_col(s), F.lit("")), F.lit(pad))
    # the outer transform computes the padded text once, not once per position
    cut = lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.substring(p, i, F.lit(n)))
    return F.transform(F.array(padded), cut)[0]


def canonical(s) -> Column:
    """Only ASCII letters, digits and spaces, lower case."""
    return F.lower(F.regexp_replace(_col(s), r"[^a-zA-Z0-9 ]+", ""))


def acronym(toks) -> Column:
    """The first characters of the tokens, joined."""
    return F.array_join(F.transform(_col(toks), lambda t: F.left(t, F.lit(1))), "")


def sorted_token_lists(lists) -> Column:
    """Each token list sorted, so that lists with the same tokens become equal."""
    return F.transform(_col(lists), lambda x: F.array_sort(x))


def longest_common_substring(a, b) -> Column:
    """The first longest substring of ``a`` that ``b`` holds; for names, not for long texts."""
    x, y = F.coalesce(_col(a), F.lit("")), F.coalesce(_col(b), F.lit(""))

    def grow(state, i):
        # the current match is extended by one character or given up for a shorter one ending here
        longer = F.substring(x, i - F.length(state["best"]), F.length(state["best"]) + 1)
        hit = (i > F.length(state["best"])) & F.contains(y, longer)
        return F.struct(F.when(hit, longer).otherwise(state["best"]).alias("best"))

    start = F.struct(F.lit("").alias("best"))
    positions = F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(positions, start, grow, lambda s: s["best"])


def without_citations(s) -> Column:
    """Citation marks such as [3] and [citation needed] replaced by as many spaces."""
    parts = F.regexp_extract_all(_col(s), F.lit(r"\[(?:\d+|citation needed)\]"), F.lit(0))
    return F.aggregate(F.array_distinct(parts), F.coalesce(_col(s), F.lit("")), lambda t, m: F.replace(t, m, F.rpad(F.lit(""), F.length(m), F.lit(" "))))


def raw_ids(entity_id) -> Column:
    """The ids that a merged id joins by a bar."""
    return F.split(_col(entity_id), r"\|")


def entity_id(source, code) -> Column:
    return F.concat_ws(":", _col(source), _col(code))


def bilou_letter(tag) -> Column:
    return F.regexp_extract(_col(tag), r"^([BILOU])(?:-|$)", 1)


def bilou_entity(tag) -> Column:
    return F.regexp_extract(_col(tag), r"^[BILU]-(.*)$", 1)


def document_id(line) -> Column:
    """The id in a document start line, null for other lines."""
    return F.nullif(F.regexp_extract(_col(line), r"^-DOCSTART-\s*\(?([^()\s]*)\)?", 1), F.lit(""))
