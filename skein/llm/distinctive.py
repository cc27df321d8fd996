"""How distinctive a term is of a record.

One pass counts every term's occurrences per record; the histogram of those
counts over the collection (how many records hold the term once, twice, ...)
gives the document frequency and the maximum-likelihood fit of a two-Poisson
mixture, by expectation-maximisation over all terms of a batch at once. Every
term of a record gets its frequency weighted by the logarithm of its rarity and
the posterior probability that the record belongs to the term's elite component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.words import words
from skein.plans.scratch import Scratch

#: Most entries of the table of frequent terms, which is broadcast.
FREQUENT_TERMS = 50_000
#: Most steps of expectation-maximisation, and the relative change below which a fit has converged.
EM_STEPS, EM_CHANGE = 500, 1e-7


def term_counts(records: DataFrame, row_id: str, texts: list[str]) -> DataFrame:
    """(``row_id``, ``term``, ``tf``) for every word of a record's text and text-list columns.

    Null columns, null list entries and texts without a word give nothing.
    """
    kinds = dict(records.dtypes)
    parts = [F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ") if kinds[c].startswith("array") else F.coalesce(F.col(c), F.lit("")) for c in texts]
    held = records.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("row_id"), F.array_sort(words(F.concat_ws(" ", *parts))).alias("w"))
    # in the sorted words a term's occurrences are the gap to the next term's first position
    held = held.withColumn("d", F.array_distinct("w"))
    first = F.transform("d", lambda t: F.array_position("w", t).cast("int"))
    held = held.withColumn("p", F.concat(first, F.array(F.size("w") + 1)))
    pairs = F.transform("d", lambda t, i: F.struct(t.alias("term"), (F.element_at("p", i + 2) - F.element_at("p", i + 1)).alias("tf")))
    return held.select("row_id", F.inline(pairs))


def fit_mixtures(term: np.ndarray, counts: np.ndarray, records: np.ndarray, total: int, steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(share, rate of the elite, rate of the rest, converged) of each term's mixture of two Poissons over ``total`` records.

    ``term`` numbers the terms from 0 in order; each has the occupied bins of
    its histogram (``counts``, ``records``). The records not in it hold the
    term no time and form one more bin.
    """
    terms = int(term[-1]) + 1
    k, n = counts.astype(float), records.astype(float)
    held, mass = np.bincount(term, n, terms), np.bincount(term, n * k, terms)
    k, n = np.append(k, np.zeros(terms)), np.append(n, np.maximum(0.0, total - held))
    term = np.append(term, np.arange(terms))
    mean = mass / max(1, total)
    share = np.minimum(0.5, np.maximum(held / max(1, total), 1e-9))
    high, low = np.maximum(1.5 * mass / np.maximum(1, held), mean * 2), mean / 4
    converged = np.zeros(terms, bool)
    open_ = np.arange(terms)  # the terms still fitted; their bins are (t, k, n)
    t = term
    for _ in range(steps):
        s, h, lo = share[open_], high[open_], low[open_]
        odds = (np.log1p(-s) - np.log(s) + h - lo)[t] + k * (np.log(lo) - np.log(h))[t]
        p = n / (1 + np.exp(np.clip(odds, -700, 700)))
        size = len(open_)
        weight, elite = np.bincount(t, p, size), np.bincount(t, p * k, size)
        fine = (weight > 0) & (weight < total)
        new = (
            np.clip(weight / total, 1e-12, 1 - 1e-12),
            np.maximum(elite / np.where(fine, weight, 1), 1e-12),
            np.maximum((mass[open_] - elite) / np.where(fine, total - weight, 1), 1e-12),
        )
        moved = np.abs(new[1] - h) / h + np.abs(new[2] - lo) / np.maximum(lo, 1e-9) + np.abs(new[0] - s) / s
        for of, value in zip((share, high, low), new):
            of[open_] = np.where(fine, value, of[open_])
        done = ~fine | (moved < EM_CHANGE)
        converged[open_[done]] = True
        if done.all():
            break
        if done.any():
            keep = ~done
            bins = keep[t]
            k, n, t = k[bins], n[bins], (np.cumsum(keep) - 1)[t[bins]]
            open_ = open_[keep]
    swapped = high < low
    return np.where(swapped, 1 - share, share), np.where(swapped, low, high), np.where(swapped, high, low), converged


def _fits(total: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            bins = lists.flatten()
            term = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            fitted = fit_mixtures(term, bins.field("tf").to_numpy(), bins.field("n").to_numpy(), total)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x) for x in fitted)], names=["term", "df", "share", "elite_rate", "rest_rate", "converged"])

    return run


def term_table(counts: DataFrame, total: int) -> DataFrame:
    """(``term``, ``df``, ``share``, ``elite_rate``, ``rest_rate``, ``converged``) of all terms.

    The histogram has one row per term and count, added up before the shuffle.
    Terms are spread over as many tasks as a shuffle has partitions, since the
    fit takes longer than the few bytes of a histogram suggest.
    """
    bins = counts.groupBy("term", "tf").agg(F.count(F.lit(1)).alias("n"))
    histogram = bins.groupBy("term").agg(F.sum("n").alias("df"), F.collect_list(F.struct("tf", "n")).alias("bins"))
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return histogram.repartition(tasks, "term").mapInArrow(_fits(total), "term string, df long, share double, elite_rate double, rest_rate double, converged boolean")


def elite_posterior(tf: Column) -> Column:
    """Probability that a record with ``tf`` occurrences belongs to the term's elite component."""
    odds = F.log((1 - F.col("share")) / F.col("share")) + F.col("elite_rate") - F.col("rest_rate") + tf * (F.log("rest_rate") - F.log("elite_rate"))
    return 1 / (1 + F.exp(F.least(F.greatest(odds, F.lit(-700.0)), F.lit(700.0))))


def term_scores(records: DataFrame, row_id: str = "row_id", texts: tuple[str, ...] = ("canonical_name", "aliases")) -> DataFrame:
    """Every record's terms: (``row_id``, ``term``, ``tf``, ``df``, ``score``, ``elite``, ``converged``).

    ``score`` is tf * ln(N / df + 1), rounded to 9 decimals, N counting all
    rows of the table, also those without a word; ``elite`` is the two-Poisson
    posterior of the record's count, ``converged`` whether the term's fit did
    within ``EM_STEPS`` steps. A null id, null and empty texts give no rows; a repeated term
    counts with its frequency; an empty table gives an empty result. Terms
    above a frequency that at most ``FREQUENT_TERMS`` terms can reach are
    joined by broadcast, so no frequent term gathers its rows in one task.
    """
    scratch = Scratch(records.sparkSession, "terms")
    counts = scratch.save(term_counts(records, row_id, list(texts)), "counts")
    total, pairs = records.count(), counts.count()
    table = scratch.save(term_table(counts, total), "table")
    least = max(8, pairs // FREQUENT_TERMS + 1)  # pairs / least < FREQUENT_TERMS
    frequent = F.broadcast(table.where(F.col("df") >= least))
    seen = counts.join(frequent, "term", "left")
    known = seen.where(F.col("df").isNotNull())
    rare = seen.where(F.col("df").isNull()).select("term", "row_id", "tf").join(table.where(F.col("df") < least), "term")
    scored = known.unionByName(rare).withColumn("score", F.round(F.col("tf") * F.log(F.lit(float(total)) / F.col("df") + 1), 9))
    return scored.select("row_id", "term", "tf", "df", "score", elite_posterior(F.col("tf")).alias("elite"), "converged")


def best_terms(records: DataFrame, row_id: str = "row_id", texts: tuple[str, ...] = ("canonical_name", "aliases"), by: str = "score") -> DataFrame:
    """(``row_id``, ``term``) of the highest ``score`` or ``elite`` of each record, ties by smaller term in string order."""
    scored = term_scores(records, row_id, texts)
    best = scored.groupBy("row_id").agg(F.min(F.struct((-F.col(by)).alias("s"), F.col("term"))).alias("b"))
    return best.select("row_id", F.col("b.term").alias("term"))
