"""Records of evaluation splits that also stand, exactly or almost, in training.

A record is the sequence of its distinct words by rising frequency. Rolling
hashes of two adjacent words (with a start mark before the first) fingerprint
it. Fingerprints are ordered by their own frequency, rare ones first, and of
every window as long as the number of fingerprints a near copy must share, the
smallest is selected (winnowing); the selected ones are joined across splits.
The shared seeds of a pair are chained in both orders; the gaps between them
bound the best alignment, and pairs whose bound suffices are aligned. As both
sequences follow one total order, the alignment's length is the number of
common words, which decides exactly.

Why no pair is lost: with m common and k other words, similarity t means
k <= m (1 - t) / t. Each other word parts at most one pair of neighbours, so of
a record's n fingerprints at most a + k <= 2 (1 - t) n are not shared, a being
its own other words; the window is the rest, and the windows' minima are the
2 (1 - t) n + 1 rarest fingerprints. What rows of a large block of linked
records share is frequent, therefore last, and not selected.

A parity sketch (one bit per word, exclusive or) goes along with every seed:
two sketches differ in at most as many bits as the records in words, which
rejects unrelated pairs where they are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.words import words
from skein.plans.scratch import Scratch

#: Most entries of the broadcast tables of frequent words and fingerprints; longs of a sketch.
FREQUENT, SKETCH = 60_000, 4
_BASE, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x51ED270B)
_ENTITY = ("canonical_name", "aliases", "definition")


def entity_words(pair_columns: tuple[str, ...] = ("source_ent", "target_ent")) -> Column:
    """The distinct words of name, aliases and definition of both entities, sorted."""
    texts = []
    for side in pair_columns:
        for field in _ENTITY:
            c = F.col(f"{side}.{field}")
            texts.append(F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ") if field == "aliases" else F.coalesce(c, F.lit("")))
    return F.array_sort(F.array_distinct(words(F.concat_ws(" ", *texts))))


def _ranks(values: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rank of each value in the table of frequent ones, 0 for the others."""
    if not len(common[0]):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(common[0], values), len(common[0]) - 1)
    return np.where(common[0][at] == values, common[1][at], 0)


def _sequences(table):
    """(key, toks) -> words in order, the sketch and the fingerprint at every position."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths)), lengths)
            tokens = tokens[np.lexsort((tokens, _ranks(tokens, table.value), row))]
            offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
            words = tokens.view(np.uint64)
            before = np.roll(words, 1)
            before[offsets[:-1][lengths > 0]] = _START
            with np.errstate(over="ignore"):
                grams = (before * _BASE + words) * _BASE
            grams ^= grams >> np.uint64(29)
            bits = np.zeros((len(lengths), SKETCH), np.uint64)
            slot = (words >> np.uint64(11)) % np.uint64(64 * SKETCH)
            np.bitwise_xor.at(bits, (row, (slot // np.uint64(64)).astype(np.int64)), np.uint64(1) << (slot % np.uint64(64)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams.view(np.int64))),
                    *(pa.array(bits[:, i].copy().view(np.int64)) for i in range(SKETCH)),
                ],
                names=["key", "toks", "grams", *(f"s{i}" for i in range(SKETCH))],
            )

    return run


def _selected(table, threshold: float):
    """(key, grams, ...) -> a row (key, n, pos, sh, ...) per selected fingerprint."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            grams = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths)), lengths)
            begins = np.cumsum(lengths) - lengths
            order = np.lexsort((grams, _ranks(grams, table.value), row))
            place = np.arange(len(grams)) - np.repeat(begins, lengths)
            chosen = order[place < np.floor(2 * (1 - threshold) * lengths[row] + 1e-9) + 1]
            of = row[chosen]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(of)),
                    pa.array(lengths[of].astype(np.int32)),
                    pa.array((chosen - begins[of]).astype(np.int32)),
                    pa.array(grams[chosen]),
                    *(c.take(pa.array(of)) for c in batch.columns[2:]),
                ],
                names=["key", "n", "pos", "sh", *batch.schema.names[2:]],
            )

    return run


def _frequent(values: DataFrame, column: str):
    """The broadcast (hashes, ranks by frequency) of the values that at most FREQUENT can be as frequent as."""
    counts = values.groupBy(column).agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    counts = Scratch(values.sparkSession, "frequency").save(counts, column)
    total = counts.agg(F.sum("df")).first()[0] or 0
    rows = counts.where(F.col("df") >= max(2, total // FREQUENT + 1)).collect()  # fewer than FREQUENT
    rank = {v: i + 1 for i, (_, v) in enumerate(sorted((r["df"], r[column]) for r in rows))}
    hashes = np.array(sorted(rank), np.int64)
    return values.sparkSession.sparkContext.broadcast((hashes, np.array([rank[h] for h in hashes.tolist()], np.int64)))


def _chain_bound() -> Column:
    """Upper bound of the alignment of two sequences of na and nb words through all their chained seeds.

    ``chain`` holds the shared seeds (i, j) in order, each the place of a common
    word; between two seeds at most as many words agree as the shorter gap holds.
    """
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("sum"))
    walk = F.aggregate(
        "chain",
        zero,
        lambda a, s: F.struct(s["i"].alias("i"), s["j"].alias("j"), (a["sum"] + F.least(s["i"] - a["i"], s["j"] - a["j"])).alias("sum")),
    )
    return walk["sum"] + F.least(F.col("na") - walk["i"], F.col("nb") - walk["j"])


def _classes(records: DataFrame, id_col: str, split: str, key_words: Column, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    rows = records.where(F.col(id_col).isNotNull() & F.col(split).isin("train", "dev", "test")).select(F.col(id_col).alias("id"), F.col(split).alias("split"), key_words.alias("w")).where(F.size("w") > 0)
    rows = rows.select("id", (F.col("split") == "train").alias("train"), F.unhex(F.md5(F.array_join("w", " "))).alias("key"), F.transform("w", lambda x: F.xxhash64(x)).alias("toks"))
    rows = scratch.save(rows, "rows")
    distinct = rows.groupBy("key").agg(F.first("toks").alias("toks"), F.max("train").alias("train"), F.max(~F.col("train")).alias("held"))
    return rows, scratch.save(distinct, "classes")


def overlapping_classes(records: DataFrame, id_col: str, split: str, key_words: Column, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows with their class ``key``, pairs (``train_key``, ``held_key``, ``similarity``, ``coverage``))."""
    if not 0.5 < threshold <= 1:
        raise ValueError("fingerprints need a threshold above 0.5")
    scratch = Scratch(records.sparkSession, "overlap")
    rows, classes = _classes(records, id_col, split, key_words, scratch)
    sketch = [f"s{i}" for i in range(SKETCH)]
    longs = ", ".join(f"{c} long" for c in sketch)
    words = _frequent(classes.select(F.explode("toks").alias("tok")), "tok")
    marked = scratch.save(classes.select("key", "toks").mapInArrow(_sequences(words), f"key binary, toks array<bigint>, grams array<bigint>, {longs}"), "marked")
    grams = _frequent(marked.select(F.explode("grams").alias("sh")), "sh")
    seeds = marked.select("key", "grams", *sketch).mapInArrow(_selected(grams, threshold), f"key binary, n int, pos int, sh long, {longs}")
    seeds = scratch.save(seeds, "seeds")
    sides = classes.select("key", "train", "held")

    def side(flag: str, n: str, p: str) -> DataFrame:
        posts = seeds.join(sides.where(flag).select("key"), "key", "left_semi")
        return posts.select(F.col("key").alias(f"{flag}_key"), F.col("n").alias(n), "sh", F.col("pos").alias(p), *(F.col(c).alias(f"{flag}_{c}") for c in sketch))

    others = (1 - threshold) / (1 + threshold) * (F.col("na") + F.col("nb")) + 1e-6
    differ = sum((F.bit_count(F.col(f"train_{c}").bitwiseXOR(F.col(f"held_{c}"))) for c in sketch), F.lit(0))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-6)
    hits = (
        side("train", "na", "i")
        .join(side("held", "nb", "j"), "sh")
        .where("train_key != held_key")
        .where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
        .where(differ <= others)
        .where(F.least("i", "j") + F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) >= need)
    )
    chained = hits.groupBy("train_key", "held_key").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("chain"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    likely = chained.where(_chain_bound() >= need).select("train_key", "held_key")
    toks = marked.select("key", "toks")
    aligned = (
        likely.join(toks.select(F.col("key").alias("train_key"), F.col("toks").alias("a")), "train_key")
        .join(toks.select(F.col("key").alias("held_key"), F.col("toks").alias("b")), "held_key")
        .withColumn("both", F.size(F.array_intersect("a", "b")))
        .withColumn("similarity", F.col("both") / (F.size("a") + F.size("b") - F.col("both")))
        .where(F.col("similarity") >= threshold)
        .select("train_key", "held_key", "similarity", (F.col("both") / F.size("b")).alias("coverage"))
    )
    equal = classes.where("train and held").select(F.col("key").alias("train_key"), F.col("key").alias("held_key"), F.lit(1.0).alias("similarity"), F.lit(1.0).alias("coverage"))
    return rows, scratch.save(aligned.unionByName(equal), "pairs")


def split_overlaps(records: DataFrame, id_col: str = "pair_id", split: str = "split", key_words: Column | None = None, threshold: float = 0.8) -> DataFrame:
    """(``pair_id_a``, ``pair_id_b``), smaller first, of a train row and a dev or test row with word sets of similarity >= ``threshold``.

    Null fields count as nothing; rows without a word, with a null id or with
    another or null split match nothing; repeated rows are all reported;
    an empty table gives an empty result.
    """
    rows, pairs = overlapping_classes(records, id_col, split, entity_words() if key_words is None else key_words, threshold)
    train = rows.where("train").select(F.col("key").alias("train_key"), F.col("id").alias("t"))
    held = rows.where("not train").select(F.col("key").alias("held_key"), F.col("id").alias("h"))
    ids = pairs.join(train, "train_key").join(held, "held_key")
    return ids.select(F.least("t", "h").alias("pair_id_a"), F.greatest("t", "h").alias("pair_id_b"))


def overlap_report(records: DataFrame, id_col: str = "pair_id", split: str = "split", source: str = "origin", threshold: float = 0.8) -> DataFrame:
    """Per held-out split and source: rows, rows found in train, mean coverage of those by their best train record.

    A null source forms its own group.
    """
    rows, pairs = overlapping_classes(records, id_col, split, entity_words(), threshold)
    best = pairs.groupBy(F.col("held_key").alias("key")).agg(F.max("coverage").alias("coverage"))
    covered = rows.where("not train").select("id", "key").join(best, "key", "left").select("id", "coverage")
    held = records.where(F.col(split).isin("dev", "test")).select(F.col(id_col).alias("id"), F.col(split).alias("split"), F.col(source).alias("origin"))
    return held.join(covered, "id", "left").groupBy("split", "origin").agg(F.count(F.lit(1)).alias("n_rows"), F.count("coverage").alias("n_found"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))
