"""Evaluation passages inside a training corpus, by prefix-filtered containment.

Each item is cut into windows of RUN words, each window into its WIDTH-word
shingles. A document holds the window only if it holds all of them in a row, so
the scan of the corpus keeps only stretches of as many neighbouring shingles as
a window has, all of them known from the items, together with their words:
after it no step reads a document again, and what is shuffled grows with the
passages found, not with the corpus.

Of every window one necessary shingle is joined, the rarest among the
stretches; windows with a shingle that no stretch has cannot occur. The
shingle's offset in the window bounds where the window starts and ends in the
stretch; what remains is verified word by word.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.rolling import rolled, stretches, word_hashes
from skein.llm.words import words
from skein.plans.scratch import Scratch

#: Words that must be in common in one run, words of a shingle.
RUN, WIDTH = 12, 5
#: Item shingles of a block. The corpus is scanned once for each block of items,
#: whose shingles go to the tasks as one sorted array (64 MB at most).
BLOCK_SHINGLES = 8_000_000


def _shingle(width: int):
    """(id, words) -> a row (id, pos, sh) per shingle."""

    def run(batches):
        for batch in batches:
            hashes, lengths = word_hashes(batch.column(1))
            row, pos, at = stretches(lengths, width)
            sh = rolled(hashes, width)[at] if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(sh)], names=["id", "pos", "sh"])

    return run


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all stretches [start, start + length), one after another."""
    begins = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) - np.repeat(begins - starts, lengths)


def _lists(values: pa.Array, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), values.take(pa.array(_ranges(starts, lengths))))


def _known_stretches(width: int, least: int, wanted):
    """(id, words) -> (id, w, shs) of every maximal stretch of at least ``least`` neighbouring wanted shingles."""

    def run(batches):
        keep = wanted.value
        for batch in batches:
            hashes, lengths = word_hashes(batch.column(1))
            row, _, at = stretches(lengths, width)
            if not len(at) or not len(keep):
                continue
            sh = rolled(hashes, width)[at]
            hit = keep[np.minimum(np.searchsorted(keep, sh), len(keep) - 1)] == sh
            new = np.append(True, row[1:] != row[:-1])
            begins = np.flatnonzero(hit & (new | ~np.append(False, hit[:-1])))
            ends = np.flatnonzero(hit & np.append(new[1:] | ~hit[1:], True)) + 1
            long = ends - begins >= least
            begins, counts = begins[long], (ends - begins)[long]
            if len(begins):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[begins])), _lists(batch.column(1).flatten(), at[begins], counts + width - 1), _lists(pa.array(sh), begins, counts)], names=["id", "w", "shs"]
                )

    return run


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", run: int = RUN, width: int = WIDTH, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """(``doc_id``, ``item_id``) where the two texts have a run of at least ``run`` words in common.

    The words are in the same order with no other word between. Null and empty
    texts and items or documents of fewer than ``run`` words match nothing;
    null ids are ignored; repeated texts are all reported; a document that
    holds several items has a row for each. Either table may be empty. Texts
    are processed whole, whatever their length. Items are taken in hashed
    blocks of about ``block_shingles`` shingles, each against all documents.
    """
    if run < width:
        raise ValueError("run must be at least width")
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    per = run - width + 1
    docs = documents.select(F.col(doc_id).cast("long").alias("id"), words(F.col(text)).alias("w")).where(F.col("id").isNotNull() & (F.size("w") >= run))
    held = items.select(F.col(item_id).cast("long").alias("item"), words(F.col(text)).alias("w")).where(F.col("item").isNotNull() & (F.size("w") >= run))
    pieces = scratch.save(held.mapInArrow(_shingle(width), "item long, pos int, sh long"), "pieces")
    blocks = max(1, math.ceil(pieces.count() / block_shingles))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    hits = None
    for number in range(blocks):
        mine = pieces.where(block == number)
        wanted = np.unique(mine.select("sh").distinct().toArrow().column(0).to_numpy())  # one block
        known = docs.mapInArrow(_known_stretches(width, per, spark.sparkContext.broadcast(wanted)), "id long, w array<string>, shs array<bigint>")
        known = scratch.save(known.withColumn("stretch", F.monotonically_increasing_id()), f"stretches{number}")
        found = known.select("stretch", F.size("w").alias("n"), F.posexplode("shs").alias("pos", "sh"))

        # The rarest shingle of every window of an item.
        rarity = found.groupBy("sh").agg(F.count(F.lit(1)).alias("df"))
        frame = Window.partitionBy("item").orderBy("pos").rowsBetween(0, per - 1)
        ranked = mine.join(rarity, "sh", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        windows = ranked.select("item", F.col("pos").alias("start"), F.min(F.struct("df", "sh", "pos")).over(frame).alias("rare"), F.count(F.lit(1)).over(frame).alias("held"))
        prefix = windows.where((F.col("held") == per) & (F.col("rare.df") > 0)).select("item", "start", (F.col("rare.pos") - F.col("start")).alias("offset"), F.col("rare.sh").alias("sh"))
        begin = F.col("pos") - F.col("offset")
        near = found.join(prefix, "sh").where((begin >= 0) & (begin + run <= F.col("n")))
        places = near.groupBy("stretch", "item").agg(F.collect_set(F.struct("start", begin.alias("begin"))).alias("places"))  # within one stretch and item
        its = held.where(block == number).select("item", F.col("w").alias("iw"))
        same = F.exists("places", lambda p: F.slice("w", p["begin"] + 1, run) == F.slice("iw", p["start"] + 1, run))
        check = places.join(known.select("stretch", "id", "w"), "stretch").join(its, "item").where(same).select(F.col("id").alias(doc_id), F.col("item").alias(item_id))
        hits = check if hits is None else hits.unionByName(check)
    return hits.distinct()  # a document may hold several passages of an item


def leak_report(documents: DataFrame, items: DataFrame, run: int = RUN, **params) -> DataFrame:
    """Per item: (``item_id``, ``measured``, ``documents``), the number of documents it leaked into.

    An item of fewer than ``run`` words can't be found: it isn't ``measured``
    and its number is null. Measured items that didn't leak have 0.
    """
    hits = leaked_items(documents, items, run=run, **params).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    own = items.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.max(F.size(words(F.col("text"))) >= run).alias("measured"))
    return own.join(hits, "item_id", "left").select("item_id", "measured", F.when(F.col("measured"), F.coalesce("documents", F.lit(0))).alias("documents"))
