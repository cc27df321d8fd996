"""Mixing sources to target shares of tokens.

Every document of a listed source gets an exponential key scaled by its quality
weight (Efraimidis-Spirakis: the order of the keys is a weighted sample without
replacement). A source's token budget first takes complete epochs of the
source, then the documents of smallest keys until the rest is used up. The
prefix sums run over key buckets and, within the one bucket where the budget
ends, over its documents. Buckets are steps of the key's logarithm: whatever the
weights, at most 0.37 of a source's documents are expected per factor of e, so
with as many steps an octave as the documents need no bucket is large, and what
is sorted per source is its bucket sums.
"""

from __future__ import annotations

import base64
import math
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.words import words
from skein.plans.scratch import Scratch

#: Folder of public tokenizer files and the byte-pair vocabulary used.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: How such vocabularies cut text before merging (a fixed value).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents that a key bucket is sized for.
BUCKET_DOCS = 4_000


def _counter(ranks):
    def run(batches):
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks.value, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64())], names=["doc_id", "source", "weight", "tokens"])

    return run


def _ranks(spark: SparkSession, file: str):
    """The vocabulary, broadcast: about 1 MB, whatever the data."""
    lines = Path(file).read_bytes().splitlines()
    return spark.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)})


def source_name(source: Column) -> Column:
    """A source as the target table writes it: trimmed, lower case, runs of hyphens and spaces as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[-\s]+", "_")


def text_weight(text: Column) -> Column:
    """The default quality weight, 0.05 to 1: the share of letters and spaces, lowered for repeated words and for fewer than 20 words."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", "")) / F.greatest(F.length(text), F.lit(1))
    found = words(text)
    count = F.greatest(F.size(found), F.lit(1))
    variety = F.sqrt(F.size(F.array_distinct(found)) / F.least(count, F.lit(400)))  # long texts repeat words anyway
    return F.greatest(F.lit(0.05), letters * F.least(F.lit(1.0), variety) * F.sqrt(F.least(F.lit(1.0), count / 20.0)))


def mixture(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, exact: bool = False, weight: Column | None = None, seed: int = 11, tokenizer: str = f"{TOKENIZERS}/{VOCABULARY}"
) -> tuple[DataFrame, DataFrame]:
    """(draw, shares): ``draw`` has (``doc_id``, ``source``, ``tokens``, ``copies``) of the documents used.

    ``shares`` reports for every target (``source``, ``target_share``,
    ``budget``, ``tokens``, ``share``, ``documents``, ``max_copies``);
    ``budget`` is what the source was to give, ``share`` the part of the tokens
    drawn. The mixture's size is ``total_tokens``, by default the
    tokens of all documents of listed sources; a source too small for its
    budget gives all that ``max_repeats`` allows. With ``exact`` the size is
    the largest in which every source that has tokens reaches its share.
    Documents with a null, unknown or unlisted source, null or empty
    text or a null id are never used; a listed source without documents
    reaches a share of 0; a null or negative share counts as 0, a null repeat
    limit as 1; a source listed twice has the sum of its shares and the higher
    limit. Equal keys are ordered by id.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixture")
    w = F.coalesce(text_weight(F.col("text")) if weight is None else weight, F.lit(1.0))
    limit = F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))
    share = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
    targets = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(share).alias("target_share"), F.max(limit).alias("max_repeats"))
    listed = F.broadcast(targets.select("source"))  # the wanted mixture, not data
    texts = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", source_name(F.col("source")).alias("source"), w.cast("double").alias("weight"), "text")
    counted = texts.join(listed, "source", "left_semi").select("doc_id", "source", "weight", "text").mapInArrow(_counter(_ranks(spark, tokenizer)), "doc_id long, source string, weight double, tokens long")
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    docs = scratch.save(counted.where("tokens > 0").withColumn("key", -F.log(uniform) / F.greatest("weight", F.lit(1e-6))).drop("weight"), "docs")

    have = {r["source"]: r for r in docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.collect()}
    room = {s: have[s]["tokens"] * repeats for s, (share, repeats) in wanted.items() if s in have}
    if total_tokens is None:
        total_tokens = sum(r["tokens"] for r in have.values())
    if exact:
        total_tokens = min((room[s] / wanted[s][0] for s in room if wanted[s][0] > 0 and room[s] > 0), default=0)
    plan = []
    for s, (share, repeats) in wanted.items():
        if s in have:
            budget = min(share * total_tokens, room[s])
            epochs = min(repeats, int(budget / have[s]["tokens"] + 1e-9))
            rest = budget - epochs * have[s]["tokens"] if epochs < repeats else 0.0
            plan.append((s, epochs, float(rest), float(budget)))
    plan = F.broadcast(spark.createDataFrame(plan, "source string, epochs int, rest double, budget double"))  # a row per source
    steps = max(16, math.ceil(sum(r["n"] for r in have.values()) / BUCKET_DOCS))
    placed = docs.join(plan.drop("budget"), "source").withColumn("bucket", F.floor(F.log2("key") * steps))
    before = F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))  # one row per source and bucket
    placed = placed.join(sums.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("before"), F.col("t")), ["source", "bucket"])
    inner = placed.where(F.col("before") + F.col("t") <= F.col("rest")).withColumn("extra", F.lit(1))
    edge = placed.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest")))
    running = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("extra", (F.col("before") + running - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    outer = placed.where(F.col("before") > F.col("rest")).withColumn("extra", F.lit(0))
    drawn = inner.unionByName(edge).unionByName(outer).select("doc_id", "source", "tokens", (F.col("epochs") + F.col("extra")).alias("copies")).where("copies > 0")
    drawn = scratch.save(drawn, "drawn")
    used = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("max_copies"))
    every = Window.partitionBy(F.lit(1))  # one row per target
    shares = targets.select("source", "target_share").join(used, "source", "left").join(plan.select("source", "budget"), "source", "left").na.fill(0, ["tokens", "documents", "max_copies", "budget"])
    whole = F.sum("tokens").over(every)
    reached = F.round(F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0), 6)
    return drawn, shares.select("source", "target_share", "budget", "tokens", reached.alias("share"), "documents", "max_copies")
