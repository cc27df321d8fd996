"""Copies that differ only in spacing, case, punctuation and order.

A blocked Bloom filter is cut into segments of one size, as many as the rows
need; all bits of a hash lie in one segment. Every partition marks its canonical
hashes in two filters, once seen and repeatedly seen, and ships of each segment
that it touches the set bits only. Merging partitions ORs both and adds the bits
that two sides had seen once; a hash can only be repeated if all its bits stand
in the merged repeat filter. Only those rows are shuffled for exact grouping,
the others are singletons where they stand.

The merged filter is probed in ranges of segments of at most ``PASS_BYTES``, one
pass over the hashes each, so a task never holds more than one range, whatever
the rows: 1 pass up to 89 million rows, 12 for a billion.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.words import bare_set
from skein.plans.scratch import Scratch

#: Bits per row, hash functions, bits of a segment, bytes of the segments probed in one pass.
BITS_PER_ROW, HASHES, SEGMENT, PASS_BYTES = 12, 4, 1 << 19, 1 << 27


def _segment(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The segment of every 64-bit hash, by its upper half."""
    return ((hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def _slots(hashes: np.ndarray, size: int) -> np.ndarray:
    """(HASHES, n) bit positions within the segment by double hashing of the lower half."""
    low = hashes.view(np.uint64) & np.uint64(0xFFFFFFFF)
    step, mask = (low >> np.uint64(13)) | np.uint64(1), np.uint64(size - 1)
    return np.stack([((low + np.uint64(i) * step) & mask).astype(np.int64) for i in range(HASHES)])


def _packed(slots: np.ndarray, size: int) -> bytes:
    """Set bits of a segment: their sorted positions or, where that is shorter, the bits."""
    if len(slots) * 32 < size:
        return slots.astype(np.uint32).tobytes()
    bits = np.zeros(size, bool)
    bits[slots] = True
    return np.packbits(bits).tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8))) if len(data) == size // 8 else np.frombuffer(data, np.uint32).astype(np.int64)


def _mark(segments: int, size: int):
    """Hashes of one partition -> (segment, bits seen once or more, bits seen repeatedly), a row per touched segment."""

    def run(batches):
        hashes = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
        if not len(h):
            return
        bits, counts = np.unique((_segment(h, segments) * size + _slots(h, size)).ravel(), return_counts=True)
        of = bits // size
        edges = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
        for start in range(0, len(edges) - 1, 256):
            parts = [(bits[i:j] % size, counts[i:j] > 1) for i, j in zip(edges[start : start + 256], edges[start + 1 : start + 257])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(of[edges[start : start + len(parts)]].astype(np.int32)), pa.array([_packed(x, size) for x, _ in parts], pa.binary()), pa.array([_packed(x[again], size) for x, again in parts], pa.binary())],
                names=["segment", "once", "again"],
            )

    return run


def _merge(size: int):
    """The rows of a segment stand together; each segment is merged by itself."""

    def run(batches):
        now, once, again = None, None, None
        done: list[tuple[int, bytes]] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int32()), pa.array([x for _, x in done], pa.binary())], names=["segment", "again"])

        for b in batches:
            for segment, one, more in zip(*(b.column(i).to_pylist() for i in range(3))):
                if segment != now:
                    if now is not None:
                        done.append((now, np.packbits(again).tobytes()))
                        if len(done) == 64:
                            yield batch()
                            done = []
                    now, once, again = segment, np.zeros(size, bool), np.zeros(size, bool)
                slots = _unpacked(one, size)
                again[slots[once[slots]]] = True
                again[_unpacked(more, size)] = True
                once[slots] = True
        if now is not None:
            done.append((now, np.packbits(again).tobytes()))
            yield batch()

    return run


def _probe(shared, first: int, segments: int, size: int):
    """Whether a hash may be repeated, for the hashes whose segment is one of the shared range."""

    @F.arrow_udf(T.BooleanType())
    def seen(hashes: pa.Array) -> pa.Array:
        table = np.frombuffer(shared.value, np.uint8)
        h = hashes.fill_null(0).to_numpy(zero_copy_only=False)
        base = np.clip(_segment(h, segments) - first, 0, len(table) * 8 // size - 1) * (size // 8)
        hit = np.ones(len(h), bool)
        for slot in _slots(h, size):
            hit &= (table[base + (slot >> 3)] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
        return pa.array(hit)

    return seen


def possible_repeats(df: DataFrame, key: str, rows: int, pass_bytes: int = PASS_BYTES, size: int = SEGMENT) -> DataFrame:
    """``df`` with a boolean ``maybe``: false only where the 64-bit hash ``key`` is null or surely occurs once in ``df``."""
    spark = df.sparkSession
    scratch = Scratch(spark, "repeats")
    segments = max(1, math.ceil(rows * BITS_PER_ROW / size))
    marks = df.select(key).where(F.col(key).isNotNull()).mapInArrow(_mark(segments, size), "segment int, once binary, again binary")
    merged = scratch.save(marks.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge(size), "segment int, again binary"), "merged")
    per_pass = max(1, pass_bytes * 8 // size)
    upper = F.shiftrightunsigned(F.col(key), 32)
    of = F.shiftright(upper * F.lit(segments).cast("long"), 32)
    passes = []
    for first in range(0, segments, per_pass):
        last = min(segments, first + per_pass)
        table = np.zeros((last - first) * (size // 8), np.uint8)  # at most pass_bytes, whatever the rows
        for r in merged.where(F.col("segment").between(first, last - 1)).toLocalIterator():
            at = (r["segment"] - first) * (size // 8)
            table[at : at + size // 8] = np.frombuffer(r["again"], np.uint8)
        mine = df if last - first == segments else df.where(of.between(first, last - 1) | (F.col(key).isNull() & F.lit(first == 0)))
        seen = _probe(spark.sparkContext.broadcast(table.tobytes()), first, segments, size)
        passes.append(mine.withColumn("maybe", F.col(key).isNotNull() & seen(F.col(key))))
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return out


def _parted(entities: DataFrame, row_id: str, values: str, pass_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(row ids that surely stand alone, row ids and exact keys that may repeat)."""
    canon = F.array_join(bare_set(F.col(values)), "|")
    rows = entities.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("row_id"), canon.alias("canon"))
    keyed = rows.select("row_id", F.when(F.col("canon") != "", F.unhex(F.md5("canon"))).alias("key"), F.when(F.col("canon") != "", F.xxhash64("canon")).alias("h"))
    keyed = Scratch(entities.sparkSession, "copies").save(keyed, "keyed")
    marked = possible_repeats(keyed, "h", keyed.count(), pass_bytes)
    return marked.where(~F.col("maybe")).select("row_id"), marked.where("maybe").select("row_id", "key")


def format_copies(entities: DataFrame, row_id: str = "row_id", values: str = "aliases", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row (``row_id_first``, ``row_id``) per copy of an earlier record.

    Rows whose sets of bare forms of ``values`` are equal and not empty are
    copies of one another; ``row_id_first`` is the smallest of their ids and
    ``row_id`` each of the others. A row whose set is empty (null or empty
    list, empty strings, punctuation only) is a copy of nothing. Row ids must
    be unique; a row with a null id is ignored, extra columns too. Groups are
    aggregated before the shuffle; rows of a hot group are split by adaptive
    execution in the join with its first row.
    """
    _, maybe = _parted(entities, row_id, values, pass_bytes)
    firsts = maybe.groupBy("key").agg(F.min("row_id").alias("row_id_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return maybe.join(firsts.drop("n"), "key").where("row_id > row_id_first").select("row_id_first", "row_id")


def collapsed(entities: DataFrame, row_id: str = "row_id", values: str = "aliases", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row (``row_id``, ``copies``) per distinct record: its smallest id and the number of its copies, itself included.

    Records with an empty set stay as they are, with one copy each.
    """
    alone, maybe = _parted(entities, row_id, values, pass_bytes)
    groups = maybe.groupBy("key").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("copies"))
    return alone.withColumn("copies", F.lit(1).cast("long")).unionByName(groups.select("row_id", "copies"))
