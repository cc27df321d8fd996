"""The N best items of every group by merging sorted runs.

Scan tasks cut their rows into runs, order each by (hash of the group, group,
score, item), keep a group's first N items of a run and store the runs in the
shared folder. A bucket is a range of hashes; there are as many as the stored
rows need, so a task holds about ``BUCKET_ROWS`` rows whatever the table, and a
run is in bucket order for any number of them. One task per bucket merges its
pieces of the runs with a loser tree; once a group has its N items, every run
seeks to its next group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.scratch import Scratch

#: Rows of a run, rows that a bucket is sized for, hashes.
RUN_ROWS, BUCKET_ROWS, _HASHES = 500_000, 250_000, 1 << 30


def _firsts(*columns: pa.Array) -> np.ndarray:
    """True where a row differs from the one before it in any column."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = False
        for c in columns:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return new


def _runs(n: int):
    """Scan batches -> truncated runs, each a stretch of rows with the same run id."""

    def cut(tables):
        t = pa.Table.from_batches(tables).combine_chunks()
        t = t.take(pc.sort_indices(t, [("grp", "ascending"), ("item", "ascending"), ("score", "descending")]))
        cols = [t.column(c).combine_chunks() for c in ("grp", "item")]
        t = t.filter(pa.array(_firsts(*cols)))  # a pair counts once, with its best score
        t = t.take(pc.sort_indices(t, [("h", "ascending"), ("grp", "ascending"), ("score", "descending"), ("item", "ascending")]))
        new = _firsts(t.column("grp").combine_chunks())
        at = np.arange(len(new))
        rank = at - np.maximum.accumulate(np.where(new, at, 0))
        return t.filter(pa.array(rank < n))

    def run(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        held, rows = [], 0

        def flush():
            t = cut(held)
            key = task * 1_000_000 + number
            t = t.append_column("run", pa.array(np.full(t.num_rows, key, np.int64))).append_column("pos", pa.array(np.arange(t.num_rows, dtype=np.int32)))
            yield from t.to_batches(max_chunksize=20_000)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RUN_ROWS:
                yield from flush()
                held, rows, number = [], 0, number + 1
        if rows:
            yield from flush()

    return run


class _Run:
    """A cursor on one sorted run of a bucket."""

    __slots__ = ("hashes", "groups", "items", "scores", "ends", "at", "key")

    def __init__(self, hashes: list, groups: list, items: list, scores: list, ends: list):
        self.hashes, self.groups, self.items, self.scores, self.ends, self.at = hashes, groups, items, scores, ends, 0
        self.load()

    def load(self) -> None:
        """The head's key, or none at the end of the run."""
        i = self.at
        self.key = (self.hashes[i], self.groups[i], -self.scores[i], self.items[i]) if i < len(self.groups) else None

    def next(self) -> None:
        self.at += 1
        self.load()

    def seek(self) -> None:
        """To the first row of the next group."""
        self.at = self.ends[self.at]
        self.load()


class LoserTree:
    """A tournament over runs: ``losers`` holds the loser of each match, ``winner`` the run with the smallest key."""

    def __init__(self, runs: list[_Run]):
        self.runs, self.k = runs, len(runs)
        self.losers = [-1] * self.k
        self.winner = -1
        for i in range(self.k):
            self.play(i, building=True)

    def beats(self, a: int, b: int) -> bool:
        x, y = self.runs[a].key, self.runs[b].key
        return x is not None and (y is None or x < y or (x == y and a < b))

    def play(self, i: int, building: bool = False) -> None:
        """Replay the matches on the path of run ``i``."""
        node, up = (i + self.k) >> 1, i
        while node:
            if building and self.losers[node] < 0:
                self.losers[node] = up
                return
            if self.beats(self.losers[node], up):
                self.losers[node], up = up, self.losers[node]
            node >>= 1
        self.winner = up


def merge_runs(runs: list[_Run], n: int):
    """(hash, group, item, score, rank) of each group's first ``n`` distinct items."""
    if not runs:
        return
    tree = LoserTree(runs)
    while (head := runs[tree.winner]).key is not None:
        group, taken, done = head.key[:2], set(), False
        while (head := runs[tree.winner]).key is not None and head.key[:2] == group:
            if done:
                head.seek()
            else:
                item = head.key[3]
                if item not in taken:
                    taken.add(item)
                    yield *group, item, -head.key[2], len(taken)
                    done = len(taken) == n
                head.next() if not done else head.seek()
            tree.play(tree.winner)


def _loaded(part: pa.Table) -> _Run:
    """A cursor on a run, with the end of every row's group."""
    groups = part.column("grp").combine_chunks()
    starts = np.flatnonzero(_firsts(groups))
    ends = np.repeat(np.append(starts[1:], len(groups)), np.diff(np.append(starts, len(groups))))
    return _Run(part.column("h").to_pylist(), groups.to_pylist(), part.column("item").to_pylist(), part.column("score").to_pylist(), ends.tolist())


def _merge(n: int, schema: pa.Schema):
    """Merges the runs of one bucket."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        keys = table.column("run").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        runs = [_loaded(table.slice(i, j - i)) for i, j in zip(edges, edges[1:])]
        out: list[list] = [[], [], [], []]
        for row in merge_runs(runs, n):
            for column, value in zip(out, row[1:]):
                column.append(value)
            if len(out[0]) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                out = [[], [], [], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def top_items(scores: DataFrame, n: int = 5, group: str = "s_id", item: str = "t_id", score: str = "score", low: float = 0.0, high: float = 1.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The ``n`` best items of every group: (``group``, ``item``, ``score``, ``rank``).

    Best means highest score, ties by smaller item in string order. Scores
    that are null, NaN or outside ``low`` to ``high`` don't count, nor do rows
    with a null group or item; a pair that occurs more than once counts once,
    with its highest score; a group with fewer items keeps them all. Empty
    input gives an empty result; extra columns are ignored. A group of any
    size sends at most ``n`` rows per run to its bucket.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    s = F.col(score).cast("double")
    rows = scores.where(F.col(group).isNotNull() & F.col(item).isNotNull() & s.between(low, high) & ~F.isnan(s)).select(
        F.pmod(F.xxhash64(group), F.lit(_HASHES)).cast("int").alias("h"), F.col(group).alias("grp"), F.col(item).alias("item"), (s + F.lit(0.0)).alias("score")
    )
    runs = Scratch(scores.sparkSession, "top").save(rows.mapInArrow(_runs(n), "h int, grp string, item string, score double, run long, pos int"), "runs")
    buckets = max(scores.sparkSession.sparkContext.defaultParallelism, math.ceil(runs.count() / bucket_rows))
    bucket = F.floor(F.col("h").cast("long") * buckets / _HASHES).cast("int")
    stored = runs.repartitionById(buckets, bucket).sortWithinPartitions("run", "pos")
    out = pa.schema([("grp", pa.string()), ("item", pa.string()), ("score", pa.float64()), ("rank", pa.int32())])
    merged = stored.drop("pos").mapInArrow(_merge(n, out), "grp string, item string, score double, rank int")
    return merged.select(F.col("grp").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank")


def best_targets(scores: DataFrame, entities: DataFrame, n: int = 5) -> DataFrame:
    """``top_items`` of the score rows whose ``s_id`` is an entity's ``research_entity_id``."""
    known = entities.select(F.col("research_entity_id").alias("s_id")).distinct()
    return top_items(scores.join(known, "s_id", "left_semi"), n)
