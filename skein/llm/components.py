"""Groups of linked records: connected components on a two-dimensional grid.

Ids are hashed to longs, on which the rounds work. In every round vertices are
hashed into ``side`` blocks, with another salt each time, and every edge into
the cell of its block pair, so the edges of a vertex with very many partners
spread over a whole row of cells. Each cell runs union-find on its own edges,
the root of a set being its member of the lowest rank in an order that is drawn
anew for the round. A vertex then takes the lowest representative of its row
and column and hops to that one's own representative (pointer jumping); links
between different representatives are the edges of a smaller graph, on which
the next round works, until all parents agree.

As the order is random, a vertex of a path is the lowest of its neighbourhood
with a chance that doesn't depend on how the ids are ordered, so the vertices
shrink by a constant factor a round whatever the input. The rounds' parents are
composed at the end and the smallest id of every component is looked up.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.scratch import Scratch

#: Edges that one cell is sized for, and edges from which a cell is worth a task of its own.
CELL_EDGES, LEAST_EDGES = 250_000, 5_000
#: Edges that a cell takes up before it reduces them to a forest.
_CHUNK = 1 << 20


def _ranks(ids: np.ndarray, salt: int) -> np.ndarray:
    """The place of every id in the round's order: a one-to-one mixing of 64 bits."""
    x = ids.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _forest(u: np.ndarray, v: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vertices, root of each, rank of the root): union-find over edges, all trees compressed.

    Vertices are indexed in rank order; the higher of two roots is hooked to
    the lower, then every path is halved until it is a star.
    """
    ids = np.unique(np.concatenate([u, v]))
    rank = _ranks(ids, salt)
    order = np.argsort(rank)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    a, b = place[np.searchsorted(ids, u)], place[np.searchsorted(ids, v)]
    parent = np.arange(len(ids))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        low, high = low[apart], high[apart]
        if not len(low):
            break
        by = np.lexsort((low, high))  # the lowest partner of every root comes first
        low, high = low[by], high[by]
        first = np.append(True, high[1:] != high[:-1])
        parent[high[first]] = low[first]
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        a, b = parent[low], parent[high]
    ids, rank = ids[order], rank[order]
    return ids, ids[parent], rank[parent]


def _union_find(salt: int):
    """(u, v) batches of one cell -> every vertex with its root; holds a forest and one chunk of edges."""

    def run(batches):
        us, vs, held = [], [], 0
        forest = None

        def reduce():
            return _forest(np.concatenate(us), np.concatenate(vs), salt)

        for batch in batches:
            us.append(batch.column(0).to_numpy())
            vs.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= _CHUNK:
                forest = reduce()
                us, vs, held = [forest[0]], [forest[1]], 0
        if us:
            forest = reduce()
        if forest is not None:
            whole = pa.RecordBatch.from_arrays([pa.array(x) for x in forest], names=["vertex", "root", "rank"])
            for start in range(0, whole.num_rows, 65536):
                yield whole.slice(start, 65536)

    return run


def side_of(edges: int, cores: int, cell_edges: int) -> int:
    """Blocks per side: enough that a cell holds about ``cell_edges``, or that every core has a cell of at least ``LEAST_EDGES``."""
    cells = max(edges / cell_edges, min(cores, edges / LEAST_EDGES))
    return max(1, math.ceil(math.sqrt(2 * cells)))


def contraction_rounds(edges: DataFrame, scratch: Scratch, cell_edges: int = CELL_EDGES) -> list[DataFrame]:
    """The (``vertex``, ``parent``, ``roots``) found in each round over the saved long edges (``u``, ``v``), u != v.

    A root is among its own roots, so one of several cells that disagree about
    a vertex leaves the disagreement with the root as well. Therefore only the
    vertices of more than one root have to go on: their parent, after its hop,
    is linked with the parents of their other roots.
    """
    rounds: list[DataFrame] = []
    cores = edges.sparkSession.sparkContext.defaultParallelism
    name = None
    while count := edges.count():
        number = len(rounds)
        side = side_of(count, cores, cell_edges)
        block = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(number)), F.lit(side))  # noqa: B023, E731
        low, high = F.least(block("u"), block("v")), F.greatest(block("u"), block("v"))
        cell = F.shiftright(high * (high + 1), 1) + low
        local = edges.repartitionById(side * (side + 1) // 2, cell.cast("int")).mapInArrow(_union_find(number), "vertex long, root long, rank long")
        found = local.groupBy("vertex").agg(F.min(F.struct("rank", "root"))["root"].alias("parent"), F.collect_set("root").alias("roots"))  # at most one root per cell of a row
        found = scratch.save(found, f"round{number}")
        rounds.append(found)
        several = found.where(F.size("roots") > 1)
        if name:
            scratch.drop(name)
        if several.isEmpty():
            break
        later = several.select(F.col("parent").alias("u"), F.explode("roots").alias("v")).where("u != v").distinct()
        for end in ("u", "v"):
            hop = several.select(F.col("vertex").alias(end), F.col("parent").alias("top"))
            later = later.join(hop, end, "left").withColumn(end, F.coalesce("top", end)).drop("top")
        name = f"edges{number}"
        edges = scratch.save(later.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), name)
    return rounds


def composed(rounds: list[DataFrame]) -> DataFrame:
    """(``vertex``, ``parent``) of all vertices of the first round after the last; joins as much as each round had open."""
    later: DataFrame | None = None
    for found in reversed(rounds):
        own = found.select("vertex", "parent")
        if later is not None:
            hop = found.where(F.size("roots") > 1).select("vertex", "parent")
            last = later.select(F.col("vertex").alias("parent"), F.col("parent").alias("last"))
            tops = hop.join(last, "parent", "left").select("vertex", F.coalesce("last", "parent").alias("last"))
            tops = tops.unionByName(later.join(hop, "vertex", "left_anti").select("vertex", F.col("parent").alias("last")))
            own = own.join(tops.withColumnRenamed("vertex", "parent"), "parent", "left").select("vertex", F.coalesce("last", "parent").alias("parent"))
        later = own
    return later


def _numbered(pairs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(vertex, name) of every id and the edges between vertices.

    An id's number is its 64-bit hash. The seed is changed until no two ids
    share a number, which the first does with 2.7 % of chance left at a billion
    ids.
    """
    for seed in range(1000):
        number = lambda c: F.xxhash64(F.col(c), F.lit(seed))  # noqa: B023, E731
        ends = pairs.select(F.explode(F.array(F.struct(number("a").alias("vertex"), F.col("a").alias("name")), F.struct(number("b").alias("vertex"), F.col("b").alias("name")))).alias("e")).select("e.*")
        names = scratch.save(ends.distinct(), f"names{seed}")
        if names.groupBy("vertex").count().where("count > 1").isEmpty():
            edges = pairs.where("a != b").select(F.least(number("a"), number("b")).alias("u"), F.greatest(number("a"), number("b")).alias("v")).distinct()
            return names, scratch.save(edges, "edges")
    raise RuntimeError("no seed without a collision")


def linked_groups(links: DataFrame, left: str, right: str, cell_edges: int = CELL_EDGES) -> DataFrame:
    """One row (``entity_id``, ``group_id``) per id that occurs in ``links``.

    ``group_id`` is the smallest id, in string order, of all ids linked to it
    directly or indirectly, itself included. Rows with a null on either side
    link nothing and their ids get no row; an id linked only to itself forms
    its own group; repeated and reversed rows count once; an empty table gives
    an empty result. Other columns are ignored.
    """
    scratch = Scratch(links.sparkSession, "components")
    pairs = links.select(F.col(left).cast("string").alias("a"), F.col(right).cast("string").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    names, edges = _numbered(scratch.save(pairs, "pairs"), scratch)
    rounds = contraction_rounds(edges, scratch, cell_edges)
    if not rounds:
        return names.select(F.col("name").alias("entity_id"), F.col("name").alias("group_id"))
    groups = names.join(composed(rounds), "vertex", "left").select("name", F.coalesce("parent", "vertex").alias("parent"))
    groups = scratch.save(groups, "groups")
    least = groups.groupBy("parent").agg(F.min("name").alias("group_id"))
    return groups.join(least, "parent").select(F.col("name").alias("entity_id"), "group_id")


def match_groups(alignment: DataFrame, cell_edges: int = CELL_EDGES) -> DataFrame:
    """Groups of a headerless alignment table (``c0``, ``c1``, label ``c2``).

    A row links if both ids are not null and ``c2`` > 0; NaN labels link
    nothing. Ids are compared without leading and trailing spaces and tabs.
    """
    trimmed = lambda c: F.regexp_replace(c, r"^[ \t]+|[ \t]+$", "")
    matching = alignment.where((F.col("c2") > 0) & ~F.isnan("c2")).select(trimmed("c0").alias("a"), trimmed("c1").alias("b"))
    return linked_groups(matching, "a", "b", cell_edges)
