"""All similar pairs between set-valued records, by metric pivot partitioning.

Equal sets collapse into one class first. Under Jaccard distance (a metric) a
class takes as pivot the nearest leader within RHO = radius / 2, or itself: the
pivots form a cover of small cells. If x has home pivot p and y lies within
``radius`` of x, the triangle inequality gives d(y, p) <= R_p + radius, R_p
being the distance of p's farthest home member; so every class is replicated to
the pivots within that bound, and a cell holds all partners of its home
members. Cells are joined exactly, pairs whose distances to the pivot differ by
more than ``radius`` being skipped.

Because R_p + radius < 1, a class within the bound shares a value with p. Pivots
are therefore found through the values, ordered by rarity. Sets of n and m
values with Jaccard similarity t have at least t / (1 + t) (n + m) in common, so
their first common value stands early enough in both; postings are keyed by
value and partner length, and a value that recurs in very many sets brings
those together only whose lengths and positions leave room for the rest.
Two home members of a cell are at most 2 RHO <= radius apart, so a cell's home
pairs are all results and no cell does work beyond its output but for the
replicas near its boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.words import bare_set
from skein.plans.scratch import Scratch

_EPS = 1e-9


def _overlap(n: Column, m: Column, t: Column) -> Column:
    """The fewest common values of sets of ``n`` and ``m`` values with similarity ``t``."""
    return F.ceil(t / (1 + t) * (n + m) - _EPS)


def _length(n: Column) -> Column:
    """A number that rises with the length of a set: the length itself up to 32, steps of 5 % above."""
    return F.when(n <= 32, n).otherwise(32 + F.floor(20 * F.log(n / 32.0))).cast("int")


def _jaccard(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _classes(records: DataFrame, row_id: str, values: Column, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(row_id, cid) of every row with a non-empty set, and (cid, toks) of each distinct set."""
    sets = records.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("row_id"), F.array_sort(F.transform(values, lambda v: F.xxhash64(v))).alias("toks"))
    sets = scratch.save(sets.where(F.size("toks") > 0), "sets")
    distinct = scratch.save(sets.groupBy("toks").agg(F.min("row_id").alias("cid"), F.count(F.lit(1)).alias("copies")), "distinct")
    # a class of one row is its own member; only rows of larger classes are looked up
    members = sets.join(distinct.where("copies > 1").drop("copies"), "toks").select("row_id", "cid")
    return members, distinct


def _ordered(distinct: DataFrame) -> DataFrame:
    """(cid, toks by rising frequency, shared: how many of its values other classes hold as well)."""
    exploded = distinct.select("cid", F.explode("toks").alias("tok"))
    frequency = exploded.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = exploded.join(frequency, "tok", "left").select("cid", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "tok").alias("t"))
    lists = known.groupBy("cid").agg(F.array_sort(F.collect_list("t")).alias("t"))  # as long as one record's set
    return lists.select("cid", F.col("t.tok").alias("toks"), F.size(F.filter("t", lambda t: t["df"] > 1)).alias("shared"))


def _shared(ordered: DataFrame) -> DataFrame:
    """A row per value that other classes hold as well, with its position ``pos`` of ``n``."""
    rows = ordered.where("shared > 0").select("*", F.posexplode("toks").alias("pos", "tok"), F.size("toks").alias("n"))
    return rows.where(F.col("pos") >= F.col("n") - F.col("shared"))


def _indexed(ordered: DataFrame, least: Column, longer: bool = False) -> DataFrame:
    """Postings under (``tok``, own ``length``) for partners of similarity ``least``, with ``longer`` for those of at least the own length only.

    The first common value of two sets leaves both no more values than follow
    it, so its position is bounded by the lengths of both.
    """
    n = F.col("n")
    fewest = F.ceil(2 * least / (1 + least) * n - _EPS) if longer else F.ceil(least * n - _EPS)
    return _shared(ordered).where(n - F.col("pos") >= fewest).withColumn("length", _length(n))


def _probing(ordered: DataFrame, least: Column, shorter: bool = False) -> DataFrame:
    """Postings under (``tok``, ``length``) of every length that a partner of similarity ``least`` may have, with ``shorter`` up to the own length."""
    n = F.col("n")
    low = F.ceil(least * n - _EPS)
    high = F.least(F.floor(n / least + _EPS), F.floor((n - F.col("pos")) * (1 + least) / least - n + _EPS))
    high = F.least(high, n) if shorter else high
    rows = _shared(ordered).withColumn("low", low).withColumn("high", high).where("low <= high")
    return rows.withColumn("length", F.explode(F.sequence(_length(F.col("low")), _length(F.col("high"))))).drop("low", "high")


def _met(a: str, b: str, t: Column) -> Column:
    """Whether two postings (columns n, pos and toks with these prefixes) meet at the first common value and may reach ``t``."""
    left = F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos"))
    return left >= _overlap(F.col(f"{a}n"), F.col(f"{b}n"), t)


def similar_classes(records: DataFrame, row_id: str, values: Column, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of the classes of equal sets.

    ``members`` has (``row_id``, ``cid``) for classes of several rows, ``pairs``
    (``cid_a``, ``cid_b``, ``similarity``) each pair of different classes once,
    smaller first. A class is named by its smallest row id.
    """
    if not 0.34 < threshold <= 1:
        raise ValueError("the pivot bound needs a threshold above 0.34")
    radius = 1 - threshold
    rho = radius / 2
    scratch = Scratch(records.sparkSession, "pairs")
    members, distinct = _classes(records, row_id, values, scratch)
    ordered = scratch.save(_ordered(distinct), "ordered")

    # Leaders: of the classes with a value in their prefix, the one with the smallest hash.
    near = _indexed(ordered, F.lit(1 - rho)).select("tok", "cid", "toks")
    rank = F.struct(F.xxhash64("cid").alias("h"), "cid", "toks")
    leaders = near.groupBy("tok").agg(F.min(rank).alias("l")).select("tok", F.col("l.cid").alias("pivot"), F.col("l.toks").alias("ptoks"))
    tried = near.join(leaders, "tok").where("cid != pivot").withColumn("d", 1 - _jaccard("toks", "ptoks")).where(F.col("d") <= rho + _EPS)
    homes = scratch.save(tried.groupBy("cid").agg(F.min(F.struct("d", "pivot")).alias("h")).select("cid", "h.pivot", "h.d"), "homes")

    # A class is its own pivot (home) unless it went away to another; a pivot with other members has a radius.
    radii = homes.groupBy("pivot").agg(F.max("d").alias("r"))
    placed = ordered.join(homes.select("cid", F.lit(True).alias("away")), "cid", "left").join(radii.withColumnRenamed("pivot", "cid"), "cid", "left")
    placed = scratch.save(placed.select("cid", "toks", "shared", F.col("away").isNull().alias("home"), "r"), "placed")
    first = F.element_at(F.array_intersect("atoks", "btoks"), 1) == F.col("tok")  # a pair is found once, at its first common value

    # Cells of one member: its partners above it, shorter set against longer.
    t = F.lit(threshold)
    side = lambda df, x: df.select("tok", "length", *(F.col(c).alias(f"{x}{c}") for c in ("cid", "toks", "n", "pos", "home", "r")))
    alone = F.when(F.col("acid") < F.col("bcid"), F.col("ahome") & F.col("ar").isNull()).otherwise(F.col("bhome") & F.col("br").isNull())
    single = (
        side(_indexed(placed, t, longer=True), "a")
        .join(side(_probing(placed, t, shorter=True), "b"), ["tok", "length"])
        .where((F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("acid") < F.col("bcid"))))
        .where(alone & _met("a", "b", t) & first)
        .withColumn("similarity", _jaccard("atoks", "btoks"))
        .where(F.col("similarity") >= threshold - _EPS)
        .select(F.least("acid", "bcid").alias("cid_a"), F.greatest("acid", "bcid").alias("cid_b"), "similarity")
    )

    # Cells of several: every class within the pivot's radius and the threshold's.
    pivots = placed.where("r is not null")
    bound = F.lit(threshold) - F.col("r")
    cells = (
        side(_probing(pivots, bound), "a")
        .join(side(_indexed(placed, F.lit(threshold - rho)), "b"), ["tok", "length"])
        .where("acid != bcid")
        .where(_met("a", "b", F.lit(threshold) - F.col("ar")) & first)
        .withColumn("dy", 1 - _jaccard("atoks", "btoks"))
        .where(F.col("dy") <= F.col("ar") + radius + _EPS)
        .select(F.col("acid").alias("p"), F.col("bcid").alias("y"), "dy", F.col("ahome").alias("home"), F.col("btoks").alias("ytoks"))
    )
    cells = scratch.save(cells, "cells")
    direct = cells.where(F.col("home") & (F.col("y") > F.col("p")) & (F.col("dy") <= radius + _EPS)).select(F.col("p").alias("cid_a"), F.col("y").alias("cid_b"), (1 - F.col("dy")).alias("similarity"))

    # The other home members against their cell; the pivot itself is part of it.
    xs = homes.join(ordered, "cid").select(F.col("pivot").alias("p"), F.col("cid").alias("x"), F.col("d").alias("dx"), F.col("toks").alias("xtoks"))
    wide = cells.select("p", "y", "dy", "ytoks")
    centre = pivots.select(F.col("cid").alias("p"), F.col("cid").alias("y"), F.lit(0.0).alias("dy"), F.col("toks").alias("ytoks"))
    inside = (
        xs.join(wide.unionByName(centre), "p")
        .where("y > x")
        .where(F.abs(F.col("dx") - F.col("dy")) <= radius + _EPS)
        .withColumn("similarity", _jaccard("xtoks", "ytoks"))
        .where(F.col("similarity") >= threshold - _EPS)
        .select(F.col("x").alias("cid_a"), F.col("y").alias("cid_b"), "similarity")
    )
    return members, scratch.save(single.unionByName(direct.where(F.col("similarity") >= threshold - _EPS)).unionByName(inside), "pairs")


def name_set(name: str = "canonical_name", aliases: str = "aliases") -> Column:
    """The distinct bare forms of an entity's name and aliases."""
    return bare_set(F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>"))))


def similar_set_links(records: DataFrame, row_id: str = "row_id", values: Column | None = None, threshold: float = 0.6) -> DataFrame:
    """(``row_id``, ``class_id``, ``links``) per row: its class of equal sets and how many other classes are similar to it.

    Rows with an empty set have class null and no links.
    """
    members, pairs = similar_classes(records, row_id, name_set() if values is None else values, threshold)
    ends = pairs.select(F.explode(F.array("cid_a", "cid_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    has = F.size(name_set() if values is None else values) > 0
    rows = records.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("row_id"), has.alias("has"))
    named = rows.join(members.withColumnRenamed("cid", "class_id"), "row_id", "left")
    named = named.select("row_id", F.when(F.col("has"), F.coalesce("class_id", "row_id")).alias("class_id"))
    return named.join(ends, "class_id", "left").select("row_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def similar_set_pairs(records: DataFrame, row_id: str = "row_id", values: Column | None = None, threshold: float = 0.6) -> DataFrame:
    """All pairs (``row_id_a``, ``row_id_b``), smaller first, of rows whose value sets have Jaccard similarity >= ``threshold``.

    ``values`` is an array column of strings, by default the bare forms of
    canonical_name and aliases. Null and empty sets are similar to nothing;
    values repeated in a record count once; equal sets are pairs; row ids must
    be unique, a null id is ignored; an empty table gives an empty result.
    Values are compared by 64-bit hash. The result grows with the pairs of
    copies; ``similar_set_links`` and ``similar_classes`` don't expand them.
    """
    members, pairs = similar_classes(records, row_id, name_set() if values is None else values, threshold)
    a = members.select(F.col("row_id").alias("row_id_a"), F.col("cid").alias("cid"))
    b = members.select(F.col("row_id").alias("row_id_b"), F.col("cid").alias("cid"))
    copies = a.join(b, "cid").where("row_id_a < row_id_b").select("row_id_a", "row_id_b")
    rows = pairs.join(a.withColumnRenamed("cid", "cid_a"), "cid_a", "left").join(b.withColumnRenamed("cid", "cid_b"), "cid_b", "left")
    x, y = F.coalesce("row_id_a", "cid_a"), F.coalesce("row_id_b", "cid_b")
    return rows.select(F.least(x, y).alias("row_id_a"), F.greatest(x, y).alias("row_id_b")).unionByName(copies)
