"""Train, validation and test splits that keep linked records together.

Records that share an entity are grouped (connected components over entity
ids). Components are assigned whole, the large before the small: they are put
into levels by size, each either a run of size classes that one chunk holds or
one class (sizes within a factor of two) in hashed chunks. A level's targets are
its share of every split and label plus what the levels above left over, so
small components make up for the large. Every chunk starts from a hashed
assignment and anneals it by moving and exchanging components; several restarts
run in parallel and the best is kept. What the chunks of the last level together
still miss is settled in one of them, annealed on from where it stands.
"""

from __future__ import annotations

import math
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.components import linked_groups
from skein.plans.scratch import Scratch

PROPORTIONS = {"train": 0.8, "dev": 0.1, "test": 0.1}
#: Components of a chunk, restarts of each chunk, annealing steps per component.
CHUNK, RESTARTS, STEPS = 20_000, 4, 6
_ID = ("source_ent.research_entity_id", "target_ent.research_entity_id")


def _with_ids(records: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(id, ids): the trimmed, non-empty ids of the fields, each split at the bar."""
    parts = F.concat(*(F.coalesce(F.split(F.col(f), r"\|"), F.array().cast("array<string>")) for f in fields))
    clean = F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", "")), lambda x: x != "")
    return records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.array_distinct(clean).alias("ids"))


def record_groups(records: DataFrame, id_col: str = "pair_id", fields: tuple[str, ...] = _ID) -> DataFrame:
    """(``id_col``, ``group_id``, ``group_rows``) of every row with a non-null id.

    Rows that share an id in any of ``fields``, directly or through other rows,
    have one group; ``group_id`` is its smallest row id. A field may hold
    several ids joined by a bar; ids are compared without leading and trailing
    spaces and tabs. Null and empty ids link nothing, so a row without an id is
    a group of one. Row ids must be unique.
    """
    scratch = Scratch(records.sparkSession, "groups")
    rows = scratch.save(_with_ids(records, id_col, fields), "rows")
    first = F.element_at("ids", 1)
    links = rows.where(F.size("ids") > 0).select(first.alias("a"), F.explode("ids").alias("b"))
    groups = linked_groups(links, "a", "b")
    linked = rows.where(F.size("ids") > 0).select("id", first.alias("entity_id")).join(groups, "entity_id").select("id", "group_id")
    linked = scratch.save(linked, "linked")
    named = linked.groupBy("group_id").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("group_rows"))
    joined = linked.join(named, "group_id").select(F.col("id").alias(id_col), F.col("least").alias("group_id"), "group_rows")
    alone = rows.where(F.size("ids") == 0).select(F.col("id").alias(id_col), F.col("id").alias("group_id"), F.lit(1).cast("long").alias("group_rows"))
    return joined.unionByName(alone)


def _deviation(held: list[list[float]], target: list[list[float]]) -> float:
    return sum((h - t) ** 2 for hs, ts in zip(held, target) for h, t in zip(hs, ts))


def anneal(sizes: list[dict[int, int]], start: list[int], target: list[list[float]], steps: int, seed: int) -> tuple[float, list[int]]:
    """(deviation, split of every component) after ``steps`` tried moves and exchanges; the best state met.

    ``sizes`` has each component's rows by kind (the place of its label),
    largest component first; those are tried more often. ``target`` has the
    wanted rows of every split by kind.
    """
    rng = random.Random(seed)
    place, kinds, n = list(start), len(target[0]), len(sizes)
    held = [[0.0] * kinds for _ in target]
    for size, s in zip(sizes, place):
        for k, rows in size.items():
            held[s][k] += rows
    cost = _deviation(held, target)
    best, undo = cost, []  # the moves since the best state
    heat = max(1.0, cost / 10)
    cool = (0.01 / heat) ** (1 / max(1, steps))
    for _ in range(steps):
        heat *= cool
        i = int(n * rng.random() ** 2)
        a = place[i]
        if rng.random() < 0.5:
            j = rng.randrange(n)
            b = place[j]
            move = dict(sizes[i])
            for k, rows in sizes[j].items():
                move[k] = move.get(k, 0) - rows
        else:
            j, b, move = -1, rng.randrange(len(target)), sizes[i]
        if a == b:
            continue
        delta = 0.0
        for k, m in move.items():
            delta += 2 * m * (m - held[a][k] + target[a][k] + held[b][k] - target[b][k])
        if delta <= 0 or rng.random() < math.exp(-min(700.0, delta / heat)):
            for k, m in move.items():
                held[a][k] -= m
                held[b][k] += m
            place[i] = b
            undo.append((i, a))
            if j >= 0:
                place[j] = a
                undo.append((j, b))
            cost += delta
            if cost < best - 1e-9:
                best, undo = cost, []
    for i, was in reversed(undo):
        place[i] = was
    return best, place


def levels_of(classes: list[tuple[int, int]], chunk: int) -> list[list[int]]:
    """Size classes by (class, components), largest class first -> runs of classes that fit one chunk, or one class of any number."""
    levels: list[list[int]] = []
    room = 0
    for size, count in classes:
        if levels and count <= room:
            levels[-1].append(size)
            room -= count
        else:
            levels.append([size])
            room = chunk - count
    return levels


def _search(shares: tuple[float, ...], left: dict, rows: dict | None, seed: int):
    """Anneals one try of one chunk.

    ``left`` is what is missing of each (split, label) before the level,
    ``rows`` the level's rows of each label: the chunk takes its part of both.
    Without ``rows`` the chunk is to hold what it holds and all that is missing.
    """

    def search(table: pa.Table) -> pa.Table:
        ids, counts, starts = (table.column(c).to_pylist() for c in ("group_id", "labels", "at"))
        order = sorted(range(len(ids)), key=lambda i: (-sum(x["n"] for x in counts[i]), ids[i]))
        kinds: dict = {}
        sizes = [{kinds.setdefault(x["label"], len(kinds)): x["n"] for x in counts[i]} for i in order]
        own = [0] * len(kinds)
        for size in sizes:
            for k, n in size.items():
                own[k] += n
        held = [[0] * len(kinds) for _ in shares]
        for i, size in zip(order, sizes):
            for k, n in size.items():
                held[starts[i]][k] += n
        base = lambda s, label, k: shares[s] * own[k] + left.get((s, label), 0.0) * own[k] / rows[label] if rows else held[s][k] + left.get((s, label), 0.0)
        target = [[max(0.0, base(s, label, k)) for label, k in kinds.items()] for s in range(len(shares))]
        for k, n in enumerate(own):  # what a split has too much already can't be given back: the others share the rest
            scale = n / max(1e-9, sum(t[k] for t in target))
            for t in target:
                t[k] *= scale
        restart = table.column("restart")[0].as_py()
        cost, place = anneal(sizes, [starts[i] for i in order], target, STEPS * len(ids) + 2000, random.Random(f"{seed}-{restart}-{ids[order[0]]}").randrange(1 << 30))
        n = len(ids)
        return pa.table({
            "chunk": table.column("chunk"), "restart": pa.array([restart] * n, pa.int32()), "cost": pa.array([cost] * n, pa.float64()),
            "group_id": pa.array([ids[i] for i in order], pa.int64()), "labels": table.column("labels").take(pa.array(order)), "at": pa.array(place, pa.int32()),
        })

    return search


def _chunk(chunks: int, seed: int, name: str) -> Column:
    return F.pmod(F.xxhash64("group_id", F.lit(f"{seed}-{name}")), F.lit(chunks)).cast("int")


def _annealed(level: DataFrame, chunks: int, restarts: list[Column], shares: tuple[float, ...], left: dict, rows: dict | None, seed: int, scratch: Scratch, name: str) -> DataFrame:
    """(group_id, labels, at) of a level; ``restarts`` has the starting split of each try."""
    tries = level.select("group_id", "labels", _chunk(chunks, seed, name).alias("chunk"), F.posexplode(F.array(*restarts)).alias("restart", "at"))
    schema = "chunk int, restart int, cost double, group_id long, labels array<struct<label:string,n:bigint>>, at int"
    tried = scratch.save(tries.groupBy("chunk", "restart").applyInArrow(_search(shares, left, rows, seed), schema), f"tried{name}")
    best = tried.groupBy("chunk").agg(F.min(F.struct("cost", "restart")).alias("b")).select("chunk", F.col("b.restart").alias("restart"))  # a row per chunk
    return tried.join(best, ["chunk", "restart"], "left_semi").select("group_id", "labels", "at")


def assign_splits(records: DataFrame, proportions: dict[str, float] | None = None, id_col: str = "pair_id", label: str = "label", fields: tuple[str, ...] = _ID, seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """(``id_col``, ``group_id``, ``group_rows``, ``split``): every row's new split, one per group.

    The splits approach ``proportions`` in rows and within each label, whatever
    its values (a null label counts as one of its own). A single group larger
    than a split's share overfills the split it fits best. The result depends
    only on the rows and ``seed``. An empty table gives an empty result.
    """
    spark = records.sparkSession
    names, shares = zip(*(proportions or PROPORTIONS).items())
    if abs(sum(shares) - 1) > 1e-9:
        raise ValueError("proportions must sum to 1")
    scratch = Scratch(spark, "split")
    groups = scratch.save(record_groups(records, id_col, fields), "groups")
    labelled = groups.join(records.select(F.col(id_col), F.col(label).cast("string").alias("label")), id_col)
    counted = labelled.groupBy("group_id", "label").agg(F.count(F.lit(1)).alias("n"))
    parts = counted.groupBy("group_id").agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("label", "n"))).alias("labels"))  # one entry per label
    parts = scratch.save(parts.withColumn("class", F.floor(F.log2("rows") + 1e-9).cast("int")), "components")
    classes = [(r["class"], r["count"]) for r in parts.groupBy("class").count().orderBy(F.desc("class")).collect()]  # at most 63 rows
    hashed = lambda salt: F.pmod(F.xxhash64("group_id", F.lit(seed), F.lit(salt)), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def start(salt: int) -> Column:
        at, edge = F.lit(len(shares) - 1), 1.0
        for s in range(len(shares) - 2, -1, -1):
            edge -= shares[s + 1]
            at = F.when(hashed(salt) < edge, s).otherwise(at)
        return at.cast("int")

    def tallied(done: DataFrame) -> dict:
        """Rows by (split, label): as many entries as there are splits and labels."""
        return {(r["at"], r["label"]): r["n"] for r in done.select("at", F.inline("labels")).groupBy("at", "label").agg(F.sum("n").alias("n")).collect()}

    counts, levels, left, placed = dict(classes), levels_of(classes, chunk), {}, []
    for number, sizes in enumerate(levels):
        level = parts.where(F.col("class").isin(sizes))
        rows = {r["label"]: r["n"] for r in level.select(F.inline("labels")).groupBy("label").agg(F.sum("n").alias("n")).collect()}
        chunks = max(1, math.ceil(sum(counts[c] for c in sizes) / chunk))
        done = scratch.save(_annealed(level, chunks, [start(i) for i in range(RESTARTS)], shares, left, rows, seed, scratch, str(number)), f"level{number}")
        wanted = {(s, k): share * n + left.get((s, k), 0.0) for s, share in enumerate(shares) for k, n in rows.items()}
        if number == len(levels) - 1 and chunks > 1:
            held = tallied(done)
            missing = {key: target - held.get(key, 0) for key, target in wanted.items()}
            one = _chunk(chunks, seed, str(number)) == 0
            settled = _annealed(done.where(one), 1, [F.col("at")] * RESTARTS, shares, missing, None, seed, scratch, f"{number}x")
            done = scratch.save(done.where(~one).unionByName(settled), f"level{number}x")
        held = tallied(done)
        left = {**left, **{key: target - held.get(key, 0) for key, target in wanted.items()}}
        placed.append(done.select("group_id", "at"))
    if not placed:
        return groups.select(id_col, "group_id", "group_rows", F.lit(None).cast("string").alias("split"))
    chosen = placed[0]
    for more in placed[1:]:
        chosen = chosen.unionByName(more)
    named = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("at") + 1)
    return groups.join(chosen.select("group_id", named.alias("split")), "group_id").select(id_col, "group_id", "group_rows", "split")
