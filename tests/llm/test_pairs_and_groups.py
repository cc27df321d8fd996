import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import components as comp
from skein.llm import format_copies as copies
from skein.llm.components import composed, contraction_rounds, linked_groups, match_groups, side_of
from skein.llm.format_copies import collapsed, format_copies
from skein.llm.grouped_split import anneal, assign_splits, levels_of, record_groups
from skein.llm.set_pairs import name_set, similar_classes, similar_set_links, similar_set_pairs
from skein.plans.scratch import Scratch

ENTITY = "row_id long, canonical_name string, aliases array<string>"


def two(df):
    return sorted(tuple(r) for r in df.collect())


def jaccard_pairs(sets, t):
    ids = sorted(sets)
    return sorted((a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t)


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.6), (2, 0.6), (3, 0.5), (4, 0.8), (5, 1.0)])
def test_similar_pairs_match_brute_force(spark, seed, threshold):
    """Clusters of edited sets, hot values, copies."""
    rng = random.Random(seed)
    sets = {}
    for c in range(40):
        base = {f"c{c}v{k}" for k in range(rng.randint(1, 8))}
        for _ in range(rng.randint(1, 6)):
            s = {v for v in base if rng.random() < 0.85} | {f"n{rng.randrange(50)}" for _ in range(rng.randint(0, 2))}
            if rng.random() < 0.4:
                s |= {"hot"}
            sets[len(sets)] = s
    rows = [(i, None, sorted(s)) for i, s in sets.items()]
    got = two(similar_set_pairs(spark.createDataFrame(rows, ENTITY).repartition(5), threshold=threshold))
    assert got == jaccard_pairs(sets, threshold)


def test_similar_pairs_of_long_and_short_sets(spark):
    """Lengths above 32 share a step; similarity at the threshold exactly."""
    rng = random.Random(9)
    sets = {}
    for c in range(30):
        base = [f"c{c}v{k}" for k in range(rng.choice([3, 5, 10, 33, 60, 120]))]
        for _ in range(4):
            sets[len(sets)] = set(base[: rng.randint(max(1, int(0.55 * len(base))), len(base))]) | {f"n{rng.randrange(300)}" for _ in range(rng.randint(0, 3))}
    rows = [(i, None, sorted(s)) for i, s in sets.items()]
    assert two(similar_set_pairs(spark.createDataFrame(rows, ENTITY).repartition(4))) == jaccard_pairs(sets, 0.6)


def test_hot_values_bring_no_hopeless_pairs_together(spark):
    """100,000 sets that share two values of three, none similar enough: no posting meets another."""
    n = 100_000
    sets = spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit("u"), "id").alias("canonical_name"), F.array(F.lit("c1"), F.lit("c2")).alias("aliases"))
    began = time.perf_counter()
    assert similar_classes(sets, "row_id", name_set())[1].count() == 0
    assert time.perf_counter() - began < 120


def test_similar_pairs_edges(spark):
    rows = [(1, "A-b", ["a b", None, ""]), (2, None, ["AB!"]), (3, None, None), (4, "--", []), (5, "x", ["y", "z"]), (6, "Z", ["x", "q"]), (7, "ab", ["ab", "ab"]), (None, "ab", None)]
    df = spark.createDataFrame(rows, ENTITY).withColumn("tok", F.lit(1)).withColumn("cid", F.lit(2))
    assert two(similar_set_pairs(df)) == [(1, 2), (1, 7), (2, 7)]  # 5 and 6 share 2 of 4
    assert two(similar_set_pairs(df.limit(0))) == []
    links = {r["row_id"]: (r["class_id"], r["links"]) for r in similar_set_links(df).collect()}
    assert links[1] == links[2] == links[7] == (1, 0) and links[3] == (None, 0) and links[4] == (None, 0) and links[5] == (5, 0)
    with pytest.raises(ValueError):
        similar_set_pairs(df, threshold=0.3)


def test_hot_group_of_copies_stays_one_class(spark):
    rows = [(i, "same", ["name"]) for i in range(300)] + [(1000 + i, f"n{i}", ["name", "same"]) for i in range(3)]
    members, pairs = similar_classes(spark.createDataFrame(rows, ENTITY), "row_id", F.array_sort(F.array_union(F.array("canonical_name"), "aliases")))
    assert members.select("cid").distinct().count() == 1 and pairs.count() == 3  # each of the three with the class: 2 of 3 shared
    assert pairs.where("similarity < 0.6").count() == 0


def components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


@pytest.mark.parametrize("cell_edges", [3, 40, 250_000])
def test_components_match_union_find(spark, cell_edges):
    rng = random.Random(cell_edges)
    links = [(f"v{rng.randrange(150):03}", f"v{rng.randrange(150):03}") for _ in range(90)]
    links += [(f"chain{i:02}", f"chain{i + 1:02}") for i in range(40)] + [("hub", f"leaf{i}") for i in range(60)] + [("self", "self"), ("chain00", "chain05")]
    got = two(linked_groups(spark.createDataFrame(links, "a string, b string"), "a", "b", cell_edges))
    assert got == components(links)


def test_ordered_chain_needs_few_rounds(spark):
    """100,000 links in id order on a grid of 20 x 20 blocks: the rounds grow with the logarithm only."""
    n = 100_000
    assert side_of(n, 4, 500) >= 20
    scratch = Scratch(spark, "chain")
    edges = scratch.save(spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")), "edges")
    rounds = contraction_rounds(edges, scratch, 500)
    assert len(rounds) <= 2 * math.log2(n)
    got = composed(rounds)
    assert got.count() == n + 1 and got.select("parent").distinct().count() == 1


def test_forest_is_a_union_find(spark):
    rng = np.random.default_rng(4)
    u, v = rng.integers(-50, 400, 300), rng.integers(-50, 400, 300)
    ids, roots, ranks = comp._forest(u, v, 3)
    named = {}
    for a, b in components([(f"{a + 50:03}", f"{b + 50:03}") for a, b in zip(u, v)]):
        named[int(a) - 50] = b
    got = dict(zip(ids.tolist(), roots.tolist()))
    groups = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert groups(got) == groups(named)
    own = dict(zip(ids.tolist(), comp._ranks(ids, 3).tolist()))
    assert all(own[r] == k == min(own[i] for i in got if got[i] == r) for r, k in zip(roots.tolist(), ranks.tolist()))


def test_match_groups_edges(spark):
    rows = [(" a", "b\t", 1.0), ("b", "a", 1.0), ("c", None, 1.0), ("d", "e", 0.0), ("f", "f", 1.0), ("b", "g", 0.5), ("x", "y", None), ("p", "q", float("nan")), (None, None, 1.0)]
    df = spark.createDataFrame(rows, "c0 string, c1 string, c2 double").withColumn("vertex", F.lit("z"))
    assert two(match_groups(df)) == [("a", "a"), ("b", "a"), ("f", "f"), ("g", "a")]
    assert match_groups(df.limit(0)).count() == 0


def test_format_copies(spark):
    rows = [(5, None, ["Heart Valve", "toe"]), (3, None, ["TOE!", "heart-valve", "toe"]), (9, "other", ["toe", "heart  valve"]), (1, None, []), (2, None, None), (4, None, ["?"]), (6, None, [None]), (7, None, ["toe"])]
    df = spark.createDataFrame(rows, ENTITY).withColumn("key", F.lit("k")).withColumn("h", F.lit(0)).repartition(4)
    assert two(format_copies(df)) == [(3, 5), (3, 9)]
    assert dict(two(collapsed(df))) == {3: 3, 1: 1, 2: 1, 4: 1, 6: 1, 7: 1}
    assert format_copies(df.limit(0)).count() == 0 and collapsed(df.limit(0)).count() == 0


def test_format_copies_at_random(spark):
    rng = random.Random(5)
    rows = [(i, None, [rng.choice(["A b", "a-B", " ab"])] * rng.randint(1, 2) + [f"v{rng.randrange(200)}"]) for i in range(600)]
    by = {}
    for i, _, al in rows:
        by.setdefault(al[-1], []).append(i)
    want = sorted((min(g), x) for g in by.values() for x in g if x != min(g))
    df = spark.createDataFrame(rows, ENTITY).repartition(7)
    assert two(format_copies(df)) == want


def test_repeat_filter_in_ranges(spark):
    """Many small segments probed in several passes: no repeat is lost, few others pass, memory per task is fixed."""
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("row_id"), F.xxhash64(F.when(F.col("id") % 10 == 0, F.col("id") % 500).otherwise(F.col("id") + 10**6)).alias("h")).repartition(6)
    df = df.unionByName(spark.createDataFrame([(-1, None)], "row_id long, h long"))
    segments = n * copies.BITS_PER_ROW // (1 << 10)
    marked = copies.possible_repeats(df, "h", n, pass_bytes=segments * 128 // 5, size=1 << 10).toPandas()
    assert len(marked) == n + 1 and not marked[marked["row_id"] == -1]["maybe"].any()
    rest = marked[marked["row_id"] >= 0]
    repeated = rest["row_id"] % 10 == 0
    assert rest[repeated]["maybe"].all() and rest[~repeated]["maybe"].mean() < 0.05


ENT = "struct<research_entity_id:string>"


def training(spark, rows):
    return spark.createDataFrame([(i, lab, (a,) if a != "null" else None, (b,)) for i, lab, a, b in rows], f"pair_id long, label int, source_ent {ENT}, target_ent {ENT}")


def test_record_groups(spark):
    rows = [(1, 1, "A", "B"), (2, 0, " B\t", "C"), (3, 1, "D|E", "F"), (4, 0, "E |G", None), (5, 1, None, None), (6, 1, "null", "Z"), (7, None, "", " ")]
    got = {r["pair_id"]: (r["group_id"], r["group_rows"]) for r in record_groups(training(spark, rows)).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (3, 2), 5: (5, 1), 6: (6, 1), 7: (7, 1)}
    assert record_groups(training(spark, rows).limit(0)).count() == 0


def test_splits_keep_groups_and_proportions(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([0, 0, 1, None]), f"E{rng.randrange(3) if i < 300 else i // rng.randint(1, 3)}", f"T{i}") for i in range(1500)]
    df = training(spark, rows)
    got = assign_splits(df).toPandas()
    assert len(got) == 1500 and got.groupby("group_id")["split"].nunique().max() == 1
    labels = {r[0]: r[1] for r in rows}
    got["label"] = [labels[i] for i in got["pair_id"]]
    shares = got["split"].value_counts(normalize=True)
    assert abs(shares["train"] - 0.8) < 0.02 and abs(shares["dev"] - 0.1) < 0.02 and abs(shares["test"] - 0.1) < 0.02
    for lab in (0, 1):
        part = got[got["label"] == lab]["split"].value_counts(normalize=True)
        assert abs(part["train"] - 0.8) < 0.05
    again = assign_splits(df.repartition(3)).toPandas()
    assert dict(zip(got["pair_id"], got["split"])) == dict(zip(again["pair_id"], again["split"]))
    assert assign_splits(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        assign_splits(df, {"train": 0.5})


def test_splits_balance_middle_sized_components_and_all_labels(spark):
    """Components of 1 to 3,000 rows, labels of any kind, several chunks in a level."""
    rng = random.Random(11)
    rows, n = [], 0
    for size in [3000] + [200] * 20 + [40] * 100 + [6] * 500 + [1] * 4000:
        name = f"E{len(rows)}"
        for _ in range(size):
            rows.append((n, rng.choice(["a", "a", "b", "c", None]), name, f"T{n}"))
            n += 1
    df = spark.createDataFrame([(i, lab, (a,), (b,)) for i, lab, a, b in rows], f"pair_id long, label string, source_ent {ENT}, target_ent {ENT}")
    got = assign_splits(df, chunk=300).toPandas()
    assert len(got) == n and got.groupby("group_id")["split"].nunique().max() == 1
    got["label"] = got["pair_id"].map({r[0]: r[1] for r in rows})
    for part in [got, *(got[got["label"] == x] for x in "abc"), got[got["label"].isna()]]:
        shares = part["split"].value_counts(normalize=True)
        assert all(abs(shares[s] - x) < 0.003 for s, x in {"train": 0.8, "dev": 0.1, "test": 0.1}.items())


def test_levels_are_chunks_or_single_classes():
    assert levels_of([(9, 3), (8, 5), (2, 50), (1, 60), (0, 10)], 20) == [[9, 8], [2], [1], [0]]
    assert levels_of([(3, 1), (0, 2)], 20) == [[3, 0]] and levels_of([], 20) == []


def test_anneal_improves_on_the_start():
    sizes = [{0: 5, 1: 5}, {0: 3, 1: 1}, {1: 2}, {0: 2}, {0: 1, 1: 1}, {0: 1}] * 5
    total = [sum(s.get(k, 0) for s in sizes) for k in range(2)]
    target = [[share * x for x in total] for share in (0.5, 0.5)]
    start = [0] * len(sizes)
    cost, place = anneal(sizes, start, target, 3000, 1)
    held = [[sum(s.get(k, 0) for s, p in zip(sizes, place) if p == side) for k in range(2)] for side in range(2)]
    assert cost == pytest.approx(sum((h - t) ** 2 for hs, ts in zip(held, target) for h, t in zip(hs, ts))) and cost < 3
