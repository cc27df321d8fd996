"""Queries and operators do the whole job: no token kind, rank, text or target is left out."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from skein import catalogue
from skein.config import DEFAULT, STOP_WORDS
from skein.operators import blocking, postings, terminology
from skein.plans.engine import Engine
from tests.conftest import DATA

QUERIES = catalogue.queries()


def union_tokens(row) -> set[str]:
    words = lambda s: {t for t in re.findall(r"[A-Za-z\d]+", s or "") if t not in STOP_WORDS}
    found, n, aliases = words(row["definition"]), DEFAULT.ngram_size, [a for a in row["aliases"] or [] if a is not None]
    for a in aliases:
        again = a.strip().lower().replace("-", "").replace("_", " ")  # dropped hyphens can bare white space
        padded = "\0" * (n - 1) + again + "\0" * (n - 1)
        found |= words(a) | {padded[i : i + n] for i in range(len(padded) - n + 1)}
    return found


def brute_force_top(rows, k: int) -> dict:
    toks = {(r["kb"], r["research_entity_id"]): union_tokens(r) for r in rows}
    size, df, holders = Counter(kb for kb, _ in toks), Counter((kb, t) for (kb, _), ts in toks.items() for t in ts), defaultdict(list)
    for e, ts in toks.items():
        for t in ts:
            if df[e[0], t] * DEFAULT.idf_factor <= size[e[0]]:
                holders[t].append(e)
    scores = defaultdict(float)
    for t, es in holders.items():
        for s in es:
            for o in es:
                if s[0] < o[0]:
                    scores[s, o] += math.log(size[o[0]] / df[o[0], t] + 1)
    groups = defaultdict(list)
    for (s, o), x in scores.items():
        groups[s, o[0]].append((-round(x, 6), o[1]))
    return {(*s, kb, t, i + 1): -x for (s, kb), g in groups.items() for i, (x, t) in enumerate(sorted(g)[:k])}


def test_candidates_come_from_words_ngrams_and_definitions(spark):
    want = brute_force_top(catalogue._named(spark, DATA).collect(), DEFAULT.top_k)
    got = {(r["s_kb"], r["s_id"], r["t_kb"], r["t_id"], r["rank"]): r["score"] for r in QUERIES["candidate_topk"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_engine_blocks_on_ngrams(spark):
    cols = "kb string, research_entity_id string, canonical_name string, aliases array<string>, definition string"
    stems = [chr(97 + i % 26) * 4 + chr(97 + i // 26) * 3 + chr(97 + i % 26) for i in range(40)]
    s, t = (spark.createDataFrame([(k, f"{k}:{i}", w + end, [w + end], None) for i, w in enumerate(stems)], cols) for k, end in (("S", "um"), ("T", "ia")))
    gold = spark.createDataFrame([(f"S:{i}", f"T:{i}", 1.0) for i in range(40)], "s_id string, t_id string, score double")
    assert {r["k"]: r["recall"] for r in Engine(spark).evaluate_candidates(s, t, gold).collect()}[1] == 1.0


def wide_folder(spark, folder) -> str:
    """S:0 has 150 candidates of equal score in T; the only gold target is the last of them."""
    cols = "kb string, research_entity_id string, row_id long, canonical_name string, aliases array<string>, definition string, updated_at timestamp, loaded_at timestamp"
    s = [("S", f"S:{i}", i, w, [w], None) for i, w in enumerate(["common one", *(chr(97 + i) * 6 for i in range(26))])]
    t = [("T", f"T:{i:04}", 100 + i, f"w{i}", [f"common w{i}" if i < 150 else f"w{i}"], None) for i in range(3000)]
    spark.createDataFrame([(*r, None, None) for r in s + t], cols).write.parquet(f"{folder}/kb_entity.parquet")
    spark.createDataFrame([("S:0", "T:0149", 1.0, "R:C")], "c0 string, c1 string, c2 double, c3 string").write.parquet(f"{folder}/test_input_alignment.parquet")
    return str(folder)


def test_recall_is_counted_to_the_largest_k(spark, tmp_path):
    at = {r["k"]: (r["candidates"], r["hits"]) for r in QUERIES["recall_at_k"](spark, wide_folder(spark, tmp_path)).collect()}
    assert at[100] == (100, 0) and at[200] == at[500] == (150, 1)


def test_definitions_are_joined_whole(spark, tmp_path):
    same, folder = "x" * 5000, wide_folder(spark, tmp_path)
    docs = [(2, "S:0", same + "a"), (1, "S:0", "first"), (3, "S:1", same + "b"), (0, "S:1", "first")]
    spark.createDataFrame(docs, "doc_id long, entity_id string, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r["research_entity_id"]: r["digest"] for r in QUERIES["definitions_concat"](spark, folder).collect()}
    assert got == {f"S:{i}": hashlib.md5(f"first {same}{end}".encode()).hexdigest() for i, end in ((0, "a"), (1, "b"))}


def test_summaries_are_whole_texts(spark, tmp_path):
    folder = wide_folder(spark, tmp_path)
    docs = [(2, "S:0", "y" * 700), (1, "S:0", "x" * 500), (0, "S:0", ""), (3, "T:0001", "z" * 90)]
    spark.createDataFrame(docs, "doc_id long, entity_id string, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r["research_entity_id"]: r["n_definition"] for r in QUERIES["summary_enrich"](spark, folder).where("n_definition is not null").collect()}
    assert got == {"S:0": 500, "T:0001": 90}


def test_remaining_candidates_keep_the_production_cut(spark, tmp_path):
    rows = QUERIES["remaining_candidates"](spark, wide_folder(spark, tmp_path)).collect()
    assert sorted(r["rank"] for r in rows if r["s_id"] == "S:0") == list(range(1, 101))


def test_every_source_draws_easy_negatives_among_all_targets(spark):
    pos = spark.createDataFrame([(f"s{i}", f"t{i % 40}", "T") for i in range(2000)], "s_id string, t_id string, t_kb string")
    hard = spark.createDataFrame([(f"s{i}", f"t{(i + 1) % 40}") for i in range(2000)], "s_id string, t_id string")
    targets = spark.createDataFrame([("T", f"t{i}") for i in range(40)], "kb string, research_entity_id string")
    easy = [(r["s_id"], r["t_id"]) for r in terminology.easy_negatives(targets, pos, hard).collect()]
    known = {(f"s{i}", f"t{(i + j) % 40}") for i in range(2000) for j in (0, 1)}
    assert len({s for s, _ in easy}) == len(easy) == 2000 and not known & set(easy)
    drawn = Counter(t for _, t in easy)
    assert len(drawn) == 40 and max(drawn.values()) < 100


def test_a_frequent_name_brings_its_holders_together_without_listing_their_tokens(spark):
    """250 holders of one name on each side: the name decides by itself where its tokens are rare, and each pair is listed once."""
    cols = "kb string, research_entity_id string, canonical_name string, aliases array<string>, definition string"
    other = lambda i: "".join(chr(97 + int(x)) for x in f"{i * 7919:08}")
    side = lambda kb, n: [(kb, f"{kb}:{i}", "x", ["shared name", "second name"] if i < 250 else [other(i) + kb.lower()], None) for i in range(n)]
    for n, whole in ((6000, True), (4000, False)):  # 19 x 250 holders are more than 4000: no token is rare in T
        s, t = spark.createDataFrame(side("S", 6000), cols), spark.createDataFrame(side("T", n), cols)
        found = blocking.exact_candidates(s, t, blocking.token_lists(s, t), pairs=F.lit(True))
        rows = found.pairs().collect()
        assert len(rows) == len(set(rows)) == 250 * 250 * whole
        assert found.rest.count() == 0 and found.matched("t").count() == 250 * whole


def test_remaining_candidates_are_ranked_among_all_targets_without_joining_pairs(spark, monkeypatch):
    """The cut comes before matched targets are left out, in one block of targets and in several; matched sources aren't scored."""
    cols = "kb string, research_entity_id string, canonical_name string, aliases array<string>, definition string"
    word = lambda i: "".join(chr(97 + int(x)) for x in f"{i * 7919 % 100000:05}") * 2
    s, t = (spark.createDataFrame([(kb, f"{kb}:{i:03}", "x", [f"{word(i // 4)}{kb.lower() if i % 3 else ''}"], None) for i in range(200)], cols) for kb in "ST")
    lists = blocking.token_lists(s, t)
    exact = blocking.exact_candidates(s, t, lists, pairs=F.lit(True))
    want = sorted(map(tuple, blocking.remaining_candidates(blocking.top_candidates(lists, 3), exact.pairs()).select("s_id", "t_id", "rank").collect()))
    for block in (blocking.BLOCK_ENTITIES, 64):
        monkeypatch.setattr(blocking, "BLOCK_ENTITIES", block)
        got = blocking.unmatched_top(lists, 3, exact.matched("s"), exact.matched("t"))
        assert sorted(map(tuple, got.select("s_id", "t_id", "rank").collect())) == want and len(want) > 50
        assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()


def unmatched_without_pairs(spark, monkeypatch, side: str) -> None:
    """The query of one side gives the entities without a match though no pair of a frequent name is listed."""
    named, exact = catalogue._named(spark, DATA), QUERIES["string_equiv"](spark, DATA)
    want = sorted(map(tuple, blocking.unmatched(named, exact, side).select("kb", "research_entity_id").collect()))
    monkeypatch.setattr(blocking, "KEY_HOLDERS", 1)  # every shared name is a frequent one
    monkeypatch.setattr(blocking.ExactMatches, "pairs", None)
    monkeypatch.setattr(blocking, "exact_matches", None)
    assert sorted(map(tuple, QUERIES["unmatched_source" if side == "s" else "unmatched_target"](spark, DATA).collect())) == want and want


def test_unmatched_sources_need_no_pairs(spark, monkeypatch):
    unmatched_without_pairs(spark, monkeypatch, "s")


def test_unmatched_targets_need_no_pairs(spark, monkeypatch):
    unmatched_without_pairs(spark, monkeypatch, "t")


def small_blocks(monkeypatch) -> None:
    monkeypatch.setattr(postings, "BLOCK_ENTITIES", 16)
    monkeypatch.setattr(postings, "UNIT_SOURCES", 5)
    monkeypatch.setattr(postings, "GATHERED", 500)


def test_candidates_of_several_blocks_are_ranked_without_shuffling_pairs(spark, monkeypatch):
    small_blocks(monkeypatch)
    monkeypatch.setattr(blocking, "BLOCK_ENTITIES", 16)
    plan = QUERIES["candidate_topk"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    rows = catalogue._named(spark, DATA).collect()
    ix = postings.index(postings.numbered_entities(catalogue._named(spark, DATA)))
    assert len(ix.blocks) > len(ix.entities.runs)
    for k in (1, 3):
        want = brute_force_top(rows, k)
        got = {(r["s_kb"], r["s_id"], r["t_kb"], r["t_id"], r["rank"]): r["score"] for r in postings.top_pairs(ix, k).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want) and len(want) > 100


def test_recall_is_counted_where_pairs_are_ranked(spark, monkeypatch):
    """No pair leaves the ranking, in several blocks, and ids that stand in several knowledge bases count as often."""
    rows = catalogue._named(spark, DATA)
    twice = rows.where("kb = 'MORBIX'").withColumn("kb", F.lit("ZWEIT"))
    e = rows.unionByName(twice)
    gold = e.select(F.col("research_entity_id").alias("s_id")).distinct().join(e.select(F.col("research_entity_id").alias("t_id")).distinct(), F.expr("pmod(xxhash64(s_id, t_id), 5) = 0"))
    want = sorted(blocking.recall_at_k(blocking.top_candidates(blocking.token_lists(e), 500), gold).collect())
    small_blocks(monkeypatch)
    monkeypatch.setattr(blocking, "recall_at_k", None)
    got = blocking.recall_of(e, gold)
    assert sorted(got.collect()) == want and want[0]["hits"] > 0
    assert QUERIES["recall_at_k"](spark, DATA).count() == 9


def test_the_best_scores_with_ties():
    rng = np.random.default_rng(1)
    for k in (1, 4, 50, None):
        for values in (3, 1000):
            score = rng.integers(0, values, 2000) / 7.0
            for least in (0.0, round(float(np.sort(score)[-(k or 1)]), 6)):
                want = sorted((i for i in range(2000) if round(score[i], 6) > 0 and round(score[i], 6) >= least), key=lambda i: (-round(score[i], 6), i))[:k]
                at, x = postings._best(score, k, least)
                assert at.tolist() == sorted(want) and (x == score[at]).all()


def frequent_names(spark):
    """Names that are frequent in small knowledge bases, so that their own tokens aren't rare, some of their holders with another rare word in common; some not normalised."""
    cols = "kb string, research_entity_id string, canonical_name string, aliases array<string>, definition string"
    rows = []
    for kb, n in (("A", 60), ("B", 90), ("C", 40), ("D", 400)):
        for i in range(n):
            own = "".join(chr(97 + int(x)) for x in f"{i * 7919 % 100000:05}") + kb.lower() * 3
            aliases = ["usual name"] if i % 3 else ["Rare_one" if kb in "AC" else "rare-One", own] if i % 9 == 0 else [own, None]
            rows.append((kb, f"{kb}:{i:03}", "x", aliases, f"zq{i % 29}zq" if i % 2 else None))
    return spark.createDataFrame(rows, cols)


def matched_as_pairs(spark, monkeypatch, side: str) -> None:
    e = frequent_names(spark)
    want = set(map(tuple, blocking.exact_candidates(e, e, blocking.token_lists(e)).pairs().select(f"{side}_kb", f"{side}_id").distinct().collect()))
    monkeypatch.setattr(blocking, "token_lists", None)
    got = list(map(tuple, blocking.matched_ids(e, side).collect()))
    assert len(got) == len(set(got)) and set(got) == want and 20 < len(want) < 400
    assert QUERIES["unmatched_source" if side == "s" else "unmatched_target"](spark, DATA).count() > 0


def test_matched_sources_need_no_token_lists(spark, monkeypatch):
    matched_as_pairs(spark, monkeypatch, "s")


def test_matched_targets_need_no_token_lists(spark, monkeypatch):
    matched_as_pairs(spark, monkeypatch, "t")
