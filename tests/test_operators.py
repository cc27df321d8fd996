import random

import pytest
from pyspark.sql import functions as F

from skein.config import EngineConfig
from skein.operators import assign, blocking, enrich, evaluate, features, kb, model, propagate, terminology, vocabulary
from skein.plans.engine import Engine
from skein.streaming import incremental

SCORES = "s_id string, t_id string, score double"


def pairs(df):
    return sorted((r["s_id"], r["t_id"]) for r in df.collect())


@pytest.fixture(scope="module")
def two_kbs(spark):
    """Two knowledge bases of 40 entities; entity i of one matches entity i of the other."""
    words = [f"alpha{i} beta{i % 13} gamma{i * 7 % 31}" for i in range(40)]
    s = [("S", f"S:{i}", w, [w, f"syn {i}"], f"long text about {w}") for i, w in enumerate(words)]
    t = [("T", f"T:{i}", w if i % 3 else w.upper(), [w, f"other{i}"] if i % 2 else [f"{w} x{i}"], f"text on {w}") for i, w in enumerate(words)]
    cols = "kb string, research_entity_id string, canonical_name string, aliases array<string>, definition string"
    return spark.createDataFrame(s, cols), spark.createDataFrame(t, cols)


# Knowledge bases


def test_edges_buckets_and_inverse(spark):
    rel = spark.createDataFrame(
        [("K", 1, "PAR", ["a", "b"]), ("K", 2, "PAR", ["a", "b"]), ("K", 3, "CHD", ["b", "a"]), ("K", 4, "part_of", ["a", "z"]), ("K", 5, "RO", ["a", "a"]), ("K", 6, "PAR", ["c", None]), ("K", 7, "RB", ["b", "c"])],
        "kb string, relation_id int, relation_type string, entity_ids array<string>",
    ).withColumns({"symmetric": F.lit(None).cast("boolean"), "labels": F.array().cast("array<string>")})
    ents = spark.createDataFrame([("K", "a"), ("K", "b"), ("K", "c")], "kb string, research_entity_id string")
    buckets = {r["research_entity_id"]: r for r in kb.relation_buckets(rel).collect()}
    assert buckets["a"]["par_relations"] == ["b", "z"] and buckets["a"]["sib_relations"] == ["a"] and buckets["a"]["chd_relations"] == []
    inv = {(r["src_id"], r["dst_id"], r["relation_type"]) for r in kb.inverse_relations(rel, ents).collect()}
    assert inv == {("a", "b", "PAR")} - {("a", "b", "PAR")} | {("c", "b", "RN")}  # z is no entity; PAR and CHD are there already
    region = {(r["start_id"], r["node_id"]): r["depth"] for r in propagate.regions(rel, ents).collect()}
    assert region[("a", "a")] == 0 and region[("a", "z")] == 1 and region[("a", "c")] == 2 and ("c", "b") not in region
    assert kb.valid_relations(rel).count() == 6


def test_entities(spark):
    ents = spark.createDataFrame(
        [("K", "K:1", "One", ["One", "uno"], "<s>", ["c"]), ("K", "K:2", "Two", ["Two"], "def", None), ("K", "K:3|K:4", "Three", None, None, None), ("K", "", "x", None, None, None)],
        "kb string, research_entity_id string, canonical_name string, aliases array<string>, definition string, other_contexts array<string>",
    )
    assert kb.valid_entities(ents).count() == 3
    with pytest.raises(Exception, match="without id"):
        kb.checked_entities(ents).collect()
    nulls = kb.with_null_entity(kb.with_null_entity(ents)).where("research_entity_id = 'K:NULL'")
    assert nulls.count() == 1
    groups = spark.createDataFrame([("K:2", "K:1"), ("K:3|K:4", "K:1")], "research_entity_id string, merge_key string")
    merged = kb.merged_entities(kb.valid_entities(ents), groups).collect()
    assert [(r["merged_id"], r["canonical_name"], r["aliases"], r["definition"]) for r in merged] == [("K:1|K:2|K:3|K:4", "One", ["One", "Two", "uno"], "def")]
    assert {r["raw_id"] for r in kb.raw_id_view(ents).collect()} >= {"K:3", "K:4"}
    urls = kb.with_source_urls(ents.withColumn("source_urls", F.lit(None).cast("array<string>")), {"K": "http://k/"}).where("research_entity_id = 'K:1'").first()
    assert urls["source_urls"] == ["http://k/1"]


def test_enrichment(spark):
    ents = spark.createDataFrame([("K", "1", "heart", ["Heart-", "cor"], "x", None), ("K", "2", "toe", None, "a long one", ["had"])], "kb string, research_entity_id string, canonical_name string, aliases array<string>, definition string, other_contexts array<string>")
    syn = spark.createDataFrame([("mesh", "heart", "pump"), ("mesh", "cor", "pump"), ("mesh", "toe", "digit")], "source string, alias string, synonym string")
    assert [(r["research_entity_id"], r["synonyms"]) for r in enrich.alias_synonyms(ents, syn).collect()] == [("1", ["pump"])]
    summaries = spark.createDataFrame([("heart", "muscle"), ("toe", "digit")], "query string, summary string")
    assert {r["research_entity_id"]: r["definition"] for r in enrich.with_summaries(ents, summaries).collect()} == {"1": "muscle", "2": "a long one"}
    contexts = spark.createDataFrame([("heart", ["", "c1"])], "canonical_name string, contexts array<string>")
    assert {r["research_entity_id"]: r["other_contexts"] for r in enrich.with_contexts(ents, contexts).collect()} == {"1": ["c1"], "2": ["had"]}


# Blocking


def test_small_kb_has_no_candidates(spark, two_kbs):
    s, t = two_kbs
    assert blocking.candidate_scores(blocking.token_lists(s.limit(18), t.limit(18))).count() == 0  # 19 df > 18 for every token


def test_candidates_recall_and_exact(spark, two_kbs):
    s, t = two_kbs
    gold = spark.createDataFrame([(f"S:{i}", f"T:{i}", 1.0) for i in range(40)], SCORES)
    curve = {r["k"]: r for r in Engine(spark).evaluate_candidates(s, t, gold).collect()}
    assert curve[1]["recall"] == 1.0 and curve[500]["recall"] == 1.0
    lists = blocking.token_lists(s, t)
    cands = blocking.candidate_scores(lists)
    exact = blocking.exact_matches(s, t, lists, pairs=F.lit(True))
    assert pairs(exact) == sorted((f"S:{i}", f"T:{i}") for i in range(1, 40, 2))
    assert pairs(blocking.exact_matches(s, t, pairs=F.lit(True))) == pairs(exact)
    rest = blocking.remaining_candidates(blocking.ranked(cands, 100), exact)
    assert not {r["s_id"] for r in rest.collect()} & {r["s_id"] for r in exact.collect()}
    assert blocking.unmatched(s, exact, "s").count() == 20
    shuffled = blocking.candidate_scores(blocking.token_lists(s.repartition(7), t.repartition(3, "canonical_name")))
    top = lambda c: sorted(tuple(r) for r in blocking.ranked(c, 3).select("s_id", "t_id", "rank").collect())
    assert top(shuffled) == top(cands)
    missed = blocking.missed_pairs(gold, exact.limit(0), s.unionByName(t))
    assert missed.count() == 40


# Features and model


def test_features_of_a_known_pair(spark):
    side = lambda i, n, al, d, wiki=None: {"research_entity_id": i, "canonical_name": n, "aliases": al, "definition": d, "wiki_entities": wiki, "mesh_synonyms": None, "dbpedia_synonyms": None}
    from skein.schema import PAIR_ENTITY
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("source_ent", PAIR_ENTITY), T.StructField("target_ent", PAIR_ENTITY)])
    full = lambda e: {f.name: e.get(f.name) for f in PAIR_ENTITY}
    rows = [(1, full(side("a", "heart valve", ["heart valve", "HV"], "the pump", ["W"])), full(side("b", "valve heart", ["valve heart"], "pump of blood", ["W", "X"]))), (0, full(side("a", None, None, None)), full(side("b", "x", [], "")))]
    f = features.features_of_pairs(spark.createDataFrame(rows, kind), ("label",)).collect()
    one = next(r.asDict() for r in f if r["label"] == 1)
    assert len(one) == 33
    assert one["has_same_canonical_name"] is False and one["has_same_name_tokens"] is False and one["has_same_name_token_set"] is True and one["has_same_stemmed_name_token_set"] is True
    assert one["has_alias_in_common"] is False and one["has_alias_token_set_in_common"] is True and one["max_alias_token_jaccard"] == 1.0
    assert one["definition_token_jaccard"] == 0.5 and one["wiki_entity_jaccard"] == 0.5 and one["has_same_mesh_synonym"] is False and one["mesh_synonym_jaccard"] == -1.0
    assert one["has_same_root_word"] is False and one["has_same_acronym"] is False and 0 < one["name_char_4gram_jaccard"] < 1
    zero = next(r.asDict() for r in f if r["label"] == 0)
    assert zero["has_same_canonical_name"] is False and zero["alias_token_jaccard"] == -1.0 and zero["max_alias_4gram_jaccard"] == 0.0


def test_train_align_and_evaluate(spark, two_kbs, tmp_path):
    """Planted matches reach P >= 0.8, R >= 0.6, F1 >= 0.7 with every strategy."""
    s, t = two_kbs
    from skein.plans.engine import pair_entity

    ps, pt = pair_entity(s).select("ent").collect(), pair_entity(t).select("ent").collect()
    rows = [(int(i == j), ps[i][0], pt[j][0]) for i in range(40) for j in (i, (i + 7) % 40, (i + 11) % 40)]
    labelled = spark.createDataFrame(rows, "label int, source_ent struct<" + pair_entity(s).schema["ent"].dataType.simpleString()[7:] + ", target_ent struct<" + pair_entity(t).schema["ent"].dataType.simpleString()[7:])
    names = features.NAME + features.ALIAS
    engine = Engine(spark, EngineConfig(score_threshold=0.5), names)
    fitted = engine.train(labelled, str(tmp_path / "model"))
    assert engine.evaluate(model.load(str(tmp_path / "model")), labelled).first()["f1"] > 0.9
    gold = spark.createDataFrame([(f"S:{i}", f"T:{i}", 1.0) for i in range(40)], SCORES)
    for strategy in ("best", "all", "modh"):
        done = engine.align(kb.KnowledgeBase("S", s), kb.KnowledgeBase("T", t), fitted, strategy, gold, str(tmp_path / f"{strategy}.tsv"))
        m = done.metrics.first()
        assert m["precision"] >= 0.8 and m["recall"] >= 0.6 and m["f1"] >= 0.7
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "best.tsv")).count() > 20


def test_predict_batches_and_max_similar(spark):
    c = spark.createDataFrame([("a", "b", "{}", "{}")] * 5, "s_id string, t_id string, s_json string, t_json string").coalesce(1)
    assert [r["score"] for r in model.predict_batches(c, lambda rows: [len(rows)] * len(rows), batch_size=2).collect()] == [2.0, 2.0, 2.0, 2.0, 1.0]
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[0.0, 2.0], [2.0, 0.0]])], "s array<array<double>>, t array<array<double>>")
    assert tuple(df.select(model.max_similar("s", "t").alias("m")).first()["m"]) == (2.0, 0, 1)
    df = spark.createDataFrame([(["x" * 200, "a", "b", "a"],), (None,)], "c array<string>")
    assert [sorted(r[0]) for r in df.select(model.sampled_contexts("c")).collect()] == [["a", "b"], ["00000"]]


# Assignment


def greedy(rows, threshold):
    s_done, t_done, out = set(), set(), []
    for s, t, x in sorted((r for r in rows if r[2] >= threshold), key=lambda r: (-r[2], r[0], r[1])):
        if s not in s_done and t not in t_done:
            s_done.add(s), t_done.add(t), out.append((s, t))
    return sorted(out)


@pytest.mark.parametrize("small", [0, 200_000])
def test_one_to_one_is_the_greedy_matching(spark, small):
    rng = random.Random(3)
    rows = list({(f"s{rng.randrange(20)}", f"t{rng.randrange(30)}"): None for _ in range(150)})
    rows = [(s, t, rng.choice([0.89, 0.9, 0.95, 0.95, 1.0])) for s, t in rows]
    got = assign.one_to_one(spark.createDataFrame(rows, SCORES), EngineConfig(one_to_one_candidates=100), small)
    assert pairs(got) == greedy(rows, 0.9)


def test_strategies(spark):
    rows = [("a", "x", 0.9), ("a", "w", 0.9), ("a", "y", 0.899999), ("b", "x", 1.0), ("c", "z", 0.5), ("d", "x", 0.95), ("d", "v", 0.91)]
    df = spark.createDataFrame(rows, SCORES)
    best, every, one = (pairs(assign.align_scores(df, s)) for s in ("best", "all", "modh"))
    assert best == [("a", "w"), ("b", "x"), ("d", "x")] and set(best) <= set(every) and len(every) == 5
    assert one == [("a", "w"), ("b", "x"), ("d", "v")]
    with pytest.raises(NotImplementedError):
        assign.align_scores(df, "none")
    assert assign.one_to_one(df.limit(0)).count() == 0


# Evaluation and propagation


def test_metrics(spark):
    rows = [(1, 0.95), (1, 0.5), (1, 0.05), (0, 0.95), (0, 0.5), (0, 0.9)]
    df = spark.createDataFrame(rows, "label int, probability double")
    std = evaluate.confusion(df).first()
    assert (std["tp"], std["fp"], std["fn"], std["tn"]) == (2, 3, 1, 0)
    sure = evaluate.confusion(df, cfg=EngineConfig(metric_mode="confident")).first()
    assert (sure["tp"], sure["fp"], sure["fn"], sure["tn"]) == (1, 1, 1, 3)
    empty = evaluate.confusion(df.limit(0)).first()
    assert (empty["precision"], empty["recall"], empty["f1"]) == (0.0, 0.0, 0.0)
    gold = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 0.0), ("d", "e", 1.0)], SCORES)
    m = evaluate.against_gold(gold.where("t_id in ('b', 'c')"), gold).first()
    assert (m["tp"], m["fp"], m["fn"], m["f1"]) == (1, 1, 1, 0.5)
    a = spark.createDataFrame([("a", "b", "1.0"), ("a", "c", "1.0")], "entity1 string, entity2 string, measure string")
    b = spark.createDataFrame([("a", "b", "1.0"), ("a", "c", "0.5")], "entity1 string, entity2 string, measure string")
    assert tuple(evaluate.mapping_stats(a, b).select("tp", "fp", "fn").first()) == (1, 1, 1)


def test_propagation_keeps_pairs(spark):
    region = lambda x, y: spark.createDataFrame([("K", x, x, 0), ("K", x, y, 1), ("K", y, y, 0)], "kb string, start_id string, node_id string, depth int")
    scores = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 0.0)], SCORES)
    assert propagate.propagate(scores, region("a", "b"), region("x", "y"), 0) is scores
    out = {r["s_id"]: r["score"] for r in propagate.propagate(scores, region("a", "b"), region("x", "y"), 1).collect()}
    assert out["b"] == 0.0 and out["a"] == pytest.approx(1 / (1 + 2.718281828459045**-1))
    assert pairs(propagate.propagate(scores, region("a", "b"), region("x", "y"), 5)) == pairs(scores)


# Terminology, vocabulary, streams


def test_terminology(spark):
    raw = [("C1", "MSH", "D1", "A1", "SY", "Heart"), ("C1", "MSH", "D1", "A2", "PT", "heart"), ("C1", "SNO", "7", "A3", "XX", "Cor"), ("C1", "OMIM", "NOCODE", "A4", "PT", "no"), ("C1", "ZZZ", "1", "A5", "PT", "no")]
    atoms = terminology.concept_atoms(spark.createDataFrame(raw, "CUI string, SAB string, CODE string, AUI string, TTY string, STR string"), ["MSH", "SNO", "OMIM"])
    assert pairs(terminology.cross_vocabulary_pairs(atoms)) == [("MSH:D1", "SNO:7")]
    ents = terminology.collapsed_entities(atoms)
    msh = ents.where("sab = 'MSH'").first()
    assert msh["canonical_name"] == "heart" and msh["aliases"] == ["heart"] and msh["auis"] == ["A1", "A2"]
    owners = terminology.atom_owner(ents)
    defs = spark.createDataFrame([("A2", 2, "second"), ("A1", 1, "first"), ("zz", 1, "no")], "aui string, ord int, def string")
    assert [tuple(r) for r in terminology.joined_definitions(defs, owners).collect()] == [("MSH:D1", "first second")]
    rel = spark.createDataFrame([("A1", "RO", "A3"), ("A1", "", "A3"), ("A1", "NULL", "A3"), ("A1", "PAR", "zz")], "AUI1 string, REL string, AUI2 string")
    codes = terminology.symmetric_codes(spark.createDataFrame([("REL", "RO", "rel_inverse", "RO"), ("REL", "PAR", "rel_inverse", "CHD")], "DOCKEY string, VALUE string, TYPE string, EXPL string"))
    assert [tuple(r) for r in terminology.entity_relations(rel, owners, codes).collect()] == [("MSH:D1", "SNO:7", "RO", True)]


def test_negatives_and_splits(spark):
    pos = spark.createDataFrame([(f"s{i}", f"t{i}", "T") for i in range(50)], "s_id string, t_id string, t_kb string")
    cands = spark.createDataFrame([(f"s{i}", f"t{(i + k) % 50}") for i in range(50) for k in range(4)], "s_id string, t_id string")
    targets = spark.createDataFrame([("T", f"t{i}") for i in range(50)], "kb string, research_entity_id string")
    hard = terminology.hard_negatives(cands, pos)
    easy = terminology.easy_negatives(targets, pos, hard)
    known = set(pairs(pos))
    assert hard.count() == 50 and not known & set(pairs(hard)) and not (known | set(pairs(hard))) & set(pairs(easy)) and easy.count() > 30
    rows = spark.createDataFrame([(i, i % 2) for i in range(100)], "pair_id int, label int")
    counts = {(r["label"], r["new_split"]): r["count"] for r in terminology.exact_stratified_split(rows, ("pair_id",)).groupBy("label", "new_split").count().collect()}
    assert counts == {(0, "test"): 10, (0, "dev"): 8, (0, "train"): 32, (1, "test"): 10, (1, "dev"): 8, (1, "train"): 32}


def test_vocabulary(spark):
    words = spark.createDataFrame([(1, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "c")], "doc int, word string")
    assert [tuple(r) for r in vocabulary.vocabulary(words, "doc", "word", 2).collect()] == [("b", 3, 2), ("a", 1, 1)]
    assert [r["word"] for r in vocabulary.vocabulary(words, "doc", "word", min_df=2).collect()] == ["b"]
    numbers = vocabulary.numbered(words, parts=3)
    assert sorted(tuple(r) for r in numbers.collect()) == [("a", 1), ("b", 2), ("c", 3)]
    texts = spark.createDataFrame([(1, ["b", "zz", "a", "b"])], "doc int, toks array<string>")
    assert vocabulary.encoded(texts, "doc", "toks", numbers).first()["ids"] == [2, 1, 2]


def test_streams(spark, two_kbs, tmp_path):
    s, t = two_kbs
    s.write.parquet(str(tmp_path / "in"))
    found = []
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.match_new_entities(stream, t, lambda df, epoch: found.extend(pairs(df)), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert sorted(found) == sorted((f"S:{i}", f"T:{i}") for i in range(1, 40, 2))
    rows = spark.createDataFrame([("2030-01-01 01:00:00", 0.5), ("2030-01-01 02:00:00", -1.0), ("2030-01-03 00:00:00", None)], "scored_at string, score double")
    rows = rows.withColumn("scored_at", F.col("scored_at").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "scores"))
    assert sorted(tuple(r)[1:] for r in incremental.score_windows(rows).collect()) == [(1, 0, None), (2, 1, 0.5)]
    live = incremental.score_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "scores")))
    q = live.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").count() == 2


def test_cli_arguments():
    from skein.cli import parser

    args = parser().parse_args(["align", "--source", "a.obo", "--target", "b.owl", "--model", "m", "--output", "o.tsv"])
    assert args.strategy == "best" and args.gold is None


def test_terminology_assembly(spark):
    atoms = terminology.concept_atoms(spark.createDataFrame([("C1", "V", "1", "A1", "PT", "Heart", 0), ("C1", "V", "1", "A2", "SY", "Cor", 1), ("C1", "W", "9", "A3", "PT", "heart", 2), ("C2", "W", "8", "A4", "PT", "toe", 3)], "CUI string, SAB string, CODE string, AUI string, TTY string, STR string, ord long"))
    definitions = spark.createDataFrame([("A2", 1, "second"), ("A1", 0, "first")], "aui string, ord long, def string")
    mrrel = spark.createDataFrame([("A3", "A4", "PAR"), ("A3", "A9", "PAR"), ("A4", "A3", "")], "AUI1 string, AUI2 string, REL string")
    made = terminology.knowledge_bases(atoms, definitions, mrrel, spark.createDataFrame([("SIB",)], "rel string"))
    rows = {r["research_entity_id"]: r for r in made.entities.collect()}
    assert set(rows) == {"V:1", "W:9", "W:8"} and rows["V:1"]["canonical_name"] == "Heart" and rows["V:1"]["definition"] == "first second"
    assert [(r["kb"], r["entity_ids"], r["symmetric"]) for r in made.relations.collect()] == [("W", ["W:9", "W:8"], False)]


def test_negative_mappings_and_eligibility(spark):
    positives = spark.createDataFrame([("A:1", "B:1", 1, "p", "B"), ("A:2", "C:1", 1, "p", "C")], "s_id string, t_id string, label int, provenance string, t_kb string")
    candidates = spark.createDataFrame([("A:1", "B:1"), ("A:1", "B:2")], "s_id string, t_id string")
    targets = spark.createDataFrame([("B", "B:1"), ("B", "B:2"), ("B", "B:3"), ("C", "C:1")], "kb string, research_entity_id string")
    got = sorted((r["s_id"], r["t_id"], r["label"]) for r in terminology.negative_mappings(positives, candidates, targets).collect())
    assert got == [("A:1", "B:1", 1), ("A:1", "B:2", 0), ("A:1", "B:3", -1)]  # nothing for A and C: C has no other target
    pairs = spark.createDataFrame([("A", "B"), ("A", "C"), ("A", "D")], "kb1 string, kb2 string")
    kbs = lambda *n: spark.createDataFrame([(x,) for x in n], "kb string")
    assert [tuple(r) for r in terminology.eligible_pairs(pairs, kbs("A", "B", "C"), kbs("A", "B", "D")).collect()] == [("A", "B")]


def test_costs_masks_and_tags(spark):
    from skein.operators import spans

    assert tuple(assign.cost(spark.createDataFrame([("a", "b", 0.9), ("c", "d", 1.0)], SCORES)).first()) == (2, 0.1, 0.0)
    rows = spark.createDataFrame([(1, 0.9, True), (1, 0.1, False), (0, 0.8, True)], "label int, probability double, ok boolean")
    got = evaluate.confusion(rows, mask=F.col("ok")).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (1, 1, 0, 0)
    tags = spark.createDataFrame([("_",), (None,), ("B-KeyEntity|U-Other",), ("O",)], "tag string")
    assert [r["tag"] for r in spans.plain_tags(tags, {"KeyEntity": "Entity"}).collect()] == ["O", "O", "B-Entity|U-Other", "O"]
