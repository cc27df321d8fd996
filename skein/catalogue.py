"""The queries of the matching pipeline over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import config
from skein.functions import similarity as sim
from skein.functions import text as tx
from skein.operators import assign, blocking, enrich, evaluate, features, kb, model, postings, propagate, spans, terminology, vocabulary
from skein.plans.engine import Engine
from skein.plans.scratch import Scratch
from skein.plans.session import table
from skein.streaming.incremental import score_windows

CFG = config.DEFAULT


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return kb.latest_entities(table(spark, d, "kb_entity"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    """The latest valid entities, normalised."""
    return kb.normalized(kb.valid_entities(_entities(spark, d)))


def _named_briefly(spark: SparkSession, d: str) -> DataFrame:
    """``_named`` with what blocking reads; the other columns aren't shuffled."""
    rows = table(spark, d, "kb_entity").select("kb", "research_entity_id", "row_id", "updated_at", "loaded_at", "canonical_name", "aliases", "definition")
    return kb.normalized(kb.valid_entities(kb.latest_entities(rows)))


def _valid_scores(spark: SparkSession, d: str) -> DataFrame:
    """One valid score per pair, its highest."""
    s = table(spark, d, "sim_score").where(F.col("score").between(0, 1) & ~F.isnan("score"))
    return s.groupBy("s_id", "t_id").agg(F.max("score").alias("score"))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """The alignment table with trimmed ids: s_id, t_id, score."""
    trim = lambda c: F.regexp_replace(c, r"^[ \t]+|[ \t]+$", "")
    a = table(spark, d, "test_input_alignment").where("c0 is not null and c1 is not null and c2 is not null")
    return a.select(trim("c0").alias("s_id"), trim("c1").alias("t_id"), F.col("c2").alias("score"), F.col("c3").alias("provenance"))


def _lists(spark: SparkSession, d: str) -> blocking.TokenLists:
    return blocking.token_lists(_named(spark, d), None, CFG)


def _top(spark: SparkSession, d: str, k: int = CFG.top_k) -> DataFrame:
    return postings.top_pairs(postings.index(postings.numbered_entities(_named_briefly(spark, d))), k)


# Strings


def normalize_strings(spark, d):
    return table(spark, d, "kb_entity").select("row_id", tx.normalize("canonical_name").alias("normal_name"), tx.equivalence_key("canonical_name").alias("match_key"), tx.canonical("canonical_name").alias("plain_name"))


def tokenize_stop(spark, d):
    t = tx.tokens("definition")
    return table(spark, d, "kb_entity").select("row_id", F.array_join(t, " ").alias("words"), F.size(t).cast("long").alias("n_words"))


def char_ngrams(spark, d):
    g = tx.char_ngrams("canonical_name", CFG.ngram_size)
    return table(spark, d, "kb_entity").where("canonical_name is not null").select("row_id", F.size(g).cast("long").alias("n_grams"), F.size(F.array_distinct(g)).cast("long").alias("n_distinct"))


def name_shapes(spark, d):
    lists = tx.sorted_token_lists(F.transform(kb.strings("aliases"), lambda a: tx.tokens(a)))
    joined = F.array_sort(F.transform(lists, lambda t: F.array_join(t, " ")))
    return table(spark, d, "kb_entity").select("row_id", tx.acronym(tx.tokens("canonical_name")).alias("acronym"), F.array_join(joined, "|").alias("token_lists"))


def common_substring(spark, d):
    pairs = table(spark, d, "training_pair")
    a, b = F.coalesce("source_ent.canonical_name", F.lit("")), F.coalesce("target_ent.canonical_name", F.lit(""))
    return pairs.select("pair_id", F.length(tx.longest_common_substring(a, b)).cast("long").alias("n_common"))


def raw_ids(spark, d):
    e = table(spark, d, "training_pair").where("source_ent.research_entity_id is not null")
    return e.select("pair_id", F.explode(F.array_distinct(F.transform(tx.raw_ids("source_ent.research_entity_id"), lambda x: F.trim(F.replace(x, F.lit("\t"), F.lit(" ")))))).alias("raw_id"))


# Entities and relations


def latest_entities(spark, d):
    return _entities(spark, d).select("kb", "research_entity_id", "row_id", "canonical_name")


def relation_buckets(spark, d):
    b = kb.relation_buckets(table(spark, d, "kb_relation"))
    return b.select("kb", "research_entity_id", *(F.array_join(f"{n}_relations", "|").alias(f"{n}_relations") for n in CFG.families))


def relation_names(spark, d):
    b = kb.relation_names(table(spark, d, "kb_relation"), _entities(spark, d))
    return b.select("kb", "research_entity_id", *(F.size(f"{n}_relations").cast("long").alias(f"n_{n}") for n in CFG.families))


def inverse_relations(spark, d):
    return kb.inverse_relations(table(spark, d, "kb_relation"), table(spark, d, "kb_entity"))


def null_entity_union(spark, d):
    return kb.with_null_entity(_entities(spark, d)).select("kb", "research_entity_id", "canonical_name")


def valid_entities(spark, d):
    return kb.valid_entities(table(spark, d, "kb_entity")).groupBy("kb").agg(F.count(F.lit(1)).alias("n_valid"))


def valid_relations(spark, d):
    return kb.valid_relations(table(spark, d, "kb_relation")).groupBy("kb", "relation_type").agg(F.count(F.lit(1)).alias("n_valid"))


def entity_names(spark, d):
    return kb.entity_names(_entities(spark, d)).select("kb", "research_entity_id", F.array_join("names", "|").alias("names"))


def relations_of(spark, d):
    return kb.relations_of(table(spark, d, "kb_relation")).select("kb", "research_entity_id", F.size("relation_ids").cast("long").alias("n_relations"), F.array_min("relation_ids").alias("first_relation"))


def _merge_groups(spark, d):
    """Matched entities under the smaller of both ids."""
    g = _gold(spark, d).where("score > 0 and s_id != t_id")
    return g.select(F.greatest("s_id", "t_id").alias("research_entity_id"), F.least("s_id", "t_id").alias("other")).groupBy("research_entity_id").agg(F.min("other").alias("merge_key"))


def merge_entities(spark, d):
    m = kb.merged_entities(_entities(spark, d), _merge_groups(spark, d))
    return m.select("merge_key", "merged_id", "canonical_name", F.array_join("aliases", "|").alias("aliases"))


def repointed_relations(spark, d):
    m = kb.merged_entities(_entities(spark, d), _merge_groups(spark, d))
    return kb.repointed_relations(table(spark, d, "kb_relation"), m).select("kb", "relation_id", "src_id", "dst_id", "relation_type")


def entity_json(spark, d):
    e = kb.entity_json(_entities(spark, d), table(spark, d, "kb_relation"))
    return e.select("kb", "research_entity_id", F.get_json_object("json", "$.canonical_name").alias("name"), F.expr("json_array_length(get_json_object(json, '$.aliases'))").cast("long").alias("n_aliases"))


def source_urls(spark, d):
    names = [r["kb"] for r in table(spark, d, "kb_registry").select("kb").collect()]
    e = kb.with_source_urls(_entities(spark, d), {n: f"https://{n.lower()}.example/term/" for n in names})
    return e.select("kb", "research_entity_id", F.array_join("source_urls", "|").alias("urls"))


# Enrichment


def _synonyms(spark, d):
    """A synonym dictionary from the entities' own details, keyed by normalised name."""
    e = _entities(spark, d).where("canonical_name is not null")
    parts = [e.select(F.lit(k).alias("source"), tx.normalize("canonical_name").alias("alias"), F.explode(kb.detail_list(k)).alias("synonym")) for k in ("mesh_synonyms", "dbpedia_synonyms")]
    return parts[0].unionByName(parts[1]).where("synonym is not null").distinct()


def synonym_enrich(spark, d):
    s = enrich.alias_synonyms(_entities(spark, d), _synonyms(spark, d))
    return s.select("kb", "research_entity_id", "source", F.array_join("synonyms", "|").alias("synonyms"))


def summary_enrich(spark, d):
    texts = table(spark, d, "documents").where("entity_id is not null and length(text) > 0").select("entity_id", "doc_id", "text")
    first = texts.groupBy("entity_id").agg(F.min("doc_id").alias("doc_id"))  # whole texts are joined to the chosen documents only
    docs = texts.join(first, ["entity_id", "doc_id"]).select("entity_id", F.col("text").alias("summary"))
    e = _entities(spark, d)
    names = e.where("canonical_name is not null").groupBy("canonical_name").agg(F.min("research_entity_id").alias("entity_id"))
    summaries = names.join(docs, "entity_id").select(F.col("canonical_name").alias("query"), "summary")
    return enrich.with_summaries(e, summaries).select("kb", "research_entity_id", F.length("definition").cast("long").alias("n_definition"))


def context_attach(spark, d):
    e = _entities(spark, d)
    c = e.where("canonical_name is not null").groupBy("canonical_name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(kb.strings("other_contexts"))))).alias("contexts"))
    return enrich.with_contexts(e, c.where(F.size("contexts") > 0)).select("kb", "research_entity_id", F.size("other_contexts").cast("long").alias("n_contexts"))


def nonempty_filter(spark, d):
    return enrich.filled_pairs(table(spark, d, "training_pair")).select("pair_id", "label")


def context_counts(spark, d):
    return enrich.context_counts(table(spark, d, "kb_entity"))


def sampled_contexts(spark, d):
    return _entities(spark, d).select("kb", "research_entity_id", F.array_join(model.sampled_contexts("aliases"), "|").alias("sample"), model.model_definition("definition").alias("definition"))


# Blocking


def doc_frequency_idf(spark, d):
    e = _named(spark, d)
    return blocking.token_idf(blocking.entity_tokens(e), e).select("kb", "token", "df", F.round("idf", 6).alias("idf"))


def candidate_topk(spark, d):
    return _top(spark, d).select("s_kb", "s_id", "t_kb", "t_id", F.round("score", 6).alias("score"), "rank")


def string_equiv(spark, d):
    e = _named(spark, d)
    return blocking.exact_matches(e, e, _lists(spark, d))


def _unmatched(spark, d, side: str) -> DataFrame:
    e = Scratch(spark, "unmatched").save(_named_briefly(spark, d), "named", clean=True)
    return blocking.unmatched(e, blocking.matched_ids(e, side), side).select("kb", "research_entity_id")


def unmatched_source(spark, d):
    return _unmatched(spark, d, "s")


def unmatched_target(spark, d):
    return _unmatched(spark, d, "t")


def remaining_candidates(spark, d):
    e, lists = _named(spark, d), _lists(spark, d)
    exact = blocking.exact_candidates(e, e, lists)
    return blocking.unmatched_top(lists, CFG.top_k, exact.matched("s"), exact.matched("t")).select("s_kb", "s_id", "t_kb", "t_id", "rank")


def named_pairs(spark, d):
    pairs = _gold(spark, d).where("score > 0").select("s_id", "t_id").distinct()
    return blocking.named_pairs(pairs, _entities(spark, d))


def _gold_between(spark, d):
    """Positive pairs, smaller knowledge base first, as candidates are generated."""
    g = _gold(spark, d).where("score > 0")
    return g.select(F.least("s_id", "t_id").alias("s_id"), F.greatest("s_id", "t_id").alias("t_id"), "score").distinct()


def recall_at_k(spark, d):
    return blocking.recall_of(_named_briefly(spark, d), _gold_between(spark, d))


def missed_pairs(spark, d):
    return blocking.missed_pairs(_gold_between(spark, d), assign.best(_valid_scores(spark, d)), _entities(spark, d))


# Features and model


def _features(names: tuple[str, ...]):
    def query(spark, d):
        f = features.features_of_pairs(table(spark, d, "training_pair", heavy=True), ("pair_id",), names)
        return f.select("pair_id", *((F.round(n, 6).alias(n) if t == "double" else F.col(n)) for n, t in f.dtypes if n != "pair_id"))

    return query


name_features = _features(features.NAME)
nlp_features = _features(features.NLP)
alias_features = _features(features.ALIAS)
synonym_features = _features(features.SYNONYM)
root_features = _features(features.ROOT)


def model_metrics(spark, d):
    """A classifier trained on the train split, evaluated on dev and test."""
    pairs, engine = table(spark, d, "training_pair", heavy=True).where("label is not null"), Engine(spark)
    fitted = engine.train(pairs.where("split = 'train'"))
    return engine.evaluate(fitted, pairs.where("split in ('dev', 'test')"))


# Alignment


def align_best(spark, d):
    return assign.best(_valid_scores(spark, d))


def align_all(spark, d):
    return assign.every(_valid_scores(spark, d))


def align_one_to_one(spark, d):
    return assign.one_to_one(_valid_scores(spark, d))


def confusion_metrics(spark, d):
    scored = _valid_scores(spark, d).withColumnRenamed("score", "probability")
    gold = _gold(spark, d).groupBy("s_id", "t_id").agg(F.max("score").alias("label"))
    return evaluate.confusion(scored.join(gold, ["s_id", "t_id"]))


def confusion_confident(spark, d):
    pairs = table(spark, d, "training_pair").where("label is not null")
    prob = F.greatest(F.lit(0.0), sim.jaccard(F.array_distinct(tx.tokens("source_ent.canonical_name")), F.array_distinct(tx.tokens("target_ent.canonical_name"))))
    cfg = config.EngineConfig(metric_mode="confident")
    return evaluate.confusion(pairs.select("label", "split", prob.alias("probability")).na.fill("none", ["split"]), cfg=cfg, by=("split",))


def gold_compare(spark, d):
    return evaluate.against_gold(assign.best(_valid_scores(spark, d)), _gold_between(spark, d))


def mapping_stats(spark, d):
    text = lambda df: df.select(F.col("s_id").alias("entity1"), F.col("t_id").alias("entity2"), F.format_string("%.1f", "score").alias("measure"))
    g = _gold(spark, d)
    return evaluate.mapping_stats(text(g.where("score > 0")), text(g.where("provenance is not null")))


def region_2hop(spark, d):
    return propagate.regions(table(spark, d, "kb_relation"), _entities(spark, d))


def neighborhood_1iter(spark, d):
    r = propagate.regions(table(spark, d, "kb_relation"), _entities(spark, d))
    out = propagate.propagated(_valid_scores(spark, d), r, r)
    return out.select("s_id", "t_id", F.round("score", 6).alias("score"))


def neighborhood_5iter(spark, d):
    r = propagate.regions(table(spark, d, "kb_relation"), _entities(spark, d))
    return propagate.propagate(_valid_scores(spark, d), r, r, 5).select("s_id", "t_id", F.round("score", 6).alias("score"))


def engine_align(spark, d):
    """The first knowledge base by name against all others: train, block, match, score, assign, evaluate."""
    e, engine = _entities(spark, d), Engine(spark)
    fitted = engine.train(table(spark, d, "training_pair", heavy=True).where("label is not null and split = 'train'"))
    first = e.agg(F.min("kb")).first()[0]
    sides = [kb.KnowledgeBase(n, e.where((F.col("kb") == first) == own)) for n, own in (("source", True), ("target", False))]
    return engine.align(*sides, fitted, "best", _gold_between(spark, d)).pairs


# Terminology


def _atoms(spark, d):
    """Atoms from the entities: the positive alignment provenance names the shared concept."""
    g = _gold(spark, d).where("score > 0 and provenance like '%:%'")
    cui = F.substring_index("provenance", ":", -1)
    ids = g.select(cui.alias("CUI"), F.explode(F.array("s_id", "t_id")).alias("id")).distinct()
    e = _entities(spark, d).select(F.col("research_entity_id").alias("id"), F.explode(kb.strings("aliases")).alias("STR")).where("STR is not null")
    rows = ids.join(e, "id").select(
        "CUI", F.substring_index("id", ":", 1).alias("SAB"), F.substring_index("id", ":", -1).alias("CODE"), F.concat_ws("|", "id", "STR").alias("AUI"),
        F.when(F.length("STR") % 3 == 0, "PT").when(F.length("STR") % 3 == 1, "SY").otherwise("AB").alias("TTY"), "STR", F.length("STR").alias("ord"),
    )
    return terminology.concept_atoms(rows)


def cross_kb_pairs(spark, d):
    return terminology.cross_vocabulary_pairs(_atoms(spark, d), "R1")


def collapse_concepts(spark, d):
    c = terminology.collapsed_entities(_atoms(spark, d))
    return c.select("research_entity_id", "canonical_name", F.array_join("aliases", "|").alias("aliases"))


def definitions_concat(spark, d):
    docs = table(spark, d, "documents").where("entity_id is not null and text is not null").select(F.col("entity_id").alias("aui"), F.col("doc_id").alias("ord"), F.col("text").alias("def"))
    owners = _entities(spark, d).select(F.col("research_entity_id").alias("aui"), "research_entity_id")
    j = terminology.joined_definitions(docs, owners)
    return j.select("research_entity_id", F.md5("definition").alias("digest"))


def entity_relations(spark, d):
    rel = kb.edges(table(spark, d, "kb_relation")).select(F.col("src_id").alias("AUI1"), F.col("dst_id").alias("AUI2"), F.col("relation_type").alias("REL"))
    owners = _entities(spark, d).select(F.col("research_entity_id").alias("aui"), "research_entity_id")
    codes = spark.createDataFrame([("REL", "SIB", "rel_inverse", "SIB"), ("REL", "RO", "rel_inverse", "RO"), ("REL", "PAR", "rel_inverse", "CHD")], "DOCKEY string, VALUE string, TYPE string, EXPL string")
    return terminology.entity_relations(rel, owners, terminology.symmetric_codes(codes))


def distinct_mappings(spark, d):
    return _gold(spark, d).select("s_id", "t_id", "score", "provenance").distinct()


def hard_easy_negatives(spark, d):
    pos = _gold(spark, d).where("score > 0").select("s_id", "t_id", F.substring_index("t_id", ":", 1).alias("t_kb")).distinct()
    hard = terminology.hard_negatives(_valid_scores(spark, d), pos)
    easy = terminology.easy_negatives(_entities(spark, d), pos, hard)
    return hard.unionByName(easy)


def negatives_check(spark, d):
    """The number of hard negatives, of negatives that are positives or drawn twice, and of sources without an easy one though the knowledge base has a target left."""
    pos = _gold(spark, d).where("score > 0").select("s_id", "t_id").distinct()
    n = Scratch(spark, "negatives").save(hard_easy_negatives(spark, d), "rows")
    known = n.join(pos.withColumn("p", F.lit(1)), ["s_id", "t_id"], "left").groupBy("s_id", "t_id").agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("p"), F.max("label").alias("label"))
    counts = known.agg(F.count_if(F.col("label") == 0).alias("n_hard"), F.count_if(F.col("p").isNotNull() | (F.col("n") > 1)).alias("n_wrong"))
    targets = _entities(spark, d).select(F.col("kb").alias("t_kb"), F.col("research_entity_id").alias("t_id"))
    of = F.substring_index("t_id", ":", 1).alias("t_kb")
    taken = pos.unionByName(n.where("label = 0").select("s_id", "t_id")).distinct().join(targets, "t_id").groupBy("s_id", "t_kb").agg(F.count(F.lit(1)).alias("taken"))
    wanted = pos.select("s_id", of).distinct().join(targets.groupBy("t_kb").agg(F.count(F.lit(1)).alias("size")), "t_kb").join(taken, ["s_id", "t_kb"], "left").where("size > coalesce(taken, 0)")
    missing = wanted.join(n.where("label = -1").select("s_id", of).distinct(), ["s_id", "t_kb"], "left_anti")
    return counts.crossJoin(missing.agg(F.count(F.lit(1)).alias("n_missing")))  # one row each


def stratified_split_counts(spark, d):
    s = terminology.exact_stratified_split(table(spark, d, "training_pair").where("label is not null").select("pair_id", "label"), ("pair_id",))
    return s.groupBy("label", "new_split").agg(F.count(F.lit(1)).alias("n_rows"))


def stratified_split(spark, d):
    return terminology.stratified_split(table(spark, d, "training_pair").select("pair_id", "label"), ("pair_id",))


# Vocabulary, vectors, spans, streams


def _words(spark, d):
    return table(spark, d, "documents", heavy=True).where("text is not null").select("doc_id", F.explode(tx.tokens("text", ())).alias("word"))


def vocab_topn(spark, d):
    return vocabulary.vocabulary(_words(spark, d), "doc_id", "word", 1000, 2, 0.9)


def word_index(spark, d):
    return vocabulary.numbered(_words(spark, d))


def encoded_documents(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", tx.tokens("text", ()).alias("toks"))
    numbers = word_index(spark, d)
    return vocabulary.encoded(docs, "doc_id", "toks", numbers).select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_ids"))


def _centres(spark, d):
    """The mean vector of every label."""
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    mean = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return mean.select("label", F.col("v.x").alias("centre"))


def cosine_similarity(spark, d):
    e = table(spark, d, "embeddings").join(_centres(spark, d), "label")
    return e.select("vec_id", F.round(sim.cosine("embedding", "centre"), 5).alias("cosine"), F.round(sim.tfidf_distance(F.lit(0), F.lit(1), "embedding", "centre"), 5).alias("distance"))


def max_sim_pair(spark, d):
    """Each vector's halves against its label centre's halves."""
    e = table(spark, d, "embeddings").join(_centres(spark, d), "label")
    halves = lambda c: F.array(F.slice(c, 1, 32).cast("array<double>"), F.slice(c, 33, 32).cast("array<double>"))
    m = e.select("vec_id", model.max_similar(halves("embedding"), halves("centre")).alias("m"))
    return m.select("vec_id", F.round("m.similarity", 5).alias("similarity"), F.col("m.i").alias("s_row"), F.col("m.j").alias("t_row"))


def _tokens(spark, d):
    from skein.sources.readers import text_tokens

    return text_tokens(table(spark, d, "documents", heavy=True).where("length(text) > 0"), "doc_id", "text")


def _runs(toks: DataFrame, hit: Column, label: str) -> DataFrame:
    """Mentions of adjacent tokens that satisfy ``hit``."""
    marked = toks.withColumn("tag", F.when(hit, F.lit(f"I-{label}")).otherwise("O"))
    return spans.single_label_mentions(_opened(marked))


def _opened(marked: DataFrame) -> DataFrame:
    """Runs of I tags written as B I L or U."""
    return spans.repaired_tags(marked)


def text_tokens(spark, d):
    return _tokens(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.max("sent").alias("last_sent"))


def mention_spans(spark, d):
    return _runs(_tokens(spark, d), F.col("surface").rlike(r"^[A-Z]"), "NAME")


def span_union(spark, d):
    toks = _tokens(spark, d)
    a, b = _runs(toks, F.col("surface").rlike(r"^[A-Z]"), "NAME"), _runs(toks, F.col("surface").rlike(r"^(?:[A-Z].*|of|the|\d+)$"), "PHRASE")
    return spans.span_union(a, b)


def bilou_roundtrip(spark, d):
    toks = _tokens(spark, d)
    return spans.mentions(spans.tagged(toks, _runs(toks, F.col("surface").rlike(r"^[A-Z]"), "NAME")))


def daily_scores(spark, d):
    return score_windows(table(spark, d, "sim_score"))


_QUERIES = (
    normalize_strings, tokenize_stop, char_ngrams, name_shapes, common_substring, raw_ids, latest_entities, relation_buckets, relation_names, inverse_relations, null_entity_union,
    valid_entities, valid_relations, entity_names, relations_of, merge_entities, repointed_relations, entity_json, source_urls, synonym_enrich, summary_enrich, context_attach,
    nonempty_filter, context_counts, sampled_contexts, doc_frequency_idf, candidate_topk, string_equiv, unmatched_source, unmatched_target, remaining_candidates, named_pairs,
    recall_at_k, missed_pairs, model_metrics, align_best, align_all, align_one_to_one, confusion_metrics, confusion_confident, gold_compare, mapping_stats, region_2hop,
    neighborhood_1iter, neighborhood_5iter, engine_align, cross_kb_pairs, collapse_concepts, definitions_concat, entity_relations, distinct_mappings, hard_easy_negatives, negatives_check, stratified_split_counts, stratified_split,
    vocab_topn, word_index, encoded_documents, cosine_similarity, max_sim_pair, text_tokens, mention_spans, span_union, bilou_roundtrip, daily_scores,
)
_FEATURES = {"name_features": name_features, "nlp_features": nlp_features, "alias_features": alias_features, "synonym_features": synonym_features, "root_features": root_features}


def queries() -> dict:
    from skein import catalogue_files

    return {f.__name__: f for f in _QUERIES} | _FEATURES | catalogue_files.queries()


def oracle_sql() -> dict[str, str]:
    from skein import catalogue_files
    from skein.catalogue_sql import SQL

    return dict(SQL) | catalogue_files.oracle_sql()
