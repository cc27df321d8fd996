"""Knowledge bases and training pairs from terminology tables (concepts, atoms, definitions, relations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.config import DEFAULT, EngineConfig
from skein.functions.similarity import lookup
from skein.functions.text import entity_id
from skein.operators.kb import KnowledgeBase

# Preference of term types for an entity's name; others rank 4.
TYPE_RANK = {
    "MH": 0, "NM": 0,
    "PT": 1, "PEP": 1, "PCE": 1,
    "ET": 2, "ETAL": 2, "CE": 2, "SY": 2, "SYN": 2, "NA": 2, "ETCF": 2, "ETCLIN": 2,
    "AB": 3, "ACR": 3,
}


def concept_atoms(mrconso: DataFrame, vocabularies: list[str] | None = None) -> DataFrame:
    """Atoms of the wanted vocabularies with a code: cui, sab, code, aui, tty, str and their order ``ord`` if present."""
    kept = mrconso.where((F.col("CODE") != "NOCODE") & F.col("SAB").isNotNull())
    if vocabularies:
        kept = kept.where(F.col("SAB").isin(*vocabularies))
    ordinal = F.col("ord") if "ord" in mrconso.columns else F.xxhash64("AUI")
    return kept.select(F.col("CUI").alias("cui"), F.col("SAB").alias("sab"), F.col("CODE").alias("code"), F.col("AUI").alias("aui"), F.col("TTY").alias("tty"), F.col("STR").alias("str"), ordinal.alias("ord"))


def cross_vocabulary_pairs(atoms: DataFrame, release: str = "") -> DataFrame:
    """(s_id, t_id, label, provenance): entities of two vocabularies that share a concept, each pair and concept once."""
    ids = atoms.select("cui", "sab", entity_id("sab", "code").alias("id")).distinct()
    a, b = ids.select("cui", F.col("sab").alias("s_sab"), F.col("id").alias("s_id")), ids.select("cui", F.col("sab").alias("t_sab"), F.col("id").alias("t_id"))
    pairs = a.join(b, "cui").where("s_sab < t_sab")
    return pairs.select("s_id", "t_id", F.lit(1).alias("label"), F.concat(F.lit(release), F.lit(":"), F.col("cui")).alias("provenance")).distinct()


def collapsed_entities(atoms: DataFrame) -> DataFrame:
    """One entity per (sab, code): the name of best-ranked term type (first in order at ties), lower-case aliases, atom ids."""
    rank = F.struct(lookup(TYPE_RANK, "tty", 4).alias("r"), "ord", "str")
    return atoms.groupBy("sab", "code").agg(
        F.min_by("str", rank).alias("canonical_name"),
        F.array_sort(F.collect_set(F.lower("str"))).alias("aliases"),
        F.array_sort(F.collect_set("aui")).alias("auis"),
    ).select("sab", "code", entity_id("sab", "code").alias("research_entity_id"), "canonical_name", "aliases", "auis")


def atom_owner(entities: DataFrame) -> DataFrame:
    """(aui, research_entity_id)."""
    return entities.select(F.explode("auis").alias("aui"), "research_entity_id")


def joined_definitions(definitions: DataFrame, owners: DataFrame) -> DataFrame:
    """(research_entity_id, definition): an entity's definitions (``aui``, ``ord``, ``def``) in file order, joined by a space."""
    d = definitions.join(owners, "aui").groupBy("research_entity_id").agg(F.array_sort(F.collect_list(F.struct("ord", "def"))).alias("d"))
    return d.select("research_entity_id", F.array_join(F.transform("d", lambda x: x["def"]), " ").alias("definition"))


def symmetric_codes(mrdoc: DataFrame) -> DataFrame:
    """The relation codes that are their own inverse."""
    return mrdoc.where((F.col("DOCKEY") == "REL") & (F.col("TYPE") == "rel_inverse") & (F.col("VALUE") == F.col("EXPL"))).select(F.col("VALUE").alias("rel")).distinct()


def entity_relations(mrrel: DataFrame, owners: DataFrame, symmetric: DataFrame) -> DataFrame:
    """(src_id, dst_id, relation_type, symmetric) between known atoms with a relation code."""
    rel = mrrel.where((F.col("REL") != "") & (F.col("REL") != "NULL")).select(F.col("AUI1").alias("a1"), F.col("AUI2").alias("a2"), F.col("REL").alias("rel"))
    src = owners.select(F.col("aui").alias("a1"), F.col("research_entity_id").alias("src_id"))
    dst = owners.select(F.col("aui").alias("a2"), F.col("research_entity_id").alias("dst_id"))
    known = rel.join(src, "a1").join(dst, "a2").join(symmetric.withColumn("symmetric", F.lit(True)), "rel", "left")  # one row per code
    return known.select("src_id", "dst_id", F.col("rel").alias("relation_type"), F.coalesce("symmetric", F.lit(False)).alias("symmetric"))


def kb_rows(entities: DataFrame, definitions: DataFrame) -> DataFrame:
    """Entity rows with kb = sab and their definitions."""
    return entities.join(definitions, "research_entity_id", "left").select(F.col("sab").alias("kb"), "research_entity_id", "canonical_name", "aliases", "definition")


def hard_negatives(candidates: DataFrame, positives: DataFrame, per_source: int = 1, seed: int = DEFAULT.seed) -> DataFrame:
    """(s_id, t_id, label 0): for every distinct positive source, hash-chosen ranked candidates that are no positives."""
    sources = positives.select("s_id").distinct()
    other = candidates.select("s_id", "t_id").join(sources, "s_id", "left_semi").join(positives.select("s_id", "t_id"), ["s_id", "t_id"], "left_anti")
    w = Window.partitionBy("s_id").orderBy(F.xxhash64("s_id", "t_id", F.lit(seed)), "t_id")
    return other.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_source).select("s_id", "t_id", F.lit(0).alias("label"), F.lit("hard_negative").alias("provenance"))


def easy_negatives(targets: DataFrame, positives: DataFrame, hard: DataFrame, per_source: int = 1, seed: int = DEFAULT.seed, cells: int = 1024) -> DataFrame:
    """(s_id, t_id, label -1): hash-chosen targets of the positive's target knowledge base, without positives and hard negatives.

    ``targets`` has (``kb``, ``research_entity_id``), ``positives`` also
    ``t_kb``. Targets are numbered per knowledge base in hash order, counted per
    cell and then within the cell. A source draws among the numbers that its
    known pairs leave, so every other target can be drawn and every source
    that has one gets one.
    """
    spots = targets.select(F.col("kb").alias("t_kb"), F.col("research_entity_id").alias("t_id")).withColumn("_h", F.xxhash64("t_id", F.lit(seed)))
    spots = spots.withColumn("_cell", F.pmod("_h", F.lit(cells)))
    counts = spots.groupBy("t_kb", "_cell").agg(F.count(F.lit(1)).alias("_n"))  # one row per knowledge base and cell
    before = Window.partitionBy("t_kb").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("t_kb", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("t_kb", "_cell").orderBy("_h", "t_id"))
    spots = spots.join(F.broadcast(starts), ["t_kb", "_cell"]).select("t_kb", "t_id", (F.col("_b") + inside - 1).alias("number"))
    size = counts.groupBy("t_kb").agg(F.sum("_n").alias("n"))  # one row per knowledge base
    known = positives.select("s_id", "t_id").unionByName(hard.select("s_id", "t_id")).distinct()
    taken = known.join(spots, "t_id").groupBy("s_id", "t_kb").agg(F.array_sort(F.collect_list("number")).alias("taken"))
    draws = positives.select("s_id", "t_kb").distinct().join(F.broadcast(size), "t_kb").join(taken, ["s_id", "t_kb"], "left")
    draws = draws.withColumn("taken", F.coalesce("taken", F.array().cast("array<bigint>"))).withColumn("free", F.col("n") - F.size("taken")).where("free > 0")
    draws = draws.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(per_source).cast("long"), F.col("free")))))
    at = F.pmod(F.pmod(F.xxhash64("s_id", "t_kb", F.lit(seed)), F.col("free")) + F.col("i"), F.col("free"))
    number = F.aggregate("taken", at, lambda x, t: F.when(t <= x, x + 1).otherwise(x))  # the at-th number that isn't taken
    drawn = draws.select("s_id", "t_kb", number.alias("number")).join(spots, ["t_kb", "number"]).select("s_id", "t_id").distinct()
    return drawn.select("s_id", "t_id", F.lit(-1).alias("label"), F.lit("easy_negative").alias("provenance"))


def negative_mappings(positives: DataFrame, candidates: DataFrame, targets: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Positives with hard and easy negatives: (s_id, t_id, label, provenance, kb1, kb2), for ``sinks.pair_tsv``.

    ``positives`` has (s_id, t_id, t_kb, label, provenance), ids as KB:code. A
    pair of knowledge bases without any negative has no rows.
    """
    hard = hard_negatives(candidates, positives, cfg.hard_negatives, cfg.seed)
    easy = easy_negatives(targets, positives, hard, cfg.easy_negatives, cfg.seed)
    own = lambda df: df.select("s_id", "t_id", "label", "provenance", F.substring_index("s_id", ":", 1).alias("kb1"), F.substring_index("t_id", ":", 1).alias("kb2"))
    negatives = own(hard.unionByName(easy))
    return own(positives).unionByName(negatives).join(negatives.select("kb1", "kb2").distinct(), ["kb1", "kb2"], "left_semi").select("s_id", "t_id", "label", "provenance", "kb1", "kb2")


def knowledge_bases(atoms: DataFrame, definitions: DataFrame, mrrel: DataFrame, symmetric: DataFrame) -> KnowledgeBase:
    """Entities and relations of every vocabulary of a terminology in one table each, with ``kb``; ``definitions`` has (aui, ord, def)."""
    entities = collapsed_entities(atoms)
    owners = atom_owner(entities)
    rows = kb_rows(entities, joined_definitions(definitions, owners))
    rel = entity_relations(mrrel, owners, symmetric).select(
        F.substring_index("src_id", ":", 1).alias("kb"), F.lit(None).cast("int").alias("relation_id"), "relation_type", F.array("src_id", "dst_id").alias("entity_ids"), "symmetric", F.array().cast("array<string>").alias("labels")
    )
    return KnowledgeBase("terminology", rows, rel)


def eligible_pairs(pairs: DataFrame, known: DataFrame, contexts: DataFrame) -> DataFrame:
    """The pairs (columns ``kb1``, ``kb2``) of two knowledge bases (``kb``) that are both known and have contexts."""
    fit = known.select("kb").join(contexts.select("kb"), "kb", "left_semi").distinct()
    for side in ("kb1", "kb2"):
        pairs = pairs.join(F.broadcast(fit.withColumnRenamed("kb", side)), side, "left_semi").select(*pairs.columns)  # one row per knowledge base
    return pairs


def stratified_split(pairs: DataFrame, keys: tuple[str, ...], label: str = "label", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """A ``new_split`` column: test, then dev of the rest, then train, in the same parts within every label.

    Rows are placed by a hash of ``keys``; the shares are exact up to sampling,
    and no label is gathered in one task.
    """
    u = F.pmod(F.xxhash64(*keys, F.lit(cfg.seed)), F.lit(1_000_000)) / 1_000_000.0
    dev = cfg.test_part + (1 - cfg.test_part) * cfg.dev_part
    return pairs.withColumn("new_split", F.when(u < cfg.test_part, "test").when(u < dev, "dev").otherwise("train")).withColumn(label, F.greatest(F.col(label), F.lit(0)))


def exact_stratified_split(pairs: DataFrame, keys: tuple[str, ...], label: str = "label", cfg: EngineConfig = DEFAULT, cells: int = 1024) -> DataFrame:
    """As ``stratified_split`` with exact shares per label: ranks by hash, counted per hash cell, then within the cell."""
    h = F.xxhash64(*keys, F.lit(cfg.seed))
    rows = pairs.withColumns({"_h": h, "_cell": F.floor((h / 2.0**63 + 1) / 2 * cells).cast("int"), "_l": F.coalesce(F.col(label), F.lit(-9))})
    counts = rows.groupBy("_l", "_cell").agg(F.count(F.lit(1)).alias("_n"))  # one row per label and cell
    before = Window.partitionBy("_l").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_l")
    starts = counts.select("_l", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"), F.sum("_n").over(whole).alias("_t"))
    inside = F.row_number().over(Window.partitionBy("_l", "_cell").orderBy("_h", *keys))
    rank = rows.join(F.broadcast(starts), ["_l", "_cell"]).withColumn("_r", F.col("_b") + inside)
    tests = F.round(F.col("_t") * cfg.test_part)
    devs = F.round((F.col("_t") - tests) * cfg.dev_part)
    split = F.when(F.col("_r") <= tests, "test").when(F.col("_r") <= tests + devs, "dev").otherwise("train")
    return rank.withColumn("new_split", split).drop("_h", "_cell", "_l", "_b", "_t", "_r")
