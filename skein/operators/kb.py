"""Knowledge bases as two DataFrames: entities and relations.

Entities have ``kb``, ``research_entity_id``, ``canonical_name``, ``aliases``,
``definition`` and optional further columns; relations have ``kb``,
``relation_id``, ``relation_type``, ``entity_ids`` (subject, object),
``symmetric`` and ``labels``. Every operator keeps both partitioned by key and
aggregates before it shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.config import DEFAULT, INVERSE_TYPES, EngineConfig
from skein.functions.similarity import lookup
from skein.functions.text import canonical, normalize, raw_ids

NO_DEFINITION = "<s>"


@dataclass(frozen=True)
class KnowledgeBase:
    """A named pair of entity and relation tables."""

    name: str
    entities: DataFrame
    relations: DataFrame | None = None


def strings(c) -> Column:
    """A list column with null as the empty list."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))


def latest_entities(entities: DataFrame) -> DataFrame:
    """The last delivered row of every (kb, research_entity_id); ties by larger row id.

    A partial aggregate of one struct per key, without a sort.
    """
    rest = [c for c in entities.columns if c not in ("updated_at", "loaded_at", "row_id", "kb", "research_entity_id", "additional_details")]
    details = [F.map_entries("additional_details").alias("additional_details")] if "additional_details" in entities.columns else []
    row = F.struct("updated_at", "loaded_at", "row_id", *rest, *details)
    last = entities.where(F.col("research_entity_id").isNotNull()).groupBy("kb", "research_entity_id").agg(F.max(row).alias("r"))
    out = last.select("kb", "research_entity_id", "r.*")
    return out.withColumn("additional_details", F.map_from_entries("additional_details")) if details else out


def normalized(entities: DataFrame, lists: tuple[str, ...] = ("aliases",)) -> DataFrame:
    """Name, definition and the list columns normalised; null lists become empty."""
    out = entities.withColumns({"canonical_name": normalize("canonical_name"), "definition": normalize("definition")})
    return out.withColumns({c: F.transform(strings(c), normalize) for c in lists if c in entities.columns})


def detail_list(key: str) -> Column:
    """A list in ``additional_details``; missing as empty. The misspelled key of old files is read too."""
    details = F.col("additional_details")
    found = F.try_element_at(details, F.lit(key))
    if key == "mesh_synonyms":
        found = F.coalesce(found, F.try_element_at(details, F.lit("mesh_synonynms")))
    return F.coalesce(found, F.array().cast("array<string>"))


def edges(relations: DataFrame) -> DataFrame:
    """Relations with both ends: kb, relation_id, src_id, dst_id, relation_type, symmetric."""
    ends = relations.select(
        "kb", "relation_id", F.element_at("entity_ids", 1).alias("src_id"), F.element_at("entity_ids", 2).alias("dst_id"), "relation_type", "symmetric"
    )
    return ends.where("src_id is not null and dst_id is not null and relation_type is not null")


def valid_entities(entities: DataFrame) -> DataFrame:
    """Entities with a non-empty id and name."""
    return entities.where((F.length("research_entity_id") > 0) & (F.length("canonical_name") > 0))


def checked_entities(entities: DataFrame) -> DataFrame:
    """As ``entities``; reading a row without id or name raises an error."""
    ok = (F.length("research_entity_id") > 0) & (F.length("canonical_name") > 0)
    return entities.withColumn("research_entity_id", F.when(F.coalesce(ok, F.lit(False)), F.col("research_entity_id")).otherwise(F.raise_error(F.lit("entity without id or name"))))


def valid_relations(relations: DataFrame) -> DataFrame:
    """Relations with a type and two ends."""
    e = F.col("entity_ids")
    return relations.where((F.length("relation_type") > 0) & (F.size(e) == 2) & F.element_at(e, 1).isNotNull() & F.element_at(e, 2).isNotNull())


def relation_buckets(relations: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Per subject the distinct objects of each relation family, sorted."""
    e = edges(relations)
    sets = [F.array_sort(F.collect_set(F.when(F.col("relation_type").isin(*types), F.col("dst_id")))).alias(f"{name}_relations") for name, types in cfg.families.items()]
    return e.groupBy("kb", F.col("src_id").alias("research_entity_id")).agg(*sets)


def relation_names(relations: DataFrame, entities: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Per subject the objects' names of each family, sorted, repetitions kept, unknown objects dropped."""
    names = entities.where("canonical_name is not null").select("kb", F.col("research_entity_id").alias("dst_id"), F.col("canonical_name").alias("name"))
    e = edges(relations).join(names, ["kb", "dst_id"])
    lists = [F.array_sort(F.collect_list(F.when(F.col("relation_type").isin(*types), F.col("name")))).alias(f"{name}_relations") for name, types in cfg.families.items()]
    return e.groupBy("kb", F.col("src_id").alias("research_entity_id")).agg(*lists)


def inverse_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """The missing inverse edges (kb, src_id, dst_id, relation_type), each once.

    An edge whose type has an inverse gets it if its object exists and no such
    edge stands there yet.
    """
    e = edges(relations)
    inverse = lookup(INVERSE_TYPES, "relation_type", None)
    wanted = e.select("kb", F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), inverse.cast("string").alias("relation_type")).where("relation_type is not null").distinct()
    there = e.select("kb", "src_id", "dst_id", "relation_type")
    known = entities.select("kb", F.col("research_entity_id").alias("src_id")).distinct()
    return wanted.join(there, ["kb", "src_id", "dst_id", "relation_type"], "left_anti").join(known, ["kb", "src_id"], "left_semi")


def with_inverse_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """All edges, the added ones with ``symmetric`` true and no relation id."""
    added = inverse_relations(relations, entities).withColumns({"relation_id": F.lit(None).cast("int"), "symmetric": F.lit(True)})
    return edges(relations).unionByName(added)


def with_null_entity(entities: DataFrame) -> DataFrame:
    """One more row (``KB:NULL``) for every knowledge base that lacks it."""
    nil = F.concat("kb", F.lit(":NULL"))
    have = entities.where(F.col("research_entity_id") == nil).select("kb").distinct()
    new = entities.select("kb").distinct().join(have, "kb", "left_anti")
    new = new.withColumns({"research_entity_id": nil, "canonical_name": F.lit("null"), "aliases": F.array().cast("array<string>")})
    return entities.unionByName(new, allowMissingColumns=True)


def with_source_urls(entities: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Empty ``source_urls`` filled from the id: the prefix before the colon names the URL it is appended to."""
    prefix, local = F.substring_index("research_entity_id", ":", 1), F.substring_index("research_entity_id", ":", -1)
    url = F.concat(lookup(prefixes, prefix, None), local)
    return entities.withColumn("source_urls", F.when(F.size(strings("source_urls")) > 0, F.col("source_urls")).when(url.isNotNull(), F.array(url)).otherwise(F.array().cast("array<string>")))


def merged_entities(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """One entity per group: ``groups`` has (``research_entity_id``, ``merge_key``), others stay alone.

    The merged id joins the sorted distinct raw ids by a bar; aliases and
    contexts are united, the distinct definitions joined by a space; the name
    is that of the smallest id.
    """
    keyed = entities.join(groups, "research_entity_id", "left").withColumn("merge_key", F.coalesce("merge_key", "research_entity_id"))
    raw = F.array_sort(F.array_distinct(F.flatten(F.collect_set(raw_ids("research_entity_id")))))
    texts = F.array_sort(F.collect_set(F.when((F.col("definition") != "") & (F.col("definition") != NO_DEFINITION), F.col("definition"))))
    return keyed.groupBy("merge_key").agg(
        F.array_join(raw, "|").alias("merged_id"),
        F.min_by("canonical_name", "research_entity_id").alias("canonical_name"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(strings("aliases"))))).alias("aliases"),
        F.array_join(texts, " ").alias("definition"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(strings("other_contexts"))))).alias("other_contexts"),
    )


def repointed_relations(relations: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges with both ends replaced by the merged ids; edges inside one merged entity are dropped."""
    ids = merged.select(F.explode(raw_ids("merged_id")).alias("raw"), "merged_id")
    e = edges(relations)
    for side in ("src_id", "dst_id"):
        e = e.join(ids.select(F.col("raw").alias(side), F.col("merged_id").alias("m")), side, "left").withColumn(side, F.coalesce("m", side)).drop("m")
    return e.where("src_id != dst_id")


def raw_id_view(entities: DataFrame) -> DataFrame:
    """(kb, raw_id, research_entity_id): lookup by each raw id of a merged id."""
    return entities.select("kb", F.explode(F.array_distinct(raw_ids("research_entity_id"))).alias("raw_id"), "research_entity_id")


def entity_names(entities: DataFrame) -> DataFrame:
    """(kb, research_entity_id, names): the distinct canonical forms of the aliases, sorted."""
    return entities.select("kb", "research_entity_id", F.array_sort(F.array_distinct(F.transform(strings("aliases"), canonical))).alias("names"))


def relations_of(relations: DataFrame) -> DataFrame:
    """(kb, research_entity_id, relation_ids): the edges an entity owns, sorted."""
    return edges(relations).groupBy("kb", F.col("src_id").alias("research_entity_id")).agg(F.array_sort(F.collect_set("relation_id")).alias("relation_ids"))


def entity_json(entities: DataFrame, relations: DataFrame | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(kb, research_entity_id, json): the fields a model reads, with the names of related entities."""
    base = entities.select(
        "kb", "research_entity_id", "canonical_name", strings("aliases").alias("aliases"), F.coalesce("definition", F.lit(NO_DEFINITION)).alias("definition"), strings("other_contexts").alias("other_contexts"),
        *((detail_list(k).alias(k) for k in ("wiki_entities", "mesh_synonyms", "dbpedia_synonyms")) if "additional_details" in entities.columns else ()),
    )
    if relations is not None:
        base = base.join(relation_names(relations, entities, cfg), ["kb", "research_entity_id"], "left")
        base = base.withColumns({f"{n}_relations": strings(f"{n}_relations") for n in cfg.families})
    return base.select("kb", "research_entity_id", F.to_json(F.struct(*[c for c in base.columns if c != "kb"])).alias("json"))
