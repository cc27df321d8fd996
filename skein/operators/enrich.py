"""Synonyms, summaries and contexts joined to entities and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import normalize
from skein.operators.kb import strings


def alias_synonyms(entities: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(kb, research_entity_id, source, synonyms): distinct synonyms of the entity's normalised aliases per source.

    ``synonyms`` has (``source``, ``alias``, ``synonym``), the alias normalised.
    """
    keys = entities.select("kb", "research_entity_id", F.explode(F.array_distinct(F.transform(strings("aliases"), normalize))).alias("alias"))
    return keys.join(synonyms, "alias").groupBy("kb", "research_entity_id", "source").agg(F.array_sort(F.collect_set("synonym")).alias("synonyms"))


def with_summaries(entities: DataFrame, summaries: DataFrame, shortest: int = 5) -> DataFrame:
    """Definitions shorter than ``shortest`` (null as empty) replaced by the ``summary`` of the name, where there is one."""
    s = summaries.select(F.col("query").alias("_q"), "summary")
    joined = entities.join(s, F.col("canonical_name") == F.col("_q"), "left")
    short = F.length(F.coalesce("definition", F.lit(""))) < shortest
    return joined.withColumn("definition", F.when(short & F.col("summary").isNotNull(), F.col("summary")).otherwise(F.col("definition"))).drop("_q", "summary")


def with_contexts(entities: DataFrame, contexts: DataFrame) -> DataFrame:
    """Non-empty ``contexts`` (``canonical_name``, ``contexts``) attached by exact name."""
    c = contexts.select("canonical_name", F.filter("contexts", lambda x: x != "").alias("contexts"))
    joined = entities.join(c, "canonical_name", "left")
    return joined.withColumn("other_contexts", F.coalesce("contexts", strings("other_contexts"))).drop("contexts")


def filled_pairs(pairs: DataFrame, field: str = "definition") -> DataFrame:
    """Training pairs whose two sides both have a non-empty ``field`` (text or list)."""
    kind = dict(pairs.select(f"source_ent.{field}").dtypes)[field]
    measure = F.size if kind.startswith("array") else F.length
    return pairs.where((measure(f"source_ent.{field}") > 0) & (measure(f"target_ent.{field}") > 0))


def context_counts(entities: DataFrame) -> DataFrame:
    """Per knowledge base: entities, those with a context, with a definition, contexts in all."""
    size = F.size(strings("other_contexts"))
    return entities.groupBy("kb").agg(
        F.count(F.lit(1)).alias("n_entities"), F.count_if(size > 0).alias("with_context"), F.sum(size).alias("n_contexts"),
        F.count_if((F.length("definition") > 0) & (F.col("definition") != "<s>")).alias("with_definition"),
    )
