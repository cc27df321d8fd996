"""Queries that write files in every format from whole tables, read them back, and their SQL over the tables.

The files stand in the session's shared folder. Names are reduced to plain
letters, digits and spaces where a format has no escapes for more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.catalogue_sql import GOLD, LATEST
from skein.functions.text import canonical
from skein.operators import kb, terminology
from skein.plans.scratch import Scratch
from skein.plans.session import table
from skein.sources import readers, sinks


def _path(spark: SparkSession, name: str) -> str:
    return f"{Scratch(spark, 'files').root}/{name}"


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return kb.latest_entities(table(spark, d, "kb_entity"))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    trim = lambda c: F.regexp_replace(c, r"^[ \t]+|[ \t]+$", "")
    a = table(spark, d, "test_input_alignment").where("c0 is not null and c1 is not null and c2 is not null")
    return a.select(trim("c0").alias("s_id"), trim("c1").alias("t_id"), F.col("c2").alias("score"))


def _plain(c) -> Column:
    return F.trim(F.regexp_replace(canonical(c), " +", " "))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """(kb, id, name, aliases) of entities with a plain name; aliases plain, distinct, without the name."""
    e = _entities(spark, d).select("kb", F.col("research_entity_id").alias("id"), _plain("canonical_name").alias("name"), F.transform(kb.strings("aliases"), _plain).alias("a"))
    return e.where("name != ''").select("kb", "id", "name", F.array_sort(F.array_distinct(F.filter("a", lambda x: (x != "") & (x != F.col("name"))))).alias("aliases"))


def _read_terms(entities: DataFrame) -> DataFrame:
    rest = F.array_sort(F.filter("aliases", lambda x: x != F.col("canonical_name")))
    return entities.select("research_entity_id", "canonical_name", F.array_join(rest, "|").alias("aliases"))


def file_alignment_tsv(spark, d):
    path = _path(spark, "a.tsv")
    sinks.write_alignment(_gold(spark, d), path)
    return readers.load_alignment(spark, path).select("s_id", "t_id", "score")


def file_alignment_rdf(spark, d):
    path = _path(spark, "a.rdf")
    sinks.write_alignment(_gold(spark, d).where("score > 0").distinct(), path, "one", "two")
    return readers.load_alignment(spark, path).select("s_id", "t_id", "score")


def file_training_jsonl(spark, d):
    path = _path(spark, "t.jsonl")
    sinks.split_jsonl(table(spark, d, "training_pair").select("label", "source_ent", "target_ent", F.coalesce("split", F.lit("none")).alias("new_split")), path)
    return readers.load_alignment(spark, path).select("s_id", "t_id", "score")


def file_missed_tsv(spark, d):
    path = _path(spark, "missed")
    sinks.missed_tsv(_gold(spark, d).where("score > 0").select("s_id", "t_id").distinct(), path)
    return spark.read.schema("s_id string, t_id string").option("sep", "\t").csv(path)


def file_kb_document(spark, d):
    path = _path(spark, "k.json")
    sinks.kb_document(kb.KnowledgeBase("all", _entities(spark, d), table(spark, d, "kb_relation")), path)
    return readers.load_kb(spark, path).entities.select("kb", "research_entity_id", "canonical_name", F.size(kb.strings("aliases")).cast("long").alias("n_aliases"))


def file_kb_relations(spark, d):
    path = _path(spark, "k.parquet")
    sinks.kb_parquet(kb.KnowledgeBase("all", _entities(spark, d), table(spark, d, "kb_relation")), path)
    return readers.load_kb(spark, path).relations.select("relation_id", "kb", "relation_type", F.array_join("entity_ids", "|", "?").alias("ends"), "symmetric")


def file_obo(spark, d):
    lines = F.transform("aliases", lambda a: F.concat(F.lit('synonym: "'), a, F.lit('" EXACT []')))
    stanza = F.array_join(F.concat(F.array(F.lit("[Term]"), F.concat(F.lit("id: "), "id"), F.concat(F.lit("name: "), "name")), lines, F.array(F.lit(""))), "\n")
    path = _path(spark, "k.obo")
    _terms(spark, d).select(stanza.alias("value")).write.text(path)
    return _read_terms(readers.load_kb(spark, path).entities)


def file_mesh(spark, d):
    lines = F.transform("aliases", lambda a: F.concat(F.lit("ENTRY = "), a, F.lit("|T000|x")))
    record = F.array_join(F.concat(F.array(F.lit("*NEWRECORD"), F.concat(F.lit("MH = "), "name")), lines, F.array(F.concat(F.lit("UI = "), "id"))), "\n")
    path = _path(spark, "k.mesh")
    _terms(spark, d).select(record.alias("value")).write.text(path)
    return _read_terms(readers.load_kb(spark, path).entities)


def file_owl(spark, d):
    """Every class refers to its subjects' parents; entities are classes, aliases labels of their own or of descriptions."""
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), sinks.escaped(x), F.lit(f"</{name}>"))
    labels = F.array_join(F.transform("aliases", lambda a: tag("skos:altLabel", a)), "")
    cls = F.concat(F.lit('<owl:Class rdf:about="'), sinks.escaped("id"), F.lit('">'), tag("rdfs:label", F.col("name")), labels, F.lit("</owl:Class>"))
    head = '<rdf:RDF xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o" xmlns:skos="k" xmlns:obo="b" xmlns:oboInOwl="i">'
    path = _path(spark, "k.owl")
    sinks.framed(head, _terms(spark, d).select("id", cls.alias("value")), [F.col("id")], "</rdf:RDF>").write.text(path)
    return _read_terms(readers.load_kb(spark, path).entities)


def file_dbpedia(spark, d):
    text = F.replace(F.replace(F.replace(F.col("definition"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    e = _entities(spark, d).where("length(definition) > 0").select(F.replace("research_entity_id", F.lit(" "), F.lit("_")).alias("id"), text.alias("text"))
    line = F.concat(F.lit("<http://dbpedia.org/resource/"), "id", F.lit('> <http://dbpedia.org/ontology/abstract> "'), "text", F.lit('"@en .'))
    path = _path(spark, "k.ttl")
    e.select(line.alias("value")).write.text(path)
    return readers.load_kb(spark, path).entities.select("research_entity_id", "canonical_name", "definition")


def file_rrf(spark, d):
    """Atoms as a concept table, one per name, read back and collapsed into entities."""
    t = _terms(spark, d).select("kb", "id", F.posexplode(F.concat(F.array("name"), "aliases")).alias("n", "str"))
    code = F.substring_index("id", ":", -1)
    cells = {"CUI": F.concat(F.lit("C"), code), "AUI": F.concat_ws("-", "id", "n"), "SAB": F.col("kb"), "TTY": F.when(F.col("n") == 0, "PT").otherwise("SY"), "CODE": code, "STR": F.col("str")}
    names = "CUI LAT TS LUI STT SUI ISPREF AUI SAUI SCUI SDUI SAB TTY CODE STR SRL SUPPRESS CVF".split()
    path = _path(spark, "MRCONSO.RRF")
    t.where("instr(id, '|') = 0").select(F.concat(F.concat_ws("|", *(cells.get(n, F.lit("")) for n in names)), F.lit("|")).alias("value")).write.text(path)
    made = terminology.collapsed_entities(terminology.concept_atoms(readers.rrf(spark, path, "MRCONSO")))
    return made.select("research_entity_id", "canonical_name", F.array_join("aliases", "|").alias("aliases"))


def file_mappings(spark, d):
    """Labelled pairs in one folder per pair of knowledge bases, read by a glob; the positive ones."""
    g = _gold(spark, d).select("s_id", "t_id", F.col("score").cast("int").alias("label"), F.lit("p").alias("provenance"))
    path = _path(spark, "mappings")
    sinks.pair_tsv(g.withColumns({"kb1": F.substring_index("s_id", ":", 1), "kb2": F.substring_index("t_id", ":", 1)}), path)
    return readers.mappings_glob(spark, f"{path}/kb1=*/kb2=*").select("s_id", "t_id", "label")


def file_conll(spark, d):
    toks = readers.text_tokens(table(spark, d, "documents", heavy=True).where("length(text) > 0"), "doc_id", "text")
    path = _path(spark, "t.conll")
    sinks.conll(toks, ["tok", "surface", "tag"], path, "tok")
    back = readers.conll(spark, path)  # the columns by the header line
    return back.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.max("sent").cast("long").alias("last_sent"))


_QUERIES = (
    file_alignment_tsv, file_alignment_rdf, file_training_jsonl, file_missed_tsv, file_kb_document, file_kb_relations, file_obo, file_mesh, file_owl, file_dbpedia, file_rrf, file_mappings, file_conll,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_PLAIN = "trim(regexp_replace(lower(regexp_replace({0}, '[^a-zA-Z0-9 ]+', '', 'g')), ' +', ' ', 'g'))"
_TERMS = f"""{LATEST},
named AS (SELECT kb, research_entity_id AS id, {_PLAIN.format("canonical_name")} AS name, list_transform(coalesce(aliases, []), lambda a: {_PLAIN.format("a")}) AS a FROM latest),
terms AS (SELECT kb, id, name, list_sort(list_distinct(list_filter(a, lambda x: x <> '' AND x <> name))) AS aliases FROM named WHERE name <> '')"""
_READ = f"WITH {_TERMS.strip()} SELECT id AS research_entity_id, name AS canonical_name, array_to_string(aliases, '|') AS aliases FROM terms"


def oracle_sql() -> dict[str, str]:
    from skein.catalogue_sql import TOKEN_COUNTS

    return {
        "file_alignment_tsv": f"WITH {GOLD.strip()} SELECT s_id, t_id, score FROM gold",
        "file_alignment_rdf": f"WITH {GOLD.strip()} SELECT DISTINCT s_id, t_id, round(score, 2) AS score FROM gold WHERE score > 0",
        "file_training_jsonl": "SELECT source_ent.research_entity_id AS s_id, target_ent.research_entity_id AS t_id, label::DOUBLE AS score FROM training_pair",
        "file_missed_tsv": f"WITH {GOLD.strip()} SELECT DISTINCT s_id, t_id FROM gold WHERE score > 0",
        "file_kb_document": f"WITH {LATEST.strip()} SELECT kb, research_entity_id, canonical_name, len(coalesce(aliases, [])) AS n_aliases FROM latest",
        "file_kb_relations": "SELECT relation_id, kb, relation_type, array_to_string(list_transform(entity_ids, lambda x: coalesce(x, '?')), '|') AS ends, \"symmetric\" FROM kb_relation",
        "file_obo": _READ,
        "file_mesh": _READ,
        "file_owl": _READ,
        "file_dbpedia": f"""WITH {LATEST.strip()}
SELECT 'http://dbpedia.org/resource/' || replace(research_entity_id, ' ', '_') AS research_entity_id, replace(research_entity_id, '_', ' ') AS canonical_name, definition FROM latest WHERE length(definition) > 0""",
        "file_rrf": f"""WITH {_TERMS.strip()}
SELECT kb || ':' || list_last(string_split(id, ':')) AS research_entity_id, name AS canonical_name, array_to_string(list_sort(list_concat([name], aliases)), '|') AS aliases FROM terms
WHERE NOT contains(id, '|') AND list_last(string_split(id, ':')) <> 'NOCODE'""",
        "file_mappings": f"WITH {GOLD.strip()} SELECT s_id, t_id, 1 AS label FROM gold WHERE trunc(score) = 1",
        "file_conll": TOKEN_COUNTS,
    }
