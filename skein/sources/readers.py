"""File readers; each returns lazy DataFrames and splits its input by records, so large files are read in parallel."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import schema
from skein.functions.text import document_id, strip
from skein.operators.kb import KnowledgeBase
from skein.plans.scratch import Scratch

# OBO keys that carry no data of the model, and its relation types.
OBO_RELATIONS = {
    "part_of", "derives_from", "has_quality", "has_origin", "sequence_of", "has_part", "non_functional_homolog_of", "position_of", "associated_with", "adjacent_to",
    "member_of", "variant_of", "is_part_of", "is_conjugate_base_of", "is_conjugate_acid_of", "is_enantiomer_of", "has_functional_parent", "is_tautomer_of",
    "has_parent_hydride", "is_substituent_group_from", "develops_from", "lacks_part", "only_in_taxon",
}


def _after(line, key: str):
    return F.substring(line, len(key) + 1, 1 << 30)


def _of(lines, key: str):
    """The values of the lines that begin with ``key``."""
    return F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(key))), lambda x: strip(_after(x, key)))


def kb_json(spark: SparkSession, path: str) -> KnowledgeBase:
    """One JSON document per file."""
    doc = spark.read.schema(schema.KB_DOCUMENT).option("multiLine", True).json(path)
    name = doc.first()
    entities = doc.select(F.col("name").alias("kb"), F.inline("entities"))
    relations = doc.select(F.col("name").alias("kb"), F.inline("relations"))
    return KnowledgeBase(name["name"] if name else "", entities, relations)


def kb_parquet(spark: SparkSession, path: str) -> KnowledgeBase:
    """A folder with ``entities`` and ``relations``, as ``sinks.kb_parquet`` writes it."""
    entities = spark.read.parquet(f"{path}/entities")
    return KnowledgeBase(path.rstrip("/").rsplit("/", 1)[-1], entities, spark.read.parquet(f"{path}/relations"))


def obo(spark: SparkSession, path: str, name: str, strict: bool = False, all_stanzas: bool = False) -> KnowledgeBase:
    """OBO stanzas, one row each. Reading stops at the first stanza that is no term, unless ``all_stanzas``.

    ``strict`` raises on a relationship type outside the known ones; by default it is dropped.
    """
    # a stanza begins with a bracket on a new line, whatever its line breaks; what stands before the first is the header
    stanza = spark.read.option("lineSep", "\n[").text(path).select(F.split(strip("value"), r"\r?\n").alias("lines"), F.monotonically_increasing_id().alias("at"))
    stanza = stanza.withColumn("tag", F.concat(F.lit("["), F.ltrim(F.element_at("lines", 1), F.lit("[")))).where(F.col("tag").rlike(r"^\[[A-Za-z]*\]"))
    if not all_stanzas:
        first_other = stanza.where("tag != '[Term]'").agg(F.min("at").alias("stop"))
        stanza = stanza.crossJoin(F.broadcast(first_other)).where("stop is null or at < stop")  # one row
    term = stanza.where("tag = '[Term]'")
    quoted = lambda key: F.filter(F.transform(_of("lines", key), lambda x: F.regexp_extract(x, r'"(.*)"', 1)), lambda x: x != "")
    label = F.replace(F.element_at(_of("lines", "name:"), 1), F.lit("_"), F.lit(" "))
    rows = term.select(F.element_at(_of("lines", "id:"), 1).alias("research_entity_id"), label.alias("canonical_name"), quoted("def:").alias("d"), quoted("synonym:").alias("s"), "lines")
    entities = rows.select(
        F.lit(name).alias("kb"), "research_entity_id", "canonical_name", F.array_distinct(F.concat(F.array("canonical_name"), "s")).alias("aliases"), F.array_join("d", " ").alias("definition")
    )
    object_id = lambda x: F.regexp_extract(x, r"^(\S+)", 1)
    is_a = rows.select("research_entity_id", F.explode(_of("lines", "is_a:")).alias("v")).select(F.col("research_entity_id").alias("src"), object_id("v").alias("dst"), F.lit("is_a").alias("relation_type"), F.lit(True).alias("symmetric"))
    rel = rows.select("research_entity_id", F.explode(_of("lines", "relationship:")).alias("v"))
    rel = rel.select(F.col("research_entity_id").alias("src"), F.regexp_extract("v", r"^\S+\s+(\S+)", 1).alias("dst"), object_id("v").alias("relation_type"), F.lit(False).alias("symmetric"))
    known = F.col("relation_type").isin(*sorted(OBO_RELATIONS))
    if strict:
        rel = rel.withColumn("relation_type", F.when(known, F.col("relation_type")).otherwise(F.raise_error(F.concat(F.lit("unknown relationship "), F.col("relation_type")))))
    rel = rel if strict else rel.where(known)
    relations = is_a.unionByName(rel).where("dst != ''").select(
        F.lit(name).alias("kb"), F.lit(None).cast("int").alias("relation_id"), "relation_type", F.array("src", "dst").alias("entity_ids"), "symmetric", F.array().cast("array<string>").alias("labels")
    )
    return KnowledgeBase(name, entities, relations)


def mesh(spark: SparkSession, path: str, name: str) -> KnowledgeBase:
    """MeSH records of ``KEY = value`` lines; lines that don't split into two are skipped."""
    record = spark.read.option("lineSep", "*NEWRECORD").text(path)
    pairs = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.split(x, " = ")), lambda p: F.size(p) == 2)
    rows = record.select(pairs.alias("p"))
    values = lambda *keys: F.transform(F.filter("p", lambda p: strip(p[0]).isin(*keys)), lambda p: strip(p[1]))
    entry = F.transform(values("ENTRY", "PRINT ENTRY"), lambda v: F.substring_index(v, "|", 1))
    entities = rows.select(
        F.lit(name).alias("kb"), F.try_element_at(values("UI"), F.lit(1)).alias("research_entity_id"), F.try_element_at(values("MH", "SH"), F.lit(1)).alias("canonical_name"),
        F.array_distinct(F.concat(values("MH", "SH"), entry)).alias("aliases"), F.array_join(values("MS"), " ").alias("definition"),
    ).where("research_entity_id is not null")
    return KnowledgeBase(name, entities)


_OWL_LABELS = (
    "rdfs:label", "skos:prefLabel", "skos:altLabel", "skos:hiddenLabel", "oboInOwl:hasExactSynonym", "oboInOwl:hasRelatedSynonym", "oboInOwl:hasNarrowSynonym", "oboInOwl:hasBroadSynonym",
)


def _text_or_ref() -> str:
    return "array<struct<_VALUE:string,`_rdf:resource`:string>>"


def owl(spark: SparkSession, path: str, name: str) -> KnowledgeBase:
    """OWL classes with labels, synonyms, definitions and named superclasses; labels may be references to descriptions."""
    fields = ", ".join(f"`{t}` {_text_or_ref()}" for t in (*_OWL_LABELS, "skos:definition", "obo:IAO_0000115", "rdfs:subClassOf"))
    cls = spark.read.format("xml").option("rowTag", "owl:Class").schema(f"`_rdf:about` string, {fields}").load(path).where("`_rdf:about` is not null")
    desc = spark.read.format("xml").option("rowTag", "rdf:Description").schema(f"`_rdf:about` string, `rdfs:label` {_text_or_ref()}").load(path)
    described = desc.where("`_rdf:about` is not null").select(F.col("`_rdf:about`").alias("ref"), F.monotonically_increasing_id().alias("at"), F.posexplode("`rdfs:label`").alias("n", "l"))
    described = described.select("ref", F.struct("at", "n", F.col("l._VALUE").alias("text")).alias("d")).where("d.text is not null")
    named = described.groupBy("ref").agg(F.array_sort(F.collect_list("d")).alias("d")).select("ref", F.transform("d", lambda x: x["text"]).alias("texts"))  # in the order of the file
    cls = cls.withColumn("id", F.col("`_rdf:about`"))
    empty = F.array().cast(_text_or_ref())

    def marked(k: int) -> Column:
        own = F.coalesce(F.col(f"`{_OWL_LABELS[k]}`"), empty)
        return F.transform(own, lambda x, i: F.struct(F.lit(k).alias("tag"), i.alias("n"), x["_VALUE"].alias("text"), x["_rdf:resource"].alias("to")))

    parts = cls.select("id", F.explode(F.concat(*map(marked, range(len(_OWL_LABELS))))).alias("l")).select("id", "l.*")
    texts = parts.join(named, F.col("to") == F.col("ref"), "left").select("id", (F.col("tag") * 2).alias("tag"), "n", F.coalesce("text", F.element_at("texts", 1)).alias("text"))
    extra = cls.select("id").join(named, F.col("id") == F.col("ref")).select("id", F.lit(1).alias("tag"), F.posexplode("texts").alias("n", "text"))  # labels of descriptions of the class itself follow its own
    labels = texts.unionByName(extra).where("text is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("tag", "n", "text"))).alias("l"))
    labels = labels.select("id", F.transform("l", lambda x: x["text"]).alias("labels"))
    definition = F.array_join(F.transform(F.concat(*(F.coalesce(F.col(f"`{t}`"), empty) for t in ("skos:definition", "obo:IAO_0000115"))), lambda x: F.lower(x["_VALUE"])), " ")
    entities = cls.select("id", definition.alias("definition")).join(labels, "id", "left").select(
        F.lit(name).alias("kb"), F.col("id").alias("research_entity_id"), F.coalesce(F.try_element_at("labels", F.lit(1)), "id").alias("canonical_name"),
        F.array_distinct(F.transform(F.coalesce("labels", F.array().cast("array<string>")), F.lower)).alias("aliases"), "definition",
    )
    parents = cls.select("id", F.explode("`rdfs:subClassOf`").alias("p")).select("id", F.col("p.`_rdf:resource`").alias("dst")).where("dst is not null")
    relations = parents.select(
        F.lit(name).alias("kb"), F.lit(None).cast("int").alias("relation_id"), F.lit("subClassOf").alias("relation_type"), F.array("id", "dst").alias("entity_ids"), F.lit(False).alias("symmetric"), F.array().cast("array<string>").alias("labels")
    )
    return KnowledgeBase(name, entities, relations)


def _decoded(literal: str) -> Column:
    """An N-Triples literal with its escapes replaced; long escapes of the basic plane are read as short ones."""
    short = F.regexp_replace(F.col(literal), r"\\U0000", r"\\u")
    plain = F.regexp_replace(short, r"(?<!\\)((?:\\\\)*)\\'", "$1'")
    return F.coalesce(F.element_at(F.from_json(F.concat(F.lit('["'), plain, F.lit('"]')), "array<string>"), 1), F.col(literal))


def dbpedia(spark: SparkSession, path: str, name: str, prefix: str = "http://dbpedia.org/resource/", limit: int = 0) -> KnowledgeBase:
    """N-Triples lines of abstracts: subjects under ``prefix``, the literal as definition, its escapes decoded; ``limit`` > 0 keeps so many."""
    triple = spark.read.text(path).select(F.regexp_extract("value", r"^<([^>]*)>", 1).alias("s"), F.regexp_extract("value", r'^<[^>]*>\s+<[^>]*>\s+"((?:[^"\\]|\\.)*)"', 1).alias("text"))
    rows = triple.where(F.startswith("s", F.lit(prefix)))
    label = F.replace(F.substring("s", len(prefix) + 1, 1 << 20), F.lit("_"), F.lit(" "))
    entities = rows.select(F.lit(name).alias("kb"), F.col("s").alias("research_entity_id"), label.alias("canonical_name"), F.array(label).alias("aliases"), _decoded("text").alias("definition"))
    return KnowledgeBase(name, entities.limit(limit) if limit else entities)


def alignment_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Four tab columns without header; rows of another width are dropped."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.size("c") == 4)
    return rows.select(F.col("c")[0].alias("s_id"), F.col("c")[1].alias("t_id"), F.expr("try_cast(c[2] as double)").alias("score"), F.col("c")[3].alias("provenance"))


def training_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs; lines that are no JSON are dropped."""
    return spark.read.schema(schema.TRAINING_PAIR).option("mode", "DROPMALFORMED").json(path)


def alignment_jsonl(spark: SparkSession, path: str) -> DataFrame:
    pairs = training_jsonl(spark, path)
    return pairs.select(F.col("source_ent.research_entity_id").alias("s_id"), F.col("target_ent.research_entity_id").alias("t_id"), F.col("label").cast("double").alias("score"), F.lit(None).cast("string").alias("provenance"))


def mapping_rdf(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (entity1, entity2, measure as text) of an alignment in RDF, read cell by cell."""
    cell = spark.read.text(path, lineSep="</Cell>").where("value like '%<Cell%'")
    resource = lambda tag: _unescaped(F.regexp_extract("value", rf"""<{tag}\b[^>]*rdf:resource\s*=\s*["']([^"']*)["']""", 1)).alias(tag)
    measure = F.regexp_extract("value", r"<measure\b[^>]*>([^<]*)<", 1)
    return cell.select(resource("entity1"), resource("entity2"), F.trim(measure).alias("measure")).distinct()


def _unescaped(s):
    for safe, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(safe), F.lit(raw))
    return s


def alignment_rdf(spark: SparkSession, path: str) -> DataFrame:
    m = mapping_rdf(spark, path)
    return m.select(F.col("entity1").alias("s_id"), F.col("entity2").alias("t_id"), F.expr("try_cast(measure as double)").alias("score"), F.lit(None).cast("string").alias("provenance"))


def rrf(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A bar-separated terminology table with its position ``ord``; quotes are ordinary characters."""
    kind = {"MRCONSO": schema.MRCONSO, "MRDEF": schema.MRDEF, "MRREL": schema.MRREL, "MRDOC": schema.MRDOC}[table]
    rows = spark.read.schema(kind).option("sep", "|").option("quote", "").option("mode", "PERMISSIVE").csv(path)
    return rows.drop("END").na.fill("").withColumn("ord", F.monotonically_increasing_id())


def mappings_glob(spark: SparkSession, pattern: str, done: DataFrame | None = None) -> DataFrame:
    """Positive rows (label 1) of many mapping files, without those listed in ``done`` (``file``)."""
    rows = spark.read.schema("s_id string, t_id string, label int, provenance string").option("sep", "\t").csv(pattern).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    rows = rows.where("label = 1")
    return rows.join(done, "file", "left_anti") if done is not None else rows


def dictionary(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key, list) rows of a JSON-lines dictionary."""
    return spark.read.schema(f"{key} string, {value} array<string>").json(path)


def conll(spark: SparkSession, path: str, columns: list[str] | None = None, transformers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Annotated tokens: (doc_id, sent, line_no, one column per field), columns named by the header line unless given.

    ``transformers`` maps a field's name to what is made of its values. Files are read by blocks: lines are numbered within
    their block, in parallel, and what the blocks before hold is added from one row per block.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", r"\r$", "").alias("line"))
    header = 0 if columns else 1
    if columns is None:
        head = lines.where("block = 0").first()
        if head is None or head["line"].startswith("-DOCSTART-"):
            raise ValueError("a file without a header line needs columns")
        columns = head["line"].split()
    blank, start = F.trim("line") == "", F.startswith("line", F.lit("-DOCSTART-"))
    lines = lines.withColumn("at", F.monotonically_increasing_id())  # rises along a block
    within = Window.partitionBy("file", "block").orderBy("at")
    counted = {"line_no": F.count(F.lit(1)), "doc_no": F.count_if(start), "brk": F.count_if(blank | start)}
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(*(c.alias(k) for k, c in counted.items()), F.max_by("line", F.when(document_id("line").isNotNull(), F.col("at"))).alias("line"))
    blocks = blocks.select("file", "block", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in counted), F.last(document_id("line"), ignorenulls=True).over(before).alias("id_before"))  # one row per block
    lines = lines.withColumns({k: c.over(within) for k, c in counted.items()} | {"doc_id": F.last(document_id("line"), ignorenulls=True).over(within)}).join(F.broadcast(blocks), ["file", "block"])
    lines = lines.withColumns({k: F.col(k) + F.col(f"{k}_before") for k in counted} | {"doc_id": F.coalesce("doc_id", "id_before")})
    lines = lines.withColumn("line_no", (F.col("line_no") - 1).cast("int")).where(F.col("line_no") >= header)
    toks = lines.where(~blank & ~start).withColumn("sent", F.dense_rank().over(Window.partitionBy("file", "doc_no").orderBy("brk")) - 1)
    cells = F.split(strip("line"), r"\s+")
    return toks.select(F.coalesce("doc_id", F.concat(F.lit("doc"), F.col("doc_no"))).alias("doc_id"), "sent", "line_no", *((transformers or {}).get(c, lambda x: x)(F.try_element_at(cells, F.lit(i + 1))).alias(c) for i, c in enumerate(columns)))


def conll_tokens(rows: DataFrame, position: str, surface: str, tag: str) -> DataFrame:
    """The token rows that ``operators.spans`` works on."""
    return rows.select("doc_id", F.col("sent").cast("long").alias("sent"), F.col(position).cast("long").alias("tok"), F.col(surface).alias("surface"), F.coalesce(tag, F.lit("O")).alias("tag"))


def text_tokens(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """An all-O annotation of plain texts: sentences end at a full stop, exclamation or question mark before white space, words and punctuation as tokens."""
    sents = texts.select(F.col(doc).cast("string").alias("doc_id"), F.posexplode(F.split(text, r"(?<=[.!?])\s+")).alias("sent", "s"))
    toks = sents.select("doc_id", F.col("sent").cast("long").alias("sent"), F.posexplode(F.regexp_extract_all("s", F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))).alias("tok", "surface"))
    return toks.select("doc_id", "sent", (F.col("tok") + 1).cast("long").alias("tok"), "surface", F.lit("O").alias("tag"))


_KB_READERS: dict[str, Callable] = {"json": lambda s, p, n: kb_json(s, p), "obo": obo, "owl": owl, "rdf": owl, "ttl": dbpedia, "nt": dbpedia, "mesh": mesh, "bin": mesh, "parquet": lambda s, p, n: kb_parquet(s, p)}
_ALIGNMENT_READERS = {"tsv": alignment_tsv, "rdf": alignment_rdf, "jsonl": alignment_jsonl, "json": alignment_jsonl}


def kb_url(spark: SparkSession, url: str, name: str) -> KnowledgeBase:
    """An OWL file behind a URL, copied in blocks into the shared folder first."""
    if urlparse(url).scheme not in ("http", "https", "ftp", "file"):
        raise ValueError(f"no URL to load: {url}")
    jvm, path = spark.sparkContext._jvm, f"{Scratch(spark, 'url').root}/source.owl"
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.java.net.URL(url).openStream(), out, 1 << 16, True)
    return owl(spark, path, name)


def listing(spark: SparkSession, path: str, pattern: str = "*", limit: int = 0) -> DataFrame:
    """(path, length) of the files below ``path``, by path; ``limit`` > 0 keeps so many. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length").orderBy("path")
    return found.limit(limit) if limit else found


def done_log(spark: SparkSession, path: str) -> DataFrame:
    """The (file) names that ``sinks.done_log`` has noted."""
    return spark.read.text(path).select(F.col("value").alias("file")).distinct()


def _extension(path: str) -> str:
    base = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for packed in (".gz", ".bz2"):
        base = base.removesuffix(packed)
    return base.rsplit(".", 1)[-1] if "." in base else ""


def load_kb(spark: SparkSession, path: str, name: str | None = None) -> KnowledgeBase:
    """A knowledge base by file extension, or of an OWL file behind a URL. Python pickles are refused: loading one runs its code."""
    if urlparse(path).scheme in ("http", "https", "ftp"):
        return kb_url(spark, path, name or path.rstrip("/").rsplit("/", 1)[-1].split(".")[0])
    kind = _extension(path)
    if kind in ("pickle", "pkl"):
        raise ValueError("pickled knowledge bases are not read; convert them to JSON or parquet")
    if kind not in _KB_READERS:
        raise NotImplementedError(f"no reader for {path}")
    base = path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
    return _KB_READERS[kind](spark, path, name or base)


def load_alignment(spark: SparkSession, path: str) -> DataFrame:
    kind = _extension(path)
    if kind not in _ALIGNMENT_READERS:
        raise NotImplementedError(f"no reader for {path}")
    return _ALIGNMENT_READERS[kind](spark, path)


def load_kbs(spark: SparkSession, paths: dict[str, str]) -> KnowledgeBase:
    """Several files as one table with a ``kb`` column each."""
    loaded = [load_kb(spark, p, n) for n, p in paths.items()]
    entities, relations = loaded[0].entities, loaded[0].relations
    for kb in loaded[1:]:
        entities = entities.unionByName(kb.entities, allowMissingColumns=True)
        if kb.relations is not None:
            relations = kb.relations if relations is None else relations.unionByName(kb.relations, allowMissingColumns=True)
    return KnowledgeBase("+".join(paths), entities, relations)
