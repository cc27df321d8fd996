import bz2
import gzip
import json

import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from skein.operators import kb, spans
from skein.sources import readers, sinks

OBO = """format-version: 1.2

[Term]
id: GO:1
name: heart_valve
def: "A valve." [x]
synonym: "cardiac valve" EXACT []
is_a: GO:2 ! parent
relationship: part_of GO:3 ! heart
relationship: strange GO:4

[Term]
id: GO:2
name: valve

[Typedef]
id: part_of

[Term]
id: GO:9
name: late
"""
MESH = """*NEWRECORD
RECTYPE = D
MH = Heart
ENTRY = Hearts|T023|x
PRINT ENTRY = Cor
MS = The organ = bad line = x
MS = The organ.
UI = D006321

*NEWRECORD
SH = surgery
UI = Q000601
"""
OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o" xmlns:skos="k" xmlns:obo="b" xmlns:oboInOwl="i">
  <owl:Class rdf:about="http://x/A"><rdfs:label>Heart</rdfs:label><skos:altLabel>Cor</skos:altLabel><oboInOwl:hasExactSynonym rdf:resource="http://x/d1"/>
    <obo:IAO_0000115>The Pump</obo:IAO_0000115><rdfs:subClassOf rdf:resource="http://x/B"/><rdfs:subClassOf/></owl:Class>
  <owl:Class rdf:about="http://x/B"></owl:Class>
  <rdf:Description rdf:about="http://x/d1"><rdfs:label>Herz</rdfs:label></rdf:Description>
</rdf:RDF>
"""


def write(path, text):
    path.write_text(text)
    return str(path)


def test_obo(spark, tmp_path):
    p = write(tmp_path / "x.obo", OBO)
    got = readers.load_kb(spark, p, "go")
    rows = {r["research_entity_id"]: r for r in got.entities.collect()}
    assert set(rows) == {"GO:1", "GO:2"}  # reading ends at the first other stanza
    assert rows["GO:1"]["canonical_name"] == "heart valve" and rows["GO:1"]["aliases"] == ["heart valve", "cardiac valve"] and rows["GO:1"]["definition"] == "A valve."
    assert {(r["relation_type"], tuple(r["entity_ids"]), r["symmetric"]) for r in got.relations.collect()} == {("is_a", ("GO:1", "GO:2"), True), ("part_of", ("GO:1", "GO:3"), False)}
    assert readers.obo(spark, p, "go", all_stanzas=True).entities.count() == 3
    with pytest.raises(Exception, match="unknown relationship"):
        readers.obo(spark, p, "go", strict=True).relations.collect()


def test_mesh(spark, tmp_path):
    rows = {r["research_entity_id"]: r for r in readers.load_kb(spark, write(tmp_path / "d.mesh", MESH), "m").entities.collect()}
    assert rows["D006321"]["aliases"] == ["Heart", "Hearts", "Cor"] and rows["D006321"]["definition"] == "The organ."
    assert rows["Q000601"]["canonical_name"] == "surgery"


def test_owl(spark, tmp_path):
    got = readers.load_kb(spark, write(tmp_path / "x.owl", OWL), "o")
    rows = {r["research_entity_id"]: r for r in got.entities.collect()}
    assert rows["http://x/A"]["canonical_name"] == "Heart" and rows["http://x/A"]["aliases"] == ["heart", "cor", "herz"] and rows["http://x/A"]["definition"] == "the pump"
    assert rows["http://x/B"]["canonical_name"] == "http://x/B" and rows["http://x/B"]["aliases"] == []
    assert [r["entity_ids"] for r in got.relations.collect()] == [["http://x/A", "http://x/B"]]


def test_dbpedia(spark, tmp_path):
    lines = [r"""<http://dbpedia.org/resource/Big_Toe> <http://p> "A \"toe\" of caf\u00e9\n\U0000263A it\'s \\."@en .""", '<http://other/X> <http://p> "no"@en .']
    rows = readers.load_kb(spark, write(tmp_path / "a.ttl", "\n".join(lines)), "db").entities.collect()
    assert [(r["canonical_name"], r["definition"]) for r in rows] == [("Big Toe", "A \"toe\" of caf\u00e9\n\u263a it's \\.")]


def test_kb_json_and_parquet_roundtrip(spark, tmp_path):
    doc = {"name": "K", "entities": [{"research_entity_id": "K:1", "canonical_name": "a", "aliases": ["a"], "additional_details": {"mesh_synonyms": ["b"]}}], "relations": [{"relation_id": 0, "relation_type": "PAR", "entity_ids": ["K:1", "K:2"], "symmetric": False, "labels": []}]}
    got = readers.load_kb(spark, write(tmp_path / "k.json", json.dumps(doc)))
    assert got.name == "K" and got.entities.select(kb.detail_list("mesh_synonyms")).first()[0] == ["b"]
    sinks.kb_parquet(got, str(tmp_path / "k.parquet"))
    again = readers.load_kb(spark, str(tmp_path / "k.parquet"))
    assert again.entities.collect() == got.entities.collect() and again.relations.collect() == got.relations.collect()
    sinks.kb_document(got, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).first()
    assert back["name"] == "K" and back["entities"][0]["research_entity_id"] == "K:1" and back["relations"][0]["entity_ids"] == ["K:1", "K:2"]
    sinks.kb_json_lines(got, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines" / "entities")).first()["kb"] == "K"


def test_obo_with_other_line_breaks(spark, tmp_path):
    path = tmp_path / "w.obo"
    path.write_bytes(OBO.replace("\n", "\r\n").encode())
    plain = readers.load_kb(spark, write(tmp_path / "x.obo", OBO), "go").entities.orderBy("research_entity_id").collect()
    assert readers.load_kb(spark, str(path), "go").entities.orderBy("research_entity_id").collect() == plain


def test_owl_keeps_all_labels_of_descriptions(spark, tmp_path):
    text = """<rdf:RDF xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o" xmlns:skos="k">
  <owl:Class rdf:about="http://x/A"><skos:prefLabel>Zeh</skos:prefLabel><skos:altLabel rdf:resource="http://x/d"/></owl:Class>
  <rdf:Description rdf:about="http://x/A"><rdfs:label>Toe</rdfs:label><rdfs:label>Digit</rdfs:label></rdf:Description>
  <rdf:Description rdf:about="http://x/d"><rdfs:label>Orteil</rdfs:label><rdfs:label>Dedo</rdfs:label></rdf:Description>
</rdf:RDF>"""
    row = readers.load_kb(spark, write(tmp_path / "y.owl", text), "o").entities.first()
    assert row["canonical_name"] == "Toe" and row["aliases"] == ["toe", "digit", "zeh", "orteil"]


def test_url_listing_and_done_log(spark, tmp_path):
    p = write(tmp_path / "z.owl", OWL)
    assert readers.kb_url(spark, f"file://{p}", "o").entities.count() == 2
    with pytest.raises(ValueError, match="URL"):
        readers.kb_url(spark, "z.owl", "o")
    write(tmp_path / "b.txt", "b")
    found = readers.listing(spark, str(tmp_path), limit=5).collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in found] == ["b.txt", "z.owl"] and found[0]["length"] == 1
    assert readers.listing(spark, str(tmp_path), "*.owl").count() == 1
    for name in ("a.tsv", "b.tsv", "a.tsv"):
        sinks.done_log(spark.createDataFrame([(name,)], "file string"), str(tmp_path / "done"))
    assert sorted(r["file"] for r in readers.done_log(spark, str(tmp_path / "done")).collect()) == ["a.tsv", "b.tsv"]


def test_unsupported_files(spark):
    with pytest.raises(ValueError, match="pickle"):
        readers.load_kb(spark, "x.pkl")
    with pytest.raises(NotImplementedError):
        readers.load_kb(spark, "x.zip")
    with pytest.raises(NotImplementedError):
        readers.load_alignment(spark, "x.zip")
    with pytest.raises(NotImplementedError):
        sinks.write_alignment(None, "x.zip")


@pytest.fixture
def alignment(spark):
    return spark.createDataFrame([("A:1", "B:<1>", 0.95, "p"), ("A:2", "B:2", 1.0, "p")], "s_id string, t_id string, score double, provenance string")


@pytest.mark.parametrize("kind", ["tsv", "rdf", "jsonl"])
def test_alignment_roundtrip(spark, tmp_path, alignment, kind):
    path = str(tmp_path / f"out.{kind}")
    sinks.write_alignment(alignment, path)
    read = readers.load_alignment(spark, path) if kind != "jsonl" else spark.read.json(path)
    assert sorted((r["s_id"], r["t_id"], r["score"]) for r in read.collect()) == [("A:1", "B:<1>", 0.95), ("A:2", "B:2", 1.0)]


def test_alignment_sources(spark, tmp_path):
    with gzip.open(tmp_path / "g.tsv.gz", "wt") as f:
        f.write("a\tb\t1.0\tx\nbad\trow\n")
    assert [tuple(r) for r in readers.load_alignment(spark, str(tmp_path / "g.tsv.gz")).collect()] == [("a", "b", 1.0, "x")]
    with bz2.open(tmp_path / "g.jsonl.bz2", "wt") as f:
        f.write(json.dumps({"label": 1, "source_ent": {"research_entity_id": "a"}, "target_ent": {"research_entity_id": "b"}}) + "\nnot json\n")
    assert [tuple(r)[:3] for r in readers.load_alignment(spark, str(tmp_path / "g.jsonl.bz2")).collect()] == [("a", "b", 1.0)]


def test_rrf_keeps_quotes(spark, tmp_path):
    line = "C1|ENG|P|L1|PF|S1|Y|A1||||MSH|PT|D1|the \"big\" heart|0|N||\n"
    row = readers.rrf(spark, write(tmp_path / "MRCONSO.RRF", line), "MRCONSO").first()
    assert (row["CUI"], row["AUI"], row["SAB"], row["TTY"], row["CODE"], row["STR"]) == ("C1", "A1", "MSH", "PT", "D1", 'the "big" heart')


def test_mappings_glob_skips_done_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\t1\tp\nx\tz\t0\tp\n")
    (tmp_path / "b.tsv").write_text("u\tv\t1\tp\n")
    done = spark.createDataFrame([("b.tsv",)], "file string")
    assert [r["t_id"] for r in readers.mappings_glob(spark, str(tmp_path / "*.tsv"), done).collect()] == ["y"]


def test_conll_roundtrip_and_mentions(spark, tmp_path):
    text = "pos\tword\ttag\n-DOCSTART- (d1)\n\n1\tBig\tB-X\n2\ttoe\tL-X\n3\thurts\tO\n\n1\tCor\tU-Y|U-Z\n\n-DOCSTART- (d2)\n\n1\tok\tO\n"
    rows = readers.conll(spark, write(tmp_path / "a.conll", text))
    assert rows.columns == ["doc_id", "sent", "line_no", "pos", "word", "tag"]
    toks = readers.conll_tokens(rows, "pos", "word", "tag")
    found = {(r.doc_id, r.sent, r.start, r.end, r.label, r.mention) for r in spans.mentions(toks).collect()}
    assert found == {("d1", 0, 1, 2, "X", "Big toe"), ("d1", 1, 1, 1, "Y", "Cor"), ("d1", 1, 1, 1, "Z", "Cor")}
    sinks.conll(rows, ["pos", "word", "tag"], str(tmp_path / "out"))
    again = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    back = readers.conll_tokens(readers.conll(spark, write(tmp_path / "b.conll", again)), "pos", "word", "tag")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, toks.collect()))
    with pytest.raises(ValueError, match="header"):
        readers.conll(spark, write(tmp_path / "c.conll", "-DOCSTART- (x)\n"))


def test_spans(spark):
    m = "doc_id string, sent long, start long, end long, label string, mention string"
    a = spark.createDataFrame([("d", 0, 1, 3, "A", "x y z"), ("d", 0, 5, 5, "A", "w")], m)
    b = spark.createDataFrame([("d", 0, 3, 4, "B", "z q"), ("d", 0, 5, 6, "B", "w v")], m)
    kept = {(r.start, r.end, r.label) for r in spans.span_union(a, b).collect()}
    assert kept == {(1, 3, "A"), (5, 6, "B")}
    gap = spark.createDataFrame([("d", 0, 1, "x", "B-A"), ("d", 0, 3, "y", "L-A")], spans.TOKEN)
    with pytest.raises(Exception, match="discontinuous"):
        spans.mentions(gap).collect()
    ignored = spark.createDataFrame([("d", 0, 1, "x", "U-EG:1")], spans.TOKEN)
    assert spans.mentions(ignored).count() == 0
    cut = spark.createDataFrame([("d", 0, 1, "x", "B-A"), ("d", 0, 2, "y", "O"), ("d", 0, 3, "z", "I-A"), ("d", 0, 4, "w", "L-A")], spans.TOKEN)
    assert [r.tag for r in spans.repaired_tags(cut).orderBy("tok").collect()] == ["U-A", "O", "B-A", "L-A"]


def test_training_and_pair_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", 1, "p", "K", "L")], "s_id string, t_id string, label int, provenance string, kb1 string, kb2 string")
    sinks.pair_tsv(pairs, str(tmp_path / "pairs"))
    assert (tmp_path / "pairs" / "kb1=K" / "kb2=L").is_dir()
    sinks.split_jsonl(pairs.withColumn("new_split", F.lit("dev")), str(tmp_path / "split"))
    assert spark.read.json(str(tmp_path / "split")).first()["new_split"] == "dev"
    sinks.evaluation_tsv(pairs, str(tmp_path / "eval"))
    sinks.evaluation_tsv(pairs, str(tmp_path / "eval"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "eval")).count() == 2


def test_conll_files_are_read_by_blocks(spark, tmp_path, monkeypatch):
    """A file longer than a block gives the same tokens, and is never read as one value."""
    docs = ["-DOCSTART- (d%d)\n\n" % d + "\n\n".join("\n".join(f"{i}\tw{d}x{s}x{i}\tO" for i in range(5)) for s in range(d % 4 + 1)) + "\n" for d in range(60)]
    path = write(tmp_path / "long.conll", "pos\tword\ttag\n" + "".join(docs).replace("\n", "\r\n"))
    text, whole = DataFrameReader.text, []
    monkeypatch.setattr(DataFrameReader, "text", lambda self, *a, **k: whole.append(k.get("wholetext")) or text(self, *a, **k))
    read = lambda: sorted(tuple(r) for r in readers.conll(spark, path).collect())
    once = read()
    assert [(r[0], r[1], r[4]) for r in sorted(once, key=lambda r: r[2])] == [(f"d{d}", s, f"w{d}x{s}x{i}") for d in range(60) for s in range(d % 4 + 1) for i in range(5)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        assert read() == once and not any(whole)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
