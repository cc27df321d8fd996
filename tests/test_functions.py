import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import similarity as sim
from skein.functions import text as tx
from skein.functions.stemming import lemma, lemmas, stem, stems


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in TYPES(values)))
    return df.select(column.alias("x")).first()["x"]


def TYPES(values):
    for k, v in values.items():
        if isinstance(v, list):
            inner = "string"
            if v and isinstance(v[0], list):
                inner = "array<string>"
            elif v and isinstance(v[0], (int, float)):
                inner = "double"
            yield k, f"array<{inner}>"
        else:
            yield k, {str: "string", int: "int", float: "double", type(None): "string"}[type(v)]


@pytest.mark.parametrize(
    ("given_", "want"),
    [("  Foo-Bar_baz\t", "foobar baz"), (" X_", "x "), ("", ""), (None, None), ("ÄÖ-1", "äö1"), (" -a", "a")],
)
def test_normalize(spark, given_, want):
    assert one(spark, tx.normalize("s"), s=given_) == want


def test_equivalence_key_is_not_stripped(spark):
    assert one(spark, tx.equivalence_key("s"), s=" A-b_C") == " ab c"


@pytest.mark.parametrize(
    ("s", "want"),
    [("the Heart of The Matter", ["Heart", "The", "Matter"]), ("a-a b1 b1", ["b1", "b1"]), ("", []), (None, []), ("naïve", ["na", "ve"]), ("٣x", ["٣x"]), ("the of", [])],
)
def test_tokens(spark, s, want):
    assert one(spark, tx.tokens("s"), s=s) == want


@given(st.text(max_size=8).filter(lambda s: all(ord(c) < 0xD800 and c != "\0" for c in s)), st.integers(2, 5))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_char_ngrams_count(spark, s, n):
    pad = "\0" * (n - 1)
    p = pad + s + pad
    assert one(spark, tx.char_ngrams("s", n), s=s) == [p[i : i + n] for i in range(len(p) - n + 1)]


def test_small_string_functions(spark):
    assert one(spark, tx.canonical("s"), s="A, b-C!") == "a bc"
    assert one(spark, tx.acronym("s"), s=["Heart", "rate"]) == "Hr"
    assert one(spark, tx.longest_common_substring("a", "b"), a="xabcyabd", b="zabdabc") == "abc"
    assert one(spark, tx.longest_common_substring("a", "b"), a="", b="z") == ""
    assert one(spark, tx.without_citations("s"), s="a[12] b[citation needed].") == "a     b" + " " * 17 + "."
    assert one(spark, tx.raw_ids("s"), s="A:1|B:2") == ["A:1", "B:2"]
    assert one(spark, tx.bilou_letter("s"), s="B-Gene") == "B"
    assert one(spark, tx.bilou_entity("s"), s="B-Gene-x") == "Gene-x"
    assert one(spark, tx.document_id("s"), s="-DOCSTART- (d1)") == "d1"
    assert one(spark, tx.document_id("s"), s="word") is None
    assert one(spark, tx.sorted_token_lists("s"), s=[["b", "a"], []]) == [["a", "b"], []]


def test_jaccard_conventions(spark):
    assert one(spark, sim.jaccard("a", "b"), a=["x", "x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, sim.jaccard("a", "b"), a=[], b=["z"]) == -1.0
    assert one(spark, sim.max_jaccard("a", "b"), a=[["x"], ["y", "z"]], b=[["z", "y"]]) == 1.0
    assert one(spark, sim.max_jaccard("a", "b"), a=[["x"], []], b=[["y"], []]) == 0.0
    assert one(spark, sim.overlaps("a", "b"), a=[["x"], []], b=[[]]) is True
    assert one(spark, sim.same_set("a", "b"), a=["x", "y", "x"], b=["y", "x"]) is True


def test_vectors_and_weights(spark):
    assert one(spark, sim.cosine("a", "b"), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(math.sqrt(0.5))
    assert math.isnan(one(spark, sim.cosine("a", "b"), a=[0.0], b=[1.0]))
    assert one(spark, sim.tfidf_distance("i", "j", "a", "b"), i=-1, j=-1, a=[1.0], b=[2.0]) == 99.0
    assert one(spark, sim.tfidf_distance("i", "j", "a", "b"), i=0, j=-1, a=[1.0, 1.0], b=[4.0, 5.0]) == 5.0
    assert one(spark, sim.distance_weight("i", "j"), i=1, j=1) == pytest.approx(math.exp(-1))
    assert one(spark, sim.idf("i", "j"), i=19, j=1) == pytest.approx(math.log(20))
    assert one(spark, sim.contiguous(F.array(F.lit(3), F.lit(4), F.lit(5))), s="") is True
    assert one(spark, sim.contiguous(F.array(F.lit(3), F.lit(5))), s="") is False
    assert one(spark, sim.flat("a"), a=[["x", None], ["y"]]) == ["x", "y"]
    assert one(spark, sim.lookup({"PT": 0}, "s", 4), s="zz") == 4


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("hopping", "hop"), ("hoping", "hope"), ("generalization", "general"), ("relational", "relat"), ("happy", "happi"), ("national", "nation"), ("kidneys", "kidney"), ("a", "a"), ("consistently", "consist"), ("hopefulness", "hope")],
)
def test_stem(word, want):
    assert stem(word) == want


def test_lemma_and_columns(spark):
    assert [lemma(w) for w in ("cells", "boxes", "bodies", "virus", "mass", "leaves")] == ["cell", "box", "body", "virus", "mass", "leaf"]
    df = spark.createDataFrame([(["cells", "cells"],), ([],), (None,)], "t array<string>").coalesce(1)
    assert [tuple(r) for r in df.select(stems(F.col("t")), lemmas(F.col("t"))).collect()][:2] == [(["cell", "cell"], ["cell", "cell"]), ([], [])]


def test_exceptional_stems_and_plurals():
    from skein.functions.stemming import lemma, stem

    assert [stem(w) for w in ("skies", "dying", "news", "innings", "proceed", "early", "running")] == ["sky", "die", "news", "inning", "proceed", "earli", "run"]
    assert [lemma(w) for w in ("teeth", "vertebrae", "analyses", "species", "boxes")] == ["tooth", "vertebra", "analysis", "species", "box"]
