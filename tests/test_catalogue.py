import pytest

from skein import catalogue
from tests.conftest import DATA
from tests.oracle import assert_same

SQL = catalogue.oracle_sql()
QUERIES = catalogue.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert_same(QUERIES[name], SQL[name], spark, DATA)


@pytest.mark.parametrize("name", ["model_metrics", "engine_align", "hard_easy_negatives", "nlp_features", "stratified_split", "sampled_contexts"])
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_bilou_roundtrip_restores_mentions(spark):
    key = lambda df: sorted((r.doc_id, r.sent, r.start, r.end) for r in df.collect())
    assert key(QUERIES["bilou_roundtrip"](spark, DATA)) == key(QUERIES["mention_spans"](spark, DATA))


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["s_kb", "s_id", "t_kb", "t_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
