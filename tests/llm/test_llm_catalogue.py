import subprocess
import sys

import pytest

from skein.llm import queries as q
from tests.conftest import DATA
from tests.oracle import assert_same

SQL, QUERIES = q.oracle_sql(), q.queries()
COLUMNS = {
    "p1_found": ["row_id_a", "row_id_b"], "p2_found": ["entity_id", "group_id"], "p3_found": ["s_id", "t_id"], "p4_found": ["pair_id_a", "pair_id_b"], "p5_found": ["row_id", "term"],
    "p6_found": ["pair_id", "group_id"], "p7_found": ["row_id_first", "row_id"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert_same(QUERIES[name], SQL[name], spark, DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_found_columns(spark):
    assert {n: QUERIES[n](spark, DATA).columns for n in COLUMNS} == COLUMNS


def test_the_rest_does_not_import_this_package():
    code = "import skein.catalogue, skein.cli, skein.streaming.incremental, sys; sys.exit(any(m.startswith('skein.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0
