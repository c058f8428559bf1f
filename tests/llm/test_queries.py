"""Every query of the subpackage on the smallest tables."""

import os

import pytest

from strataloom.llm import queries

ROOT = os.environ.get("STRATALOOM_TESTDATA", "/root/testdata/sf0.001")
COLUMNS = {"p2_found": ["uid", "family_uid"], "p3_found": ["record_id", "defect"], "p5_found": ["uid_a", "uid_b"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, ROOT)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() == df.distinct().count()
