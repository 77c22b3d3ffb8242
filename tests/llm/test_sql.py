"""The registered queries of this folder against their SQL, and their plans."""

import os

import pytest

from compare import difference, duck
from wardline.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = duck(FOLDER).execute(ORACLES[name])
    assert difference((df.columns, [tuple(r) for r in df.collect()]), ([d[0] for d in cursor.description], cursor.fetchall())) is None


def test_native_operator_runs_no_python(spark):
    plan = QUERIES["op6_decontamination"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan
