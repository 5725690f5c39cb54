import importlib.util
import os

import pytest

import __spark_entry__


def test_registered():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and len(q) > 55
    if importlib.util.find_spec("energraph.llm"):
        assert {f"p{n}_found" for n in (1, 3, 5, 7, 8)} <= set(q)


def test_flagship(spark):
    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "node", "energy", "rank"] and df.count() > 0
