"""Corpus queries against their SQL."""

import pytest
from compare import compare, connect

from gridwake.llm.queries import LLM_ORACLES, LLM_QUERIES

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(LLM_ORACLES))
def test_sql(spark, name):
    result = compare(spark, connect(PATH), name, LLM_QUERIES, LLM_ORACLES, PATH)
    assert result["ok"], result["why"]
    assert result["rows"]
