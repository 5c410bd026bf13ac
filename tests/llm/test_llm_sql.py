import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF  # noqa: E402
from oracle import assert_same, connect  # noqa: E402

from codeweft.llm.catalogue import LLM  # noqa: E402


@pytest.mark.parametrize("name", sorted(LLM.sql))
def test_equals_sql(spark, name):
    assert_same(LLM.queries[name](spark, SF), connect(SF), LLM.sql[name])
