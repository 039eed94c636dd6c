"""Every query against its SQL on the smallest tables; rows only where SQL cannot express it."""

import pytest
from harness import ROOT, compare

from corpusloom.plans.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE:
        compare(spark, QUERIES[name], ORACLE[name], "sf0.001")
    else:
        # values are held against models in test_operators.py; here: rows, and the same ones again
        first, again = (QUERIES[name](spark, f"{ROOT}/sf0.001") for _ in range(2))
        key = lambda d: sorted(map(repr, d.collect()))
        rows = key(first)
        assert first.columns == again.columns and rows == key(again)
        assert rows or name == "so09_near_duplicates"  # the smallest table has no near pair
