"""Operators on samples and hand-made graphs, against the rows written down in ``golden``."""

import pytest

from golden import GOLDEN
from sample_cases import CASES


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    columns, rows = GOLDEN[name]
    names = [c.rsplit(" ", 1)[0] for c in columns.split(", ")]
    got = CASES[name](spark, None)
    assert sorted(got.columns) == sorted(names)
    tidy = lambda r: repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r))
    assert sorted(map(tidy, got.select(*names).collect())) == sorted(map(tidy, rows))
