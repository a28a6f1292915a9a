"""Every query of the engine's own operators against its SQL."""

from __future__ import annotations

import pytest

from lodestream.plans import registry

from .conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        got, want = same_rows(df, registry.ORACLE_SQL[name])
        assert got == want
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
