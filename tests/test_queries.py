"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest

import oracle
from tabloom.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
#: Learnt groupings, models and out-of-fold scores; SQL has no counterpart, the other tests cover them.
WITHOUT_SQL = {"binning_proposals", "remedies_target_groups", "text_scores", "model_importance", "model_comparison", "text_topics", "features_linear_gain"}


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        assert oracle.differences(df, con, SQL[name]) == []
    else:
        assert name in WITHOUT_SQL and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
