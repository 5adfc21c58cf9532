"""Every query that has SQL gives the rows of that SQL; the others run."""

import oracle
import pytest

from recollect import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    df = plans.QUERIES[name](spark, oracle.SF_DIR)
    if name in plans.ORACLE_SQL:
        assert oracle.compare(df, plans.ORACLE_SQL[name]) is None
    else:
        assert df.count() >= 0
