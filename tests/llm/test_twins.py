import pytest

import __spark_entry__ as entry
from folioscope.llm.sql import SQL
from tests.compare import TESTDATA, connect


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_twin_agree(spark, name):
    df = entry.queries()[name](spark, TESTDATA)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    result = connect(TESTDATA).execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())
    assert ours and ours == theirs
