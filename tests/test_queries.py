"""Every query gives what DuckDB gives for its SQL; those without SQL run and have a stable schema."""

import pytest
from compare import DATA, rows_of_duck, rows_of_spark


from tempora.plans.catalog import QUERIES, SQL

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    got = rows_of_spark(df)
    if name in SQL:
        assert got == rows_of_duck(duck(SF), SQL[name])


def test_entry_points():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
