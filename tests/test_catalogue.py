"""Every catalogue entry against DuckDB on the same files."""

import datetime

import pytest

from daytally.plans import catalogue, oracle

SQL = oracle.statements()


def normal(rows):
    def value(v):
        return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v

    return sorted((tuple(value(v) for v in row) for row in rows), key=repr)


def test_every_entry_has_sql():
    assert set(SQL) == set(catalogue.ENTRIES)


@pytest.mark.parametrize("name", sorted(catalogue.ENTRIES))
def test_entry_matches_sql(name, source, duck):
    df = catalogue.comparable_types(catalogue.ENTRIES[name](source))
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(row) for row in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert len(got) == len(expected)
    assert normal(got) == normal(expected)
