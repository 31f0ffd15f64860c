"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from thicket.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(tables):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{tables}/{t}.parquet'")
    return c


def rows_of(rows, cols):
    return sorted((tuple(v + 0.0 if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, tables, db, name):
    df = QUERIES[name](spark, tables)
    want = db.sql(SQL[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    assert rows_of(df.collect(), cols) == rows_of([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, tables, name):
    assert QUERIES[name](spark, tables).count() > 0


def test_entry(spark, tables):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_multiclass_fit_takes_every_dimension(spark, tables, monkeypatch):
    from thicket.plans import queries

    seen, fit = [], queries.Booster.fit
    monkeypatch.setattr(queries.Booster, "fit", lambda frame, *a, **k: seen.append(frame) or fit(frame, *a, **k))
    assert QUERIES["multiclass_fit"](spark, tables).count() > 0
    assert len(seen[0].features) == 64
