"""The driver's contract."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["dense_filtered", "bm25", "f_not", "join_fair_claim", "chunk_fixed", "rate_window"])
def test_some_oracles(spark, name):
    import duckdb

    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    rows = lambda found: sorted(tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in found)
    assert rows(df.select(*names).collect()) == rows(db.sql(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})").fetchall())
