"""Every registered query of the library runs on the smallest tables; those with SQL equal DuckDB's rows."""

import duckdb
import pytest

from brindle.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "documents events conversations pages embeddings".split()
# Least rows of the queries that SQL cannot express, at this size.
LEAST = {"tidy_documents": 2, "level_fold": 100}


def text(x):
    return "~" if x is None or str(x) in ("<NA>", "NaT", "nan") else f"{x:.6f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name not in catalogue.ORACLES:
        got = df.collect()
        assert len(got) >= LEAST[name] and all(any(v is not None for v in r) for r in got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = lambda p: sorted(tuple(map(text, r)) for r in p.astype(object).itertuples(index=False))
    assert rows(df.toPandas()) == rows(con.execute(catalogue.ORACLES[name]).df()[df.columns])
