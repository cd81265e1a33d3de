"""The corpus queries that have SQL against it in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from textloom.llm import queries


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v for v in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", queries.ORACLES)
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(con.sql(queries.ORACLES[name]).df())
