"""Every query with an oracle gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from millrace.operators import signals
from millrace.plans import registry
from millrace.session import TABLES

registry.load()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    got = [tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(got, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def agrees(spark, name, where) -> list[tuple]:
    con = duckdb.connect()
    for path in where.iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    got = rows(registry.QUERIES[name](spark, str(where)).toPandas())
    assert got == rows(con.sql(registry.ORACLES[name]).df())
    return got


def test_row_positions_in_a_table_of_several_files(spark, sf, tmp_path):
    (tmp_path / "documents.parquet").mkdir()
    for part, low, high in (("b", 0, 60), ("a", 60, 150), ("d", 150, 150), ("c", 150, 10**9)):
        duckdb.sql(f"COPY (SELECT * FROM '{sf}/documents.parquet' WHERE doc_id >= {low} AND doc_id < {high}) TO '{tmp_path}/documents.parquet/part-{part}.parquet' (ROW_GROUP_SIZE 20)")
    assert len(agrees(spark, "row_positions", tmp_path)) == 200


@pytest.mark.parametrize("over", [1, 2, 3])
def test_weight_changes_of_a_model_that_lacks_tensors(spark, sf, tmp_path, over):
    duckdb.sql(f"COPY (SELECT * FROM '{sf}/embeddings.parquet' WHERE vec_id < {40 + over}) TO '{tmp_path}/embeddings.parquet'")
    assert len(agrees(spark, "weight_changes", tmp_path)) == 10
    last = signals.verdicts(*signals._neighbours(spark, str(tmp_path))).where("model = 'm10'").first()
    assert last.head_scale == 1 and (last.embed_ratio == 0) == (over == 1) and last.embed_ratio < 2
