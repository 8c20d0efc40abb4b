"""Every plan with SQL of its own gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from corpusloom.plans import catalog
from corpusloom.plans.dialect import TABLES, render

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    ours = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=str)
    cur = duck.execute(catalog.oracle_sql()[name])
    heads = [x[0] for x in cur.description]
    assert sorted(heads) == names
    assert ours == sorted(([plain(r[heads.index(c)]) for c in names] for r in cur.fetchall()), key=str)


def test_render_nests():
    assert render("@size(@split(a, ','))", False) == "size(split(a, ',', -1))"
    assert render("@size(@split(a, ','))", True) == "len(regexp_split_to_array(a, ','))"


def test_rounds_as_duckdb_at_ties(spark):
    sql = "select round(x, 1) as a, round(round(x, 3) + y, 2) as b from t"
    rows = [(w / s * 0.39 + 11.8 * y / w - 15.59, 0.005) for w in range(1, 60) for s in (1, 2, 4, 5, 8) for y in range(0, 120, 7)] + [(29.849999999999998, 1.0), (0.15, 0.0), (-2.45, 0.1), (None, 1.0)]
    spark.createDataFrame(rows, "x double, y double").createOrReplaceTempView("t_rounds")
    ours = [tuple(r) for r in spark.sql(render(sql, False).replace("from t", "from t_rounds")).collect()]
    values = ", ".join(f"({'null' if x is None else repr(x)}::double, {y!r}::double)" for x, y in rows)
    theirs = duckdb.connect().execute(f"select round(x, 1), round(round(x, 3) + y, 2) from (values {values}) t(x, y)").fetchall()
    assert ours == theirs
