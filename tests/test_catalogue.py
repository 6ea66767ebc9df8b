"""Every registered query of the engine that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from kinelake.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rel = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert plain(df.select(*[f"`{c}`" for c in cols]).collect()) == plain([[r[i] for i in at] for r in rel.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() >= 0


def test_order_and_partitions_do_not_matter(spark):
    from pyspark.sql import functions as F

    from kinelake.operators import similarity, timeline
    from kinelake.plans.base import intervals, vectors

    v = vectors(spark, DIR)
    a = similarity.capped_neighbours(v, 2, 8, 0.25)
    b = similarity.capped_neighbours(v.orderBy(F.rand(3)).repartition(7), 2, 8, 0.25)
    assert plain(a.collect()) == plain(b.collect())
    i = intervals(spark, DIR)
    assert plain(timeline.merged(i).collect()) == plain(timeline.merged(i.repartition(5)).collect())
