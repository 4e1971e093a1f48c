"""Every query with SQL gives its rows on the smallest tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeframe import catalog_of_queries as catalog

TABLES = "orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, data, duck, name):
    got, want = catalog.QUERIES[name](spark, data).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            assert np.allclose(got[c].astype(float).fillna(-9e9), want[c].astype(float).fillna(-9e9), atol=2e-4)
        else:
            assert (got[c] == want[c]).all()


def test_without_sql(spark, data):
    for name in set(catalog.QUERIES) - set(catalog.ORACLE):
        assert catalog.QUERIES[name](spark, data).head(1)


def test_dump_of_scattered_events(spark, tmp_path):
    """The text of floors is that of sums in the order of the events, whatever files these lie in (0.2 + 0.7 + 0.1 is below 1, 0.1 + 0.7 + 0.2 is 1)."""
    values = [0.2, 0.7, 0.1]
    rows = [(3 * user + i, user, v) for user in range(20) for i, v in enumerate(values)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double").withColumn("ts", F.lit("2024-01-01 05:00:00").cast("timestamp"))
    assert int(0.2 + 0.7 + 0.1) == 0 and int(0.1 + 0.7 + 0.2) == 1
    for name, order in (("up", F.col("event_id")), ("down", F.col("event_id").desc())):
        events.coalesce(1).sortWithinPartitions(order).write.parquet(f"{tmp_path}/{name}/events.parquet")
        found = catalog.QUERIES["array_dump"](spark, f"{tmp_path}/{name}").collect()
        assert len(found) == 20 and {r["v"].split(", ")[5] for r in found} == {"0"}
