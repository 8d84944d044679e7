"""Queries against their SQL on keys of more than six digits."""

import duckdb
import pytest
from test_queries import compare

from ledgerglass.plans import catalogue


@pytest.mark.parametrize("name", ["licence_key", "licence_series", "dosage_classes"])
def test_keys_of_seven_and_more_digits(spark, tmp_path, name):
    c = duckdb.connect()
    keys = "SELECT unnest([0, 7, 99999, 100000, 100003, 123456, 999999, 12345678] || range(1000000, 1000040)) AS p_partkey"
    c.execute(f"COPY (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, 'hot bolt' AS p_name, 'Brand#1' AS p_brand, 'LARGE' AS p_type, CAST(1 + p_partkey % 50 AS BIGINT) AS p_size, 1.0 AS p_retailprice FROM ({keys})) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    r = c.execute(catalogue.ORACLES[name])
    compare(df.columns, [tuple(x) for x in df.collect()], [d[0] for d in r.description], r.fetchall())
