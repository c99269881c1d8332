import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return str(value) if isinstance(value, list) or hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str([_plain(v) for v in r]) for r in found.fetchall())
    assert sorted(str([_plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
