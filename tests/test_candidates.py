"""Fusion of 50 candidates of each branch, against the query's SQL with both of its branch cuts at 50."""

import duckdb

from proofline.plans import retrieval

from tests.test_queries import shown


def test_hybrid_fuses_fifty_candidates(spark, sf_dir):
    sql = retrieval.HYBRID_RRF.replace("QUALIFY rank <= 10),\ncosines", "QUALIFY rank <= 50),\ncosines").replace("QUALIFY r <= 10)", "QUALIFY r <= 50)")
    assert sql.count("<= 50") == 2
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        duck.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want = duck.sql(sql)
    rows = sorted(repr(tuple(map(shown, r))) for r in retrieval.hybrid_rrf(spark, sf_dir).select(*want.columns).collect())
    assert rows == sorted(repr(tuple(map(shown, r))) for r in want.fetchall())
