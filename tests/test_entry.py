"""The driver's contract."""

import __spark_entry__
from proofline.plans import QUERIES


def test_entry_and_names(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"query_id", "doc_id", "rank", "bm25_score"}
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(QUERIES) <= set(queries) and set(sql) <= set(queries)
    assert all(isinstance(s, str) and s.strip() for s in sql.values())
