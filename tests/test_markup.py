"""Blocks of pages."""

import pytest
from pyspark.sql import functions as F

from proofline.functions.markup import html_blocks, html_blocks_sql

PAGES = [
    ("<body><h2 class=x>Head &amp; more</h2><p>See <a href='u'>this</a> for\n the <b>rest</b>.<p id=y>Next&nbsp;one<br>goes on</p>", [("h2", "Head & more"), ("p", "See this for the rest."), ("p", "Next one goes on")]),
    ("<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>tail", [("li", "one"), ("li", "two"), ("td", "a"), ("td", "b"), ("", "tail")]),
    ("<script>if (a<b) '<p>'</script><nav><p>menu</p></nav><P>It is &lt;p&gt;</P><!-- <p>no</p> --><div>free</div>", [("p", "It is <p>"), ("", "free")]),
    ("<pre>x</pre><param><picture>y</picture>", [("pre", "x"), ("", "y")]),
    ("", []), (None, None),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_blocks_of_a_page(spark, page, want):
    found = spark.createDataFrame([(page,)], "html string").select(html_blocks(F.col("html")).alias("b")).first()["b"]
    assert (found and [tuple(b) for b in found]) == (want or found) and (found is None) == (page is None)


def test_sql_has_the_same_blocks():
    import duckdb

    for page, want in PAGES:
        found = duckdb.execute(f"SELECT {html_blocks_sql('html')} FROM (SELECT CAST(? AS VARCHAR) AS html)", [page]).fetchone()[0]
        assert (found and [(b["tag"], b["text"]) for b in found]) == (want or found)
