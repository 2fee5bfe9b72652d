from sillage.plans.registry import ORACLES, QUERIES
from tests.oracle import connect, rows


def test_page_selectors_read_references_as_their_sql_does(spark, tmp_path):
    """Titles that were cut within a reference, and references other than &amp;."""
    title = ["a &amp;&amp; b&amp", "say &quot;x&quot; &lt;", "&#233; &eacute &nbsp;x", "&amp;quot; &ampx &amp;amp;", "a &  b", "plain"]
    page = '<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><article><h1>{}</h1><p>x &quot; &amp</p></article>'
    table = [(i, f"https://h.example/{i}", page.format(t)) for i, t in enumerate(title)]
    spark.createDataFrame(table, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    ours = QUERIES["page_selectors"](spark, str(tmp_path)).toPandas()
    con = connect("/root/testdata/sf0.001")
    con.execute(f"create or replace view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert rows(ours) == rows(con.execute(ORACLES["page_selectors"]).df())
