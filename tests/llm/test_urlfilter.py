import duckdb
import pandas as pd

from tickweave.llm import urlfilter
from tickweave.llm.oracles import SQL

PAGES = [
    (1, "http://A.example.com/de/1", '<a href="https://b.example.org/x">b</a>'), (2, "https://b.example.org/x?y", "<A HREF='//c.example.org'>c</A>"), (3, "http://c.example.org", None),
    (4, "http://x.example.net/es/1#a", '<a href="http://x.example.net/en/">own</a>'), (5, "http://d.example.org/a", '<a class="k" href=http://X.example.net/es/1>bad</a><a href="/local">l</a>'),
    (6, "http://e.example.org/", '<a href="http://d.example.org/">d</a> <a href="http://d.example.org/2">again</a>'), (7, None, '<a href="http://x.example.net/">n</a>'), (8, "no scheme", ""),
    (9, "http://www.example.com/en/a", ""), (10, "http://example.com/en/a", ""), (11, "http://example.com", ""), (12, "http://notexample.com/en/", ""), (13, "s://h://i/p", ""), (13, "s://h://i/p", ""),
]


def test_verdicts_against_sql_over_real_links(spark):
    got = sorted(map(tuple, urlfilter.judged(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()), key=str)
    pages = pd.DataFrame(PAGES, columns=["page_id", "url", "html"])  # noqa: F841
    want = duckdb.sql(SQL["op1_url_filters"]).fetchall()
    assert got == sorted(want, key=str)
    verdict = {r[0]: r[4] for r in got}
    assert verdict[4] == "block" and verdict[9] == "allow" and verdict[10] == "block"
    assert verdict[5] == verdict[6] == "block" and verdict[2] == verdict[3] == "allow"  # distrust reaches who links, trust whom it is linked to


def test_no_pages(spark):
    assert urlfilter.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
