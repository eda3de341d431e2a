"""Main text of pages against the articles the test pages are made of, and the alignment against a plain table."""

import html
import re

import __spark_entry__ as entry
import pytest
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st

from zonecast.llm import html_text as H


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *row]
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j + 1] + 1 if x == y else max(row[j + 2], new[j]))
        row = new
    return row[-1]


def is_subsequence(a, b):
    rest = iter(b)
    return all(x in rest for x in a)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25), st.sampled_from([8, 1 << 24]))
def test_common_lines_are_a_longest_common_subsequence(a, b, cells):
    cells, H._CELLS = H._CELLS, cells
    try:
        found = [a[i] for i in sorted(H.common_lines(a, b))]
    finally:
        H._CELLS = cells
    assert len(found) == lcs_length(a, b) and is_subsequence(found, b)


def article(page):
    """Blocks of the article of a given page, by patterns."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " " if b == "<br>" else "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inside.replace("<br>", " "))]
    return "\n".join(b for b in blocks if b)


def test_query_gives_the_articles(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = entry.queries()["op13_html_text"](spark, SF_DIR).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(df):
    return {r["page_id"]: r["text"] for r in H.main_text(df).collect()}


def test_template_lines_of_undeclared_pages_go_and_copies_stay(spark):
    top, low = "<div>Daily Post</div><div>Read all about it</div>", "<div>Printed in Town</div>"
    body = lambda i: "".join(f"<p>Story {i} part {k} with words of its own {i * 7 + k}.</p>" for k in range(4))
    rows = [(i, f"http://h.example.com/en/{100 + i}", f"<body>{top}{body(i)}{low}") for i in range(6)]
    # a copy of the last story beside it, and a page of another host with the same lines
    rows += [(6, "http://h.example.com/en/105/?ref=1", rows[5][2]), (7, "http://h.example.com/en/106.html#x", rows[5][2]), (8, "http://other.example.com/en/100", rows[0][2])]
    got = texts(frame(spark, rows))
    own = lambda i: re.sub("</?p>", "", body(i).replace("</p><p>", "\n"))
    for i in range(5):
        assert got[i] == own(i)
    assert got[5] == got[6] == own(5)
    assert got[7].split("\n")[2:6] == own(5).split("\n")
    assert got[8].startswith("Daily Post\n") and got[8].endswith("Printed in Town")


def test_named_elements_go(spark):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="menu-open"><header><h1>Site</h1></header>
    <div id="cookie-banner">We use cookies <a>ok</a></div><div role="navigation"><a>Home</a></div><div class="content adventure"><h1>Tales of
    an&nbsp;adventure</h1><p>One &lt;b&gt; &eacute;<b>t</b>&eacute;<br>two<p>Three<script>var x = "</p>";</script> four</p><div class="share">Share</div>
    <form><label>Mail</label><input></form><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></div><section id="comments"><p>Nice!</p></section>
    <aside>More</aside><div hidden>no</div><footer>&copy; Site</footer>"""
    want = "Tales of an adventure\nOne <b> été two\nThree four\na\nb\nc\nd"
    assert texts(frame(spark, [(1, "http://a.example.com/x", page)]))[1] == want
    inside = "<body><nav>n</nav><main><header><h2>Head</h2></header><p>Text</p><div class='ad'>Buy</div><p>More</p></main><p>Out</p>"
    assert texts(frame(spark, [(1, "http://a.example.com/x", inside)]))[1] == "Head\nText\nMore"


ODD = [
    (1, None, None), (2, "", ""), (None, "http://a.example.com/p", "<p>x"), (4, "no url", "plain &amp text < 3"), (4, "http://a.example.com/p", "<p>x"),
    (5, "http://a.example.com", "</div></p><b><i>loose</b> ends<!-- a > b --><p"), (6, "http://a.example.com/" + "long/" * 500, "<p>" * 3000 + "deep"),
]


@pytest.mark.parametrize("partitions", [1, 5])
def test_odd_pages(spark, partitions):
    df = frame(spark, ODD)
    for name in ("_key", "host", "path", "hashes", "lines", "text", "position", "declared", "shared", "near"):
        df = df.selectExpr("*", f"'own' AS {name}")
    rows = H.main_text(df.repartition(partitions)).collect()
    got = sorted(((r["page_id"], r["text"]) for r in rows), key=str)
    want = [(1, ""), (2, ""), (4, "plain & text < 3"), (4, "x"), (5, "loose ends"), (6, "deep"), (None, "x")]
    assert got == sorted(want, key=str)
    assert H.main_text(df.limit(0)).count() == 0


def test_one_path_with_most_pages(spark):
    same = [(i, "http://h.example.com/en/hot?page=%d" % i, f"<div>Top</div><p>Story number {i} and more of it</p>") for i in range(400)]
    rows = same + [(1000, "http://h.example.com/en/hos", "<div>Top</div><p>Another story</p>")]
    got = texts(frame(spark, rows))
    assert len(got) == 401 and all(got[i] == f"Story number {i} and more of it" for i in range(400)) and got[1000] == "Another story"
