from __future__ import annotations

import html
import random
import re

from pyspark.sql import functions as F

from meridia.llm import html_extract as op

TEST = "/root/testdata/sf0.01"


def plain(page):
    """The article of the test pages, by patterns alone."""
    body = page.partition("<article>")[2].partition("</article>")[0]
    parts = re.split(r"</?(?:p|h1|h2|h3|ul|li)>", body)
    out = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " " if "<br" in x else "", x) if "<br" not in x else re.sub(r"</?b>", "", x.replace("<br>", " ")))).strip() for x in parts]
    return "\n\n".join(x for x in out if x)


def test_every_page_of_the_test_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{TEST}/pages.parquet").collect()}
    got = op.op9_html_extract(spark, TEST).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id])
        assert r.n_chars == len(r.text)


def page(i, body, extra=""):
    return (
        f"<html><head><title>T{i}</title><style>p{{x:1}}</style></head><body><div class='top-menu'><a href=/>Home</a> <a href=/{i}>News {i}</a></div>"
        f"<div class=page><div id=cookie-notice>We use cookies {i}</div><div class='body with-sidebar'><h2>Head &amp; line {i}</h2>{body}<p>Read the rules.</p>{extra}</div>"
        f"<div class=sidebar><p>Other {i} things to look at, {i} of them</p></div><form><p>Write {i} to us</p></form><section class=comments><p>Reader {i} says hi</p></section></div><div id=footer>(c) {i}</div></body></html>"
    )


def test_wrapper_of_a_host_without_articles(spark):
    bodies = [f"<p>First &lt;para&gt; of {i} with\n  words &eacute;.<p>Second <b>bold</b>{i}<br>line<ul><li>One {i}<li>Two {i}</ul>" for i in range(8)]
    rows = [(i, f"https://User@Site.example/{i}?x", page(i, b), "h") for i, b in enumerate(bodies)]
    rows += [(100, None, page(100, bodies[0]), "h"), (101, "https://site.example/e", "", "h"), (102, "https://site.example/n", None, "h"), (103, "nonsense", "just text", "h"), (104, "https://one.example/", "<p>alone", "h"), (0, rows[0][1], rows[0][2], "h"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = [(r.page_id, r.text) for r in op.main_text(df).collect()]
    assert len(got) == len(rows)
    got = dict(got)
    for i in range(8):
        assert got[i] == f"Head & line {i}\n\nFirst <para> of {i} with words é.\n\nSecond bold{i} line\n\nOne {i}\n\nTwo {i}", got[i]
    assert got[101] == got[102] == got[None] == "" and got[103] == "just text" and got[104] == "alone"
    assert "Head & line 100" in got[100] and "cookies" not in got[100] and "says hi" not in got[100]
    assert op.main_text(df.limit(0)).count() == 0


def test_odd_markup():
    assert op.extract("<article>a<!-- no --> b<script>var x='</p>';</script>c</article>") == "a bc"
    assert op.extract("<article><p title='a>b'>x &nbsp; y</p><nav>menu</nav><table><tr><td>1<td>2<tr><td>3</table></article>") == "x y\n\n1\n\n2\n\n3"
    assert op.extract("<p>" * 3000 + "deep") == "deep" and op.extract("<div>" * 3000 + "deep") == "deep"
    assert op.extract("<main>a < b &amp;&amp; c</main>") == "a < b && c"


def test_matching_is_the_largest():
    a, b = op.parse("<ul><li>1<li><b>2</b><li>3</ul>"), op.parse("<ul><li><b>2</b><li>3</ul>")
    names = sorted(x.name for x, _ in op.matched(a, b))
    assert names == ["#", "#", "b", "li", "li", "root", "ul"]


def stm(a, b):
    """The size of the largest matching, by the textbook recursion."""
    if a.name != b.name:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + stm(x, y))
    return 1 + m[-1][-1]


def test_matching_equals_brute_force(monkeypatch):
    rnd = random.Random(5)

    def tree(depth):
        node = op.Node(rnd.choice("abc"))
        node.name = node.tag
        node.children = [tree(depth - 1) for _ in range(rnd.randint(0, 4))] if depth else []
        return node

    for table in (op.TABLE, 4):
        monkeypatch.setattr(op, "TABLE", table)
        for _ in range(60):
            a, b = tree(3), tree(3)
            b.name = b.tag = a.tag
            pairs = op.matched(a, b)
            assert len(pairs) == stm(a, b) and all(x.name == y.name for x, y in pairs)


def anonymous(i, layout=0):
    """Pages without telling tags or names: template, teaser links and text differ by place alone."""
    text = "".join(f"<div>Line {i} {j} of the story, told at some length for page {i * 7 + j}.</div>" for j in range(4))
    top = "<div class=c1>Welcome to the site that all know</div><div class=c2><a href=/1>Teaser number one</a> <a href=/2>Teaser two</a></div>"
    low = f"<div class=c9>All rights kept by the house since long ago</div><div class=c8>Page made {i} ms</div>"
    if layout:
        return f"<html><body><table><tr><td>{top}<td class=z><div>Same head of the other layout</div>{text}<div>Same end of the other layout</div></table>{low}</body></html>"
    return f"<html><body>{top}<div class=c3><div class=c4>Good morning, dear reader of ours</div>{text}<div>Thank you for your visit here</div></div>{low}</body></html>"


def test_wrappers_decide(spark):
    """Without its wrapper a page keeps template text; two layouts of one host have a wrapper each."""
    rows = [(i, f"http://h.example/{i}", anonymous(i, i % 3 == 0)) for i in range(30)]
    rows += [(1000 + i, "http://h.example/copy", rows[1][2]) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op.main_text(df).collect()}
    assert len(got) == len(rows)
    for i, _, page in rows:
        n = i if i < 1000 else 1
        want = "\n\n".join(f"Line {n} {j} of the story, told at some length for page {n * 7 + j}." for j in range(4))
        assert got[i] == want
        assert op.extract(page) != want and want in op.extract(page)


def test_common_text_stays_unless_nearly_all_pages_have_it(spark):
    rows = [(i, "http://h.example/", anonymous(i).replace("Thank you for your visit here", "A line of many pages" if i < 20 else f"own {i}")) for i in range(30)]
    got = {r.page_id: r.text for r in op.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(("A line of many pages" in got[i]) == (i < 20) for i in range(30))


def test_keys_are_those_of_spark(spark):
    rows = [("", ""), ("/root/a", "text"), ("/é", "x" * 100)]
    got = spark.createDataFrame(rows, "p string, t string").select(F.xxhash64("p", "t").alias("h"), "p", "t").collect()
    assert all(r.h == op.text_key(r.p, r.t) for r in got)


def test_deep_long_and_unclosed_pages(spark):
    deep = [f"<html>{'<div>' * 520}deep {i} words" for i in range(3)]
    long = ["<html><body><div class=x>" + "".join(f"<p>par {i} {j}</p>" for j in range(3000)) + "</div>" for i in range(3)]
    rows = [(i, f"http://{h}.example/{i}", x) for h, pages in (("d", deep), ("l", long), ("u", ["<p>kept <a " + "<a " * 300_000] * 2)) for i, x in enumerate(pages)]
    got = [(r.url, r.text) for r in op.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    got = dict(got)
    assert [got[f"http://d.example/{i}"] for i in range(3)] == [f"deep {i} words" for i in range(3)]
    assert got["http://l.example/2"] == "\n\n".join(f"par 2 {j}" for j in range(3000))
    assert got["http://u.example/1"] == "kept"
