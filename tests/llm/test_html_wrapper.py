import html
import json
import re

import pandas as pd

from skein.llm import html_wrapper as W
from skein.llm.queries import QUERIES

from .helpers import SF01

PAGE = """<html><head><title>t</title></head><body><div class="site-header">Top</div><nav><a href=x>menu</a></nav>
<div class="content"><div class="post"><h2>T &amp; U&nbsp;</h2><p>para <b>one</b>  is
long enough to count<p>two &lt;3 {n}<script>if(a<b)"</p>"</script></div><div class="comments"><p>a comment</p></div></div>
<aside>side</aside><form><p>field</p></form><div id="cookie-notice">we use cookies</div></body></html>"""


def rows(spark, data):
    from pyspark.sql import functions as F

    return spark.createDataFrame(data, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("text", F.lit(1)).withColumn("page", F.lit(2))


def test_pages_of_the_table(spark):
    """On the table's own layout the article element's blocks are the text."""
    pages = pd.read_parquet(f"{SF01}/pages.parquet")
    got = QUERIES["op3_html_wrapper"](spark, SF01).toPandas().set_index("page_id")
    assert len(got) == len(pages)
    for i, page in zip(pages.page_id, pages.html):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        want = [" ".join(html.unescape(x).split()) for x in re.split(r"(?:</?(?:p|b|br|h1)>)+", inner)]
        assert got.text[i] == "\n".join(x for x in want if x)
        assert got.n_chars[i] == len(got.text[i])


def test_furniture_goes(spark):
    data = [(i, f"http://a.example/{i}", PAGE.replace("{n}", str(i))) for i in range(5)]
    got = {r.page_id: r.text for r in W.extract(rows(spark, data)).collect()}
    assert got == {i: f"T & U\npara one is long enough to count\ntwo <3 {i}" for i in range(5)}


def test_awkward(spark):
    data = [(1, None, None), (2, "http://b/", ""), (3, "nonsense", "plain text only"), (3, "nonsense", "plain text only"), (4, "http://b/", "<p>unclosed <b>bold<p>x < y & z</div></p>"), (5, "http://b/", "<<>><!-- open"), (6, "http://b/", "<article>" + "<p>w &#228;</p>" * 3000), (None, "http://b/", "<script>x")]
    got = [(r.page_id, r.text) for r in W.extract(rows(spark, data)).collect()]
    assert len(got) == len(data)
    d = dict(got)
    assert d[1] == d[2] == "" and d[3] == "plain text only" and d[4] == "unclosed bold\nx < y & z" and d[6] == "\n".join(["w ä"] * 3000)
    assert W.extract(rows(spark, [])).count() == 0


def test_wrapper_generalises():
    one = W.parse("<body><h1>a</h1><ul><li>x<li>y</ul><p>t</p></body>")[1]
    two = W.parse("<body><h1>b</h1><div class=z>n</div><p>t</p><p>u</p></body>")[1]
    assert W.expression(W.align(one, two)) == "<body><h1>#TEXT</h1>(<ul>(<li>#TEXT</li>)+</ul>)?(<div[z]>#TEXT</div>)?(<p>#TEXT</p>)+</body>"
    assert W.expression(W.align(json.loads(json.dumps(one)), one)) == W.expression(one)
    assert W.expression(W.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl>")[1]) == "<dl>(<dt>#TEXT</dt><dd>#TEXT</dd>)+</dl>"


def test_wrappers_of_hosts(spark):
    data = [(1, "http://A.example:80/x", "<body><p>one</p>"), (2, "https://a.example/y", "<body><p>x</p><p>y</p>"), (3, "http://b.example", "<main><p>hello</p></main>")]
    got = {r.host: r.wrapper for r in W.infer_wrappers(rows(spark, data)).collect()}
    assert got == {"a.example": "<body>(<p>#TEXT</p>)+</body>", "b.example": "<main><p>#TEXT</p></main>"}


def unmarked(i, notice):
    """No article element and no telling name: what tells is where texts repeat and where they vary."""
    links = "".join(f"<li><a href=/{k}>section {k}</a>" for k in range(8))
    story = "".join(f"<p>Paragraph {k} of story {i} goes on for a while, about {i * 7919 % 1000} things.</p>" for k in range(2 + i % 4))
    more = "<div>Sign here to get our letter.</div>" if notice else ""
    return f"<body><div>The Daily</div><div><ul>{links}</ul></div><div><div><h1>Story {i}</h1>{story}{more}<p>The end of {i}.</p></div><div>All stories by our staff</div></div><div>Some rights kept</div></body>"


def wanted(i):
    return "\n".join([f"Story {i}", *(f"Paragraph {k} of story {i} goes on for a while, about {i * 7919 % 1000} things." for k in range(2 + i % 4)), f"The end of {i}."])


def test_unmarked_pages_and_the_part_of_alignment(spark, monkeypatch):
    data = [(i, f"http://daily.example/{i}", unmarked(i, i % 3 == 0)) for i in range(30)]
    got = {r.page_id: r.text for r in W.extract(rows(spark, data)).collect()}
    assert got == {i: wanted(i) for i in range(30)}
    streams = [(W.bare(W.parse(p)[1]), [(2 * i + 1) * 2**52 // 60]) for i, _, p in data]
    wrapper, pages = W.aligned(streams)
    assert [W.main_text(p, W.decide(wrapper, pages)) for _, _, p in data] == [wanted(i) for i in range(30)]
    monkeypatch.setattr(W, "align", lambda xs, ys: xs)  # without alignment no slot gathers what pages share
    wrapper, pages = W.aligned(streams)
    assert [W.main_text(p, W.decide(wrapper, pages)) for _, _, p in data] != [wanted(i) for i in range(30)]


def test_a_hot_host_is_aligned_in_groups(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 3)
    data = [(i, f"http://daily.example/{i}", unmarked(i, i % 3 == 0).replace("<body>", f"<body><div class=c{'abcdefgh'[i % 8]}></div>")) for i in range(60)]
    got = {r.page_id: r.text for r in W.extract(rows(spark, data).repartition(12)).collect()}
    assert got == {i: wanted(i) for i in range(60)}


def test_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "<p>in the deep</p>" + "</div>" * 5000 + "<p>above, with more words than there are below</p>"
    spans = "".join(f"<div><p>one {k}<ul><li>a {k}<li>b</ul><blockquote>q {k}</blockquote></div>" if k % 2 else f"<p>two {k}<br>three" for k in range(4000))
    data = [(1, "http://deep/", deep), (2, "http://x/", unmarked(1, False)), (3, "http://long/", f"<main>{spans}</main>"), (4, "http://deep2/", "<ul><li>" * 5000 + "x")]
    got = {r.page_id: r.text for r in W.extract(rows(spark, data)).collect()}
    assert got[1] == "in the deep\nabove, with more words than there are below" and "\nStory 1\n" in got[2] and got[4] == "x"
    assert got[3] == "\n".join(f"one {k}\na {k}\nb\nq {k}" if k % 2 else f"two {k}\nthree" for k in range(4000))


def test_names_in_an_article_do_not_hide_text():
    page = "<body><nav>menu</nav><article><h2 id=share-prices>Share prices</h2><p class=banner-year>They rose.</p></article></body>"
    assert W.main_text(page, W.decide(W.parse(page)[1], [1])) == "Share prices\nThey rose."
    form = "<body><form><div><p>All of this page is in a form, as some systems have it.</p></div></form></body>"
    assert W.main_text(form, W.decide(W.parse(form)[1], [1])) == "All of this page is in a form, as some systems have it."


def story(i, inside):
    return f"<body><div class=site-header>The Daily</div><ul><li><a href=/1>one</a><li><a href=/2>two</a></ul><div class=story><h1>Story {i}</h1><p>Paragraph of story {i} goes on for a while, about {i * 7919 % 1000} things.</p>{inside}</div><div>Some rights kept</div></body>"


def told(i, *more):
    return "\n".join([f"Story {i}", f"Paragraph of story {i} goes on for a while, about {i * 7919 % 1000} things.", *more])


def extracted(spark, pages):
    return {r.page_id: r.text for r in W.extract(rows(spark, [(i, f"http://daily.example/{i}", p) for i, p in enumerate(pages)])).collect()}


def test_links_left_open_and_without_href(spark):
    pages = [story(i, "").replace("<h1>", "<a name=top><h1>") for i in range(12)]
    assert extracted(spark, pages) == {i: told(i) for i in range(12)}
    pages = [story(i, "").replace("<h1>", "<h1><a href=x>") for i in range(12)]
    assert extracted(spark, pages) == {i: told(i) for i in range(12)}


def test_recurring_headings_in_an_article(spark):
    inside = lambda i: f"<h2>Summary</h2><p>In short, {i} it was.</p><h2>Further notes</h2><p>Of {i}, no more.</p><h3>More from us</h3><ul><li><a href=/a>this</a></ul>"
    got = extracted(spark, [story(i, inside(i)) for i in range(60)])
    assert got == {i: told(i, "Summary", f"In short, {i} it was.", "Further notes", f"Of {i}, no more.") for i in range(60)}


def test_names_inside_an_article(spark):
    inside = lambda i: f"<div class=section-header><p>Section of {i}, with words.</p></div><div class=social-science><p>Society and {i}.</p></div><div class='comments-area'><p>reader {i} says no</p></div>"
    got = extracted(spark, [story(i, inside(i)) for i in range(60)])
    assert got == {i: told(i, f"Section of {i}, with words.", f"Society and {i}.") for i in range(60)}
    for name, yes in (("site-header", True), ("section-header", False), ("social-science", False), ("share_buttons", True), ("share-prices", False), ("post comment-list", True), ("c-nav", True), ("main-content", False), ("", False)):
        assert W.furniture(name) is yes, name


def test_linked_lists_of_an_article(spark):
    inside = lambda i: "<ul>" + "".join(f"<li><a href=/{i}/{k}>Reference {k} of {i}, a book</a>" for k in range(5)) + "</ul>"
    got = extracted(spark, [story(i, inside(i)) for i in range(30)])
    assert got == {i: told(i, *(f"Reference {k} of {i}, a book" for k in range(5))) for i in range(30)}


def test_alignment_equals_the_plain_one_and_takes_many_siblings():
    import random
    import time

    def plain(xs, ys):
        a, b = xs, ys
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        return best[0][0]

    random.seed(1)
    node = lambda x: [x, 0, 0, [], None]
    for _ in range(300):
        xs, ys = ([random.choice("abcd") for _ in range(random.randint(0, 9))] for _ in range(2))
        pairs = W.matched(list(map(node, xs)), list(map(node, ys)))
        assert [x[0] for x, _ in pairs if x] == xs and [y[0] for _, y in pairs if y] == ys
        assert all(x[0] == y[0] for x, y in pairs if x and y) and sum(1 for x, y in pairs if x and y) == plain(xs, ys)
    xs, ys = ([node(random.choice("abcdefgh")) for _ in range(20000)] for _ in range(2))
    began = time.process_time()
    assert len(W.matched(xs, ys)) < 40000 and time.process_time() - began < 5
