import html
import random
import re
import time

import pytest
from citemill.llm import main_text as T


def test_best_equals_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        scores = [rng.choice([-2, -1, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        sums = [(sum(scores[a : b + 1]), -a, b) for a in range(len(scores)) for b in range(a, len(scores)) if scores[a] > 0 and scores[b] > 0]
        first, last = T.best(scores)
        most = max((s[0] for s in sums), default=0)
        assert (sum(scores[first : last + 1]) if last >= first else 0) == max(most, 0)


PLAIN = {}
ARTICLE = "First part of the text.\nSecond & last <part> of it, a little longer than the first."
BODY = "<p>First  part\n of the <i>te</i>xt.<p>Second &amp; last &lt;part&gt; of&nbsp;it, a little longer<br>than the first."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><article>{BODY}</article><footer>Ours &copy;</footer></body></html>",
        f'<body class="has-sidebar"><div id="menu"><ul><li><a href="/">Home page<li><a>News</ul></div><div class="post-body">{BODY}</div><div class="widget sidebar">Read more of our texts today</div><div id="comments"><p>A comment by a reader of it</div>',
        f"<main><header class=top>Site name</header>{BODY}<aside>See also our other long articles of this kind</aside></main><form>Sign in <input name=q></form>",
        f'<form id="all"><div class=cookieBanner>We use cookies, and a lot of them</div><article>{BODY}<section class="comment-list"><article class="comment">Good text, well written indeed</article></section></article></form>',
        f'<div role="banner">Name of the site</div><section>{BODY}</section><div style="display: none">hidden words of the page</div><div hidden>more of them</div>',
        f"<!-- <p>no --><article>{BODY}</article><!-- never closed <p>words",
        f'<article data-x="a > b">{BODY}<div class="ad">Buy this</div></article><p class="notice">All rights are reserved by them</p>',
        f'<div class="page with-sidebar"><h1 class="page-header">First part of the text.</h1><p>{BODY.partition("<p>Second")[1][3:]}{BODY.partition("<p>Second")[2]}</div><div class="comments"><p>A very long comment by a reader of it, who says a lot more than the article does</p></div>',
        f"<ARTICLE>{BODY}</ARTICLE><noscript>turn it on please</noscript><style>p{{}}</style>",
    ],
)
def test_pages_of_many_kinds(page):
    assert T.extract(page, PLAIN) == ARTICLE


def test_odd_pages():
    assert T.extract(None, PLAIN) == T.extract("", PLAIN) == T.extract("<p> \n</p>", PLAIN) == ""
    assert T.extract("just a text, 1 < 2 & 3 > 2 </", PLAIN).startswith("just a text, 1 < 2 & 3 > 2")
    assert T.extract("<article><header><h1>Title of it</h1><p>by someone</p></header><p>The text itself.</article>", PLAIN) == "Title of it\nThe text itself."
    assert T.extract('<p class="a>x</p><p>some words of text</p>', PLAIN).endswith("some words of text")
    assert T.extract("<table><tr><td>a cell<td>another cell</table>", PLAIN) == "a cell\nanother cell"
    began = time.time()
    for piece in ("<p>word ", "<a '", '<a \'">', "<", "<b", "</", "<!--", "<div><script>", "&", "<p class='ad'>"):
        T.extract(piece * (300_000 // len(piece)), PLAIN)
    assert time.time() - began < 30


def article_of(page):
    """The article of a page of the test tables, which all have the same few tags."""
    article = re.search("<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?p>|<br>|</?h1>", article))
    return "\n".join(b for b in blocks if b)


def test_query_gives_every_article_of_the_sample(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    found = {r.page_id: r for r in T.op12_main_text(spark, sf_dir).collect()}
    assert len(found) == len(pages)
    for page in pages:
        want = article_of(page.html)
        assert found[page.page_id].text == want and found[page.page_id].n_chars == len(want) and found[page.page_id].url == page.url


def test_operator_on_odd_rows(spark):
    rows = [(1, "u", None, 1), (None, None, f"<article>{BODY}</article>", 1), (2, "u", f"<article>{BODY}</article>", 1), (2, "u", f"<article>{BODY}</article>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    weights = T.fit(pages)
    assert weights["word p"] > 1 and weights["tag article"] < weights["tag p"] < 0
    assert weights == T.fit(pages.union(pages)) and T.fit(pages.limit(0)) == {} and T.fit(pages, sample=1) == weights
    found = sorted(((r.page_id or 0, r.text) for r in T.main_text(pages, weights).collect()))
    assert found == [(0, ARTICLE), (1, ""), (2, ARTICLE), (2, ARTICLE)]
    assert T.main_text(pages.limit(0), {}).count() == 0


def test_held_out_pages(spark):
    """Weights of one half of the pages find the articles of the other half."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = T.fit(pages.where("page_id % 2 = 0"), sample=50)
    assert all(T.extract(r.html, weights) == article_of(r.html) for r in pages.where("page_id % 2 = 1").collect())
