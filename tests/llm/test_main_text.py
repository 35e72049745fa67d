import re
from html import unescape

from paddock.llm.main_text import Page, RegionModel, extract, learn_weights

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1><p>Welcome to our site of words</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to make words.</p></div><div class="content-sidebar-wrap">%s
<h1>Real   title</h1><p>First &amp; second para with <a href=x>link words</a> inside.<br>After the break.</p>
<script>var t = "</p><p>no</p>";</script><aside><p>side words here</p></aside><ul><li>item one<li>item two</ul>
<form><p>Your name</p><input></form><p>Last&nbsp;para
 of  text &lt;b&gt;.</p>%s<div class="sidebar"><p>more side text that is long enough to matter for a scan</p></div></div>
<section id="comments"><article class="comment"><p>Nice post, thank you very much for it!</p></article></section>
<footer><p>&copy; foot</p></footer></body></html>"""
TEXT = ("Real title\nFirst & second para with link words inside.\nAfter the break.\nitem one\nitem two\n"
        "Last para of text <b>.")
SCHEMA = "page_id long, url string, html string, text string, id string"


def truth(html):
    inside = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inside))
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    out = extract(pages).collect()
    assert len(out) == len(html)
    for r in out:
        assert r.text == truth(html[r.page_id]) and r.n_chars == len(r.text)


def test_marked_and_unmarked_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = learn_weights(pages.selectExpr("page_id AS id", "html"), RegionModel())
    for opened, closed in (("<main>", "</main>"), ("<article>", "</article>"), ('<div class="post">', "</div>")):
        assert Page(PAGE % (opened, closed)).text(weights, RegionModel()) == TEXT


def test_odd_pages(spark):
    given = [None, "", "plain text", "<p", "<p>a", "a < b", "<p>x</p><!-- c", "<script>var", "<br><br>",
             "<p class='a>b' title=\"x>y\">q</p>", "<p>" + "word " * 50000 + "</p>", "<div " + "a" * 50000, "<p>&amp;&#233;&#x41;"]
    want = ["", "", "plain text", None, "a", "a < b", "x", "", "", "q", ("word " * 50000).strip(), "", "&éA"]
    rows = [(i, None, h, "t", "i") for i, h in enumerate(given)] + [(4, "u", "<p>a", "t", "i")]
    out = extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    for r in out:
        if want[r.page_id] is not None:
            assert r.text == want[r.page_id], r.page_id
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0


def unmarked(html):
    return re.sub(r"<(/?)article>", r"<\1div>", html)


def test_marks_are_no_feature(spark):
    """The scan alone finds the article: the same pages without their marks give the same text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    weights = learn_weights(pages.selectExpr("page_id AS id", "html"), RegionModel())
    assert not any("article" in f for f in weights if not f.startswith("t:"))
    weights = {f: w for f, w in weights.items() if f != "t:article"}
    wrong = [i for i, h in html.items() if Page(unmarked(h)).text(weights, RegionModel()) != truth(h)]
    assert len(wrong) <= 0.02 * len(html), len(wrong)


PARAGRAPHS = "".join(f"<p>Sentence number {i} of an article that has a few words to say.</p>" for i in range(6))
ARTICLE = "\n".join(f"Sentence number {i} of an article that has a few words to say." for i in range(6))
LINKS = "".join(f'<a href="/{i}">Other story {i}</a> ' for i in range(5))


def page_of(body):
    return f"<html><body><nav><a href=/>Home</a></nav>{body}<footer>&copy; foot</footer></body></html>"


def test_class_words_do_not_decide_alone(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights, model = learn_weights(pages.selectExpr("page_id AS id", "html"), RegionModel()), RegionModel()

    def text(body):
        return Page(page_of(body)).text(weights, model)

    assert text(f"<div class='promo-story'>{PARAGRAPHS}</div>") == ARTICLE
    assert text(f"<div class='comment-open'>{PARAGRAPHS}</div>") == ARTICLE
    assert text(f"<div>{PARAGRAPHS}</div><div class=links>{LINKS}</div>") == ARTICLE
    assert text(f"<div class=links><ul>{LINKS.replace('<a', '<li><a')}</ul></div><div>{PARAGRAPHS}</div>") == ARTICLE
    assert text(f"<h1><a href=/s>The story</a></h1><div>{PARAGRAPHS}</div>") == "The story\n" + ARTICLE
    for name in ("user_feedback", "comments"):  # also where readers write more than the author
        assert text(f"<div>{PARAGRAPHS}</div><div class='{name}'>{PARAGRAPHS * 3}</div>") == ARTICLE
        assert text(f"<article>{PARAGRAPHS}</article><div class='{name}'>{PARAGRAPHS * 30}</div>") == ARTICLE
    half = PARAGRAPHS.index("<p>Sentence number 3")
    for cut in ("<ins class='adsbygoogle'>Buy this now</ins>", "<div class=sidebar><p>On the side of it</p></div>"):
        for opened, closed in (("<article>", "</article>"), ("<div>", "</div>")):
            assert text(opened + PARAGRAPHS[:half] + cut + PARAGRAPHS[half:] + closed) == ARTICLE
    nested = f"<div class='promo-story'>{PARAGRAPHS}<div class='sidebar'><p>On the side</p></div></div>"
    assert text(nested) == ARTICLE
