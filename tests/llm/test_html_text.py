import html
import re

from common_cases import ROWS, awkward, empty, files_of

from quiremill.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, many cookies indeed, and more words to be long enough.</p></div>
%s<aside><p>Side text that nobody wants to read at all in here.</p></aside>
<div id="comments"><p>I disagree with this article very strongly, says a reader.</p></div>
<form><label>Your mail</label><textarea>x</textarea><button>Send</button></form><footer>&copy; Us</footer></body></html>"""
BODY = ("<h2>Head &amp; line</h2><p>First   paragraph\n with <b>bold</b> text and a <a href=x>link</a>.<p>Short.<ul><li>one</li><li>two &lt;3</li></ul>"
        "<p>Last paragraph of the article, long enough to count as content, surely.</p>")
TEXT = ("Head & line\nFirst paragraph with bold text and a link.\nShort.\none\ntwo <3\n"
        "Last paragraph of the article, long enough to count as content, surely.")


def test_article():
    assert H.extract(PAGE % f"<article>{BODY}</article>") == TEXT


def test_without_an_article_element():
    assert H.extract(PAGE % f'<div class="post">{BODY}</div>') == TEXT


def test_reader_comments_inside_the_article():
    inside = '<section class="comments"><article class="comment"><p>First! A comment of some words here.</p></article></section>'
    assert H.extract(PAGE % f"<article>{BODY}{inside}</article>") == TEXT


def test_broken_markup():
    assert H.extract("<p>one<b>two<p>three</i></div><p>four &amp five &#x41; &nosuch; <") == "onetwo\nthree\nfour & five A &nosuch; <"
    assert H.extract("plain text") == "plain text" and H.extract("<nav>only a menu</nav>") == "" and H.extract("<p>cut off <a hre") == "cut off"


def test_smoothing_keeps_the_mean():
    assert all(abs(v - 3) < 1e-9 for v in H.smoothed([3.0] * 9, 1.0)) and len(H.smoothed([1.0], 2.0)) == 1


def test_whole_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("page_id file_id", "url name", "html content")
    page = {r.file_id: r.content for r in pages.collect()}
    for r in H.main_text(pages).collect():
        article = page[r.file_id].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?p>|</?h1>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_awkward_files(spark):
    files = files_of(awkward(spark))
    got = sorted((r.file_id or 0, len(r.text)) for r in H.main_text(files).collect())
    assert got == sorted((i or 0, len(re.sub(r"\s+", " ", t or "").strip())) for i, t in ROWS)
    as_bytes = H.main_text(files.withColumn("content", files["content"].cast("binary"))).collect()
    assert sorted((r.file_id or 0, len(r.text)) for r in as_bytes) == got
    assert H.main_text(files_of(empty(spark))).count() == 0


def test_names_of_wrappers_do_not_drop_the_page():
    for name in ("has-sidebar", "content with-sidebar", "no-comments", "search-results", "sticky-header site", "comments-enabled", "sidebar"):
        for inner in (f"<article>{BODY}</article>", f"<main>{BODY}</main>", f'<div class="post">{BODY}</div>'):
            assert H.extract(f'<html><body><div class="{name}">{inner}<div class="cookie-notice"><p>We use cookies.</p></div></div></body></html>') == TEXT
    for name in ("has-sidebar", "search-results", "sticky-header site"):
        assert H.extract(PAGE % f'<div class="{name}"><div>{BODY * 4}</div></div>') == "\n".join([TEXT] * 4)
    assert H.extract(f"<form>{PAGE % f'<article>{BODY * 2}</article>'}</form>") == "\n".join([TEXT] * 2)
    assert H.extract(f"<body><form><div>{BODY}</div><input><button>Go</button></form></body>") == TEXT


def test_long_comments_and_sidebars_stay_out():
    long = "<p>Words of somebody else that go on and on, longer than the post itself.</p>" * 20
    for name in ("comments", "comments-area", "sidebar", "related-posts"):
        assert H.extract(f'<body><div class="post">{BODY}</div><div class="{name}">{long}</div></body>') == TEXT


BLOG = """<body><div><a href=/>Home</a> <a href=/n>News</a></div><div><a href=1>One</a><br><a href=2>Two</a></div><div>%s</div>
<div>Short line</div><div><a href=3>Imprint</a></div><div><a href=4>Terms</a></div></body>"""


def test_the_clusters_choose_where_no_element_tells(monkeypatch):
    """A page of plain divisions: the ratios find the text; with equal ratios the whole page would be returned."""
    long = "<p>A paragraph of the text that goes on for long enough to stand out among the lines of the page.</p>" * 6
    want = "\n".join(["A paragraph of the text that goes on for long enough to stand out among the lines of the page."] * 6)
    assert H.extract(BLOG % long) == want
    monkeypatch.setattr(H, "smoothed", lambda ratios, sigma: [1.0] * len(ratios))
    assert H.extract(BLOG % long) != want
    monkeypatch.undo()
    real = H.smoothed
    monkeypatch.setattr(H, "smoothed", lambda ratios, sigma: [max(ratios) - r for r in real(ratios, sigma)])
    assert H.extract(BLOG % long) != want


def test_names_inside_the_article_drop_none_of_its_text():
    keep = ['<h1 id="search">Search</h1>', '<h2 id="related-work">Related work</h2>', '<section id="side-effects"><p>Short.</p></section>',
            '<section id="related-work"><h2>Related work</h2><p>Others did the same.</p></section>',
            '<table class="pop-density"><tr><td>one</td></tr></table>', "<p>Let <math><mi>x</mi></math> be <label>labelled</label>, <object>or so</object>.</p>",
            '<blockquote class="notice">Quoted</blockquote>', '<figure class="side"><figcaption>Caption</figcaption></figure>']
    for k in keep:
        text = [x for x in re.sub(r"\s+", " ", re.sub(r"</?(?:h1|h2|p|tr|td|table|section|blockquote|figure|figcaption)[^>]*>", "\x00", k)).split("\x00")]
        text = "\n".join(t for t in (re.sub(r"<[^>]*>", "", x).strip() for x in text) if t)
        assert H.extract(PAGE % f"<article>{BODY}{k}</article>") == f"{TEXT}\n{text}", k
    drop = ['<div class="ad">Buy this</div>', '<div class="ad-slot"><p>Buy now</p></div>', '<div id="comments"><p>First!</p></div>', '<aside>Aside</aside>',
            '<div class="newsletter-signup">Mail</div>', '<div class="share-buttons"><a>X</a></div>', '<section class="related-posts"><a>More</a></section>',
            '<form><label>Name</label><input></form>', '<div class="cookie-notice">Cookies</div>', '<section id="comments"><p>Me too</p></section>']
    for k in drop:
        assert H.extract(PAGE % f"<article>{BODY}{k}</article>") == TEXT, k


def test_a_partial_name_marks_what_the_clusters_leave_out():
    prose = "<p>Words of the article in a division with an unlucky name, as long as every other paragraph that it has.</p>" * 3
    got = H.extract(PAGE % f'<article>{BODY}<div class="side-effects">{prose}</div><div class="post-footer">Posted <a>here</a></div></article>')
    assert got.count("unlucky name") == 3 and "Posted" not in got


def test_deep_pages_take_linear_time():
    import time
    for page in ("<div>x " * 50_000, '<div class="side-a">x ' * 50_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "x", "<div>" * 50_000 + "</section>" * 50_000 + "x",
                 "<article>" * 50_000 + "x", "<p>x" * 50_000):
        began = time.time()
        assert H.extract(page).count("x") >= 1
        assert time.time() - began < 5


def test_query(spark):
    from quiremill.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    page = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = QUERIES["op3_html_text"](spark, folder).collect()
    assert sorted(r.page_id for r in got) == sorted(page)
    for r in got:
        article = page[r.page_id].html.split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?p>|</?h1>", article)]
        assert r.url == page[r.page_id].url and r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
