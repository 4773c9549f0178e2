from lattica.llm import html

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class="post-%d"><h1>Title &amp; more</h1><p>First   paragraph, with\n text.</p><aside>Side bar.</aside>
<p>Second <b>bold</b> one.<form><input>Subscribe now.</form><div class="comments"><p>Nice, very nice, indeed!</p></div><p>Third&nbsp;&#233;.</div>
<div class=ad>Buy this, now!</div><footer>&copy; host, all rights.</footer></body></html>"""
WANT = "Title & more\nFirst paragraph, with text.\nSecond bold one.\nThird é."


def test_extracts_the_article_only(spark):
    rows = [(k, f"http://Host.example/{k}", PAGE % k) for k in range(5)] + [(10, None, None), (11, "x", ""), (12, "http://a/", "plain &lt;text&gt;"), (13, "http://b/", "<p>unclosed <a href='x"), (14, "http://c/", "<script>never closed")]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, path int, host int")
    got = {r.page_id: (r.text, r.n_chars) for r in html.main_text(pages).collect()}
    assert all(got[k] == (WANT, len(WANT)) for k in range(5))
    assert got[10] == got[11] == got[14] == ("", 0) and got[12][0] == "plain <text>" and got[13][0] == "unclosed"
    assert html.main_text(pages.where("false")).count() == 0


def test_hosts_vote(spark):
    """A page whose own best container is another one is extracted by its host's winning path."""
    body = "<body><div class=main>{}</div><div class=box>{}</div></body>"
    long, short = "<p>Long text, of many words. It goes on, and on, for a while.</p>", "<p>Short, text.</p>"
    rows = [(k, "http://h/x", body.format(long, short)) for k in range(4)] + [(9, "http://h/y", body.format(short, long))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r.path for r in html.host_paths(pages).collect()] == [">body>div.main"]
    assert {r.text for r in html.main_text(pages).where("page_id = 9").collect()} == {"Short, text."}


def test_real_pages_keep_their_articles(spark):
    """In the generated pages all of the article is main text, and nothing outside it is."""
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [" ".join(unescape(re.sub(r"</?(?!p|br|h1|h2)[a-z][^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|br|h1|h2)\b[^>]*>", inner)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b), r.page_id


LONG = "<p>Long text, of many words. It goes on, and on, for a while, until it ends.</p>"
BODY = "Long text, of many words. It goes on, and on, for a while, until it ends."


def text_of(page):
    return html.extract(page, html.vote(page)[0] or None)


def test_class_of_the_whole_page_says_nothing():
    for page in (
        f'<body class="single with-sidebar"><article>{LONG}</article></body>',
        f'<div class="post comments-open">{LONG}</div>',
        f'<html class="no-sidebar header-fixed"><body id="search"><main class="content">{LONG}</main>',
        f'<div id="page" class="sidebar-right-layout"><div class="main">{LONG}</div></div>',
        f'<div class="side-effects">{LONG}</div>',
        f'<div class="header">{LONG}{LONG}</div>',  # named so, but most of the page
    ):
        assert set(text_of(page).split("\n")) == {BODY}, page


def test_boilerplate_of_any_element_goes():
    for noise in (
        '<p class="advert">Buy this, now.</p>',
        '<p class="cookie-notice">We use cookies, as you know.',
        '<p class="comment">Nice, very nice.</p>',
        '<ul><li class="ad">Buy, now.<li class="comment-item">Nice, indeed.</ul>',
        '<h2 id="sponsored">Sponsored, by us.</h2>',
        '<article class="comment"><p>Reader, writes. A lot, of it.</p></article>',
        '<div class="commentList"><p>Reader, writes. Much, more, than, the, article. And more, and more, and more.</p></div>',
        '<span class="ad-slot">Buy, now.</span>',
        '<div role="navigation">Home, away.</div>',
        '<section id="related-posts"><p>Other, things.</p></section>',
    ):
        page = f"<body><div class=post>{LONG}{noise}{LONG}</div></body>"
        assert text_of(page) == BODY + "\n" + BODY, noise


def test_attributes_as_the_standard_reads_them():
    for tag in ("<p data-x=it's>", '<p title="a > b" x=\'"\'>', '<p a="b"c=d/>', "<p =x 'y \"z>", "<p class=a/b/>", "<p\n\thidden>", "<P CLASS=X>"):
        assert text_of(f"<body><div>{tag}One &lt;two&gt;, three.</p>{LONG}</div>") == "One <two>, three.\n" + BODY, tag
    assert text_of("<div/>One, two.</div>") == "One, two."
    assert text_of("<p>a<!-->b<!-- c --!>d</ x>e<!doctype z>f</p>") == "abdef"
    assert text_of("<p>1 < 2 and <3</p>") == "1 < 2 and <3"


def test_deep_and_long_pages_take_linear_time():
    import time

    def seconds(n):
        page = "<div class=a1>" * n + LONG + "</div>" * n + "<td>x" * n + "</b>" * n + "<p class=x title='" * 50
        began = time.perf_counter()
        path, _ = html.vote(page)
        assert html.extract(page, path).startswith(BODY)
        return time.perf_counter() - began

    seconds(1000)
    few, many = seconds(4000), seconds(16000)
    assert many < 12 * few + 0.5, (few, many)


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "http://h/x", f"<article>{LONG}</article>")] * 3 + [(2, None, f"<article>{LONG}</article>"), (None, "http://h/y", LONG)]
    pages = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "page_id long, url string, html string, path int, host int, text int, votes int")
    assert [r.text for r in html.main_text(pages).collect()] == [BODY] * 5


def test_forms_that_hold_the_page_and_those_beside_it():
    assert text_of(f"<body><form id=aspnetForm><nav><a href=/>Home</a></nav><div><label>Search</label><input><p>Two, words.</p>{LONG}</div></form></body>") == "Two, words.\n" + BODY
    assert text_of(f"<body><div>{LONG}{LONG}<form><p>Leave your name, please.</p><label>Name</label><select><option>One<option>Two</select></form></div></body>") == BODY + "\n" + BODY
    assert text_of(f"<body><form class=comment-form><p>Write.</p>{LONG}</form><div>{LONG}</div></body>") == BODY


def test_controls_inside_a_sentence_keep_its_words():
    assert text_of(f"<div><p>Press the <button type=button>Save</button> key, or <label for=x>this <b>box</b></label>.</p>{LONG}</div>") == "Press the Save key, or this box.\n" + BODY
    assert text_of(f"<div><p>Read, please. <button>Share</button></p><div><button>Like</button> <label>Mail</label></div>{LONG}</div>") == "Read, please.\n" + BODY
    assert text_of(f"<div><p>One, <button>never closed</p><p>Two, three.</p>{LONG}</div>") == "One,\nTwo, three.\n" + BODY


def test_certain_words_behind_any_prefix():
    for name in ("wp-comment", "fb-comments", "blog-comment", "c-ad__x", "google-ads", "adbox", "responses"):
        for tag in ("div", "section", "p"):
            noise = f"<{tag} class='{name}'>Nice, very nice, indeed.</{tag}>"
            assert text_of(f"<body><div class=post>{LONG}{noise}{LONG}</div></body>") == BODY + "\n" + BODY, noise
    for name in ("no-ads", "has-comments", "with-fb-comments", "comments-open", "commentary", "adobe"):
        assert text_of(f"<body><div class='{name}'>{LONG}</div></body>") == BODY, name


def test_a_page_larger_than_a_batch(spark):
    many = 60_000  # some 5 MB
    pages = spark.createDataFrame([(1, "http://h/1", f"<article>{LONG * many}</article>"), (2, "http://h/2", f"<article>{LONG}</article>")], "page_id long, url string, html string")
    assert {r.page_id: r.n_chars for r in html.main_text(pages).collect()} == {1: many * (len(BODY) + 1) - 1, 2: len(BODY)}
