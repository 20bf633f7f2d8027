import re
from html import unescape

from sparkloom.llm import html_extract as h

NAV = '<nav><ul><li><a href="/x">Home</a></ul></nav><div class="ad-box">Buy now</div>'


def text(body, path=None):
    return h.article(f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{NAV}{body}</body></html>", path)


def test_blocks_and_references():
    got = text('<article class="post"><h1>A &amp; B</h1><p><b>one<br>two<p>x &lt;y&gt;&nbsp; z<ul><li>i<li>j</ul><script>"</p>"</script></article><footer>end</footer>')
    assert got == "A & B\n\none two\n\nx <y> z\n\ni\n\nj"


def test_parts_that_are_no_article():
    got = text(
        '<header>Site</header><main><article><header><h1>Title</h1></header><p>Body text here</p><form>mail</form><aside>side</aside></article>'
        '<section id="comments"><p>Nice one</p></section></main><div class="cookie-notice">We use cookies</div><div role="navigation">more</div>'
    )
    assert got == "Title\n\nBody text here"


def test_odd_markup():
    assert h.article(None, None) == h.article("", "x") == ""
    assert h.article("just text", None) == "just text"
    assert text("<p>a<!-- b --><p>c<!-- never closed") == "a\n\nc"
    assert text('<p title="a > b">q</p><p>1 < 2</p>') == "q\n\n1 < 2"
    assert text("<div>" * 3000 + "deep") == "deep"
    assert text("<p>x</div></span></p>y") == "x\n\ny"


def test_hosts_vote(spark):
    good = "<div class='story'><p>" + "word " * 60 + "</p></div>"
    noisy = "<div class='stuff'><p>" + "noise " * 200 + "</p></div>"
    rows = [(k, f"http://Site.example.com:80/{k}", f"<body>{good}</body>", "x") for k in range(9)]
    rows += [(9, "http://u@site.example.com/9", f"<body>{good}{noisy}</body>", "x"), (10, None, "<p>lone</p>", "x"), (11, "no url", None, None), (9, "http://site.example.com/9", "<body><p>other</p></body>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in h.extract(df).collect()]
    story = " ".join(["word"] * 60)
    assert sorted(got) == sorted([(k, story, len(story)) for k in range(10)] + [(10, "lone", 4), (11, "", 0), (9, "other", 5)])
    assert h.extract(df.limit(0)).count() == 0


def test_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in h.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = re.split(r"</?(?:p|h1)>", inner)
        want = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
        assert got[r.page_id] == "\n\n".join(w for w in want if w)


def test_a_mark_does_not_drop_an_article():
    art = "<h1>Title</h1><p>" + "Long words of it. " * 30 + "</p>"
    want = "Title\n\n" + ("Long words of it. " * 30).strip()
    side = '<div class="sidebar"><p>Side matter here</p></div>'
    assert text(f'<div class="wrapper has-sidebar"><div class="post">{art}</div>{side}</div>') == want
    assert text(f'<form id="aspnetForm" action="x"><input type="hidden"><div class="post">{art}</div>{side}</form>') == want
    assert text(f'<div id="page" class="header-fixed">{art}</div><div class="foot">tiny</div>').startswith(want)
    assert text(f'<div class="content no-sidebar">{art}</div><div>tiny</div>').startswith(want)
    assert text(f'<div class="sidebar"><article>{art}</article></div>') == want
    got = text(f'<article>{art}<table class="share-prices"><tr><td>One</td><td>2.5</td></tr></table></article>')
    assert got == want + "\n\nOne\n\n2.5"


def test_what_must_go():
    art = "<h1>Title</h1><p>" + "Long words of it. " * 30 + "</p>"
    want = "Title\n\n" + ("Long words of it. " * 30).strip()
    for junk in (
        '<div class="ad-box"><p>Buy now</p></div>', '<div id="site-footer">c 2020</div>', '<div class="cookie-notice">We use cookies</div>', '<aside>More</aside>',
        '<ul class="comment-list"><li>Nice one</li></ul>', '<div class="share-buttons"><span>Tell all</span></div>', '<div role="search">Find</div>', "<form><label>Mail</label><input></form>",
        '<div id="comments"><p>' + "A reader says much. " * 60 + "</p></div>", "<nav>Home</nav>", "<footer>end</footer>", "<header><h1>Site</h1></header>", '<div class="newsletter-signup">Join</div>',
    ):
        assert text(f'<div class="post">{art}</div>{junk}') == want, junk
        assert text(f'{junk}<main><div class="post">{art}</div></main>') == want, junk


def test_hosts_with_wrappers(spark):
    body = "<p>" + "word " * 80 + "</p>"
    rows = []
    for host, wrap in (("a.com", '<div class="wrapper has-sidebar">{}</div>'), ("b.com", '<form id="f">{}</form>'), ("c.com", '<div class="no-sidebar">{}</div>')):
        page = wrap.format(f'<div class="story"><h1>T</h1>{body}</div><div class="sidebar"><p>aside text</p></div>')
        rows += [(len(rows), f"http://{host}/{k}", page) for k in range(3)]
    got = {r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"T\n\n" + ("word " * 80).strip()}


def test_a_long_page():
    page = "<article>" + "<p>para &amp; more</p>" * 40_000 + "</article>"
    assert len(h.article(page, None).split("\n\n")) == 40_000


STORY = "".join(f"<p>Paragraph {{0}} number {k} tells about {{0}} things at some length, as stories do.</p>" for k in range(5))
WANT = "\n\n".join(f"Paragraph {{0}} number {k} tells about {{0}} things at some length, as stories do." for k in range(5))


def of_host(spark, template, n=20, want=WANT):
    """Texts of n pages of a host made from a template, and what they should be."""
    rows = [(k, f"http://h.org/{k}", template.replace("STORY", STORY.format(f"w{k}"))) for k in range(n)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[k] for k in range(n)], [want.replace("STORY", WANT).format(f"w{k}") for k in range(n)]


PARTS = "reader-comments user-comments discussion cookie-policy legal-notice promo-strip advertorial most-read share-tools trending feedback copyright user-reviews subscribe-cta".split()


def test_recurring_parts_go_whatever_their_class(spark):
    for body in (
        '<div class="top"><p>The Daily Site of news</p></div><div class="story">STORY</div><div class="bottom"><p>All rights with the owner 2020</p></div>',
        '<div class="x1">The Daily Site of news</div><article>STORY<div class="x2"><p>Read us every day, on paper too</p></div></article>',
        '<div><p>The Daily Site</p>STORY<p>All rights with the owner</p></div>',
        '<p>The Daily Site</p>STORY<p>All rights with the owner</p>',
    ):
        got, want = of_host(spark, f"<body>{body}</body>")
        assert got == want, body


def test_copies_and_near_copies_lose_nothing(spark):
    near = [(k, "http://c.org/", f'<body><div class="a">Site</div><div class="story">{STORY.format("same")}<p>Only line {k}</p></div></body>') for k in range(12)]
    same = [(k, "http://d.org/", f'<body><div class="story">{STORY.format("same")}</div></body>') for k in range(12, 24)]
    adverts = [(k, "http://e.org/", f'<body><div class="box">Offer {k}</div><div class="story">{STORY.format("same")}</div></body>') for k in range(24, 34)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(near + same + adverts, "page_id long, url string, html string")).collect()}
    text = WANT.format("same")
    assert all(got[k] == f"{text}\n\nOnly line {k}" for k in range(12))
    assert all(got[k] == text for k in range(12, 24)) and all(got[k].endswith(text) for k in range(24, 34))


def test_marked_parts_beside_and_inside():
    story, want = STORY.format("w"), WANT.format("w")
    for name in PARTS:
        junk = f'<div class="{name}"><p>Something that is said here by others</p></div>'
        assert text(f'<div class="story">{story}</div>{junk}') == want, name
        assert text(f"<article>{story}{junk}</article>") == want, name


def test_comments_do_not_rescue_themselves():
    story, want = STORY.format("w"), WANT.format("w")
    many = "".join(f'<article class="comment"><p>Reader {k} says quite a lot about this and that, again and again.</p></article>' for k in range(60))
    plain = many.replace(' class="comment"', "")
    assert text(f'<div class="story">{story}</div><section id="comments">{many}</section>') == want
    assert text(f'<div class="story">{story}</div><section id="comments">{plain}</section>') == want
    assert text(f'<main>{story}</main><section class="responses">{plain}</section>') == want
    assert text(f'<main><div class="story">{story}</div></main><section class="voices">{plain.replace("article", "div")}</section>') == want
    listed = "".join(f'<li class="comment"><article><p>Reader {k} says a lot.</p></article></li>' for k in range(60))
    assert text(f'<div class="story">{story}</div><ol>{listed}</ol>') == want


def test_headline_beside_the_text():
    story, want = STORY.format("w"), WANT.format("w")
    head = '<header class="entry-header"><h1>Big title</h1></header>'
    assert text(f'<div class="page">{head}<div class="entry">{story}</div></div>') == f"Big title\n\n{want}"
    assert text(f'<div class="page">{head}<article>{story}</article></div>') == f"Big title\n\n{want}"
    assert text(f'<div class="page">{head}<main>{story}</main></div>') == f"Big title\n\n{want}"
    assert text(f'<header><h1>Site</h1></header><article><h1>Big title</h1>{story}</article>') == f"Big title\n\n{want}"
    got = h.article(f'<body><div class="page"><h1>Big title</h1><div class="entry">{story}</div></div></body>', ">body>div.page>div.entry")
    assert got == f"Big title\n\n{want}"


def test_link_lists_go():
    story, want = STORY.format("w"), WANT.format("w")
    links = '<div class="z"><a href="/a">One page</a> <a href="/b">Other page</a></div>'
    assert text(f'{links}<div class="story">{story}</div>{links}') == want
    assert text(links) == "One page Other page"
