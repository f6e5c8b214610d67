import pytest
from sigloom.llm import html_text as H

LONG = "The council met on Tuesday to discuss the new bridge over the river and its cost to the town."
PAGE = f"""<!DOCTYPE html><html><head><title>Menu words that are no text</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head>
<body class="has-sidebar"><header><h1>Daily News</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Sport and leisure</a></li></ul></nav>
<div class="ad">Buy one get one free today only in our shop</div>
<article><header><h1>New&nbsp;bridge &amp; road</h1></header><p>{LONG} <b>Bo</b>ld.<br>Next line.</p><!-- hidden --><aside>Read also our older story</aside>
<div class='ad-slot banner'>advert advert advert</div><ul><li>First point made in the hall</li><li>Second point</li></ul><p>It ends   here&#33;<form>Your mail <input type="text"></form></p></article>
<section id="comments"><p>I do not agree with any of this, says a reader at length, and goes on for long.</p></section><div class="sidebar"><p>Other stories</p></div><footer>&copy; Us. All rights are kept.</footer></body></html>"""
WANT = f"New bridge & road {LONG} Bold. Next line. First point made in the hall Second point It ends here!"


def test_article_and_unmarked_article():
    assert H.extract(PAGE, H.learn([PAGE] * 3)) == WANT
    assert H.extract(PAGE, H.Weights()) == WANT
    bare = PAGE.replace("<article>", "<div>").replace("</article>", "</div>").replace("<header><h1>New", "<h1>New").replace("road</h1></header>", "road</h1>")
    assert H.extract(bare, H.learn([PAGE] * 3)) == WANT


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("<p>", ""), ("plain text", "plain text"), ("a < b and c", "a < b and c"), ("<p>one two<p>three", "one two three"), ("<script>never ends", ""), ("<p>x &lt;b&gt; &#x41;&bogus; y</p>", "x <b> A&bogus; y"), ("</p></div>text</div>", "text")])
def test_odd_pages(page, want):
    assert H.extract(page, H.Weights()) == want


def test_scan_finds_the_best_stretch():
    import random

    rnd = random.Random(4)
    for _ in range(300):
        parts = [("text", "w " * rnd.randint(1, 4), rnd.random() < 0.3) if rnd.random() < 0.5 else ("tag", rnd.choice(["p", "div", "/article"]), False) for _ in range(12)]
        w = H.Weights({"p": -0.5, "div": -3.0})
        value = [w.of(*p) for p in parts]
        lo, hi = H._scan(parts, w)
        assert sum(value[lo:hi]) == pytest.approx(max(0.0, *(sum(value[i:j]) for i in range(13) for j in range(i, 13))))


def test_query(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 6), (None, "v", "<p>" + "word " * 200_000 + "</p>", 7), (1, "u", PAGE, 5)], "page_id long, url string, html string, n_chars int")
    w = H.fit(df)
    got = H.extracted(df, w).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, len(WANT)), (2, 0), (None, 999_999), (1, len(WANT))]
    assert H.extracted(df.limit(0), H.fit(df.limit(0))).collect() == []


def test_articles_of_the_test_pages(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    truth = {}
    for r in pages.collect():
        s = re.sub(r"</?(p|h1|br)[^>]*>", "\x00", re.search(r"<article>(.*?)</article>", r.html, re.S).group(1))
        truth[r.page_id] = " ".join(w for b in re.sub("</?b>", "", s).split("\x00") if (w := " ".join(html.unescape(b).split())))
    assert {r.page_id: r.text for r in H.extracted(pages, H.fit(pages)).collect()} == truth


STORY = "<p>The whole story is told here, from its first day to its last, with all that was said. </p>" * 4
TEXT = " ".join(["The whole story is told here, from its first day to its last, with all that was said."] * 4)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p>One.</p><div class='share-price'>{STORY}</div><p class='notice-board'>Two.</p></article>", f"One. {TEXT} Two."),
        (f"<body><div class='entry-content ad-free'>{STORY}</div></body>", TEXT),
        (f"<div class='content has-sidebar'><nav>Home</nav>{STORY}<div class='sidebar'>More of it</div></div>", TEXT),
        (f"<div id='page-menu-layout'>{STORY}</div>", TEXT),
        (f"<form id='aspnetForm'><nav>Home</nav><div>{STORY}</div><footer>Us</footer></form>", TEXT),
        (f"<div class='sidebar'><main>{STORY}</main></div>", TEXT),
        (f"<article>{STORY}</article><section id='comments'><article class='comment'>{STORY * 5}</article></section>", TEXT),
        (f"<div>{STORY}</div><aside class='related'><article><p>Another story, a short one</p></article></aside>", TEXT),
        (f"<div>{STORY}</div><form><label>Mail</label><p>Tell us what you think of it</p></form>", TEXT),
        (f"<div>{STORY}<div class='ad-slot-3'>Buy</div><div class='cookieBanner'>We use some</div></div>", TEXT),
        ("<nav>Home</nav><div class='ad'>Buy this</div><footer>Us</footer>", ""),
        (f"<svg><div>{STORY}</div>", TEXT),
        (f"<p title='a > b'>{STORY}</p>", TEXT),
        (f"<p title='never closed>{STORY}", TEXT),
    ],
)
def test_marks(page, want):
    assert H.extract(page, H.Weights()) == want


AD = "<div class='ad'>" + "buy " * 40 + "</div>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<p>Ten words that no element of the page marks at all.</p><form id='aspnetForm'>{STORY}</form>", f"Ten words that no element of the page marks at all. {TEXT}"),
        (f"<p>Ten words that no element of the page marks at all.</p><div class='layout right-sidebar'>{STORY}</div>", f"Ten words that no element of the page marks at all. {TEXT}"),
        (f"<div id='content' class='right-sidebar'>{STORY}</div>", TEXT),
        (f"<div id='page' class='menu-left'>{STORY}</div>", TEXT),
        (f"<div class='post related-post'>{STORY}</div>", TEXT),
        (f"<div class='sidebar-left'>{STORY}</div>", TEXT),
        (f"<article><div class='container comments'>{STORY}</div></article>", TEXT),
        (f"<article><h1>Title of the story</h1><p>A short lead here.</p>{AD}{STORY}</article>", f"Title of the story A short lead here. {TEXT}"),
        (f"<article>{STORY}{AD}<p>A last word on it.</p></article>", f"{TEXT} A last word on it."),
        (f"<body><nav><a href='/'>Home</a> <a href='/s'>Sport</a>{STORY}</body>", TEXT),
        (f"<body><div class='ad'>Buy one now<p>{STORY}</body>", TEXT),
        (f"<article><h1 class='banner'>Big news</h1>{STORY}<p class='copyright'>Told by us.</p></article>", f"Big news {TEXT} Told by us."),
        (f"<article>{STORY}<p class='ad'>Buy it</p><p class='share'>Tell a friend</p></article>", TEXT),
        ("<div class='sidebar'>" + "<a href='/'>one more link to read</a> " * 20 + "</div>", ""),
        (f"<article>{STORY}</article><div class='sidebar'>{'<p>Other news in a few words. </p>' * 60}</div>", TEXT),
        (f"<div>{STORY}</div><div id='comments'>{'<p>I see it in another way. </p>' * 60}</div>", TEXT),
    ],
)
def test_marks_are_weights_on_what_holds_the_story(page, want):
    assert H.extract(page, H.Weights()) == want


def test_class_names_are_learned():
    other = "<div class='ad-leaderboard'>Buy it now, or tomorrow</div>"
    pages = [f"<body>{other}<article><p>{i} {STORY}</p></article></body>" for i in range(6)]
    assert H.extract(f"<div>{STORY}{other}</div>", H.learn(pages)) == TEXT
    assert "Buy" in H.extract(f"<div>{STORY}{other}</div>", H.Weights())


@pytest.mark.parametrize("page", ["<a " * 100_000, "<a \"" * 75_000, "<a b=\">\" " * 60_000, "<" * 300_000, "<div>" * 60_000 + "<header>x</header>" * 5_000, "<svg>" * 60_000, "<!-" * 100_000, "<!--" * 75_000, "</p" * 100_000, "<b></i>" * 40_000, "<p>" * 100_000, "<div class='" + "ad " * 100_000, "&#" * 150_000])
def test_broken_pages_take_linear_time(page):
    import time

    began = time.process_time()
    H.extract(page + " end", H.Weights())
    H.learn([page])
    assert time.process_time() - began < 6


def test_copies_of_a_page_are_sampled_once(spark):
    pages = spark.range(5000).selectExpr("id AS page_id", "'<article><p>a b</p></article><div>x</div>' AS html").unionAll(spark.sql("SELECT -1L, '<article><h1>a</h1><p>b</p></article>'"))
    assert H.fit(pages, most=10_000) == H.learn(["<article><p>a b</p></article><div>x</div>", "<article><h1>a</h1><p>b</p></article>"])
