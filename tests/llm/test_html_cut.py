import itertools
import random

from pyspark.sql import functions as F

from scoreline.llm import html_cut as H

PAGE = """<html><head><title>T</title><meta name=x><script>var t="</p>"</script><style>p{}</style></head><body class="page">
<header class=site><h1>Site name</h1><p>Best site in the world, really.</p></header>
<nav><ul><li><a href=/>Home</a><li><a href=/b>About us and more</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this long notice even longer, please accept them all.</p></div>
<div id="content"><h1>Great headline</h1><p>First <a href=x>paragraph</a> has&nbsp;some <b>words</b> &amp; things, and goes on for a while.</p>
<div class="ad-box"><p>Buy this thing now! It is really good and very cheap today.</p></div><!-- a comment -->
<p>Second paragraph<br>with a break and enough words to count.</p><ul><li>Item one</li><li>Item two</li></ul><p>Short.</p>
<form><label>Email</label><input><button>Go</button></form></div>
<aside><h3>Related</h3><p>Some other story that is rather long and has sentences. It goes on.</p></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I really liked this article, it was very good to read. Thanks!</p></div></section>
<footer><p>Copyright 2020 all rights reserved by the company of the site.</p></footer></body></html>"""
TEXT = "Great headline\nFirst paragraph has some words & things, and goes on for a while.\n" \
       "Second paragraph with a break and enough words to count.\nItem one\nItem two\nShort."


def test_page():
    assert H.main_text(PAGE) == TEXT
    article = "<body><nav>menu</nav><article><header><h1>Head</h1></header><p><b>Bold start.<br><p>Next &lt;one&gt;.<aside>side</aside><p>Last.</article>"
    assert H.main_text(article) == "Head\nBold start.\nNext <one>.\nLast."


LONG = "This sentence is one of many that readers or advertisers write below an article, and it goes on for more than " \
       "seventeen words so that its length alone speaks for it, which must not be enough. "


def test_boilerplate_inside_the_article_stays_boilerplate():
    for open_, close in (("<aside>", "</aside>"), ("<footer>", "</footer>"), ("<form>", "</form>"), ("<nav>", "</nav>"),
                         ("<div class=comments><article class=comment><div class=content>", "</div></article></div>"),
                         ("<section id=comments><div class='entry content'><div class=text>", "</div></div></section>")):
        for outer, end in (("<main><article>", "</article></main>"), ("<div id=content class=content><article>", "</article></div>"),
                           ("<main><article><div class='entry content'><div class=text>", "</div></div></article></main>")):
            page = f"<body>{outer}<h1>Head line</h1><p>First one.</p>{open_}<p>{LONG * 3}</p><p>{LONG}</p>{close}<p>Last one.</p>{end}</body>"
            assert H.main_text(page) == "Head line\nFirst one.\nLast one.", (open_, outer)
    page = f"<form id=page><main><h1>Head line</h1><p>First one.</p><aside><p>{LONG}</p></aside></main></form>"
    assert H.main_text(page) == "Head line\nFirst one."
    assert H.main_text(page.replace("main>", "article>")) == "Head line\nFirst one."
    assert H.main_text(page.replace("<form", "<form hidden")) == ""


def test_classes_that_mention_boilerplate_are_neutral():
    for name in ("content has-sidebar", "no-sidebar", "share-enabled", "with-comments", "content-sidebar-wrap", "sidebar-layout", "hidden-xs",
                 "comments-open", "article-header"):
        page = f"<body><div class='{name}'><h1>Head line</h1><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div></body>"
        assert H.main_text(page) == f"Head line\n{LONG.strip()}", name
    page = f"<body><div class=content><header class=entry-header><h1>Head line</h1></header><p>{LONG}</p></div></body>"
    assert H.main_text(page) == f"Head line\n{LONG.strip()}"
    for name in ("sidebar", "right-sidebar", "main-header", "content-footer", "sidebar-wrapper", "post-comments", "related-content", "hidden",
                 "sponsored post", "has-sidebar sidebar"):
        assert H.main_text(f"<body><article><div class='{name}'><p>{LONG}</p></div></article></body>") == "", name


P1 = "The council met on Tuesday evening to talk about the new bridge, which has been planned for more than ten years now."
P2 = "Most members said that the costs had risen too far, but nobody wanted to give the plan up after so much work."
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>Contact us</a></li></ul>"

#: page forms and their main texts: what stands between [[ and ]]
FORMS = {
    "plain divs": f"<div>{MENU}</div><div>[[<h1>The bridge</h1><p>{P1}</p><ul><li>ten years</li><li>two rivers</li></ul><p>{P2}</p>]]</div>"
                  "<div>Copyright 2021 The Paper. All rights reserved.</div>",
    "table layout": f"<table><tr><td>{MENU}</td><td>[[<h2>The bridge</h2><p>{P1}</p><div>In short</div><p>{P2}</p>]]</td></tr></table>",
    "class legal": f"<div class=legal-news>[[<h1>The bridge</h1><p>{P1}</p><p>Short one</p><p>{P2}</p>]]</div><footer>Imprint</footer>",
    "style alert": f"<div id=content>[[<h1>The bridge</h1><div class=text-alert-blue><p>{P1}</p><p>{P2}</p></div>]]</div>",
    "inline notice": f"<div class=post>[[<p>Good <span class=notice>inline words</span> text. {P1}</p><p>{P2}</p>]]</div>",
    "inline hidden": f"<div>[[<p>{P1}<span hidden> not <b>shown</b></span></p><p>{P2}</p>]]</div>",
    "user reviews": f"<article>[[<h1>The bridge</h1><p>{P1}</p><p>{P2}</p>]]<section class=user-reviews><p>{P2}</p><p>Nice.</p></section></article>",
    "author box": f"<article>[[<h1>The bridge</h1><p>{P1}</p>]]<div class=author-box><p>Jo writes about towns and has been with the paper for years.</p></div></article>",
    "cookie line": f"<div>[[<p>{P1}</p><p>{P2}</p>]]<p>We use cookies to give you the best service on our pages.</p></div>",
    "imprint line": f"<div>[[<p>{P1}</p><p>{P2}</p>]]<p>Copyright 2020 by The Paper. All rights reserved.</p></div>",
    "such a line in an article": f"<article>[[<p>{P1}</p><p>All rights reserved.</p><p>{P2}</p>]]</article>",
    "notice inside": f"<article>[[<h1>The bridge</h1><p>{P1}</p>]]<div class=notice><p>Your browser is out of date, please renew it soon.</p></div>[[<p>{P2}</p>]]</article>",
    "definition list": f"<div>[[<h1>The bridge</h1><p>{P1}</p><dl><dt>Length</dt><dd>two miles</dd><dt>Cost</dt><dd>too much</dd></dl><p>{P2}</p>]]</div>",
    "headings between": f"<div class=wrapper><div>{MENU}</div><div>[[<h2>Then</h2><p>{P1}</p><h2>Now</h2><div>So it goes</div><p>{P2}</p>]]</div></div>",
    "cookie recipes": f"<div class=cookie-recipes>[[<h1>Cookies</h1><p>{P1}</p><ol><li>Flour</li><li>Sugar</li></ol><p>{P2}</p>]]</div>",
}


def form_text(form):
    marked = "\n".join(part.split("]]")[0] for part in form.split("[[")[1:])
    inline = H.re.sub(r"<span hidden>.*?</span>|</?span[^>]*>", "", marked)
    return "\n".join(x for x in H.re.split(r"<[^>]*>|\n", inline) if x.strip())


def test_page_forms_come_through_the_cut():
    overruled = blocks = 0
    for name, form in FORMS.items():
        page = f"<html><body>{form.replace('[[', '').replace(']]', '')}</body></html>"
        assert H.main_text(page) == form_text(form), name
        for text, score, content in H.labelled_blocks(page):
            blocks += 1
            overruled += (score > 0) != content
    assert len(FORMS) >= 10 and overruled / blocks > 0.08, (overruled, blocks)


def test_hidden_inline_text_ends_with_its_block():
    assert H.main_text(f"<article><p>Seen <i style='display: none'>not seen <b>at</b> all</i>again.</p><p>Open <span hidden>gone</p><p>{P1}</p></article>") \
        == f"Seen again.\nOpen\n{P1}"


def test_minimum_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(1, 8)
        s = [rng.uniform(-2, 2) for _ in range(n)]
        e = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i) if rng.random() < 0.4]

        def cost(label):
            return sum(abs(x) for x, y in zip(s, label) if (x > 0) != y) + sum(w for a, b, w in e if label[a] != label[b])
        assert abs(cost(H.minimum_cut(s, e)) - min(map(cost, itertools.product([True, False], repeat=n)))) < 1e-9


def test_odd_pages():
    for html in ("", "   ", "<", "<p", "</p></div>", "<!--", "<script>", "&#0;&#xD800;&bogus;", "<p>" * 2000, "<div>" * 5000 + "x"):
        assert isinstance(H.main_text(html), str)
    assert H.main_text("<article>" + "<p>Some words here.</p>" * 5000 + "</article>").count("\n") == 4999


def test_frame(spark):
    rows = [(1, "u", PAGE), (None, None, None), (3, "", ""), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("id", F.lit(0))
    got = sorted(H.extract_main_text(df).collect(), key=lambda r: (r.page_id or 0))
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(None, None, "", 0), (1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (3, "", "", 0)]
    assert H.extract_main_text(df.limit(0)).count() == 0
