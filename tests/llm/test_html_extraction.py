"""Main text: planted pages, whatever goes around them, and odd rows."""

import html
import re

import pytest

from tessera.llm import wrappers

SCHEMA = "page_id long, url string, html string, text string, host string"


def texts(spark, pages, url="http://h.example/"):
    rows = [(k, f"{url}{k}", p, "clash", "clash") for k, p in enumerate(pages)]
    return [r["text"] for r in wrappers.extract_pages(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()]


def reference(page):
    body = re.search(r"<article>(.*?)(</article>|<footer>|$)", page, re.S)[1].replace("<br>", " ")
    parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(p for p in parts if p)


def test_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.extract_pages(pages).collect()}
    want = {r.page_id: reference(r.html) for r in pages.collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_what_goes_around(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h2>Site</h2></header><div class="main-menu"><p>menu</p></div>
      <div id=sidebar><p>side</p></div><div role="alert"><p>alert</p></div><main><article><h1>A &lt; B &amp;amp; &#233;</h1><p>One
      <b>two</b>\t<a href="/x">three</a><!-- no --></p><div class="advert-box">Buy</div><form><p>mail</p></form><ul><li>a<li>b</ul>
      <p>Four<p>Five<script>var x = "</p>";</script> six<div class="comments"><article class="comment"><p>nice</p></article></div>
      <p hidden>not seen</p></article></main><aside>rel</aside><p class="cookie-notice">We use</p><footer>f</footer></body></html>"""
    assert texts(spark, [page]) == ["A < B &amp; é\n\nOne two three\n\na\n\nb\n\nFour\n\nFive six"]


def test_unnamed_groups_by_their_text(spark):
    page = '<body><div class="x1"><a href=/>Home</a> <a href=/n>News</a></div><div class="x2"><h1>Title {k}</h1><p>Some long text of page {k}, with words.</p>{more}</div><div class="x3"><a>rel</a></div></body>'
    made = [page.format(k=k, more="<p>And more of it.</p>" * (k % 3)) for k in range(5)]
    got = texts(spark, made)
    assert got[0] == "Title 0\n\nSome long text of page 0, with words."
    assert got[2].count("And more of it.") == 2 and "Home" not in "".join(got) and "rel" not in "".join(got)


def test_wrapper_is_a_union_free_expression():
    pages = ["<body><ul><li>a<li>b</ul><p>x</p></body>", "<body><ul><li>a</ul><h2>t</h2><p>x</p><p>y</p></body>"]
    made = [wrappers.folded(wrappers.blocks(p)[0]) for p in pages]
    assert wrappers.merge(*made).expression() == "<html><body><ul>(<li>#</li>)+</ul>(<h2>#</h2>)?(<p>#</p>)+</body></html>"


def test_odd_pages(spark):
    rows = [(None, None, None, "", ""), (1, None, "<p>one", "", ""), (1, "no scheme", "<p>one", "", ""), (2, "http://x/", "", "", ""), (3, "http://x/", "<<<>>< & < b &bogus; &#x; <", "", ""), (4, "http://x/", "<p>" + "long " * 50_000, "", "")]
    rows += [(5, "http://x/", "<div>" * 300 + "deep" + "</div>" * 300, "", "")]
    got = wrappers.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1] == ["one", "one"]
    assert wrappers.extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("page", ["<script>never ends <p>x", "<!-- never ends", "<p title='never ends", "</p></div>text</b>", "<a><p>x</a>"])
def test_broken_markup_is_no_error(page):
    root, got = wrappers.blocks(page)
    assert isinstance(root, wrappers.Node) and all(t for _, t in got)


NAMED = """<html><body class="single no-sidebar"><div class="page-header"><p>Site</p></div><div class="layout sidebar-right"><main class="with-sidebar"><article class="post has-comments">
  <div class="entry-header"><h1 class="section-header">Title</h1></div><p>Some long text of the article, with many words.</p><section id="discussion"><h2>Discussion</h2><p>We discuss it.</p></section>
  <div class="share-box">Share</div><article class="comment"><p>nice</p></article></article></main><div class="sidebar"><p>side</p></div></div></body></html>"""


@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_names_that_hold_the_content(spark, tag):
    page = NAMED if tag == "article" else f'<body class="home has-ads"><div id="main-menu">menu</div><{tag} class="content no-comments widget-area"><h2 class="related-title">Head</h2><p>Text of the page, long enough.</p></{tag}><div class="comments"><p>nice</p></div></body>'
    want = "Title\n\nSome long text of the article, with many words.\n\nDiscussion\n\nWe discuss it." if tag == "article" else "Head\n\nText of the page, long enough."
    assert texts(spark, [page]) == [want]


def test_linked_references(spark):
    page = '<body><nav><a>Home</a></nav><article><h1>T</h1><p>Text.</p><div><p>See <a>a long name of a work</a> and <a>another long name</a>.</p></div><h2>References</h2><ol><li><a>First work</a></li><li><a>Second work</a></li></ol><table><tr><td><a>cell</a></td></tr></table></article></body>'
    only = "<body><article><div>By <a>a very long list of links</a></div></article></body>"
    assert texts(spark, [page]) == ["T\n\nText.\n\nSee a long name of a work and another long name.\n\nReferences\n\nFirst work\n\nSecond work\n\ncell"]
    assert texts(spark, [only]) == ["By a very long list of links"]


def test_a_group_of_links_on_other_pages(spark):
    made = [f'<body><div class="x2"><h1>Title {k}</h1><p>Some long text of the page, with words.</p><div class="x4">{box}</div></div></body>' for k, box in enumerate(["<a>Only links in here</a>"] * 3 + ["Plain words"])]
    assert [t.split("\n\n")[2:] for t in texts(spark, made)] == [[], [], [], ["Plain words"]]


def test_quotes_inside_tags():
    page = """<p>One <img alt=John's> two three</p><p>four it isn't five</p><p title = "a > b" class='c > d' x="1">six</p><p ">seven</p><p>eight "</p>"""
    assert [t for _, t in wrappers.blocks(page)[1]] == ["One two three", "four it isn't five", "six", "seven", 'eight "']


ARTICLE = "<article><h1>T</h1><p>Some long text of the article, with many words.</p><p>And more.</p></article>"


@pytest.mark.parametrize("opening", ["<body class=no-sidebar>", "<body class=has-sidebar>", "<body class=with-header>", "<body class=search-results>", "<div class=content-sidebar-wrap>", "<div class=content-widget>", "<div class=post-social>"])
@pytest.mark.parametrize("article", ["<article>", "<article class='post hentry comments-open'>", "<article class='post tag-social category-alert'>", "<div class='post hentry comments-open'>", "<div class=story>"])
def test_names_of_what_holds_the_article_tell_nothing(opening, article):
    page = opening + ARTICLE.replace("<article>", article).replace("</article>", f"</{article[1:].split()[0].strip('>').split(' ')[0]}>")
    told = wrappers.marks(wrappers.Judge(wrappers.folded(wrappers.blocks(page)[0])).decide())
    assert wrappers.extract(page, told) == "T\n\nSome long text of the article, with many words.\n\nAnd more."


def test_inline_elements_and_remarks(spark):
    page = "<article><p>Find <b class=search>good</b> words <span class=ad>Buy <span>now</span> cheap stuff</span>here.</p><div class=reviews><p>Great</p></div><div class=user-feedback><p>Nice</p></div></article>"
    assert texts(spark, [page]) == ["Find good words here."]


@pytest.mark.parametrize(
    "page, words",
    [
        ("<article>" + "<div>" * 100_000 + "deep" + "</div>" * 100_000 + "<p>flat</p></article>", 2),
        ("<article><p>" + "<span>word " * 100_000 + "</p>" * 100_000, 100_000),
        ("<article><p>one</p><p>" + "<span class=ad>word " * 100_000, 1),
        ("<article><p>" + "<table><p>" * 20_000 + "</p></li>" * 20_000 + "deep</article>", 1),
    ],
)
def test_deep_and_unclosed_pages(page, words):
    told = wrappers.marks(wrappers.Judge(wrappers.folded(wrappers.blocks(page)[0])).decide())
    assert len(wrappers.extract(page, told).split()) == words


def test_long_lists_are_aligned():
    made = [wrappers.folded(wrappers.blocks("<body><article>" + "".join(f"<div class={chr(97 + i % (26 - k)) * (1 + i % 7)}{chr(97 + i // 26 % 26)}>t{i}</div>" for i in range(3000)))[0]) for k in range(2)]
    merged = wrappers.merge(*made)
    assert len(merged.children[0].children[0].children) <= 6000


FILLER = "Sentences about {k} and other things, long enough to be a paragraph of the page's main text"
#: Templates by hand: name, page of k, and the text that it should give.
TEMPLATES = {
    "blog": (
        """<html><body class="home blog has-sidebar"><header class="site-header"><p class="site-title"><a href=/>My blog</a></p><ul class="menu"><li><a>Home</a><li><a>About</a></ul></header>
        <div id="content-sidebar-wrap"><div class="hentry post type-post tag-social"><h1 class="entry-title">Post {k}</h1><div class="entry-content"><p>{f} one.</p><p>{f} <em>two</em>.</p><h2>More</h2><p>{f} three.</p>
        <div class="sharedaddy share-buttons"><a>Tweet</a> <a>Mail</a></div></div></div><div id="comments" class="comments-area"><h2>Two remarks</h2><ol class="comment-list"><li><p>First {k}, very nice indeed, thank you for the long text.</p><li><p>Second {k}</p></ol>
        <form><p>Your mail</p><label>Name</label><input></form></div><div class="sidebar widget-area"><h3>Archive</h3><ul><li><a>May</a></ul></div></div><footer>Powered by words</footer></body></html>""",
        "Post {k}\n\n{f} one.\n\n{f} two.\n\nMore\n\n{f} three.",
    ),
    "shop": (
        """<body><div class="topbar">Free delivery from fifty on</div><nav><a>Shirts</a><a>Shoes</a></nav><div class="breadcrumbs"><a>Home</a> &gt; <a>Shoes</a></div>
        <main><h1>Shoe {k}</h1><div class="product-description"><p>{f}.</p><ul><li>Leather</li><li>Size {k}</li></ul><table><tr><th>Weight</th><td>{k} kg</td></tr><tr><th>Colour</th><td>red</td></tr></table></div>
        <form><select><option>1</option></select><button>Buy now</button></form><section class="customer-reviews"><h2>Reviews</h2><div class="review"><p>Fits well, {k} times.</p></div></section>
        <div class="related-products"><h2>You may like</h2><a>Shoe 9</a></div></main><footer><p>Imprint</p></footer></body>""",
        "Shoe {k}\n\n{f}.\n\nLeather\n\nSize {k}\n\nWeight\n\n{k} kg\n\nColour\n\nred",
    ),
    "forum": (
        """<body><table class="header-bar"><tr><td><a>Forum</a></td><td><a>Rules</a></td></tr></table><div id="wrap"><h1>Question {k}</h1><div class="thread-start"><div class="author-box"><b>user{k}</b></div><div class="message"><p>{f}?</p><p>{f}!</p></div></div>
        <div class="replies"><div class="reply"><p>Answer {k} with quite some words in it.</p></div><div class="reply"><p>Another answer {k} with words.</p></div></div></div><div class="login-box"><form><p>Log in</p></form></div></body>""",
        "Question {k}\n\n{f}?\n\n{f}!",
    ),
    "news": (
        """<body><div class="cookie-consent"><p>We use cookies, do you agree to that?</p></div><header><nav><ul><li><a>Politics</a></li><li><a>Sports</a></li></ul></nav></header><div class="page"><article class="article--full"><header><h1>News {k}</h1><p class="byline">By Ann {k}</p></header>
        <div class="ad-slot">Advertisement</div><p>{f}.</p><figure><img><figcaption>Picture {k}</figcaption></figure><p>{f}, <a>linked</a>.</p><aside><h3>Read on</h3><a>Other</a></aside><p>Subscribe to our paper for only one per week.</p></article>
        <section><article class="teaser"><h3><a>Other news of the day</a></h3></article><article class="teaser"><h3><a>And more of it</a></h3></article></section></div><footer>Contact</footer></body>""",
        "News {k}\n\nBy Ann {k}\n\n{f}.\n\nPicture {k}\n\n{f}, linked.",
    ),
    "docs": (
        """<body><div><a>Manual</a> <a>API</a> <a>Search the whole manual</a></div><div><div><ul><li><a>Chapter one</a></li><li><a>Chapter two</a></li></ul></div><div><h1>Function f{k}</h1><p>{f}.</p><h2>Parameters</h2><dl><dt>x{k}</dt><dd>{f} of x.</dd></dl>
        <pre>call f{k}(x)</pre><h2>Returns</h2><p>{f} of it.</p></div></div><div>Made with love by the docs team</div></body>""",
        "Function f{k}\n\n{f}.\n\nParameters\n\nx{k}\n\n{f} of x.\n\ncall f{k}(x)\n\nReturns\n\n{f} of it.",
    ),
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_templates(spark, name):
    page, want = TEMPLATES[name]
    fill = lambda s: [s.replace("{f}", FILLER).replace("{k}", str(k)) for k in ("seven", "eleven", "forty", "ninety", "ninety")]
    assert texts(spark, fill(page), f"http://{name}.example/") == fill(want)


def test_hosts_are_merged_in_a_tree(spark, monkeypatch):
    page, want = TEMPLATES["docs"]
    monkeypatch.setattr(wrappers, "FAN_IN", 2)
    made = [page.replace("{f}", FILLER).replace("{k}", f"k{k}") for k in range(12)]
    rows = spark.createDataFrame([(k, f"http://h.example/{k}", p, "", "") for k, p in enumerate(made)], SCHEMA).repartition(9)
    got = {r.page_id: r.text for r in wrappers.extract_pages(rows).collect()}
    assert got == {k: want.replace("{f}", FILLER).replace("{k}", f"k{k}") for k in range(12)}


WORDS = ["river", "stone", "market", "winter", "garden", "letter", "bridge", "copper", "signal", "harvest", "morning", "village"]


def said(k, n, start=0):
    """n words that differ from page to page."""
    return " ".join(WORDS[(5 * k + 7 * i * (k + 1) + start) % len(WORDS)] + str((k + 1) * (i + 1) % 89) for i in range(n))


def host(template, pages=6):
    """Pages of one host and their texts: template(k) gives a page's html and the blocks that are its text."""
    made = [template(k) for k in range(pages)]
    return [f"<html><body><nav><a>Home</a></nav>{page}<footer>Site of pages</footer></body></html>" for page, _ in made], ["\n\n".join(blocks) for _, blocks in made]


def lead(k):
    """A lead that all pages have stays; what stands apart and short words at the end go."""
    same = "This lead of the column is the same on each of its pages."
    return f"<article><h1>{said(k, 3)}</h1><p>{same}</p><p>{said(k, 30)}</p><p>{said(k, 20, 5)}</p><div>NOTICE Share this</div><p>Thanks for reading</p></article>", [said(k, 3), same, said(k, 30), said(k, 20, 5)]


def named(k):
    """Names drop no paragraph, nor a group whose paragraphs vary; but adverts and remarks."""
    return (
        f'<article><h1>{said(k, 3)}</h1><p class="related">{said(k, 20)}</p><div class="social"><p>{said(k, 20, 3)}</p></div><p>{said(k, 9, 4)}</p><p class="ad">{said(k, 5, 6)}</p>'
        f'<div class="comments"><p>{said(k, 20, 7)}</p></div></article>',
        [said(k, 3), said(k, 20), said(k, 20, 3), said(k, 9, 4)],
    )


def controls(k):
    """Words of labels and buttons in a text outside any form stay, those of forms and of lone buttons go."""
    a, b = said(k, 20), said(k, 20, 4)
    return f"<article><h1>{said(k, 2)}</h1><p>{a} Set <label>X{k}</label> it <output>by{k}</output></p><p>{b}</p><form><p>Your <label>name</label></p><button>Send</button></form><div><button>Like</button></div></article>", [said(k, 2), f"{a} Set X{k} it by{k}", b]


def voices(k):
    """Readers' remarks under names that tell nothing: repeated blocks after the article's paragraphs, more on one page than on another."""
    body = [said(k, 25, i) for i in range(2 + k % 2)]
    remarks = "".join(f'<div class="v"><b>Reader {i}</b> {said(k + i, 15, 2)}</div>' for i in range(1 + k % 3))
    return f"<article><h1>{said(k, 3)}</h1>{''.join(f'<p>{p}</p>' for p in body)}<section class=voices><h2>Voices</h2>{remarks}</section></article>", [said(k, 3), *body]


def beside(k):
    """A short article and long remarks beside it, neither told by its name."""
    remarks = "".join(f'<div class="cc"><p>{said(k + i, 60, 2)}</p></div>' for i in range(8 - k % 3))
    return f'<div class="m"><h1>{said(k, 3)}</h1><p>{said(k, 12)}</p><p>{said(k, 9, 3)}</p></div><div class="n">{remarks}</div>', [said(k, 3), said(k, 12), said(k, 9, 3)]


def sections(k):
    """Repeated sections with headings, blocks that stand for paragraphs, and a list at the end are the article's."""
    parts = [(said(k + i, 2), said(k + i, 25, i)) for i in range(2 + k % 3)]
    blocks = [said(k, 15, i) for i in range(2 + k % 2)]
    items = [said(k, 4, i) for i in range(2 + k % 4)]
    html_ = "".join(f"<section><h2>{h}</h2><p>{p}</p></section>" for h, p in parts) + "<div class=t>" + "".join(f"<div class=u>{b}</div>" for b in blocks) + "</div>"
    return f"<article><h1>{said(k, 3)}</h1><p>{said(k, 9)}</p>{html_}<h2>Sources</h2><ul>{''.join(f'<li>{i}</li>' for i in items)}</ul></article>", [said(k, 3), said(k, 9), *(x for part in parts for x in part), *blocks, "Sources", *items]


@pytest.mark.parametrize("template", [lead, named, controls, voices, beside, sections])
def test_hosts_of_six_pages(spark, template):
    pages, want = host(template)
    assert texts(spark, pages) == want


def test_streams_are_passed_on_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    pages, _ = host(lead, 9)
    column = [pa.array(["h"] * 9), pa.array(pages)]
    batches = [pa.RecordBatch.from_arrays([c.slice(k, 1) for c in column], names=["host", "html"]) for k in range(9)]
    assert len(list(wrappers._streams(iter(batches)))) == 1
    monkeypatch.setattr(wrappers, "PASSED", 2 * len(pages[0]))
    assert len(list(wrappers._streams(iter(batches)))) >= 4
