from __future__ import annotations

import pytest

from hourgrid.llm import extract as X


@pytest.fixture(scope="module")
def weights():
    return X.fit_weights(X.labelled_pages())


PAGES = {
    "<html><head><title>T</title></head><body><nav><ul><li><a href='/a'>Home</a></li><li>About</li></ul></nav><div class=\"ad\">Buy this now and be happy for ever</div>"
    "<article><h1>Title here</h1><p>First  line\nof &amp; text.<p>Second <b>bo</b>ld &lt;line&gt;</p><ul><li>one</li><li>two</li></ul></article>"
    "<div class='comments'><p>I like this very much indeed, thank you</p></div><footer>&copy; somebody</footer></body></html>":
        "Title here\nFirst line of & text.\nSecond bold <line>\none\ntwo",
    "<body><header>Site name</header><main><p>Only words.</p><aside>Other things to read on the site</aside><form>Your name <input></form><p>And more words.</p></main>"
    "<div id='sidebar'>Lots and lots of links that nobody follows</div>": "Only words.\nAnd more words.",
    "<article><p>a</p><script>var x = '<p>no</p>';</script><style>p{}</style><!-- <p>hidden</p> --><p>b &eacute;&#33;</p></article>": "a\nb é!",
    "just words without any tag": "just words without any tag",
    "<nav>menu</nav>": "",
    "<p>unclosed <b>bold": "unclosed bold",
    "<p>5 < 6 and 7 > 3</p>": "5 < 6 and 7 > 3",
    "<p title=\"a>b\">x</p>": "x",
    "": "",
}


@pytest.mark.parametrize("page", PAGES, ids=range(len(PAGES)))
def test_main_text(weights, page):
    assert X.main_text(page, weights) == PAGES[page]


AROUND = ['<body class="has-sidebar">{}', '<body class="no-sidebar search">{}', '<html class="no-ads"><body>{}', '<div class="content-with-sidebar">{}</div>', '<div id="comments-page">{}</div>',
          '<div class="layout has-sidebar">{}</div>', '<div class="post comments-open tag-search">{}</div>', '<div id="content" class="sidebar-right">{}</div>',
          '<div class="content-sidebar-wrap">{}</div>', '<div role="main" class="search">{}</div>', '<div class="without_menu">{}</div>']


@pytest.mark.parametrize("around", AROUND)
def test_names_of_pages_and_wrappers(weights, around):
    page = '<nav>Home</nav><article><h2 id="search">Search</h2><p>First words of it.</p><h2 id="related-work" class="toc">Related work</h2><p>More words.</p><h3><span id="Comments">Comments</span></h3><p>End.</p></article>'
    assert X.main_text(around.format(page), weights) == "Search\nFirst words of it.\nRelated work\nMore words.\nComments\nEnd."


BOXES = ['class="post-comments"', 'class="article-share"', 'class="content-nav"', 'class="sidebar-content"', 'class="sidebar-wrap"', 'id="page-sidebar"', 'class="footer text-center"', 'class="sidebar has-widget"',
         'class="widget col-4"', 'role="navigation" class="content"', 'id="comments" class="comments-with-replies"']


@pytest.mark.parametrize("box", BOXES)
def test_boxes_named_with_content_words_stay_out(weights, box):
    assert X.main_text(f"<article><p>Words before it.</p><div {box}><p>one two three</p></div><p>Words after it.</p></article>", weights) == "Words before it.\nWords after it."


UNCLOSED = [
    ("<datalist><option value=a><option value=b></datalist><article><p>one</p></article>", "one"),
    ("<article><p>one <svg class=i/>two</p><p>three</p></article>", "one\ntwo\nthree"),
    ("<article><p>one</p><svg class=i><path d='M0'><p>two</p></article><p>three</p>", "one\ntwo\nthree"),
    ("<article><p>one</p><div><svg class=i><path d='M0'></div><section>two</section></article>", "one\ntwo"),
    ("<article><math/><p>one</p><select><option>x<option>y</select><p>two</p></article>", "one\ntwo"),
    ("<article><p>one</p><ul><li><button>x<li>two</ul><button>y</button><p>three</p></article>", "one\ntwo\nthree"),
    ("<article><p>one</p><div><select><option>x</option></div><p>two</p></article>", "one\ntwo"),
    ("<p>one</p><svg><desc><p>x</p></desc><text>y</text></svg><p>two <noscript><div>x</div></noscript>three</p>", "one\ntwo\nthree"),
    ("<article><p>one</p><script>x<p>y</p></article>", "one"),
    *((f"<article><p>one</p><div><{t} class=i{end}</div><p>two</p></article><p>three</p>", "one\ntwo\nthree") for t in ("iframe", "object", "canvas", "button", "noscript", "template", "select", "option") for end in ("/>", ">x")),
    *((f"<body><{t} id=i>x<article><p>one</p><p>two</p></article></body>", "one\ntwo") for t in ("iframe", "object", "canvas", "button", "noscript")),
]


@pytest.mark.parametrize("page, text", UNCLOSED)
def test_elements_without_end_tag(weights, page, text):
    assert X.main_text(page, weights) == text


def test_many_parts_without_end_tag(weights):
    parts = "<svg>" + "<path d=''>" * 50000 + "</svg><select>" + "<option>x" * 50000 + "</select>"
    assert X.main_text(f"<article><p>one</p>{parts}<p>two</p></article>", weights) == "one\ntwo"


def test_labelled_pages_have_wrappers():
    pages = [p for p, _ in X.labelled_pages(60, 99)]
    assert sum("<body class=" in p for p in pages) >= 30 and any('-page">' in p for p in pages) and any("content-with-" in p for p in pages) and any("<h1 id=" in p for p in pages)


def test_held_out_pages(weights):
    pages = X.labelled_pages(60, 99)
    hits = sum(X.main_text(p, weights).split() == c.split() for p, c in pages)
    assert hits >= 55


def test_long_pages_are_read_whole(weights):
    page = "<nav>" + "<a>m</a>" * 50 + "</nav><article>" + "".join(f"<p>line {i}</p>" for i in range(30000)) + "</article>"
    assert X.main_text(page, weights).count("\n") == 29999
    for odd in ("<" * 20000, "<a " * 20000, "<a \"" * 20000, "<!--" * 5000, "</p>" * 20000, "<div>" * 3000):
        X.main_text(odd, weights)


def test_rows(spark, weights):
    df = spark.createDataFrame([(1, "u", "<article><p>hi</p></article>", 3), (1, "u", "<article><p>hi</p></article>", 3), (2, None, None, 4), (None, "v", "", 5)],
                               "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in X.extract(df, weights).collect()), key=str)
    assert got == sorted([(1, "u", "hi", 2), (1, "u", "hi", 2), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert X.extract(df.limit(0), weights).collect() == []


@pytest.mark.parametrize("page, text", [
    ("<body><article><ul><li class=ad>Buy this now<li>real words here<li>and more of them</ul></article></body>", "real words here\nand more of them"),
    ("<table><tr><td class=sidebar>menu<td><p>real words of the page</table>", "real words of the page"),
    ("<table><thead><tr><th class=ad>x<tbody><tr><td class=menu>y<td>real words<tr><td>other words</table>", "real words\nother words"),
    ("<article><dl><dt class=ad>x<dd>real words<dt>other words</dl></article>", "real words\nother words"),
    ("<article><ul><li>one two<ul><li class=ad>x<li>three four</ul>five six<li>seven</ul></article>", "one two\nthree four\nfive six\nseven"),
    ("<article><p>one<br>two<br/>three</p></article>", "one\ntwo\nthree"),
])
def test_items_without_end_tag(weights, page, text):
    assert X.main_text(page, weights) == text


@pytest.mark.parametrize("tag, end", [("<div>", ""), ("<li>", ""), ("<p>", ""), ("<div><li>", ""), ("<b>", ""), ("<div>", "</span>"), ("<svg><desc><div>", ""), ("<div class=a>", "</p>")])
def test_work_per_tag_does_not_grow_with_depth(weights, tag, end):
    import time

    begin = time.process_time()
    X.main_text(f"<article><p>one</p>{tag * 60000}{end * 60000}words", weights)
    assert time.process_time() - begin < 20  # quadratic work takes minutes
