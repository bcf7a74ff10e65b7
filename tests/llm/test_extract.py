from pagetide.llm import html_extract
from pagetide.llm.html_extract import extract

PAGE = """<!DOCTYPE html><html><head><title>Site title</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><header><h2>Our site</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-banner">We use cookies on this site.</div><div id="sidebar"><p>Popular stories of the week are here.</p></div>
<article><h1>A   title</h1><p>First &amp; foremost, <b>bo</b>ld text
goes on.<p>Second paragraph<br>with a break.<div class="ad">Buy now, buy more!</div><ul><li>One item</li><li>Another item</li></ul>
<aside>Related: other stories</aside><form><input name=q><button>Search</button></form><p>The end &copy; 1 &lt; 2.</p></article>
<section class="comments"><p>Great article, I liked it a lot!</p></section><footer>&copy; site</footer></body></html>"""


def test_article_only():
    assert extract(PAGE) == "A title First & foremost, bold text goes on. Second paragraph with a break. One item Another item The end © 1 < 2."


def test_pages_without_article_and_broken_pages():
    plain = "<body><div class='menu'><a href=x>Home</a></div><div><p>Some words of the main text stand here.</p><p>And more of them.</p></div><div class='footer'>bye</div>"
    assert extract(plain) == "Some words of the main text stand here. And more of them."
    assert extract("<article><p>never closed <b>at all") == "never closed at all"
    assert extract("just text & more") == "just text & more"
    assert [extract(x) for x in (None, "", "<p></p>", "<script>x()</script>", "<nav>menu</nav>")] == [""] * 5
    long = "<article>" + "<p>" + "word " * 20000 + "</p></article>"
    assert extract(long) == " ".join(["word"] * 20000)


def test_weights_from_labelled_pages():
    main = extract(PAGE)
    weights = html_extract.fit_weights([(PAGE, main)])
    assert weights["word:article"] > 0 > weights["word:cut"] and weights["tag:block"] < 0
    assert extract(PAGE, weights) == main


def test_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (None, None, None, None)], "page_id long, url string, html string, text string")
    out = html_extract.extract_text(pages)
    assert out.columns == ["page_id", "url", "text"]
    assert sorted(r.text for r in out.collect()) == sorted([extract(PAGE)] * 2 + [""])
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_names_that_only_look_like_furniture():
    words = "Some words of the main text stand here."
    for attributes in ("class=overflow-hidden", 'style="overflow-x: hidden"', 'aria-hidden="false"', 'class="no-sidebar"', 'class="page has_sidebar"', "id=layout-with-nav", "class=ad-free-article", "id=social-sciences"):
        for tag in ("body", "div", "article", "main"):
            assert extract(f"<{tag} {attributes}><p>{words}</p></{tag}>") == words
    for tag in ("body", "article", "main"):
        assert extract(f"<{tag} class='widget' hidden><p>{words}</p></{tag}>") == words
    for attributes in ("hidden", 'hidden=""', "aria-hidden='true'", 'style="color: red; display : none"', "class=left-sidebar", "class=comment-has-replies", "class=social-links", "id=ad-slot-1"):
        assert extract(f"<body><p>{words}</p><div {attributes}><p>more words</p></div></body>") == words
    assert extract(f"<body><div hidden=until-found><p>{words}</p></div></body>") == words


def test_form_around_the_page_stays_and_small_forms_go():
    words = "Some words of the main text stand here."
    menu = "<nav>" + "<a href=x>Home</a>" * 30 + "</nav>"
    assert extract(f"<body><form id=aspnetForm>{menu}<div><p>{words}</p></div></form></body>") == words
    assert extract(f"<body><form id=f><article><p>{words}</p></article></form><p>" + "rest " * 40 + "</p></body>") == words
    assert extract(f"<body><p>{words}</p><form><p>Your name</p></form><p>And more of them stand here.</p></body>") == words + " And more of them stand here."


def test_furniture_inside_an_article_parts_nothing():
    first, second = "one " * 30, "two " * 30
    page = f"<article><p>{first}</p><aside><p>{'other ' * 150}</p></aside><p>{second}</p></article>"
    assert extract(page) == (first + second).strip()
    inner = f"<article><p>{first}</p><aside><article><p>{'other ' * 500}</p></article></aside><p>{second}</p></article>"
    assert extract(inner) == (first + second).strip()


def test_tags_that_never_end():
    assert extract("<p>a <b word <i x='1> more") == "a <b word <i x='1> more"
    assert extract("<p>a <b title='x>y' class=\"u\">word</b> <i \"> more") == "a word <i \"> more"
    assert extract("one <a <a <a") == "one <a <a <a"
    assert extract("<div><b><p>one<p>two</x></p></div>") == "one two"


def test_time_is_linear_in_the_page():
    # each of these took hours where a tag looked again at what others had passed
    n = 50_000
    assert extract("<a " * n) == ("<a " * n).strip()
    assert extract('<a "' * n + "'>") == '<a "' * n + "'>"
    for page in ("<div>" * n + "word</x>" * n, "<div>" + "<b>" * n + "word<p></p>" * n, "<form>" * n + "word <i>" * n, "<form>word<article>" * n):
        assert len(extract(page)) >= 4 * n
