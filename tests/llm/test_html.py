import numpy as np

from repolens.llm.html_template import extract_pages, main_text, ordered_and_nested, page_tokens, templates, with_host

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><nav><ul><li><a href=x>Home</a></li></ul></nav><!-- c --><div class="cookie-notice">We use cookies</div>
<div id="wrap"><article><h1>Head &amp;  line</h1><p><b>One.<br><p>Two&nbsp;x <i>ita</i>lic &copy; &#233;</p><div class="ad">buy</div>
<form>f<input></form><aside>as</aside><ul><li>a<li>b</ul><section class="comments"><article class="comment"><p>Nice!</p></article></section>
</article><div class="sidebar">side</div></div><footer>foot</footer></body></html>"""


def test_parts_that_are_no_article_are_left_out():
    assert main_text(PAGE) == "Head & line One. Two x italic \xa9 \xe9 a b"
    assert main_text('<div class="menu">m</div><div class=post><p>aa</p><pre>b\n c</pre><table><tr><td>1<td>2</table></div><p id="newsletterBox">no</p>') == "aa b c 1 2"
    assert main_text("<main><p>x</p></main><div>y</div>") == "x"
    assert main_text("<body><div><a href=1>menu entry</a></div><div><p>long text here</p></div>") == "long text here"
    assert main_text('<div class="layout-sidebar-right"><article><p>x</p><div class=comments>c</div></article><div class=sidebar>y</div></div>') == "x"
    assert main_text('<div class="page-with-sidebar"><div class=content><p>x</p></div></div><section id=comments><article>no</article></section>') == "x"
    assert main_text(None) == main_text("") == main_text("<script>x") == ""
    assert main_text("plain < text &lt; <3 <b unclosed") .startswith("plain < text < <3")
    assert main_text("<p>" + "very long text " * 20_000) == ("very long text " * 20_000).strip()


def test_constant_text_of_a_host_is_boilerplate_and_repeated_passages_are_not(spark):
    passage = "<p>A passage that many pages quote in full.</p>"
    page = lambda i: (
        f"<body><div class=x1><p>Welcome to our site</p></div><article><h1>Title {i}</h1><p>Body {i} text.</p>"
        f"{passage if i % 2 else ''}<p class=z>Read more on this page</p></article></body>")
    rows = [(i, "http://h.example/%d" % i, page(i)) for i in range(8)] + [(100 + i, "http://h.example/copy", page(1)) for i in range(30)]
    rows += [(200, "http://one.example/", page(3)), (201, None, None), (None, "http://h.example:80/", ""), (5, "http://h.example/5", page(5))]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = extract_pages(pages).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[2] == "Title 2 Body 2 text." and texts[3] == "Title 3 Body 3 text. A passage that many pages quote in full."
    assert texts[110] == "Title 1 Body 1 text. A passage that many pages quote in full."
    assert texts[200].endswith("Read more on this page") and texts[201] == texts[None] == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(pages.limit(0)).count() == 0


def test_template_classes(spark):
    pages = spark.createDataFrame(
        [(i, "http://h/", f"<body><div id=a><p>n {i}</p></div><div id=b><section><p>t {i}</p><p>u {i}</p></section></div></body>") for i in range(6)],
        "page_id long, url string, html string")
    tokens = page_tokens(with_host(pages))
    hosts = spark.createDataFrame([("h", 6, 6)], "host string, n_pages long, n_rows long")
    row = templates(tokens, hosts).first()
    assert len(row.frame) == 5 and len(row.constant) == 0  # body, two divs, the section and the paragraph of the first div
    root, inner, crossing, absent = np.array([1, 5, 9]), np.array([6, 7]), np.array([2, 6]), np.array([50])
    assert ordered_and_nested(np.array([1, 2, 5, 6, 7, 9]), [root, inner, crossing, absent]) == [(True, 0), (True, 2), (True, -2), (True, -1)]
    assert ordered_and_nested(np.array([1, 9, 5]), [root])[0][0] is False
    assert ordered_and_nested(np.array([], np.int64), [root]) == [(True, -1)]
