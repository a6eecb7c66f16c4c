"""HTML extraction: what stays, what goes, and the vote of a host."""

from rankwell.llm.extract import Page, extract_pages

MAIN = "The first paragraph of the article is long enough to matter here."
MORE = "A second paragraph follows it, with <b>bold</b> and <a href='/x'>linked</a> words."
PAGE = f"""<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{margin:0}}</style>
<script>var t="</p>";if(a<b)track(0);</script></head><body class="with-sidebar">
<div id="cookie-notice">We use cookies. <button>OK</button></div>
<header><h1>Site name</h1><nav><ul><li><a href="/">Home</a></li><li><a href="/b">B</a></li></ul></nav></header>
<div class="ad">Buy this now.</div>
<article class="post-12"><h2>Head &amp; title</h2><p>{MAIN}</p><!-- note -->
<p>{MORE}<br>After  the
break&nbsp;here.</p><form><label>Mail</label><input name="q"></form>
<section class="comments"><p>First! A reader says something rather long about this article.</p></section></article>
<aside><p>Unrelated things at the side.</p></aside><footer>&copy; nobody</footer></body></html>"""
TEXT = (
    f"Head & title\n{MAIN}\n"
    "A second paragraph follows it, with bold and linked words. After the break here."
)


def extracted(page):
    p = Page(page)
    return p.text(p.container())


def test_article_without_what_surrounds_it():
    assert extracted(PAGE) == TEXT


def test_broken_and_bare_pages():
    assert extracted("") == ""
    assert extracted("plain words only") == "plain words only"
    assert extracted("<p>one<p>two") == "one\ntwo"
    assert extracted("<div><p>open <b>bold</div><div>next</div>") == "open bold\nnext"
    assert extracted("<p>a < b and c > d &lt;x&gt; &#233;</p>") == "a < b and c > d <x> é"
    assert extracted("<p>text</p><!-- open comment") == "text"
    assert extracted("<script>never closed <p>x</p>") == ""
    assert extracted("<body><nav><a href='/'>Home</a></nav></body>") == ""


def test_a_class_name_does_not_hide_the_whole_page():
    assert extracted(f"<body><div class='share menu'><p>{MAIN}</p></div></body>") == MAIN


def test_deep_nesting_and_long_pages():
    assert extracted("<div>" * 3000 + f"<p>{MAIN}</p>" + "</div>" * 3000) == MAIN
    many = "".join(f"<p>paragraph {i} of many</p>" for i in range(5000))
    assert extracted(f"<main>{many}</main>").count("\n") == 4999


def test_pages_of_a_host_agree(spark):
    box = lambda extra: (
        f"<body><div class='c-1'><p>{MAIN}</p><p>{MAIN}</p></div><div class='x'>{extra}</div></body>"
    )
    rows = [(i, f"http://h.example/{i}", box("short"), 1) for i in range(5)]
    rows.append((9, "http://h.example/9", box("<p>" + "filler words without end " * 40 + "</p>"), 1))
    rows += [(10, None, box("s"), 1), (11, "http://h.example/11", None, 1), (12, "nonsense", PAGE, 1)]
    rows += [(12, "nonsense", PAGE, 1), (None, "http://h.example/13", "", 1)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = extract_pages(table).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r["text"] for r in got}
    want = f"{MAIN}\n{MAIN}"
    assert [by_id[i] for i in (0, 1, 9, 10)] == [want] * 4  # 9 alone would take the filler
    assert by_id[11] == "" and by_id[None] == "" and by_id[12] == TEXT
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_pages(table.limit(0)).collect() == []


def test_nothing_but_boilerplate_goes():
    whole = lambda page: Page(page).text(0, Page(page).outvoted(None, frozenset()))
    long = f"<p>{MAIN}</p>" * 9
    body = "\n".join([MAIN] * 9)
    assert whole(f"<body><article>{long}</article><article><p>two</p></article></body>") == f"{body}\ntwo"
    assert whole(f"<body><div><h1>Title</h1><p>Lead</p><div>{long}</div></div></body>") == f"Title\nLead\n{body}"
    assert whole(f"<body><p>Before</p><table><tr><td>{MAIN * 9}</td></tr></table><p>After</p></body>") == (
        f"Before\n{MAIN * 9}\nAfter"
    )


def test_a_host_keeps_siblings_at_its_path(spark):
    part = lambda k, n: f"<div class='part-{k}'>" + f"<p>{MAIN}</p>" * n + "</div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{part(1, 3)}</body>") for i in range(5)]
    rows.append((9, "http://h.example/9", f"<body>{part(1, 3)}{part(2, 2)}<p>End</p></body>"))
    got = {r["page_id"]: r["text"] for r in extract_pages(
        spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[0] == "\n".join([MAIN] * 3)
    assert got[9] == "\n".join([MAIN] * 5 + ["End"])


def test_an_advert_longer_than_a_short_article_goes():
    assert extracted(f"<body><div class='ad'>{MAIN}</div><article><p>Short.</p></article></body>") == "Short."


def kept(page):
    p = Page(page)
    return p.text(0, p.outvoted(None, frozenset()))


def test_a_stray_quote_opens_nothing():
    page = "<p>Start.</p><p title=it's>One.</p><p>Two here.</p><p>Three don't lose this.</p>"
    assert kept(page) == "Start.\nOne.\nTwo here.\nThree don't lose this."
    assert kept("<p a=\"x>y\" b='>' c = \"d\">In.</p><p \">Out.</p><p a=\"never closed>On.</p>") == "In.\nOut.\nOn."


def test_class_words_take_no_article():
    for page in (
        f"<article class='post comments-open'><p>{MAIN}</p></article>",
        f"<div id='content' class='has-comments'><p>{MAIN}</p></div>",
        f"<div class='comments'><article><p>{MAIN}</p></article></div>",
        f"<div class='with-sidebar no-ads'><p>{MAIN}</p></div>",
    ):
        assert kept(page) == MAIN
    work = "<article><p>One.</p><section class='related-work'><p>Two.</p></section><p>Three.</p></article>"
    assert kept(work) == "One.\nTwo.\nThree."


def test_boilerplate_goes_whatever_its_size():
    long = "<p>Some reader says a lot about this. </p>" * 50
    for name in ("comments", "comment-list", "commentsArea", "related-posts", "cookie-notice", "share-buttons", "sidebar2"):
        assert kept(f"<div><p>{MAIN}</p></div><div class='{name}'>{long}</div>") == MAIN


def test_lists_of_links_in_an_article_stay():
    links = "<ul><li><a href='/a'>One source</a></li><li><a href='/b'>Another source</a></li></ul>"
    assert kept(f"<article><p>Before.</p>{links}<p>After.</p></article>") == "Before.\nOne source\nAnother source\nAfter."
    assert kept(f"<div><p>Before.</p>{links}<p>After.</p></div>") == "Before.\nOne source\nAnother source\nAfter."
    assert kept(f"<div>{links}<p>After.</p></div>") == "After."


def test_depth_and_strays_take_linear_time():
    import time

    begin = time.process_time()
    assert kept("<div>" * 40_000 + "deep") == "deep"
    assert kept("<p>x</span></b>" * 20_000).count("x") == 20_000
    assert kept("<p a=\"" * 5_000 + "end") == ""
    assert time.process_time() - begin < 20
