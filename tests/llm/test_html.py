from execlens.llm import html

PAGES = "page_id long, url string, html string"


def page(i, body, extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header class=top><a href=/>Site</a></header>"
        f"<nav><ul><li><a>Home {i}</a></li><li>More</li></ul></nav><div class='cookie-notice'>We use cookies</div><!-- ad <p>no</p> --><div class=\"ad\">Buy {i}</div>{body}"
        f"<aside class=sidebar>Side {i}</aside><section id=comments><p>Nice post {i}</p></section><form><input>Subscribe</form>{extra}<footer>&copy; x</footer></body></html>"
    )


def run(spark, rows):
    return {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}


def test_article(spark):
    rows = [(i, f"https://h.example/{i}", page(i, f"<article><h1>Head&nbsp;{i} &amp; co</h1><p><b>Bold{i}<i>er</i> te xt<br>on<p>Second\n  {i}&#33;</p><ul><li>one<li>two</ul></article>")) for i in range(12)]
    got = run(spark, rows)
    for i in range(12):
        assert got[i] == f"Head {i} & co\nBold{i}er te xt on\nSecond {i}!\none\ntwo"


def test_without_article_the_fullest_element(spark):
    rows = [(i, "http://user@H.example:80/x", page(i, f"<div id=wrap><div class=content><h1>H{i}</h1><p>" + f"many words of page {i} " * 9 + "</p></div></div>")) for i in range(9)]
    got = run(spark, rows)
    for i in range(9):
        assert got[i] == f"H{i}\n" + (f"many words of page {i} " * 9).strip()


def test_comments_adverts_and_open_elements_inside(spark):
    body = "<nav><article><p>Text <span>one</span></p><div class='ad-box'>Buy</div><div class=comments><article class=comment><p>Hi</p></article></div><p>Two</p></article>"
    assert run(spark, [(1, "http://a/", page(1, body))])[1] == "Text one\nTwo"


def test_texts_of_all_pages_are_template(spark):
    body = lambda i: f"<div class=box><p>Own words of page {i}, and some more of them</p><p>Read all about us</p></div>"
    rows = [(i, "http://s/", page(i, body(i))) for i in range(10)] + [(50, "http://t/", page(50, body(50)))] + [(60 + i, "http://u/", page(i, f"<article><p>Own {i}</p><p>Shared by all</p></article>")) for i in range(10)]
    got = run(spark, rows)
    assert got[3] == "Own words of page 3, and some more of them" and got[50].endswith("\nRead all about us")
    assert got[61] == "Own 1\nShared by all"


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "x", ""), (None, "http://a/", "<article>q</article>"), (4, "http://a/", "<article>a < b & c &am &#x41; </article"), (4, "http://a/", "<article>a < b & c &am &#x41; </article"), (5, "http://a/", "<script>never closed"), (6, "http://a/", "<article><p>open")]
    got = html.main_text(spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS host", "2 AS text", "3 AS row", "4 AS n_chars")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got)[:3] == [(0, "q", 1), (1, "", 0), (2, "", 0)]
    assert {r.text for r in got if r.page_id == 4} == {"a < b & c &am A </article"} or {r.text for r in got if r.page_id == 4} == {"a < b & c &am A"}
    assert {r.page_id: r.text for r in got}[5] == "" and {r.page_id: r.text for r in got}[6] == "open"
    assert html.main_text(spark.createDataFrame([], PAGES)).collect() == []
    assert [html.host_of(u) for u in ("https://U:p@A.b:8/x", "nope", None, "//x/y", "ftp://c")] == ["a.b", "", "", "", "c"]


def test_a_host_of_two_layouts(spark):
    text = lambda i: f"Story {i} begins here. " + f"Sentence {i} goes on. " * 20
    page = lambda i, a, x: f"<html><body><div class=nav>Home</div><div class={a}><div class={x}><p>{text(i)}</p></div></div></body></html>"
    rows = [(i, None if i >= 20 else f"http://h.test/{i}", page(i, *(("a", "x") if i % 5 < 3 else ("b", "y")))) for i in range(30)]
    rows.append((30, "http://parts.test/", f"<div class=m><p>{text(30)}</p></div><div class=n><p>{text(31)}</p></div>"))
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: text(i).strip() for i in range(30)} | {30: text(30).strip() + "\n" + text(31).strip()}


def test_raw_elements_that_hold_nothing_or_never_end():
    got = lambda body: html.extract(f"<article>{body}</article>", frozenset(), None)
    for x in ('<svg class="i" />', "<math/>", "<iframe src='a' />", "<svg><path d='M0'/></svg>", "<button>Press</button>"):
        assert got(f"<p>One {x}two</p><p>three</p>") == "One two\nthree"
    for x in ("button", "object", "audio controls", "video", "canvas"):
        assert got(f"<p>One <{x}>two</p><p>three</p>") == "One two\nthree"
    assert got("<p>One</p><script>var a = '<p>';") == got("<p>One</p><style>p {}") == "One"


def test_classes_against_brute_force(spark):
    """Occurrence vectors written out in full give the same classes and the same template as their hashes."""
    page = lambda i: "<body><div class=top>Hello</div>" + "<ul>" + "<li>x</li>" * (i % 3) + "</ul>" + ("<div class=odd>o</div>" if i == 4 else "") + ("<section class=s><p>Own text of page %d</p></section>" % i if i % 4 else "") + "<div class=end>Bye</div></body>"
    for n in (1, 2, 9, 13):
        pages = [page(i) for i in range(n)]
        vectors, chars = {}, {}
        for i, x in enumerate(pages):
            count, some = html.page_tokens(x)
            for t, c in count.items():
                vectors.setdefault(t, [0] * n)[i] = c
                chars[t] = chars.get(t, 0) + some.get(t, 0)
        want: dict = {}
        for t, v in vectors.items():
            if 2 * sum(c > 0 for c in v) >= n:
                want.setdefault(tuple(v), set()).add(t)
        while bad := [v for v, ts in want.items() if any(t and html._parent(t) not in set().union(*want.values()) for t in ts)]:
            for v in bad:
                del want[v]
        tokens = {t: (sum(c > 0 for c in v), hash(tuple(v))) for t, v in vectors.items()}
        assert {frozenset(ts) for ts in html.valid_classes(tokens, n).values()} == {frozenset(ts) for ts in want.values()}
        assert not any("odd" in t for ts in want.values() for t in ts) or n < 9
        if n >= html.SUPPORT:
            made = html.templates(spark.createDataFrame([(i, f"http://h/{i}", x, i) for i, x in enumerate(pages)], "page_id long, url string, html string, row long")).collect()
            root, texts = html.template({t: (*x, chars[t]) for t, x in tokens.items()}, n)
            assert [(r.host, r.n, r.root, sorted(r.texts)) for r in made] == [("h", n, root, sorted(texts))] and root == "body/section.s" and len(texts) == 2


def test_nested_lists_stay_in_the_article_and_names_must_say_nothing_else():
    body = "<div class='tags-explained'>One</div><div class='search-results-intro'>two</div><div class=side>three</div><div class='banner-story'>four</div><p>five <math><mi>x</mi></math></p>"
    assert html.extract(f"<body><nav>Menu</nav><article>{body}<div class='related-links'>no</div><div class='ad-box-2'>no</div></article></body>") == "One\ntwo\nthree\nfour\nfive x"


def test_templates_beyond_a_broadcast(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3 * (i % 2)}.test/{i}", page(i, f"<article><p>Text {i}</p></article>")) for i in range(40)]
    want = run(spark, rows)
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    assert run(spark, rows) == want == {i: f"Text {i}" for i in range(40)}


def test_a_very_long_page(spark):
    text = "word " * 200_000
    assert run(spark, [(1, "http://a/", f"<article><p>{text}</p></article>"), (2, "http://a/", "<article><p>x</p></article>")]) == {1: text.strip(), 2: "x"}
