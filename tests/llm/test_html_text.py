"""Main text of pages: hand-made cases, and pages built from known articles."""

import random

import pytest

from gustlab.llm import html_text as H

CASES = [
    (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""), ("<p>Short.</p>", "Short."),
    ("just text", "just text"), ("a < b &amp; c", "a < b & c"),
    ("<article><h1>T &eacute;</h1><p>a<b>b</b>\n c<br>d</p><p>&nbsp; </p><p>e</article>", "T é\n\nab c d\n\ne"),
    ("<nav>menu</nav><main><p>one<p>two</main><footer>f</footer>", "one\n\ntwo"),
    ("<script>var t='</p><p>x';</script><article><p>y</p><style>p{}</style><!-- <p>z</p> --></article>", "y"),
    ("<article><p>&amp;lt; once</p></article>", "&lt; once"),
    ('<article><p title="a > b">x</p><div class="ad">buy</div><p>y</p></article>', "x\n\ny"),
    ('<article><p>x</p><section id="comments"><article><p>me too</p></article></section></article>', "x"),
    ('<div class="sidebar-left"><p>s</p></div><article>t<aside>n</aside></article><div role="alert">z</div>', "t"),
    ("<article><p>x</p><form><input><button>b</button><label>l</label></form><ul><li>i<li>j</ul></article>", "x\n\ni\n\nj"),
    ("<article><p>cut off <b>mid", "cut off mid"), ("<article><p>cut <a hre", "cut"), ("<article><p>end &am", "end &am"),
    ("<ARTICLE><P CLASS=lead>Upper</P></ARTICLE>", "Upper"),
    ("<article><header><h1>Title</h1></header><p>x</p><footer>by me</footer></article>", "Title\n\nx"),
    ("<header><h1>Site</h1></header><article><p>x</p></article>", "x"),
    ("<article><p>x</p><p hidden>h</p><p style='display: none'>i</p></article>", "x"),
    ("<div class='site-header'><p>Site</p></div><article><div class='article-header'><h1>T</h1></div><p class=side-by-side>x</p></article>", "T\n\nx"),
    ("<article><p>x</p><div class='newsletter-signup'>s</div><div class=post_comments><p>c</p></div><p>y</p></article><div id=cookie-notice>k</div>", "x\n\ny"),
    ("<article><table><tr><td>a<td>b</table></article>", "a\n\nb"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert H.main_text(page) == text


KEPT = [
    ("<article><h1><a href=/t>Title</a></h1><p>x</p></article>", "Title\n\nx"),
    ("<article><p>x</p><p><a href=/y>All of it a link</a></p></article>", "x\n\nAll of it a link"),
    ("<article><p>x</p><ol><li><a href=/a>Smith 2010</a><li><a href=/b>Lee 2011</a></ol></article>", "x\n\nSmith 2010\n\nLee 2011"),
    ("<main><p>x</p><ul><li><a href=/a>On the origin of species</a><li><a href=/b>A history of the tides</a></ul></main>",
     "x\n\nOn the origin of species\n\nA history of the tides"),
    *[(f"<article><p>x</p><section {k}={w}><h2 id={w}>H</h2><p>y</p></section></article>", "x\n\nH\n\ny") for k in ("id", "class")
      for w in ("discussion", "related-work", "social-history", "privacy-notice", "disclaimer", "share", "hidden", "menu")],
    ("<article id=discussion><p>x</p></article>", "x"),
    ("<article><h2 id=comments>Comments</h2><p>x</p></article>", "Comments\n\nx"),
    ("<article><p>E <math><mi>m</mi><mo>=</mo><mn>2</mn></math>.</p></article>", "E m=2."),
    ("<article><p>x</p><math display=block><mi>m</mi></math><p>y</p></article>", "x\n\nm\n\ny"),
    ("<article><math><mi>m</mi><p>in it</p></math></article>", "m\n\nin it"),
    ("<article><p>x</p><div class=related><h3>More</h3><p><a href=/a>Another story</a></p></div><p>y</p></article>", "x\n\ny"),
    ("<article><p>x</p><div class='share social'><p>Tell it</p></div><p>y</p></article>", "x\n\ny"),
    ("<article><p>x</p><ul><li><a href=/>Home</a><li><a href=/b>Next</a></ul><div><a>Mail</a> <a>Print</a></div></article>", "x"),
    ("<article><p>x</p><div class=notice role=alert>n</div></article>", "x"),
]


@pytest.mark.parametrize("page,text", KEPT)
def test_article_text_is_kept_whole(page, text):
    assert H.main_text(page) == text


HARD = [
    ("<article><p data-x=it's>A</p><p>B</p></article>", "A\n\nB"),
    ("<article><p><a href=x?q=\"a>A</a></p><p>B</p></article>", "A\n\nB"),
    ("<article><p 'a>A</p><p>B's</p></article>", "A\n\nB's"),
    ("<article><p a = 'x > y' b= c>A</p><p>B</p></article>", "A\n\nB"),
    ("<article><p>First <select><option>One<option>Two</select> end.</p><p>Second</p></article>", "First end.\n\nSecond"),
    ("<article><p>First <select><option>One</option><optgroup><option>Two</option></optgroup></select> end.</p></article>", "First end."),
    ("<article><p>First <select><option>One<input> end.</p><p>Second</p></article>", "First end.\n\nSecond"),
    ("<article><p>First <svg><title>icon</title><g><path d='M0'/></g></svg> tail</p></article>", "First tail"),
    ("<article><p>First <svg><path><p>Second</p></article>", "First\n\nSecond"),
    ("<article><p>First <svg><foreignObject><div>in it</div></foreignObject></svg> tail</p></article>", "First tail"),
    ("<article><p>First <object><p>no plugin</p></object> tail</p></article>", "First tail"),
    ("<article><p>First <video><source><div>old</div></video> tail <button><div>b</div></button></p></article>", "First tail"),
    ("<article><p>First <button>b</p><p>Second</p></article>", "First\n\nSecond"),
    ("<article><p>A<!-->B<!--->C<!-- D --!>E</p></article>", "ABCE"),
    ("<body><form id=aspnetForm><nav>m</nav><article><p>A</p><form><p>f</p></form><p>B</p></article></form>", "A\n\nB"),
    ("<body><article><p>A</p><form><p>Your mail</p><input></form></article>", "A"),
    ("<article><section class=ad-hoc><p>A</p></section><section id=cookies><p>B</p></section></article>", "A\n\nB"),
    ("<article><p>A</p><div class=ad-slot><p>x</p></div><div class=top-ad>y</div><div class=ads>z</div><div id=cookie-notice>n</div></article>", "A"),
    ("<article><p>A <span hidden>h</span>b <i aria-hidden=true>i</i><span style='display:none'>n</span><noscript>s</noscript>"
     "<span class=advert>buy</span> c</p></article>", "A b c"),
    ("<article><p>A <span class=advert>buy</p><p>B</p></article>", "A\n\nB"),
    ("<article><p>A</p><noscript><p>no</p></noscript><p>B</p></article>", "A\n\nB"),
    ("<article><ul><li>a <svg><title>t</title></svg><li>b</ul></article>", "a\n\nb"),
    ("<article><table><tr><td>a <select><option>x</select><td>b<tr><td>c</table></article>", "a\n\nb\n\nc"),
]


@pytest.mark.parametrize("page,text", HARD)
def test_markup_as_the_standard_reads_it(page, text):
    assert H.main_text(page) == text


def test_planted_articles_in_hard_markup():
    """Pages built piece by piece, so the article is known: what stands visible in it, and nothing else."""
    g = random.Random(11)
    word = lambda: g.choice(["alpha", "b&amp;b", "été", "x &lt; y", "it's", "\"q\"", "3 > 2"])
    attr = lambda: g.choice(["", " class=lead", " data-x=it's", " title='a > b'", " href=x?q=\"a", " a = b", " x=\"'\""])
    import html

    def inline(deep=0):
        """(markup, visible text)"""
        k = g.randrange(12 if deep < 2 else 1)
        w = " ".join(word() for _ in range(g.randrange(1, 5)))
        if k < 5:
            return w, w
        if k == 5:
            a, b = inline(deep + 1)
            t = g.choice(["b", "i", "em", "span", "a", "code"])
            return f"<{t}{attr()}>{a}</{t}>", b
        hidden = ["<!-->", "<!--->", f"<!-- {w} <p> -->", f"<svg><title>{w}</title><path d='M0'/></svg>", f"<button{attr()}>{w}</button>",
                  f"<select><option>{w}<option>{w}</select>", f"<span hidden>{w}</span>", f"<i aria-hidden=true>{w}</i>",
                  f"<noscript><p>{w}</noscript>", f"<span class=advert>{w}</span>", f"<script>'<p>{w}'</script>",
                  f"<object><p>{w}</p></object>", "<img alt='x > y'>", f"<video><div>{w}</div></video>", "<input value=it's>"]
        return g.choice(hidden), ""

    for i in range(500):
        body, want = [], []
        for _ in range(g.randrange(1, 6)):
            parts = [(w := word(), w)] + [inline() for _ in range(g.randrange(6))]
            markup, seen = " ".join(a for a, _ in parts), " ".join(b for _, b in parts)
            body.append(g.choice([f"<p{attr()}>{markup}</p>", f"<p>{markup}", f"<div{attr()}>{markup}</div>", f"<section><p>{markup}</section>"]))
            want.append(" ".join(html.unescape(seen).split()))
        page = f"<!doctype html><html><head><title>t</title></head><body>{{}}<nav><a{attr()}>menu</a></nav><article>{''.join(body)}</article><footer>f</footer>{{}}"
        page = page.format(*g.choice([("", ""), ("<form id=f>", "</form>"), ("<div class=wrap>", "</div>"), ("<form>", "")]))
        assert H.main_text(page) == "\n\n".join(want), page


def test_time_grows_with_the_page():
    import time

    def took(page):
        begin = time.perf_counter()
        H.main_text(page)
        return time.perf_counter() - begin

    for make in (lambda n: "<span>" * n + "x</i>" * n, lambda n: "<svg>" + "<g>" * n + "</b>" * n, lambda n: "<p>" + "<b>x<hr>" * n,
                 lambda n: "<table>" + "<tr><td>x" * n, lambda n: "<!" * n, lambda n: "<a b='" * n, lambda n: "<script>" * n,
                 lambda n: "<p a=\"x" * n, lambda n: "<form>" * n + "<article>" * n):
        small = min(took(make(5_000)) for _ in range(3))
        assert min(took(make(40_000)) for _ in range(2)) < 30 * small + 0.2


def test_very_long_and_badly_nested_pages():
    assert H.main_text("<article>" + "<p>word " * 100_000) == "\n\n".join(["word"] * 100_000)
    assert len(H.main_text("<article><p>" + "x" * 3_000_000)) == 3_000_000
    assert H.main_text("<b><i><p></b>x</i></table></p></div></article>") == "x"
    assert H.main_text("</p></svg></select><article></nav>x") == "x"


def test_line_blocks_without_an_article_element():
    paras = ["word " * 40 + str(i) for i in range(4)]
    page = ("<div><a href=/>Home</a> <a href=/x>About us and more</a></div><div>Log</div><br>"
            + "".join(f"<p>{p}</p>" for p in paras) + "<div><a>Next page of the list</a></div><div><a>Other</a></div><div><a>x</a></div><p>(c)</p>")
    assert H.main_text(page) == "\n\n".join(" ".join(p.split()) for p in paras)


def test_regions():
    import numpy as np

    assert H.regions(np.array([5, 0, 0, 0, 90, 3, 0, 50, 0, 0, 0, 9]), 86).tolist() == [False, False, True, True, True, True, True, True, False, False, False, False]
    assert not H.regions(np.zeros(0, int), 0).any()


def test_query_over_planted_pages(spark):
    g = random.Random(5)
    rows, want = [], {}
    for i in range(60):
        paras = [" ".join(g.choice(["alpha", "b&b", "été", "x<y"]) for _ in range(g.choice([1, 3, 30]))) for _ in range(g.randint(1, 6))]
        esc = [p.replace("&", "&amp;").replace("<", "&lt;") for p in paras]
        body = "".join(g.choice([f"<p>{p}</p>", f"<p>{p}", f"<div class='text'>{p}</div>"]) for p in esc)
        page = (f"<html><head><title>t</title></head><body><nav><a>m</a></nav><div class='cookie-banner'>ok?</div><article>{body}"
                f"</article><div class='comments'><p>nice</p></div><footer>f</footer></body></html>")
        rows.append((i, f"u{i}", page))
        want[i] = "\n\n".join(paras)
    rows += [(100, None, None), (None, "u", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in H.extract(df, keep=["page_id", "url"]).collect()}
    assert {i: r["text"] for i, r in got.items()} == {**want, 100: "", None: "x"}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert H.extract(df.limit(0)).collect() == []
    clash = H.extract(df.withColumnRenamed("url", "Text"))
    assert clash.columns == ["page_id", "html", "text", "n_chars"] and clash.count() == 62
