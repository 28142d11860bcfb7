import numpy as np

from plumbline.llm import html


def text(h):
    own = html.blocks(h)
    kind = html.MARKED if any(k == html.MARKED for _, k in own) else html.PLAIN
    return "\n".join(t for t, k in own if k == kind)


def test_article_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a>Menu</a></ul></nav>
    <!-- <p>no</p> --><div class="ad">Buy</div><article><h1>Head &amp; <i>tail</i></h1><p><b>Bold&nbsp;text<br><p>Next&#33;   line
    two<p>x &lt;b&gt; y</p><aside>Side</aside><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><form><p>f</p></form><section id="comments"><p>I think</p></section></article>
    <footer>&copy; x</footer></body></html>"""
    assert text(page).split("\n") == ["Head & tail", "Bold text", "Next! line two", "x <b> y", "one", "two", "a", "b"]


def test_words_in_class_names():
    story = "<h1>Head</h1><p>The story</p>"
    for open_, close in (('<div class="layout has-sidebar">', "</div>"), ('<main class="with-toc">', "</main>"), ('<article class="post comments-open">', "</article>"), ("<div id=pageWithSidebar>", "</div>"), ('<div class="no-ads"><article>', "</article></div>")):
        assert text(open_ + story + close) == "Head\nThe story"
    # A name of its own doesn't drop the page's article either, but what it names within the article goes.
    for open_, close in (('<div class="sidebar"><article>', "</article></div>"), ('<article class="widget">', "</article>"), ('<div class="overlay"><main><div class="promo"><article>', "</article></div></main></div>")):
        assert text(f'<p>outside</p>{open_}{story}<div class="ad">Buy</div>{close}') == "Head\nThe story"
    comments = '<div id="comments"><article class="comment-body"><p>I think</p></article></div><div class="related-posts"><article><p>Teaser</p></article></div>'
    assert text(f"<article>{story}{comments}</article>") == text(f"<main>{story}</main>{comments}") == text(f"{comments}<main>{story}</main>") == "Head\nThe story"
    assert text('<nav class="x"><article>n</article></nav><p>v</p>') == "v"
    for name in ("sidebar", "site-footer", "commentList", "ad-2", "nav_bar", "main-nav", "x ads", "search-form"):
        assert text(f'<div class="{name}">Named</div><p>v</p>') == "v"


def test_odd_pages():
    assert text("") == "" and text("plain  text") == "plain text"
    assert text("<p>a<p>b</div></p>c") == "a\nb\nc"
    assert text("<script>x") == "" and text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert text("<article><p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><object>no player</object><p hidden>h</p><svg><style>p{}</style><text>drawn</text></svg><template>t</template></article>") == "a x=2\nno player\nh\ndrawn"
    assert text("<article><header><h1>T</h1></header><p>x</p></article><p>outside</p>") == "T\nx"
    for long in ("<div>" * 30000 + "deep", "<i>" * 30000 + "deep" + "</b>" * 30000, "<i>" * 30000 + "<p>" * 30000 + "deep", "<b><div>" * 9000 + "deep" + "</b>" * 30000, "<td>" * 20000 + "deep"):
        assert text(long) == "deep"
    assert text("<p title='a>b'>q</p>&unknown; &#x41;") == "q\n&unknown; A"


def test_repeated_runs_against_brute_force():
    rng = np.random.default_rng(0)
    streams = [rng.integers(1, 4, rng.integers(0, 40)).astype(np.uint64) for _ in range(12)]
    got = html.repeated(streams, run=5, pages=3)
    for i, s in enumerate(streams):
        want = np.zeros(len(s), bool)
        for k in range(len(s) - 4):
            own = s[k : k + 5].tobytes()
            if sum(any(t[j : j + 5].tobytes() == own for j in range(len(t) - 4)) for t in streams) >= 3:
                want[k : k + 5] = True
        assert (got[i] == want).all()


def test_host_boilerplate(spark):
    menu, foot = "<div>Home News Sport Weather and more</div>", "<div>All rights are reserved by us here</div>"
    rows = [(i, f"http://h.example/{i}", f"{menu}<p>unique{i} story{i} told{i} once{i} only{i}</p>{foot}", "x") for i in range(6)]
    rows += [(50, "http://h.example/copy", rows[0][2], "x"), (60, "http://other.example/", f"{menu}<p>alone</p>", "x"), (70, None, None, "x"), (None, "http://h.example/", "<article><p>main</p></article>" + menu, "x"), rows[1]]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert all(by[i] == f"unique{i} story{i} told{i} once{i} only{i}" for i in range(6))
    assert by[50] == by[0] and by[60] == "Home News Sport Weather and more\nalone" and by[70] == "" and by[None] == "main"


def test_empty(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_runs_of_a_whole_wide_host(spark):
    """A host dealt into groups keeps the verdict it has in one group, and that of counting by hand."""
    rng = np.random.default_rng(1)
    said = lambda i: " ".join(f"w{x}" for x in rng.integers(0, 10**6, 8)) + f" own{i}"
    often = [" ".join(f"{name}{j}" for j in range(6)) for name in ("menu", "foot", "twice")]
    pages = []
    for i in range(90):
        own = [said(i), *(t for t, at in zip(often, ({5, 41, 77}, set(range(60)), {3, 88})) if i in at)]
        pages.append((i, own))
    pages += [(100 + i, pages[9][1] + ["copied words of one page only"]) for i in range(40)]
    html_of = lambda own: "".join(f"<div>{t}</div>" for t in own)
    rows = [(i, "http://h.example/", html_of(own)) for i, own in pages] + [(200, "http://h.example/m", f"<article>{often[2]}</article>"), (201, "http://g.example/", html_of(often))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    runs = {}
    for _, own in [*pages, (200, [often[2]])]:
        words = " ".join(own).split()
        for k in range(len(words) - 3):
            runs.setdefault(tuple(words[k : k + 4]), set()).add(tuple(words))
    want = {200: often[2], 201: "\n".join(often)}
    for i, own in pages:
        words = " ".join(own).split()
        hit = {j for k in range(len(words) - 3) if len(runs[tuple(words[k : k + 4])]) >= 3 for j in range(k, k + 4)}
        at, kept = 0, []
        for t in own:
            size = len(t.split())
            if sum(j not in hit for j in range(at, at + size)) > min(html.UNIQUE, size - 1):
                kept.append(t)
            at += size
        want[i] = "\n".join(kept)
    assert any("menu" in " ".join(own) for _, own in pages) and not any("menu" in t or "foot" in t or "twice" in t for i, t in want.items() if i < 200)
    for size in (4, 32, 10**6):
        assert {r["page_id"]: r["text"] for r in html.extract(df, group_pages=size).collect()} == want
