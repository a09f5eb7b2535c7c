import random
import time

import pytest

from momentlake.llm import html_extract as H


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b &lt;c&gt;&nbsp;&#233;", "a\n\nb <c> é"),
        ("<div class='top-nav'>x</div><p>a\n  b</p><script>var x='<p>no</p>'</script>", "a b"),
        ("<header>h</header><article><header><time>t</time><h1>T</h1></header><p>a<b>b</b><br>c</p><div class=ad>z</div><ul><li>q<li>r</ul><section id=comments><p>no</p></section></article><aside>s</aside><footer>f</footer>", "T\n\nab c\n\nq\n\nr"),
        ("<main><p>x</p><form><input>f</form></main><p>out</p>", "x"), ("<body class='has sidebar'><div id=content><p>k</p></div><div class='sidebar'>s</div></body>", "k"),
        ("<p>a<!-- b --><style>p{}</style>c", "ac"), ("<div hidden>x</div><div style='display: none'>y</div>z", "z"), ("<p>1 < 2</p>", "1 < 2"), ("<p>open", "open"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), ("<div class=cookie-notice>c</div><div role=navigation>n</div><p>t</p>", "t"), ("<article><p>a</p></article><article class=comment><p>b</p></article>", "a"),
        ("<article><p>a</p><section id=comments><article><p>b</p></article></section></article><aside><article><p>c</p></article></aside>", "a"),
        ("<form id=page><article class='has-comments'><p>a</p></article></form>", "a"), ("<article hidden><p>a</p></article><p>b</p>", "b"),
        ("<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000 + "<p>after</p>", "deep\n\nafter"), ("<b>" * 5000 + "x y", "x y"), ("<ul><li>q" * 3000, "\n\n".join(["q"] * 3000)),
    ],
)
def test_main_text(page, text):
    assert H.main_text(page) == text


def test_alignment_is_the_largest():
    a = H.skeleton(H.parse("<html><body><nav><ul><li>a<li>b</ul></nav><article><h1>x</h1><p>a<p>b</article><footer>f</footer></body></html>"))
    b = H.skeleton(H.parse("<html><body><header>h</header><nav><ul><li>a</ul></nav><div class=x>x</div><article><h1>x</h1><p>a</article><footer>f</footer></body></html>"))
    labels = lambda t: {n[2]: n[0] for n in walk(H._tree(t))}

    def walk(n):
        yield n
        for c in n[1]:
            yield from walk(c)

    to = H.align(a, b)
    assert all(labels(a)[k] == labels(b)[v] for k, v in to.items()) and len(to) == len(labels(a))
    assert H.align(a, a) == {k: k for k in H.align(a, a)}


def test_constant_slots_are_template(spark):
    page = lambda n, extra: f"<html><body><div class=box>Shop now</div><div class=txt><p>story {n} here</p></div>{extra}</body></html>"
    rows = [(i, f"http://a.net/{i}", page(i, "<div class=end>all rights</div>"), "h") for i in range(30)]
    rows += [(100, "http://b.net/1", page(1, ""), "h"), (101, None, None, None), (None, "http://a.net/x", page(99, ""), "h"), (102, "http://a.net/y", "", "h"), (3, "http://a.net/3", page(3, "<div class=end>all rights</div>"), "h")]
    got = {}
    for r in H.extracted_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)).collect():
        got.setdefault(r.page_id, []).append(r)
    assert all(got[i][0].text == f"story {i} here" for i in range(30)) and len(got[3]) == 2
    assert got[100][0].text == "Shop now\n\nstory 1 here" and got[101][0].text == "" and got[None][0].text == "story 99 here"
    assert all(r.n_chars == len(r.text) for v in got.values() for r in v)


def test_copies_of_an_article_stay(spark):
    page = "<html><body><article><h1>One</h1><p>same text everywhere</p></article></body></html>"
    rows = [(i, "http://a.net/", page.replace("One", f"One {i % 20}")) for i in range(60)]
    got = H.extracted_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text.endswith("same text everywhere") for r in got)


def test_empty(spark):
    assert H.extracted_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize(
    "inner, text",
    [
        ("<section id='related-work'><p>a</p></section><section id=search-results><p>b</p></section><section id=search>c</section>", "a\n\nb\n\nc"),
        ("<h2 id=cookie-policy-history>h</h2><h3 id=search class=menu>k</h3>", "h\n\nk"), ("<div class='post-header'><h1>T</h1></div><div class=entry-header>u</div>", "T\n\nu"),
        ("<p>x <math><mi>y</mi></math> z</p>", "x y z"), ("<p>a</p><div class=share>s</div><section class=related>r</section><article class=teaser>t</article>", "a"),
    ],
)
def test_slugs_inside_an_article_stay(inner, text):
    assert H.main_text(f"<article>{inner}</article>") == text == H.main_text(f"<main>{inner}</main>")


@pytest.mark.parametrize(
    "page, text",
    [
        ("<main><h1>h</h1><p>long body</p><article class=card>teaser</article></main>", "h\n\nlong body\n\nteaser"),
        ("<main><article><p>a</p></article><article><p>b</p></article></main>", "a\n\nb"), ("<main></main><article>a</article>", "a"),
        ("<div class=entry>long first part</div><p>x</p><div class=entry>second</div>", "long first part\n\nsecond"),
        ("<div id=content><div class=post>one</div><div class=post>two</div></div>", "one\n\ntwo"), ("<div itemprop=articleBody>b</div><div class=post>c</div>", "b"),
    ],
)
def test_all_main_parts_are_read(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("tag", ["article", "div"])
def test_mirrored_copies_make_no_template(spark, tag):
    """Copies of one text count once, whatever their menus and dates; lists and quotes stay as paragraphs do."""
    body = f"<{tag}><h1>One</h1><p>the same long text everywhere on this host</p><ul><li>item</ul><blockquote>quote</blockquote></{tag}>"
    rows = [(i, "http://a.net/", f"<body><nav>menu {i}</nav>{body}</body>") for i in range(40)]
    rows += [(100 + i, "http://a.net/", f"<body><nav>menu</nav>{body.replace('long', f'long and quite different {i}')}</body>") for i in range(4)]
    got = H.extracted_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 44 and all("One" in r.text and "item" in r.text and r.text.endswith("quote") for r in got)


def test_two_layouts_of_a_host_have_templates_each(spark):
    one = lambda n: f"<body><div class=box>Shop now</div><div class=txt><p>story {n} here</p></div></body>"
    two = lambda n: f"<body><table class=forum><tr><td class=rules>Be kind</td></tr><tr class=b><td class=said>word {n} said</td></tr></table></body>"
    rows = [(i, "http://a.net/", one(i) if i % 5 < 3 else two(i)) for i in range(50)]
    got = H.extracted_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"story {i} here" if i % 5 < 3 else f"word {i} said" for i in range(50)}


@pytest.mark.parametrize("deep", [150, 300, 5000])
def test_text_after_deep_nesting_stays(deep):
    page = "<div id=wrap><article><p>a</p>" + "<div>" * deep + "in" + "</div>" * deep + "<p>after</p></article></div>"
    assert H.main_text(page) == "a\n\nin\n\nafter"


def test_names_touch_no_part_of_a_line_and_no_words_of_an_article():
    inner = '<p>Buy <span class="share">shares</span> of <span class=related>related</span> firms <i hidden>x</i>now</p><div class="form">The form of the poem</div><p>end</p><div class=form><input>Name</div>'
    assert H.main_text(f"<article>{inner}</article>") == "Buy shares of related firms now\n\nThe form of the poem\n\nend"


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a x=">"' * 120_000, '<a ">"' * 150_000, "<div>" * 100_000, "<b>" * 100_000 + "<p>" * 100_000, "<!x" * 300_000, "<b>" * 150_000 + "</p>" * 150_000], ids=range(7))
def test_long_broken_pages_take_linear_time(page):
    began = time.process_time()
    H.main_text(page)
    assert time.process_time() - began < 20  # a few seconds; minutes or hours if squares were at work


def test_alignment_of_many_siblings():
    tree = lambda n: "body(" + ",".join(f"div.c{i % n}" for i in range(5000)) + ")"
    began = time.process_time()
    assert len(H.align(tree(7), tree(5))) > 2500 and time.process_time() - began < 5


def test_alignment_against_brute_force():
    """The size of the alignment is the best over all ways to match children in order."""
    rng = random.Random(5)

    def tree(depth):
        return rng.choice("ab"), [tree(depth - 1) for _ in range(rng.randrange(4) if depth else 0)]

    def text(t):
        return t[0] + (f"({','.join(map(text, t[1]))})" if t[1] else "")

    def brute(a, b):
        if a[0] != b[0]:
            return 0

        def rest(i, j):
            if i == len(a[1]) or j == len(b[1]):
                return 0
            return max(rest(i + 1, j), rest(i, j + 1), brute(a[1][i], b[1][j]) + rest(i + 1, j + 1))

        return 1 + rest(0, 0)

    for few in (H.FEW, 0):
        H.FEW, kept = few, H.FEW
        for _ in range(150):
            a, b = ("a", [tree(2) for _ in range(4)]), ("a", [tree(2) for _ in range(4)])
            H.align.cache_clear()
            to = H.align(text(a), text(b))
            assert len(to) == brute(a, b) and len(set(to.values())) == len(to)
            up = list(to.items())
            assert up == sorted(up) or all((k < m) == (v < w) for k, v in up for m, w in up)
        H.FEW = kept


def brute_template(pages):
    """Slots of one layout with the same text on 80% of its different pages, 8 at least."""
    different = {}
    for p in pages:
        signature, blocks = H.read(p)
        texts = {}
        for b in blocks:
            texts.setdefault(b.slot, []).append(b.text)
        different.setdefault(H._slots(p)[2], {k: "\n".join(v) for k, v in texts.items()})
    found = set()
    for slot in {k for t in different.values() for k in t}:
        held = [t.get(slot) for t in different.values()]
        most = max(held.count(x) for x in held if x is not None)
        if most >= max(8, 0.8 * len(different)):
            found.add(slot)
    return found


def test_templates_against_brute_force(spark):
    """The template decides inside and outside of an article; the result is that of counting slots by hand."""
    page = lambda n: f"<body><div class=top>Shop now</div><article><h1>Title {n}</h1><p>story {n} of many words goes on here</p><div class=ask>Send us your story</div></article><div class=end>{'bye' if n % 10 else n}</div></body>"
    pages = [page(n) for n in range(40)]
    rows = [(n, "http://a.net/", p) for n, p in enumerate(pages)]
    template = frozenset(brute_template(pages))
    got = {r.page_id: r.text for r in H.extracted_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: H.main_text(p, template) for n, p in enumerate(pages)}
    assert got[3] == "Title 3\n\nstory 3 of many words goes on here" and H.main_text(pages[3]).endswith("Send us your story")


def test_what_varies_wins_over_a_marked_teaser(spark):
    page = lambda n: f"<body><article class=card>Read our offer</article><div class=txt><p>story {n} is long and told in many words</p></div></body>"
    rows = [(n, "http://a.net/", page(n)) for n in range(20)]
    got = {r.page_id: r.text for r in H.extracted_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"story {n} is long and told in many words" for n in range(20)}


def test_templates_beyond_the_broadcast(spark, monkeypatch):
    page = lambda n: f"<body><div class=box>Shop now</div><div class=txt><p>story {n} here</p></div></body>"
    rows = [(n, "http://a.net/" if n % 3 else None, page(n)) for n in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, H.extracted_pages(pages).collect()), key=str)
    monkeypatch.setattr(H, "MOST_BROADCAST", -1)
    assert sorted(map(tuple, H.extracted_pages(pages).collect()), key=str) == want and all(r[2].startswith("story") for r in want)


def test_headings_and_lines_that_articles_share_stay(spark):
    """Thirty pages of a host: what recurs inside their articles stays unless a name or its place at the rim speaks against it."""
    say = lambda n, k: f"Text {n} of part {k} tells something of its own, and more of {n * 7 + k}."
    page = lambda n: (
        f"<body><article><h1>Title {n}</h1><h2>Background</h2><div><p>{say(n, 1)}</p></div><div class='ad-unit'><div>Buy our things now</div></div><h2>Method</h2><p>{say(n, 2)}</p>"
        f"<section>Shared between all articles.</section><h3>Results</h3><p>{say(n, 3)}</p><div>All rights reserved, follow us.</div></article></body>"
    )
    pages = spark.createDataFrame([(n, f"http://h.example/{n}", page(n)) for n in range(30)], "page_id long, url string, html string")
    for r in H.extracted_pages(pages).collect():
        n = r.page_id
        assert r.text.split("\n\n") == [f"Title {n}", "Background", say(n, 1), "Method", say(n, 2), "Shared between all articles.", "Results", say(n, 3)]
