import itertools
import random

import pytest
from pyspark.sql import functions as F

from careflow.llm.maincontent import blocks, content_cost, extract_main_text, main_text, min_cut

LONG = "This is a long line of text that speaks about many things. " * 6

PAGES = {
    "article with a footer and adverts": (
        "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script><style>p{}</style></head><body><nav><ul>"
        "<li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy this. Now!</div>"
        "<article><h1>Head &amp; line</h1><p><b>Head line again.<br><p>First  part,\n two lines.</p><p>Next &quot;part&quot;.</p>"
        "</article><footer>&copy; site &middot; Words of the footer.</footer></body></html>",
        'Head & line Head line again. First part, two lines. Next "part".',
    ),
    "sidebar, comments, form and cookie notice": (
        f"<body><header><a href=/>Site</a><p>Best site, founded in 1990.</p></header><div id=main class=content><div class='side"
        f"bar'><p>{LONG}</p></div><h1>Title</h1><p>Short.</p><p>{LONG}</p><blockquote>Quoted words.</blockquote><ul><li>first "
        "point</li><li>second point</li></ul></div><section id=comments><h2>Comments</h2><article><p>I like it a lot, it is good."
        "</p></article></section><form><label>Name</label><input><textarea>x</textarea><button>Send</button></form>"
        "<div class='cookie-notice'>We use cookies to improve.</div><footer>Copyright 2020</footer>",
        f"Title Short. {LONG.strip()} Quoted words. first point second point",
    ),
    "no containers, unclosed paragraphs, a table": (
        "<title>x</title><p>Para one<p>Para two <b>bold</b> te<i>xt</i><noscript>enable</noscript><table><tr><td>a<td>b</table>",
        "Para one Para two bold text a b",
    ),
    "cut off in the middle of a tag": ("<body><article><p>Some words here.</p><p>And the la<a hre", "Some words here. And the la"),
    "hidden parts": ("<main><p>Seen.</p><p hidden>Not.</p><div style='display: none'>Nor this.</div><p>x &lt; y</p></main>", "Seen. x < y"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, text = PAGES[name]
    assert main_text(page) == text


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 8)
        gain = [round(rng.uniform(-3, 3), 2) for _ in range(n)]
        edges = [(a, b, round(rng.uniform(0, 2), 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]

        def cost(kept):
            lost = sum(max(z, 0) if not k else max(-z, 0) for z, k in zip(gain, kept, strict=True))
            return lost + sum(c for a, b, c in edges if kept[a] != kept[b])

        best = min(map(cost, itertools.product((True, False), repeat=n)))
        assert abs(cost(min_cut(gain, edges)) - best) < 1e-6


def test_neighbours_decide_for_short_blocks():
    # 'ok' alone would be boilerplate; between content it stays
    assert min_cut([3.0, -0.5, 3.0], [(0, 1, 0.6), (1, 2, 0.6)]) == [True, True, True]
    assert min_cut([-3.0, 0.5, -3.0], [(0, 1, 0.6), (1, 2, 0.6)]) == [False, False, False]


def test_table_and_messy_rows(spark, table):
    rows = extract_main_text(table("pages")).collect()
    assert len(rows) == table("pages").count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert all(r["text"] and "track(" not in r["text"] for r in rows)
    messy = [(1, "u", None), (2, None, ""), (None, "u", "<p>Text é</p>"), (3, "u", "<<<>>> & &bogus; &#0;"), (3, "u", "no tags at all"),
             (4, "u", "<div>" * 3000 + "deep" + "</div>" * 10), (5, "u", "<p>word word.</p>" * 5000)]
    df = spark.createDataFrame(messy, "page_id long, url string, html string").withColumn("text", F.lit("z"))
    found = {(r["page_id"], r["url"]): r for r in extract_main_text(df).collect()}
    assert found[1, "u"]["text"] == found[2, None]["text"] == "" and found[None, "u"]["n_chars"] == 6
    assert found[4, "u"]["text"] == "deep"
    assert found[5, "u"]["text"] == " ".join(["word word."] * 5000)
    assert extract_main_text(df.limit(0)).count() == 0


def ancestors(node):
    out = []
    while node:
        out.append(id(node))
        node = node.parent
    return out


def nearness(a, b):
    up = {x: k for k, x in enumerate(ancestors(a))}
    return next(1 / (1 + max(0, max(k, up[x]) - 1)) for k, x in enumerate(ancestors(b)) if x in up)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>One one.</p><img alt=John's src=a.jpg><p>Two two.</p><p>It's three.</p>", "One one. Two two. It's three."),
        ('<p>One.</p><img alt=5" src=a.jpg><p>Two.</p><p>A "third" one.</p>', 'One. Two. A "third" one.'),
        ("<p>One.</p><!--><p>Two.</p><!-- no > --><p>Three.</p><!---><p>Four.</p><!--no--!><p>Five.</p>", "One. Two. Three. Four. Five."),
        ('<p>One.</p><p title="never closed>Two.</p><p>Three.</p>', "One. Two. Three."),
        ("<p>One.</p><p title = 'a > b'>Two.</p><p data-x='<p>'>Three.</p>", "One. Two. Three."),
        ("<p>One.</p><p a==b c='d'e=\"f\">Two.</p>", "One. Two."),
    ],
)
def test_quotes_and_comments_hide_no_text(page, text):
    assert main_text(page) == text


def test_deep_and_wide_pages_take_time_in_proportion():
    import time

    n = 20_000
    pages = {
        "divs": "<div>A sentence of some length. " * n,
        "inline": "<b>" * n + "<hr>Some words here. " * n,
        "crossed": "<i><b></i>A word or two. " * n,
        "closers": "<div><i><div>" + "<b>" * n + "</i></p>words. " * n,
        "flat": "<p>A sentence of some length. " * n,
    }
    for name, page in pages.items():
        started = time.perf_counter()
        text = main_text(page)
        assert time.perf_counter() - started < 5, name
        assert len(text) > 6 * n, name


def test_nearness_is_that_of_a_walk_up_the_tree(table):
    rng = random.Random(3)
    tags = ["div", "p", "li", "ul", "section", "td", "tr", "table"]
    pages = [r["html"] for r in table("pages").select("html").collect()]
    pages += ["".join(rng.choice([f"<{t}>", f"</{t}>", "word one. "]) for t in rng.choices(tags, k=60)) for _ in range(300)]
    for page in pages:
        found = blocks(page)
        assert [b.near for b in found[1:]] == [nearness(a.node, b.node) for a, b in itertools.pairwise(found)]
    # an inline element that ends between two blocks does not part them
    one, two = blocks("<div><i><b><p>One.</p></i><p>Two.</p></b></div>")
    assert two.near == nearness(one.node, two.node) == 1


def test_whole_pages_are_labelled_at_the_least_cost(table):
    """Every labelling of pages of a few blocks, with costs and edges written down anew."""
    seen = 0
    for page in [r["html"] for r in table("pages").select("html").collect()]:
        found = blocks(page)
        if not 1 < len(found) <= 13:
            continue
        seen += 1
        gain, headed = [], False
        for b in found:
            gain.append(content_cost(b, b.node.tag == "h1" and not headed))
            headed |= b.node.tag == "h1"
        edges = [(k - 1, k, 0.6 * nearness(found[k - 1].node, found[k].node)) for k in range(1, len(found))]
        for k, b in enumerate(found):
            same = [j for j in range(k) if found[j].node.parent is b.node.parent]
            if same and same[-1] != k - 1:
                edges.append((same[-1], k, 0.6 / (k - same[-1]) ** 0.5))
        best = min(
            itertools.product((True, False), repeat=len(found)),
            key=lambda kept: sum(max(-z, 0) if k else max(z, 0) for z, k in zip(gain, kept, strict=True))
            + sum(c for a, b, c in edges if kept[a] != kept[b]),
        )
        assert main_text(page) == " ".join(b.text for b, k in zip(found, best, strict=True) if k)
    assert seen > 5
