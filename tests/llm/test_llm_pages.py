"""Main text of pages: names, marks, and the style tree against brute force."""

import collections
import math

import pytest

from geosieve.llm import html as pages

SCHEMA = "page_id long, url string, html string"
STORY = "<p>One sentence of the story.<p>Another one, which is longer."
TEXT = "One sentence of the story.\nAnother one, which is longer."


@pytest.mark.parametrize("page, want", [
    (f'<div class="layout has-sidebar"><article>{STORY}</article></div>', TEXT),
    (f'<main class="no-sidebar">{STORY}</main>', TEXT),
    (f'<article class="post related-news">{STORY}</article>', TEXT),
    (f'<div id="search-page"><article>{STORY}</article></div>', TEXT),
    (f'<div class="comments"><article>{STORY}</article></div>', TEXT),
    (f'<form><div>{STORY}</div></form>', TEXT),
    (f'<article><header class="entry-header"><h1>Head</h1></header>{STORY}</article>', "Head\n" + TEXT),
    (f'<article><p class="social">Social life.</p><p id="ad-hoc">Ad hoc.</p>{STORY}</article>', "Social life.\nAd hoc.\n" + TEXT),
    ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<svg><text>no</text></svg>, always.</article>",
     "So x=2 holds, always."),
    ("<p>a <script>var x = '<p>';</script>b <select><option>no</select>c", "a b c"),
    (f"<div>{STORY}</div><article>Teaser</article>", TEXT + "\nTeaser"),
    (f'<article>{STORY}</article><div class="related"><article>Teaser</article></div>', TEXT),
    (f'<article>{STORY}<section id="commentList"><article>Reply</article></section></article>', TEXT),
    (f'<div>{STORY}</div><div class="site-footer">(c)</div><div class="cookie-banner">Yes?</div><p class="ad">Buy', TEXT),
    ("<div hidden>no</div><div role=navigation>menu</div>", ""),
    ("", ""), ("<p> \n&nbsp;", ""), ("</p></p><b>open", "open"),
])
def test_names_and_marks(page, want):
    assert pages._kept(page, set()) == want


def run(spark, rows):
    table = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], SCHEMA + ", text string, host string")
    return {r.page_id: (r.text, r.n_chars) for r in pages.main_text(table).collect()}


@pytest.mark.parametrize("n", [2, 3, 7, 12])
def test_unnamed_notice_goes_on_hosts_of_any_size(spark, n):
    rows = [(i, "http://a.example/", f"<body><div>Story {i} about {i * i}.</div><div>Accept our rules.</div>") for i in range(n)]
    rows.append((100, "http://alone.example/", "<div>Only page.</div><div>Accept our rules.</div>"))
    got = run(spark, rows)
    assert all(got[i][0] == f"Story {i} about {i * i}." for i in range(n))
    assert got[100][0] == "Only page.\nAccept our rules."


def test_the_tree_removes_branches_and_lines_of_articles(spark, monkeypatch):
    def page(i):
        menu = "".join(f"<li>Part {j}</li>" for j in range(12)) + f"<li>You are on {i}</li>"
        return f"<ul>{menu}</ul><article><p>Story {i}.<p>Subscribe to us.<p>More of story {i}.</article>"

    def unmarked(i):
        return page(i).replace("article>", "div>")

    rows = [(i, "http://a.example/", page(i)) for i in range(30)] + [(100 + i, "http://b.example/", unmarked(i)) for i in range(30)]
    got = run(spark, rows)
    for i in range(30):
        want = f"Story {i}.\nMore of story {i}."
        assert got[i][0] == got[100 + i][0] == want
    monkeypatch.setattr(pages, "LOW", 0.0)
    monkeypatch.setattr(pages, "LOW_INSIDE", 0.0)
    without = run(spark, rows)
    assert "Subscribe to us." in without[0][0] and "You are on 3" in without[103][0]


def test_an_article_that_is_the_same_on_all_pages_stays(spark):
    rows = [(i, "http://a.example/", f"<div>Menu {i}</div><article><p>The same long story everywhere.</article>") for i in range(9)]
    assert set(run(spark, rows).values()) == {("The same long story everywhere.", 31)}


def brute(rows):
    """Importances by plain recursion over merged trees: {path: (importance, highest)} and {(path, text): importance}."""
    distinct = set(rows)
    m = len(distinct)
    styles, texts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    up = {}
    for page in distinct:
        nodes, blocks = pages.parse(page, "h")
        for n in nodes:
            up[n.path] = n.up.path if n.up else None
        for path, style in {(n.path, n.style) for n in nodes if n.style}:
            styles[path][style] += 1
        for path, text in {(n.path, t) for n, t in blocks}:
            texts[path][text] += 1

    def drawn(x):
        return (m * min(x, 1) + 0.5) / (m + 1)

    weight, value = collections.Counter(), collections.Counter()
    for path, seen in styles.items():
        total = sum(seen.values())
        w = total * (1 - pages.DAMPING ** len(seen))
        weight[path] += w
        value[path] += w * drawn(-sum(c / total * math.log(c / total) for c in seen.values()) / math.log(m))
    for path, seen in texts.items():
        total = sum(seen.values())
        weight[path] += total
        value[path] += total * drawn(1 - sum(c / total * math.log(c) for c in seen.values()) / math.log(m))

    def branch(path):
        w, v, best = weight[path], value[path], 0.0
        for child in [c for c, p in up.items() if p == path]:
            cw, cv, high = branch(child)
            w, v, best = w + pages.DAMPING * cw, v + pages.DAMPING * cv, max(best, high)
        found[path] = (v / w, max(best, v / w)) if w else (None, best)
        return w, v, found[path][1]

    found = {}
    branch(next(p for p, u in up.items() if u is None))
    lone = {(p, pages._hash(t)): drawn(1 - math.log(c) / math.log(m)) for p, s in texts.items() for t, c in s.items() if c > 1}
    return {p: x for p, x in found.items() if weight[p]}, lone


def test_importances_match_brute_force(spark):
    rows = [f"<div class=k{i % 3}><p>common<p>own {i}<ul>{'<li>x' * (i % 4)}</ul></div><div>foot {i % 2}<b>!</b></div>" for i in range(7)]
    rows += rows[:2]
    table = spark.createDataFrame([(5, "h", r) for r in rows], "key long, host string, html string")
    paths, texts = pages.style_tree(table)
    want_paths, want_texts = brute(rows)
    got = {r.path: (r.importance, r.highest) for r in paths.collect()}
    assert got.keys() == want_paths.keys()
    for path, pair in want_paths.items():
        assert got[path] == pytest.approx(pair, abs=1e-9)
    lone = {(r.path, r.text): r.importance for r in texts.collect()}
    assert lone == pytest.approx(want_texts, abs=1e-9)


def test_deep_and_empty_pages(spark):
    deep = "<div>" * 3000 + "deep words"
    assert run(spark, [(1, "http://a.example", deep), (2, "http://a.example", deep + "!"), (3, None, None)])[3] == ("", 0)
    assert pages._kept(deep, set()) == "deep words"
    assert run(spark, [(1, "http://b.example", deep)])[1][0] == "deep words"
    empty = spark.createDataFrame([], SCHEMA)
    assert pages.main_text(empty).count() == 0
