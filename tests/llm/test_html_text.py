"""Site style trees against a plain recursive version, and the tree's own decisions."""

import collections
import math
import random
import time

from pyspark.sql import functions as F

from sparrel.llm import html_text
from sparrel.llm.common import table

SF = "/root/testdata/sf0.1"


def brute_entropy(counts, pages):
    """Importance from the numbers of pages that each layout or text is on."""
    n = sum(counts)
    if not n:
        return 0.0
    singles, doubles = counts.count(1), counts.count(2)
    share = min(1.0, max(2 * doubles / max(singles, 1) / pages, 1 / html_text.SCALE))
    total = sum(-math.log(share) if c == 1 and pages > 1 else math.log(html_text.SCALE) if c == 1 else c * math.log(pages / c) for c in counts)
    return min(total / n / math.log(html_text.SCALE), 1.0)


def brute_tree(pages):
    """{(host, path): [composite, most, pages]} by recursion over merged trees."""
    seen = collections.defaultdict(lambda: (set(), collections.defaultdict(set), collections.defaultdict(set)))
    parent = {}
    for host, html in pages:
        if not html:
            continue
        page = html_text.Page(html, names=False)
        told = collections.defaultdict(list)
        for text, path, _ in page.blocks:
            told[path].append(text)
        key = max(("\n".join(t) for t in told.values()), key=lambda t: (len(t), t), default=html)
        for n in page.nodes:
            parent[host, n.path] = n.parent
            layout = tuple(c for i, c in enumerate(n.layout) if not i or c != n.layout[i - 1])
            seen[host, n.path][0].add(key)
            seen[host, n.path][1][layout].add(key)
        for text, path, _ in page.blocks:
            seen[host, path][2][text].add(key)
    nodes = {}
    for at, (pages_, layouts, texts) in seen.items():
        if at in parent:
            m = len(pages_)
            nodes[at] = [m, len(layouts), len(texts), brute_entropy([len(x) for x in layouts.values()], m), brute_entropy([len(x) for x in texts.values()], m)]
    out = {}
    for (host, path), (m, layouts, texts, layout, content) in nodes.items():
        values = []
        for k, value in ((3, layout), (4, content)):
            weight = {h: x[0] ** 2 / (x[0] + html_text.PRIOR_PAGES) for (h, p), x in nodes.items() if p == path and h != host and (k == 3 or x[2])}
            prior = (html_text.PRIOR_PAGES + sum(w * nodes[h, path][k] for h, w in weight.items())) / (html_text.PRIOR_PAGES + sum(weight.values()))
            strength = html_text.PRIOR_PAGES + min(sum(weight.values()), html_text.MOST_PRIOR)
            values.append((m * value + strength * prior) / (m + strength))
        out[host, path] = [layouts, texts, *values]

    children = collections.defaultdict(list)
    for at, up in parent.items():
        children[at[0], up].append(at)

    def value(at):
        layouts, texts, layout, content = out[at]
        below = [value(c) for c in children[at]]
        parts = [b[0] for b in below] + ([content] if texts else [])
        f = html_text.GAMMA**layouts
        own = (1 - f) * layout + f * sum(parts) / len(parts) if below else content if texts else layout
        return own, max([own, *(b[1] for b in below)])

    return {at: value(at) for at in nodes}


def test_entropies_and_importance_equal_recursion(spark):
    rng = random.Random(6)
    pages = []
    for k in range(150):
        host = rng.choice(["a", "a", "a", "b", "b", "c", ""])
        menu = "".join(f"<li>{w}</li>" for w in rng.choice([["home", "news"], ["home", "shop", "about"], ["jobs", "home"]]))
        story = "".join(f"<p>{rng.choice(['shared', 'own'])} {rng.randrange(4)}<b>{rng.randrange(200)}</b></p>" for _ in range(rng.randint(0, 4)))
        pages.append((f"//{host}/{k}" if host else None, rng.choice(["", "lead"]) + f"<body><div class=m{host}><ul>{menu}</ul></div><div>{story}</div><i>same</i></body>"))
    pages += pages[:7] + [("//a/x", None), ("//a/y", ""), ("//a/z", "<p><p><p>"), ("//d/1", "<div>alone</div>")]
    rows = spark.createDataFrame(pages, "url string, html string").repartition(3)
    got = {(r["host"], r["path"]): (r["composite"], r["most"]) for r in html_text.importance(html_text.smooth(html_text.style_tree(html_text.page_stats(rows)))).collect()}
    want = brute_tree([((u or "///").split("/")[2], h) for u, h in pages])
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k][i], want[k][i], rel_tol=1e-9, abs_tol=1e-9) for k in want for i in (0, 1))


def test_the_tree_decides_without_names(spark):
    pages = table(spark, SF, "pages")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["id"]: r["text"] for r in html_text.extract(pages, names=False).collect()}
    plain = {i: html_text.Page(h or "", names=False).text() for i, h in html.items()}
    assert sum(got[i] != plain[i] for i in html) > 0.99 * len(html)
    # what is left holds no line of a menu, a notice or a footer, and all of the article
    inside = {i: html_text.Page((h or "")[(h or "").find("<article") : (h or "").find("</article>")], names=False).text() for i, h in html.items()}
    assert sum(got[i] == inside[i] for i in html) > 0.99 * len(html)


def test_few_pages_are_smoothed_not_switched(spark):
    """Menus that rotate go on a host of one page too, as other hosts have their place in the page; a place of its own stays."""
    page = "<body><div class=x>{menu}</div><div class=y><p>Story {k} is told here at some length.</p></div></body>"
    rows = [(k, f"http://big.example.com/{k}", page.format(menu=f"Menu {k % 7}", k=k)) for k in range(60)]
    rows += [(100, "http://one.example.com/", page.format(menu="Menu of another kind", k=100)), (101, "http://own.example.com/", "<body><div class=z>No other host has this</div></body>")]
    got = {r["id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), names=False).collect()}
    assert all(got[k] == f"Story {k} is told here at some length." for k in [*range(60), 100]) and got[101] == "No other host has this"


def test_copies_of_a_page_count_once(spark):
    rows = [(k, f"http://h.example.com/{k}", f"<body><div class=top>Notice {k % 9}</div><div class=story><p>{'One story in many copies. ' * 3}</p></div></body>") for k in range(30)]
    rows += [(100 + k, f"http://h.example.com/{k}x", f"<body><div class=top>Notice {k % 9}</div><div class=story><p>Another story that is number {k}, of some length.</p></div></body>") for k in range(30)]
    got = {r["id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), names=False).collect()}
    assert all("One story in many copies." in got[k] for k in range(30)) and all(got[100 + k].startswith("Another story") for k in range(30))


def test_broken_pages_take_linear_time():
    for piece in ("<a ", "<a '", '<a ">" ', "<b>", "<p><b>", "</script", "<script>", "<!--", "<!", "<a x", "x=' ", '<i a="'):
        text = piece * (300_000 // len(piece))
        began = time.perf_counter()
        html_text.Page(text)
        html_text.Page("<p " + text)
        html_text.Page("<p " + text + '">">')
        assert time.perf_counter() - began < 10, piece


def test_tags_as_browsers_read_them():
    text = lambda h: html_text.Page(h).text()
    assert text('<p title="a > b">x</p>') == "x" and text("<p title='it\"s'>x<p>y") == "x\ny"
    assert text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2" and text("a <- b <3") == "a <- b <3"
    assert text("<p>a<!-- > --><b c='</p>'>d</b></p><SCRIPT>if (a</b/) '</scripty>'</Script >e") == "ad\ne"
    assert text("<p hidden>gone</p><p>here") == "here" and text("<div <p>x") == "x"
    assert text("<i>" * 5000 + "deep" + "</i>" * 5000 + "<p>on") == "deep\non"


def test_hosts(spark):
    urls = ["http://WWW.A.example.com:80/x", "//b.example.com/x", "https://u:p@c.example.com?q", "http://[2001:db8::1]:8080/x", "d.example.com/x", None, "", " https://e.example.com"]
    got = [r[0] for r in spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, url string").orderBy("k").select(html_text.host_of(F.col("url"))).collect()]
    assert got == ["a.example.com", "b.example.com", "c.example.com", "[2001:db8::1]", "", "", "", "e.example.com"]


def test_empty_table_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "//a/1", "<p>x</p>"), (1, "//a/1", "<p>x</p>"), (None, None, "<p>x</p>")], "page_id long, url string, html string")
    assert html_text.extract(rows.limit(0)).count() == 0
    assert sorted((tuple(r) for r in html_text.extract(rows).collect()), key=repr) == [(1, "//a/1", "x", 1), (1, "//a/1", "x", 1), (None, None, "x", 1)]
