"""Pages, urls and vectors against plain versions."""

import math
import random
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.llm import embedding_dedup, html_extract, url_filter
from glyphflow.llm.common import connected_components


def page(article, extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad">buy</div>{extra}<article>{article}</article><footer>&copy; x</footer></body></html>'


@pytest.mark.parametrize(
    "html, want",
    [
        (page("<h1>A&amp;B</h1><p><b>one<br>two <p>three\n  four</p>"), "A&B\n\none two\n\nthree four"),
        (page('<p>x</p><script>var t="</p>";</script><aside>no</aside><div class="reader-comments"><p>no</p></div><form>no</form><p>y'), "x\n\ny"),
        (page("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>"), "a\n\nb\n\nc\n\nd"),
        (page("&lt;p&gt; &#233;&nbsp;&am; <!-- no --> <span>z</span>"), "<p> é &am; z"),
        ("<p>no article</p><nav>menu</nav>text", "no article\n\ntext"),
        ("", ""),
        ("<", "<"),
        ("<p>a<div hidden>b</div><!-- never closed", "a"),
        ("a < b & c", "a < b & c"),
        ("<div>" * 5000 + "deep", "deep"),
    ],
)
def test_main_text(html, want):
    assert html_extract.main_text(html_extract.parse(html), "h", set()) == want


def test_templates_are_counted_by_host(spark):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(20))
    promo = "<div><p>Get the app now</p></div>"
    rows = [(i, f"http://a.b/{i}", f"<body>{promo}<p>{t}</p></body>") for i in range(8) for t in [text()]]
    rows += [(20 + i, "http://c.d/", f"<body>{promo}<p>only here</p></body>") for i in range(30)]  # one page, crawled often
    rows += [(60 + i, f"http://e.f/{i}", page(f"<p>shared line</p><p>{text()}</p>")) for i in range(10)]
    rows += [(80, None, None), (81, "x", "")]
    df = spark.createDataFrame([(i, u, h, "x", "x") for i, u, h in rows], "page_id long, url string, html string, host string, text string")
    for keys in (500_000, 0):
        got = {r["page_id"]: r["main_text"] for r in html_extract.extract(df, broadcast_keys=keys).collect()}
        assert all("app" not in got[i] and len(got[i]) > 20 for i in range(8))
        assert got[20] == "Get the app now\n\nonly here"
        assert all(got[60 + i].startswith("shared line\n\n") for i in range(10))
        assert got[80] == got[81] == ""
    assert html_extract.extract(df.limit(0)).count() == 0


def plain_rule(host, path):
    best = None
    for rule, verdict in url_filter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def test_urls(spark):
    urls = [None, "", "x", "http://", "HTTP://WWW.Example.ORG/en/12?x#y", "http://example.org/es/1", "http://aexample.org/es/1", "https://x.com/fr/", "https://x.com?/fr/", "https://x.com/de/9#", "http://freecasino.net/a", "http://science-journal.net/a", "a://b::c/d", "http://org/", "http://x.org", "http://é.com/fr/x y", "http://qqzz.net/" + "ab" * 5000]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, Rule int")
    assert url_filter.judge_urls(df).columns == ["page_id", "url", "host", "path", "words", "log_odds", "rule", "verdict"]
    for r in url_filter.judge_urls(df).collect():
        u = urls[r["page_id"]]
        rest = u.partition("://")[2] if u else ""
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
        path = urlsplit("x://y" + rest[len(host) :]).path
        assert (r["host"], r["path"]) == (host.lower() if host.isascii() else host, path)
        rule = plain_rule(r["host"], path)
        assert (r["rule"], r["verdict"])[: 2 if rule else 1] == (rule or (None,))
    got = {urls[r["page_id"]]: r["verdict"] for r in url_filter.judge_urls(df).collect()}
    assert got["http://freecasino.net/a"] == "block" and got["http://science-journal.net/a"] == got["http://qqzz.net/" + "ab" * 5000] == "allow" and got[None] == "allow"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_models_are_learnt(spark):
    # what rules say of some hosts' paths is told of other hosts; a busy host counts once, and the rules' own words not at all
    urls = [f"http://h{chr(97 + i)}.com/de/zorp/{k}" for i in range(8) for k in range(3)] + [f"http://g{chr(97 + i)}.com/fr/flimm/{k}" for i in range(8) for k in range(3)]
    urls += ["http://busy.com/de/dull/"] * 50 + ["http://x.net/zorp", "http://x.net/flimm", "http://x.net/de/1", "http://x.net/dull", "http://zorpflimm.net/", "http://zorpzorp.net/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    model = url_filter.learn(df)
    assert "zorp" in model.odds and "de" not in model.odds and "com" not in model.odds and abs(model.odds["dull"]) < url_filter.MARGIN
    got = {r["url"]: r for r in url_filter.judge_urls(df).collect()}
    assert [got[f"http://{x}"]["verdict"] for x in ("x.net/zorp", "x.net/flimm", "x.net/de/1", "x.net/dull", "zorpzorp.net/")] == ["block", "allow", "allow", "allow", "block"]
    assert got["http://zorpflimm.net/"]["words"] == ["zorp", "flimm", "net"]
    for r in got.values():  # workers score with the driver's own model
        words = model.words(r["host"], r["path"])
        assert r["words"] == words and r["log_odds"] == model.log_odds(words)


def test_segmentation_is_the_most_probable():
    m = url_filter.UrlModel()

    def cost(word):
        return m.log_word.get(word, -math.log(m.total) - 1.3 * len(word))

    def best(run):
        return max(cost(run[:n]) + best(run[n:]) for n in range(1, len(run) + 1)) if run else 0.0

    for run in ("pokernews", "freebetsx", "qqq", "shopxart", "roads", "sexart"):
        parts = m.segment(run)
        assert "".join(parts) == run
        assert math.isclose(sum(map(cost, parts)), best(run))
    assert m.segment("pokernews") == ("poker", "news") and m.segment("roads") == ("roads",)


def plain_links(rows, threshold=0.95):
    usable = {k: np.array(v, dtype=np.float64) for k, (_, v) in enumerate(rows) if v is not None and len(v) and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)}
    label = list(range(len(rows)))
    n = [0] * len(rows)
    for a in usable:
        for b in usable:
            if a < b and len(usable[a]) == len(usable[b]):
                x, y = usable[a] / np.abs(usable[a]).max(), usable[b] / np.abs(usable[b]).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    n[a] += 1
                    n[b] += 1
                    old, new = label[b], label[a]
                    label = [new if z == old else z for z in label]
    return sorted((i, n[k], min(rows[j][0] for j in range(len(rows)) if label[j] == label[k])) for k, (i, _) in enumerate(rows))


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.3])).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(300, [2 * x for x in rows[3][1]])]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [math.nan] + [1.0] * 15), (404, [math.inf] + [1.0] * 15), (405, [None] + [1.0] * 15), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (408, [1e-300] * 16), (409, [1e300] * 16)]
    df = spark.createDataFrame([(i, v, 1, i, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, id long, block string")
    for block in (8192, 20):
        got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, block=block).collect())
        assert got == plain_links(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_the_bound_holds():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    q = np.rint(x / scale)
    e = np.linalg.norm(x - scale * q, axis=1)
    off = np.abs(x @ x.T - (q @ q.T) * scale * scale.T)
    assert (off <= e[:, None] + e[None] + e[:, None] * e[None] + 1e-12).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(500, k) for k in range(501, 560)] + [(7, 7), (-5, -9)]
    label = {}

    def find(i):
        while label.setdefault(i, i) != i:
            i = label[i]
        return i

    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            label[q] = p
    for one_task in (1_000_000, 0):
        got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
        assert got == {i: find(i) for i in label}
        assert connected_components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0
