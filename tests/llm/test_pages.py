import html as entities
import math
import random
import re

import numpy as np
import pytest

from weftline.llm import html, urls

URLS = [
    ("HTTP://Exa.ORG", "exa.org", "", None),
    ("x", "", "", None),
    (None, "", "", None),
    ("a://b.example.org/en/1?x", "b.example.org", "/en/1", "example.org/en/1"),
    ("a://b.example.org/en/2", "b.example.org", "/en/2", "org/"),
    ("q://w?://org/", "w", "", None),
    ("h://a.com/de/x#y", "a.com", "/de/x", "com/de/"),
    ("h://notcom/de/", "notcom", "/de/", None),
    ("h://org/", "org", "/", "org/"),
    ("h://myexample.org/es/", "myexample.org", "/es/", "org/"),
    ("\nh://EXAMPLE.org/es/\nz?", "example.org", "/es/\nz", "example.org/es/"),
]


def test_rules_and_parts(spark):
    rows = [(k, u, "<p>one example of words</p>") for k, (u, *_) in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' host", "'y' score")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.judged(pages).collect()}
    assert got == {k: tuple(v) for k, (_, *v) in enumerate(URLS)}
    assert {r["page_id"]: r["verdict"] for r in urls.judged(pages).filter("rule is not null").collect()} == {3: "block", 4: "allow", 6: "block", 8: "allow", 9: "allow", 10: "block"}
    assert urls.judged(pages.limit(0)).count() == 0


def test_segmentation_is_the_best_path():
    w = urls.Words({"big": 50, "data": 40, "bigd": 1, "at": 30, "a": 20, "shop": 9})
    for name in ("bigdata", "datashop", "bigdatashop", "ataat", "zq", "bigzzdata"):
        cuts = [[]]
        best = None
        for mask in range(1 << (len(name) - 1)):
            parts, last = [], 0
            for k in range(1, len(name) + 1):
                if k == len(name) or mask >> (k - 1) & 1:
                    parts.append(name[last:k])
                    last = k
            cost = sum(w.cost.get(p, w.unknown(len(p))) for p in parts)
            best = cost if best is None else min(best, cost)
        assert abs(sum(w.cost.get(p, w.unknown(len(p))) for p in w.segment(name)) - best) < 1e-9 and cuts
    assert w.segment("bigdata") == ["big", "data"] and w.segment("") == []


def test_long_runs_of_unknown_letters_stay_together():
    w = urls.Words({"big": 50, "data": 40, "x" * 30: 5})
    for n in (1, 19, 20, 21, 200):
        assert w.segment("big" + "z" * n + "data") == ["big", "z" * n, "data"]
    assert w.segment("data" + "x" * 30) == ["data", "x" * 30]


def test_weights_and_prior_against_a_plain_count(spark):
    rows = [("good", 2, "allow"), ("good", 1, "allow"), ("bad", 3, "block"), ("both", 1, "block"), ("both", 4, "allow"), ("new", 9, None)]
    got = {r["token"]: r["weight"] for r in urls.weights(spark.createDataFrame(rows, "token string, times long, verdict string")).collect()}
    block, allow = {"good": 0, "bad": 3, "both": 1}, {"good": 3, "bad": 0, "both": 4}
    want = {t: np.log((block[t] + 1) / (4 + 4)) - np.log((allow[t] + 1) / (7 + 4)) for t in block}
    assert got == pytest.approx(want)
    places = spark.createDataFrame([("allow", 30), ("block", 4), ("block", 6), (None, 7)], "verdict string, n long")
    assert urls.prior(places) == pytest.approx(np.log(11 / 31))


def test_query_against_brute_force(spark):
    """Every row of the query, without DataFrames: counts of all words, plain Viterbi over all cuts, plain naive Bayes."""
    from collections import Counter

    folder = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    words = Counter(w for r in pages for w in re.findall(r"[^\W\d_]+", re.sub(urls._TAGS, " ", r["html"] or "").lower()))
    total = sum(words.values())

    def segment(name):
        best = [(0.0, [])]
        for end in range(1, len(name) + 1):
            ways = [(best[s][0] + (math.log(total / words[name[s:end]]) if name[s:end] in words else math.log(total) + 2.5 * (end - s)), s) for s in range(end)]
            cost, s = min(ways)
            best.append((cost, [*best[s][1], name[s:end]]))
        return best[-1][1]

    def split(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        return m[1].lower(), m[2]

    def tokens(host, path):
        out = []
        for kind, text in (("h:", host), ("p:", path.lower())):
            for n in re.findall(r"\d+|[^\W\d_]+", text):
                out += [kind + "0"] if n[0].isdigit() else [kind + w for w in segment(n)]
        return out

    def rule(host, path):
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, default=None)

    seen, n = {"allow": Counter(), "block": Counter()}, Counter()
    for r in pages:
        if found := rule(*split(r["url"])):
            seen[found[2]].update(tokens(*split(r["url"])))
            n[found[2]] += 1
    both = set(seen["allow"]) | set(seen["block"])
    odds = {t: math.log((seen["block"][t] + 1) / (sum(seen["block"].values()) + len(both) + 1)) - math.log((seen["allow"][t] + 1) / (sum(seen["allow"].values()) + len(both) + 1)) for t in both}
    want = {}
    for r in pages:
        host, path = split(r["url"])
        score = math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(odds.get(t, 0) for t in tokens(host, path))
        found = rule(host, path)
        want[r["page_id"]] = (host, path, found and found[1], found[2] if found else "block" if round(score, 9) > 0 else "allow", pytest.approx(score, abs=1e-6))
    got = {r["page_id"]: tuple(r)[1:] for r in urls.op5_urls(spark, folder).collect()}
    assert got == want and any(v[2] is None for v in want.values())


@pytest.mark.parametrize(
    "page,texts",
    [
        (None, []),
        ("", []),
        ("<", ["<"]),
        ("a < b &lt;c&gt; &#233;", ["a < b <c> é"]),
        ("<p>a\n\t b<p>c<b>d</b>e<br>f", ["a b", "cde", "f"]),
        ("<script>var t='</p>';</script><style>p{}</style><p>x<!-- no --></p>y", ["x", "y"]),
        ("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>", ["1", "2", "3", "4"]),
        ('<a title="1>2" href=x>t</a><title>T &amp; U</title>', ["t", "T & U"]),
        ("<div>a</span></b>b</div></div>c", ["ab", "c"]),
    ],
)
def test_blocks(page, texts):
    assert [t for _, t, _ in html.blocks(page)] == texts


def test_gradients_by_differences():
    r = np.random.default_rng(0)
    m = html.Labeller(1, 3, 5)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, mask, y = r.normal(size=(4, 2, 5)), np.array([[1, 1], [1, 1], [1, 1], [1, 0]], float), r.integers(0, 2, (4, 2)).astype(float)

    def loss():
        p = m.forward(x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    for name, g in m.gradients(x, mask, y).items():
        at = tuple(r.integers(0, s) for s in m.p[name].shape)
        old = m.p[name][at]
        m.p[name][at] = old + 1e-4
        up = loss()
        m.p[name][at] = old - 1e-4
        down = loss()
        m.p[name][at] = old
        assert abs((up - down) / 2e-4 - np.asarray(g)[at]) < 1e-3


def article(page):
    """Blocks of the article element, by regular expressions, joined by an empty line."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    lines = re.sub(r"<(?!/?b>)[^>]*>", "\n", inner)
    found = (" ".join(entities.unescape(x).split()) for x in re.sub("</?b>", "", lines).split("\n"))
    return "\n\n".join(x for x in found if x)


def test_main_text_of_every_page(spark):
    folder = "/root/testdata/sf0.01"
    page = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = html.op7_html(spark, folder).collect()
    assert len(got) == len(page) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(r["text"] == article(page[r["page_id"]]) for r in got) >= 0.99 * len(page)


def test_other_layouts_and_empty_pages(spark):
    sample = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(60).collect()]
    model = html.trained(sample)
    r, good, total = random.Random(3), 0, 0
    for _ in range(200):
        found, want = html.labelled(html.blocks(html.layout(r, ["A text the model has never met, in plain words.", "Some more of it; short."])))
        score = model.forward(*html.padded([html.vectors(found)]))[:, 0] >= 0.5
        good += sum(int(s) == w for s, w in zip(score, want))
        total += len(found)
    assert good / total > 0.93
    again = html.Labeller.load(model.dump())
    assert html.main_texts(again, [None, "", "<p>"]) == ["", "", ""]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extracted(empty, model).count() == 0 and html.learn(empty) is not None


SENTENCES = [
    "The first sentence of a story is long enough to be read, and it goes on for a while.",
    "A second one follows it, with a comma or two, and says a little more than the first did.",
    "At the end there is a third, which closes the matter; nobody has to wait any longer.",
]


@pytest.mark.parametrize("inner", ["".join(f"<div>{x}</div>" for x in SENTENCES), "<div id=text>" + "".join(f"<p>{x}</p>" for x in SENTENCES) + "</div>", "<article>" + "".join(f"<div>{x}</div>" for x in SENTENCES) + "</article>"])
def test_main_text_needs_no_telling_names(spark, inner):
    model = html.trained([r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(200).collect()])
    page = f"<body><div><a href=/>Home</a></div><div><a href=/b>More</a></div>{inner}<div class=cookie-notice>We use cookies.</div><footer>me</footer></body>"
    assert html.main_texts(model, [page]) == ["\n\n".join(SENTENCES)]


def test_rows_and_long_pages(spark):
    model = html.trained([])
    article = lambda n: "<article>" + "<p>Some words of a paragraph, which is one of many here.</p>" * n + "</article>"
    rows = [(1, "u", article(2)), (1, "u", article(2)), (None, None, article(1)), (3, "u", None), (4, "u", ""), (5, "u", article(3000)), (6, "u", "<nav><a href=x>x</a></nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' text", "'y' n_chars", "1 _rank")
    got = html.extracted(pages, model).collect()
    one = "Some words of a paragraph, which is one of many here."
    assert sorted((r["page_id"] or 0, r["text"].count(one), r["n_chars"]) for r in got) == [(0, 1, 53), (1, 2, 108), (1, 2, 108), (3, 0, 0), (4, 0, 0), (5, 3000, 3000 * 55 - 2), (6, 0, 0)]


def test_a_very_long_page_stays_in_memory():
    """A page of 200,000 blocks beside short ones, under 2 GB."""
    import subprocess
    import sys

    code = """
import resource
from weftline.llm import html
model = html.Labeller()
pages = ["<p>a b c</p>" * 200_000] + ["<p>a</p>" * 50] * 31
assert len(html.main_texts(model, pages)) == 32
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 2_000_000
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
