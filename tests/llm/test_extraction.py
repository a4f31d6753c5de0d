"""Main text of pages: held-out made pages, hand-written pages of other layouts, and the given table."""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from salespark.llm import catalog, extraction, layouts, markup  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return extraction.learn(spark)


def test_given_pages(spark):
    rows = {r["page_id"]: r for r in catalog.op13_main_text(spark, SMALL).collect()}
    table = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(rows) == len(table)
    for page in table:
        inside = re.search(r"<article>(.*)</article>", page["html"], re.DOTALL).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inside))).split())
        got = rows[page["page_id"]]
        assert (got["text"], got["n_chars"], got["url"]) == (want, len(want), page["url"])


def test_held_out_pages(model):
    exact = precision = recall = 0
    made = list(extraction.made_pages(10**6, 10**6 + 150))
    for page in made:
        want = extraction.labelled(page)[2]
        got = extraction.main_texts([page.replace(layouts.MARK, "")], model)[0]
        both = sum((Counter(got.split()) & Counter(want.split())).values())
        exact += got == want
        precision += both / max(1, len(got.split()))
        recall += both / max(1, len(want.split()))
    assert exact > 0.7 * len(made) and precision > 0.95 * len(made) and recall > 0.95 * len(made)


PROSE = [
    "The river had risen in the night, and by morning the lower fields were gone under brown water.",
    "Nobody in the village remembered a flood like it, although the old church wall carried marks from earlier ones.",
    "Helpers came from the next valley with boats, blankets &amp; bread; they stayed for nine days.",
]


def page_with(body, around="{}"):
    return f"<html><head><title>Flood</title><style>p{{}}</style></head><body>{around.format(body)}</body></html>"


TEXT = "".join(f"<p>{p}</p>" for p in PROSE)
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>'
FOOT = "<footer>&copy; 2024 The Valley Paper. All rights reserved.</footer>"


@pytest.mark.parametrize(
    "body",
    [
        f"{NAV}<main><article><h1>Flood</h1>{TEXT}</article></main>{FOOT}",
        f'<div id="header"><a href="/">Valley Paper</a></div><div class="menu"><a href="/a">A</a> | <a href="/b">B</a></div><div id="content"><h1>Flood</h1>{TEXT}</div><div id="footer">Imprint and legal notes of the paper</div>',
        f'<div class="cookie-banner">We use cookies to improve this site. <button>Accept</button></div>{NAV}<div class="post-content"><h1>Flood</h1>{TEXT}</div><aside class="sidebar"><h3>Popular</h3><ul><li><a href="/x">Ten bridges</a></li><li><a href="/y">The mill</a></li></ul></aside>{FOOT}',
        f'{NAV}<article><h1>Flood</h1>{TEXT}<div class="ad">Buy new boots today, half price for all.</div></article><section id="comments"><h3>Comments</h3><div class="comment"><p>I was there and it was much worse than this says, believe me.</p></div><form><label>Name</label><input><button>Send</button></form></section>{FOOT}',
        f"<header><h1>Valley Paper</h1>{NAV}</header><article><h1>Flood</h1>{TEXT}</article><form><label>Search</label><input><button>Go</button></form>{FOOT}",
    ],
)
def test_layouts(model, body):
    want = " ".join(["Flood", *[html.unescape(p) for p in PROSE]])
    assert extraction.main_texts([page_with(body)], model) == [want]


def test_reader():
    page = markup.read_page("<p>a&lt;b <b>c<p>d<br>e</b></p><ul><li>x<li>y</ul><script>if (a<b) '</p>'</script><!-- z --> 1 < 2 &nbsp;3<td>q<a title='>'>r</a>")
    texts = markup.kept_text(page, [tag not in markup.UNSEEN for tag in page.tags])
    assert texts == "a<b c d e x y 1 < 2 3 qr"
    assert [t for t in page.tags if t in ("p", "li", "b")] == ["p", "b", "p", "li", "li"]
    assert markup.kept_text(markup.read_page("x <!-- never closed <p>y"), [True] * 9) == "x"
    assert markup.kept_text(markup.read_page("<a href='unclosed>t</a> u"), [True] * 9) in ("", "t u", "u")


def test_decoding_is_closed_and_best():
    pick = np.random.default_rng(2)
    for _ in range(200):
        n = int(pick.integers(1, 9))
        parents = [-1] + [int(pick.integers(0, i)) for i in range(1, n)]
        odds = pick.normal(size=n)
        kept = extraction.decode(parents, odds)
        sums = [
            sum(odds[i] for i in range(n) if m >> i & 1)
            for m in range(1 << n)
            if all(not m >> i & 1 or i == 0 or m >> parents[i] & 1 for i in range(n))
        ]
        assert all(not kept[i] or kept[parents[i]] for i in range(1, n))
        assert abs(sum(odds[i] for i in range(n) if kept[i]) - max(sums)) < 1e-9


def test_awkward_rows(spark, model):
    long = page_with(f"{NAV}<article>" + TEXT * 3000 + f"</article>{FOOT}")
    rows = [(1, None, "u", 7), (2, "", "u", 7), (3, "   ", None, 7), (4, "<p><b><div></p>", "u", 7), (5, long, "u", 7), (5, long, "u", 7), (None, "<" * 5000, "u", 7), (6, "<div>" * 3000 + "deep", "u", 7)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text int")
    found = extraction.extract_main_text(pages, model)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    told = [(r["page_id"], r["text"], r["n_chars"]) for r in found.collect()]
    assert len(told) == 8 and all(len(t) == n for _, t, n in told)
    assert all(t == "" for i, t, _ in told if i in (1, 2, 3, 4))
    assert {t for i, t, _ in told if i == 5} == {" ".join([html.unescape(p) for p in PROSE] * 3000)}
    assert extraction.extract_main_text(pages.limit(0), model).count() == 0
