import pytest

from quarrylens.llm import html_extract as H

FIRST = "The harbour was quiet that morning, and the boats lay still; nobody spoke of the storm, nor of the men who had gone out."
LAST = "By noon the wind had turned, the nets were dry, and the whole village came down to the quay to see what was left of it."


def text_of(inside, before=""):
    page = f"<html><head><title>t</title></head><body>{before}<article><h1>The storm at sea</h1><p>{FIRST}</p>{inside}<p>{LAST}</p></article><footer>&copy; all rights</footer></body></html>"
    return H.extract([page], H.model())[0]


@pytest.mark.parametrize("before", [
    '<form class="search"><input list="q"><datalist id="q"><option value="a"><option value="b"></datalist></form>',
    '<div class="search"><select><option>red<option>green</select></div>',
    '<div class="search"><select><optgroup label="x"><option>red<optgroup label="y"><option>green</div>',
    '<nav><button>Menu</nav>',
    "<button>Menu",
    "<select><option>red",
    '<div class="logo"><svg viewBox="0 0 1 1"><path d="M0 0"/></div>',
    '<div class="banner"><object data="x.swf"></div>',
    "<div><math><mi>x</div>",
    '<div class="notice"><noscript>Please turn scripts on.</div>',
    '<div class="widget"><template><p>one</div>',
])
def test_missing_end_tags_lose_no_article(before):
    text = text_of("", before)
    assert FIRST in text and LAST in text
    assert "Menu" not in text and "red" not in text and "green" not in text


@pytest.mark.parametrize("inside", ["<div><button>Share</div>", "<div><button>Share<object></div>", "<p><svg><path d='M0 0'></p>", "<p><button><div>Share</div></button></p>", "<button>Share", "<p>Choose <select><option>Share</p>"])
def test_missing_end_tags_inside(inside):
    for later in ("", "<p><button>Share</button><svg></svg><object></object></p>"):
        text = text_of(inside + f"<p>{FIRST[::-1]}</p>" + later)
        assert FIRST in text and FIRST[::-1] in text and LAST in text
        assert "Share" not in text


def test_fallbacks_and_formulas_are_text():
    text = text_of("<p>Let <math><mi>a</mi><mo>=</mo><mi>b</mi></math> hold, <object data='x'>as the chart shows,</object> for all.</p><noscript><p>The same chart in words, for those who read it without scripts at all.</p></noscript>")
    assert "Let a=b hold, as the chart shows, for all." in text and "The same chart in words" in text


def test_raw_text_is_skipped():
    text = text_of("<script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><textarea><p>no</textarea><iframe><p>no</iframe>")
    assert text.split("\n\n") == ["The storm at sea", FIRST, LAST]


@pytest.mark.parametrize("source", ["<a " + "x" * 1_000_000, "<b and a sentence " * 55_000, "<div>" * 100_000 + "x", "<!" * 500_000, "<div><li>" * 60_000, "<b>" + "<div>" * 60_000 + "</b>" * 100_000, "<button><p>x" * 50_000, '<a "' * 250_000, "<a>" * 60_000 + "<div>" * 30_000 + "</a>" * 60_000])
def test_a_long_page_is_read_once(source):
    import time

    began = time.perf_counter()
    H.Forest([H.Page(source)])
    assert time.perf_counter() - began < 8


def test_end_tags_may_have_attributes():
    for end in ("</script foo>", "</SCRIPT/>", "</script\n>", "</script a='>"):
        assert FIRST[::-1] in text_of(f"<script>x</scripty>y{end}<p>{FIRST[::-1]}</p>")
    assert H.extract([f"<article><h1>T</h1><p>{FIRST}</p><p>{LAST}</p><script>x</script"], H.model())[0] == f"T\n\n{FIRST}\n\n{LAST}"


def test_marginals_match_enumeration():
    import itertools

    import numpy as np

    page = H.Page("<div class=nav><a>x</a></div><article><h1>t</h1><p>one<p>two</article><footer>f</footer>")
    forest, (w, e) = H.Forest([page]), H.model()
    n, score = len(page.tag), forest.x @ w
    assert 5 <= n <= 12
    total, marginal, joint = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        weight = np.exp(sum(score[i] * y[i] for i in range(n)) + sum(e[forest.kind[i], y[forest.parent[i]], y[i]] for i in range(n) if forest.parent[i] >= 0))
        total += weight
        marginal += weight * np.array(y)
        for i in range(n):
            if forest.parent[i] >= 0:
                joint[i, y[forest.parent[i]], y[i]] += weight
    p, both = forest.beliefs(w, e)
    assert np.allclose(p, marginal / total, atol=1e-9) and np.allclose(both, joint / total, atol=1e-9)


def test_learning_follows_the_likelihood():
    """Expected counts equal those of the labelled pages, up to what the penalty holds back."""
    import random

    import numpy as np

    w, e = H.model()
    rng = random.Random(3)
    pages = [H.Page(H.labelled_page(rng)[0]) for _ in range(500)]
    y = np.concatenate([H.labels_of(p) for p in pages])
    forest = H.Forest(pages)
    p, _ = forest.beliefs(w, e)
    assert abs((p - y).mean()) < 0.01 and ((p > 0.5) == y).mean() > 0.97


def test_main_text_edges(spark):
    page = f"<article><h1>T</h1><p>{FIRST} &eacute;&#128512;</p></article>"
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", None), (1, "u", page, "x"), (None, "v", "<article><p>" + FIRST + "</p><p>" + "long " * 200_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, r.text[:20], r.n_chars) for r in H.main_text(df).collect()), key=repr)
    size = len(f"T\n\n{FIRST} é😀")
    assert got == sorted([(1, "u", f"T\n\n{FIRST}"[:20], size)] * 2 + [(2, None, "", 0), (3, "u", "", 0), (0, "v", FIRST[:20], len(FIRST) + 2 + 999_999)], key=repr)
    assert H.main_text(df.limit(0)).count() == 0
