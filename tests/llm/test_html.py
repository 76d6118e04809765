"""Blocks against cases by hand, the network's gradient, and held-out accuracy."""

from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest

from onoma.llm import html_blocks
from onoma.llm.html_blocks import Labeller, blocks_of, composed, label, main_text, padded, trained, vectors


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("", []),
        ("plain &amp; bare", ["plain & bare"]),
        ("<p>a<p>b</p>c", ["a", "b", "c"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<div>a <b>bo</b>ld<br>word\n\t x</div>", ["a bold word x"]),
        ("<script>if (a<b) '</p>'</script>x<style>p{}</style><!-- <p>no -->y", ["xy"]),
        ("<p title='a>b' class=\"c>d\">in</p><p", ["in"]),
        ("a < b &lt;c&gt; &#233;&eacute;&unknown; &am", ["a < b <c> éé&unknown; &am"]),
        ("<script>never closed <p>x", []),
        ("<!-- never closed <p>x", []),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("</div></p>x</nothing><unknown>y</unknown>", ["xy"]),
    ],
)
def test_blocks(page, texts):
    assert [t for _, t, _ in blocks_of(page)] == texts


def test_paths_and_links():
    (path, _, link), (second, _, _) = blocks_of('<div class="a B" id=c><nav><a href="/">home</a></nav></div><p>x</p>')
    assert path == ("div .a .b .c", "nav") and link == 1.0 and second == ("p",)


def test_long_and_deep_pages_are_read_whole():
    assert len(blocks_of("<p>x</p>" * 30_000)) == 30_000
    assert len(blocks_of("<div>" * 3000 + "x" + "</div>" * 3000)) == 1
    assert len(blocks_of("<" * 100_000)) == 1
    assert blocks_of('<p class="' + "a" * 100_000) == []


def test_gradient(monkeypatch):
    rng = np.random.default_rng(0)
    model = Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = padded([rng.normal(size=(n, html_blocks.WIDTH)) for n in (4, 2, 6)])
    y = rng.random(mask.shape) < 0.5
    _, grad = model.gradient(x, mask, y)
    for k in model.p:
        at = np.unravel_index(np.abs(grad[k]).argmax(), model.p[k].shape)
        base = model.p[k][at]
        losses = []
        for e in (1e-3, -1e-3):
            model.p[k][at] = base + e
            losses.append(model.gradient(x, mask, y)[0])
        model.p[k][at] = base
        assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(grad[k][at], rel=2e-2)


def test_held_out_accuracy():
    made = composed(150, 77)
    found = label(trained(), [b for b, _ in made])
    assert np.mean(np.concatenate([(p >= 0.5) == np.array(y, bool) for p, (_, y) in zip(found, made, strict=True)])) > 0.99


def test_a_page_is_labelled_alike_in_any_company():
    made = [b for b, _ in composed(40, 5)]
    alone = [label(trained(), [b])[0] for b in made]
    for p, q in zip(alone, label(trained(), made), strict=True):
        assert np.allclose(p, q, atol=1e-4)
    assert vectors([]).shape == (0, html_blocks.WIDTH)


class Article(HTMLParser):
    """What stands in <article>, cut at h1 and p."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("h1", "p"):
            self.parts.append("")
        if tag == "br":
            self.parts[-1] += " "

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag in ("h1", "p"):
            self.parts.append("")

    def handle_data(self, data):
        if self.inside:
            self.parts[-1] += data


def test_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = duckdb.sql(f"select page_id, url, html from '{sf}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in main_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    assert len(got) == len(pages)
    for i, url, page in pages:
        parser = Article()
        parser.feed(page)
        parser.close()
        text = "\n".join(x for x in (" ".join(p.split()) for p in parser.parts) if x)
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, text, len(text))


def test_odd_pages(spark):
    rows = [(1, "u", None, 7), (2, None, "", 7), (3, "u", "<nav><ul><li><a href=x>home</a></li></ul></nav>", 7), (3, "u", "<nav><ul><li><a href=x>home</a></li></ul></nav>", 7), (None, "v", "<article><p>" + "A long story of many words. " * 20 + "</article>", 7)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in found) == [(0, 559), (1, 0), (2, 0), (3, 0), (3, 0)]
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_math_and_sample_text_stay_and_drawings_go():
    texts = lambda page: [t for _, t, _ in blocks_of(page)]
    assert texts("<p>so <math><mi>x</mi>=1</math> holds</p>") == ["so x=1 holds"]
    assert texts("<p>a</p><xmp>b c</xmp><p>d</p>") == ["a", "b c", "d"]
    assert texts("<p>a <svg><text>no</text></svg>b</p><svg><p>c</p>") == ["a b", "c"]


def test_pages_are_read_in_bounded_groups(monkeypatch):
    import onoma.llm.html_blocks as h

    pages = [blocks_of("<body><article>" + "".join(f"<p>word {i} of many.</p>" for i in range(n)) + "</article><nav><a>x</a></nav>") for n in (1, 2, 3, 700, 701, 40, 41, 42, 5000)]
    whole, held = label(trained(), pages), []
    judge = h.Labeller.judge
    monkeypatch.setattr(h, "CELLS", 128)
    monkeypatch.setattr(h, "ROWS", 64)
    monkeypatch.setattr(h.Labeller, "judge", lambda self, into, mask: held.append(mask.shape) or judge(self, into, mask))
    for p, q in zip(label(trained(), pages), whole, strict=True):
        assert np.allclose(p, q, atol=1e-4)
    assert all(pages == 1 or steps * pages <= 128 for steps, pages in held)
    assert list(h._parts(np.array([5, h.CHARACTERS, 1, 1, 2 * h.CHARACTERS]))) == [(0, 1), (1, 2), (2, 4), (4, 5)]
    assert list(h._parts(np.array([], int))) == []
