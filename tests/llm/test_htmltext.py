import html
import re

import numpy as np
import pytest

from marginlake.llm import htmltext, queries
from marginlake.llm.recurrent import SequenceLabeller


@pytest.fixture(scope="module")
def model():
    return htmltext.train()


@pytest.fixture(scope="module")
def main_text(model):
    def read(page):
        found = htmltext.blocks(page)
        prob = htmltext.label(model, [found], htmltext.Buckets(htmltext.MARKS))[0]
        return " ".join(b.text for b, p in zip(found, prob, strict=True) if p >= 0.5)

    return read


def texts(page):
    return [b.text for b in htmltext.blocks(page)]


def test_blocks_are_leaves_with_single_blanks():
    assert texts("<p>a  b\n c<p>d<b>e</b>f<br>g<div>h<ul><li>i<li>j</ul>k</div>") == ["a b c", "def g", "h", "i", "j", "k"]
    assert texts("<p>&lt;x&gt; &amp; &eacute;&#233; &copy;</p>") == ["<x> & éé ©"]
    assert texts('<script>var t="</p>";</script><style>p{}</style><!-- no --><p>yes') == ["yes"]
    assert texts("") == texts(None) == texts("<p> </p>") == []
    assert texts("no markup at all") == ["no markup at all"]
    assert texts("<html><head><title>t</title><body>x") == ["x"]
    assert texts("<html><head><title>t<body>x</body></html>")[-1:] != ["t"]


def test_paths_survive_missing_end_tags():
    found = htmltext.blocks("<article><p><b>one<br><p>two</article><footer>three")
    assert [b.text for b in found] == ["one", "two", "three"]
    assert found[1].path == ("p", "article") and found[2].path == ("footer",)


def test_gradients_equal_finite_differences():
    model = SequenceLabeller(7, 5, 2, units=3)
    model.params = {k: v.astype(np.float64) for k, v in model.params.items()}
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 4])
    n = lengths.sum()
    nm, nw = rng.integers(1, 4, n), rng.integers(0, 4, n)
    bags = ((rng.integers(0, 7, nm.sum()), nm), (rng.integers(0, 5, nw.sum()), nw), rng.normal(size=(n, 2)).astype(np.float32))
    y = rng.integers(0, 2, n).astype(np.float32)
    _, grads = model.gradients(bags, lengths, y)
    for name, p in model.params.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in p.shape)
            keep, step = p[at], 1e-2
            p[at] = keep + step
            up = model.gradients(bags, lengths, y)[0]
            p[at] = keep - step
            down = model.gradients(bags, lengths, y)[0]
            p[at] = keep
            assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3, name


def test_labels_do_not_depend_on_the_batch(model):
    maker = htmltext.PageMaker(17)
    pages = [[b for b, _ in maker.page()] for _ in range(9)]
    marks = htmltext.Buckets(htmltext.MARKS)
    together = htmltext.label(model, [*pages, []], marks)
    for page, prob in zip(pages, together):
        assert np.allclose(htmltext.label(model, [page], marks)[0], prob, atol=1e-4)
    assert len(together[-1]) == 0


def test_invented_pages_that_were_not_trained_on(model):
    maker = htmltext.PageMaker(4242)
    pages = [maker.page() for _ in range(150)]
    prob = htmltext.label(model, [[b for b, _ in p] for p in pages], htmltext.Buckets(htmltext.MARKS))
    right = [(p >= 0.5) == (y > 0) for q, p in zip(pages, prob) for p, y in zip(p, [y for _, y in q])]
    assert np.mean(right) > 0.985


def test_hand_written_pages(main_text):
    assert (
        main_text(
            "<html><body><header><div class=logo>My Site</div><nav><a href=x>Home</a> <a>News</a></nav></header>"
            '<div id="cookie-notice"><p>We use cookies. By continuing you agree.</p></div><main><h1>Title here</h1>'
            "<p>The first paragraph of this story is long enough to read, and it goes on.</p><p>Second para with "
            "<a href=y>a link</a> inside of it, too.</p><aside><h3>Related</h3><ul><li><a>Foo bar</a></li></ul></aside>"
            '<p>Third &amp; last.</p></main><section id="comments"><h2>Comments</h2><div class="comment"><p>I really liked '
            "this article, it was great.</p></div></section><form><label>Email</label><button>Subscribe</button></form>"
            "<footer><p>&copy; 2020 Some site. All rights reserved.</p></footer></body></html>"
        )
        == "Title here The first paragraph of this story is long enough to read, and it goes on. "
        "Second para with a link inside of it, too. Third & last."
    )


def test_odd_pages(spark, model):
    article = "<article><h1>Head</h1><p>One sentence, and more of it. Another one.</p></article>"
    long = "<article>" + "<p>A paragraph of some words, again and again.</p>" * 3000 + "</article>"
    rows = [(1, "u", article, "c"), (1, "u", article, "c"), (2, None, None, "c"), (3, "u", "", "c"), (None, "u", "<p", "c"), (4, "u", long, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    got = htmltext.extract(df, model).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    assert by_id[1]["text"] == "Head One sentence, and more of it. Another one."
    assert by_id[2]["text"] == by_id[3]["text"] == ""
    assert by_id[4]["text"].count("paragraph") == 3000
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert htmltext.extract(df.filter("false"), model).count() == 0


def test_sample_pages_give_their_articles(spark):
    sf = "/root/testdata/sf0.01"
    inline = lambda m: " " if re.match(r"</?(p|h1|br)", m[0]) else ""
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want[r["page_id"]] = " ".join(html.unescape(re.sub(r"<[^>]*>", inline, article)).split())
    rows = queries.op3_html_text(spark, sf).collect()
    assert len(rows) == len(want)
    assert np.mean([r["text"] == want[r["page_id"]] for r in rows]) > 0.98


def test_marked_sections_and_declarations_are_comments():
    for odd in ("<![foo[bar]]>", "<![CDATA[ x ]]>", "<!foo bar>", "<![if IE]>", "<!DOCTYPE"):
        found = [b.text for b in htmltext.blocks(f"<body><p>Before.</p>{odd}<p>After it.</p>")]
        assert found[0] == "Before."
    assert [b.text for b in htmltext.blocks("<p>One <![foo[bar]]> two.</p><![endless")] == ["One two."]


def test_formulas_are_text():
    assert [b.text for b in htmltext.blocks("<p>Let <math><mi>x</mi></math> be.</p>")] == ["Let x be."]


def test_depth_does_not_hide_ancestors():
    """A line is described alike directly under its footer and under many nested elements."""
    names = []
    for depth in (0, 30, 3000):
        page = "<footer class='foot'>" + "<div>" * depth + "<p>All rights reserved.</p>"
        names.append(set(htmltext.blocks(page)[0].path) - {"div"})
    assert names[0] == names[1] == names[2] and "=foot" in names[0]
