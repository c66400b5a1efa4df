"""Main text: the model against enumeration, pages of the table against another parser, other layouts by held-out accuracy."""

import itertools
from html.parser import HTMLParser

import numpy as np
import pytest

from corpuslode.llm import main_text as M
from corpuslode.llm.labelled_pages import labelled_pages
from corpuslode.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    return M.train(labelled_pages())


def tree(pages):
    nodes = M.Nodes()
    for i, h in enumerate(pages):
        M.read_page(nodes, i, h)
    return nodes, M.structure(nodes)


def test_messages_give_the_marginals_of_all_assignments(model):
    nodes, s = tree(["<div class=content><p>One two three.<p>Four</div><nav>x</nav>"])
    f = M.features(model, nodes, s)
    found, pair = M._inferred(model, f, s)
    n = len(nodes.tag)
    own = model.chars[f.leaf, f.chars] + model.links[f.leaf, f.links] + model.ends[f.leaf, f.ends]
    np.add.at(own, f.at, model.word[f.word])
    single, both = np.zeros((n, 3)), np.zeros((n, 4, 3))
    for states in itertools.product(range(3), repeat=n):
        above = [states[p] if p >= 0 else 3 for p in nodes.parent]
        w = np.exp(sum(own[i, x] + model.child[f.tag[i], a, x] for i, (x, a) in enumerate(zip(states, above, strict=True))))
        for i, (x, a) in enumerate(zip(states, above, strict=True)):
            single[i, x] += w
            both[i, a, x] += w
    assert np.allclose(found, single / single.sum(axis=1, keepdims=True))
    assert np.allclose(pair, both / both.sum(axis=(1, 2), keepdims=True))


def test_training_makes_labels_likelier():
    pages = labelled_pages(60, seed=3)
    nodes, s = tree(pages)
    wanted = M.states(nodes, s)
    likely = [np.log(M.marginals(m, nodes, s)[np.arange(len(wanted)), wanted]).mean() for m in (M.train(pages, 1), M.train(pages, 10), M.train(pages, 40))]
    assert likely[0] < likely[1] < likely[2]


def test_held_out_layouts(model):
    nodes, s = tree(labelled_pages(300, seed=91))
    text = np.array([bool(t) for t in nodes.text])
    right = (M.marginals(model, nodes, s)[:, M.MAIN] >= 0.5) == (M.states(nodes, s) == M.MAIN)
    assert right[text].mean() > 0.985


class Article(HTMLParser):
    """The blocks of a page's one article, by another parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "div"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1", "div"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_whole_query(spark, sf_dir):
    found = {r["page_id"]: r for r in QUERIES["op12_main_text"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(found) == len(pages)
    for page_id, url, html in pages:
        article = Article()
        article.feed(html)
        wanted = "\n".join(b for x in article.blocks if (b := " ".join(x.split())))
        assert found[page_id]["text"] == wanted and wanted
        assert (found[page_id]["url"], found[page_id]["n_chars"]) == (url, len(wanted))


TEXT = "The first sentence of a paragraph that is long enough to be one. And a second one, to be sure of it."


@pytest.mark.parametrize(
    ("body", "wanted"),
    [
        (f"<article><p>{TEXT}</p><p>Short.</p></article>", [TEXT, "Short."]),
        (f"<nav><ul><li><a href=a>Home</a></ul></nav><main><h1>Title here</h1><p>{TEXT}</main><footer>&copy; Somebody.</footer>", ["Title here", TEXT]),
        (f"<div class=cookie-notice>We use cookies. Do you agree?</div><div id=content><p>{TEXT}</p></div>", [TEXT]),
        (f"<article><p>{TEXT}</p><div class=ad>Buy this now!</div><p>{TEXT}</p></article>", [TEXT, TEXT]),
        (f"<article><p>{TEXT}</p></article><section id=comments><h3>Comments</h3><p>I like it. It is very good.</p></section>", [TEXT]),
        (f"<article><p>{TEXT}</p></article><aside class=sidebar><h3>Related</h3><ul><li><a href=x>Other page</a></ul></aside>", [TEXT]),
        (f"<header class=site-header>Site name</header><div class=post-content><p>{TEXT}</p></div><form class=newsletter><label>Your mail</label><input></form>", [TEXT]),
        (f"<article><p>a&nbsp;b &lt;i&gt; &amp;amp; &#x41;&eacute;  {TEXT}\n\t<b>bold</b>er<!-- no --><script>var x='<p>no</p>'</script><br>line</p></article>", [f"a b <i> &amp; Aé {TEXT} bolder line"]),
        (f"<article><ul><li>One<li>Two</ul><p>{TEXT}<table><tr><td>x<td>y</table></article>", ["One", "Two", TEXT, "x", "y"]),
        (f"<article>{TEXT}<p>{TEXT}</p>tail text of it.</article>", [TEXT, TEXT, "tail text of it."]),
        ("", []), ("<p></p><div> \n </div>", []), ("<script>x", []), ("<!-- never closed <p>x</p>", []), ("<article", []),
    ],
    ids=range(15),
)
def test_pages(model, body, wanted):
    html = f"<!DOCTYPE html><html><head><title>No text</title><style>p{{}}</style></head><body>{body}</body></html>"
    assert M.extract(model, [html, None, ""]) == ["\n".join(wanted), "", ""]


def test_misnested_and_deep_pages_end(model):
    deep = "<div>" * 3000 + TEXT + "</p></span></td>" * 50
    odd = ["<", "<>", "</", "<a b='", "<p a=\"x>y", "&#xFFFFFFFF; &bogus;", "<td>x</table></td><li></ul>", "<p" * 500, "<!" * 500, deep, "\x00 ퟿", "plain text only, without any markup at all."]
    assert len(M.extract(model, odd)) == len(odd)


def test_odd_tables(spark, model):
    rows = [(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2), (2, None, f"<article><p>{TEXT}</p></article>", 3)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text int")
    assert sorted((r["page_id"] or 0, r["url"], r["text"]) for r in M.main_text(df, model).collect() if r["page_id"] != 1) == [(0, None, ""), (2, None, TEXT)]
    assert M.main_text(df, model).count() == 4 and M.main_text(df.limit(0), model).collect() == []


def test_fit_on_given_pages(spark):
    pages = labelled_pages(40, seed=8)
    given = M.fit(spark, spark.createDataFrame([(h,) for h in [*pages, None]], "html string"), rounds=5)
    assert len(given.words) > 5 and M.extract(given, [None]) == [""]
    assert M.extract(M.train([]), ["<p>x</p>"]) is not None
