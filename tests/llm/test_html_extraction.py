"""Leaf blocks, the field's decoding and training, and pages held out from training."""

from __future__ import annotations

import html
import itertools
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from lowtide.llm.html_blocks import blocks
from lowtide.llm.html_extraction import FEATURES, Field, Sequence, extract, labelled, main_text, train, trained
from lowtide.llm.html_training import training_pages


@pytest.fixture(scope="module")
def field():
    return trained(300)


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("plain &amp; more", ["plain & more"]),
        ("<p>a<p>b<div>c</div>", ["a", "b", "c"]),
        ("<p>fo<b>o</b> b&nbsp;ar<br>x</p>", ["foo b ar x"]),
        ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
        ("<script>if(a<b){'</p>'}</script>q<style>x", ["q"]),
        ('<div title="a>b">t</div>', ["t"]),
        ("<p hidden>no</p><p style='display: none'>no</p>yes", ["yes"]),
        ("a < b and c > d", ["a < b and c > d"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<!-- <p>x</p> -->y<!-- open", ["y"]),
        ("<p title='open>text", ["text"]),
        ("</div></p>x</b>y", ["xy"]),
        ("<head><title>t</title></head><body>b", ["b"]),
        ("&#x41;&eacute;&copy", ["Aé©"]),
    ],
)
def test_blocks(page, want):
    assert [b.text for b in blocks(page)] == want


def test_deep_and_broken_pages_end():
    assert len(blocks("<div>x" * 3000)) == 3000
    assert blocks("<" * 5000)[0].text == "<" * 5000
    blocks("<a title='" * 3000)


def test_viterbi_finds_the_best_labels():
    r = np.random.default_rng(2)
    field = Field(r.normal(size=(len(FEATURES), 2)), r.normal(size=(2, 2, 2)))
    for _ in range(20):
        n = int(r.integers(1, 8))
        page = Sequence([r.choice(len(FEATURES), 4).tolist() for _ in range(n)], r.integers(0, 2, n).tolist())

        def score(labels, page=page):
            total = sum(field.weights[f, y].sum() for f, y in zip(page.features, labels))
            return total + sum(field.pairs[s, a, b] for s, a, b in zip(page.shared[1:], labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert score(field.decode(page)) == pytest.approx(score(best))


def test_training_raises_the_likelihood_of_labels():
    pages, labels = labelled(training_pages(40))
    one, many = train(pages, labels, rounds=2), train(pages, labels, rounds=60)
    wrong = lambda f: sum(a != b for p, y in zip(pages, labels) for a, b in zip(f.decode(p), y))
    assert wrong(many) < wrong(one)


def test_pages_held_out(field):
    pages, labels = labelled(training_pages(150, seed=4242))
    right = sum(a == b for p, y in zip(pages, labels) for a, b in zip(field.decode(p), y))
    assert right >= 0.985 * sum(map(len, labels))


def test_articles_of_the_table(field):
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    for page in random.Random(1).sample(pages, 60):
        article = re.search(r"(?s)<article>(.*?)(</article>|<footer>)", page)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", article))).split())
        assert main_text(page, field) == want


def test_extract_table(spark, field):
    article = "<article><p>One &amp; only.</p><p>Two  words\n here.</p></article><footer>&copy; me</footer>"
    long = "<article>" + "<p>" + "many words of text, " * 20_000 + "</p></article>"
    rows = [(1, "u", article, 3), (1, "u", article, 3), (2, None, None, 4), (3, "v", "", 5), (4, "w", "<nav><a href=x>menu</a></nav>", 6), (None, "x", long, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in extract(pages, field=field).collect()))
    text = "One & only. Two words here."
    body = " ".join(["many words of text,"] * 20_000)
    assert got == [(0, "x", body, len(body)), (1, "u", text, len(text)), (1, "u", text, len(text)), (2, "", "", 0), (3, "v", "", 0), (4, "w", "", 0)]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract(empty, field=field).collect() == []


def test_formulas_and_figures_stay_in_their_paragraph():
    page = "<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be, see <svg><title>t</title><desc>d</desc><path d='M0'/><text>label</text></svg> and <object data=a>fallback</object>.</p><p>Next</p>"
    assert [b.text for b in blocks(page)] == ["Let x=1 be, see label and fallback.", "Next"]


def test_hidden_elements_below_the_greatest_depth():
    deep = "<div>" * 600
    page = f"<p>a</p>{deep}in<div hidden>not<b>nor</b></div>shown<script>x</script>{'</div>' * 600}<p>after</p>"
    assert [b.text for b in blocks(page)] == ["a", "in", "shown", "after"]


def test_text_features_see_the_whole_block():
    from lowtide.llm.html_extraction import _text_features

    block = lambda text: blocks(f"<p>{text}</p>")[0]
    plain = "word " * 200
    for feature, end in (("comma", "a, b"), ("copyright", "©"), ("bar", "a | b"), ("symbols", "$$$$ " * 80)):
        assert feature not in _text_features(block(plain)) and feature in _text_features(block(plain + end))
