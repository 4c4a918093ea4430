from __future__ import annotations

import itertools

import numpy as np
import pytest

from labreports.llm.html_blocks import leaf_blocks
from labreports.llm.html_crf import BlockModel, block_features, default_model, main_text
from labreports.llm.html_examples import labelled_page


@pytest.fixture(scope="module")
def model():
    return default_model()


def labels(model, page):
    blocks = leaf_blocks(page)
    scores = [sum(model.weights.get(n, 0.0) for n in block_features(b)) for b in blocks]
    return model.decode(scores)


def test_held_out_accuracy(model):
    random = np.random.default_rng(99)
    pages = [labelled_page(random) for _ in range(300)]
    right = [(a == b) for page, truth in pages for a, b in zip(labels(model, page), truth, strict=True)]
    assert np.mean(right) >= 0.985


def test_viterbi_is_the_best_of_all_paths():
    random = np.random.default_rng(4)
    for _ in range(50):
        chain = BlockModel({}, random.normal(size=(2, 2)), random.normal(size=2))
        scores = random.normal(size=6).tolist()

        def value(path):
            total = chain.start[path[0]] + sum(s if y else -s for s, y in zip(scores, path))
            return total + sum(chain.steps[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert chain.decode(scores) == [bool(y) for y in best]
    assert chain.decode([]) == []


def test_blocks():
    page = """<!DOCTYPE html><head><title>T</title><style>p{}</style></head><body><!-- <p>no</p> -->
    <script>var a = "</p><p>x";</script><ul><li>One<li>Two &amp; <b>three</b></ul>
    <div class="Side-bar wide">A<br>B&nbsp;C<p>D</div>E <textarea>f</textarea> 1 < 2 <p>open"""
    blocks = leaf_blocks(page)
    assert [b.text for b in blocks] == ["One", "Two & three", "A B C", "D", "E 1 < 2", "open"]
    assert {"div", ".side", ".bar", ".wide"} <= blocks[2].above and blocks[3].tag == "p"
    assert ".side" not in blocks[4].above


@pytest.mark.parametrize("inside", [
    "<svg width=1/>", "<svg/>", "<svg><title>t</title><path d='x'/></svg>", "<svg><svg></svg></svg>", "<math><mi>x</mi></math>",
    "<math/>", "<video src=x>", "<video src=x>no</video>", "<video src=x><audio>", "<audio src=y>", "<canvas>no</canvas>",
    "<canvas>", "<object data=x>", "<object><object>no</object>no</object>", "<select><option>no</select>", "<noscript>no</noscript>",
    "<template><p>no</p></template>", "<svg><script>'</svg>'</script></svg>", "<!-- <svg> -->", "<iframe src=x>no</iframe>",
])
def test_elements_without_text_cut_nothing(inside):
    for before, behind in (("<p>One.</p>", "<p>Two.</p>"), ("<div><p>One.", "</div><p>Two."), ("<p>One.", "<p>Two.<video>Three</video>")):
        blocks = [b.text for b in leaf_blocks(f"<body>{before}{inside}{behind}")]
        assert blocks == ["One.", "Two."], (before, inside)


@pytest.mark.parametrize("tag", ['<a href="x>', "<a href='x>", '<a href="x" title="y>', "<p title=it's>", '<b class=">'])
def test_unbalanced_quotes_are_part_of_the_tag(tag):
    text = " ".join(b.text for b in leaf_blocks(f"<p>One. {tag}Two.</p><p>Three.</p>"))
    assert text == "One. Two. Three."


def test_many_open_elements_take_linear_time():
    assert [b.text for b in leaf_blocks("<svg><video>" * 20_000 + "<p>end")] == ["end"]
    assert [b.text for b in leaf_blocks("<svg><video>" * 20_000 + "no" + "</svg>" * 3 + "<p>end")] == ["end"]
    assert leaf_blocks("<a href='" * 3_000 + "<p>end")[-1].text.endswith("end")


PAGE = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a>
<li><a href=y>News</a></ul></nav><div class="cookie-notice"><p>We use cookies here.</p></div><article><h1>Title of it</h1>
<p>First   paragraph &eacute;nds here.</p><div class="ad">Buy now!</div><p>Second paragraph of the text, with an end.</p>
</article><aside class="sidebar"><h3>Related</h3><ul><li><a href=z>Other story</a></ul></aside><form><label>Mail</label>
<button>Go</button></form><section class="comments"><h3>Comments</h3><div class="comment"><p>I disagree with all this.</p>
</div></section><footer><p>Copyright 2024</p></footer></body></html>"""


def test_main_text_and_odd_rows(spark, model):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p", "x"),
            (4, "u", "<div>" * 3000 + "deep", "x"), (5, "u", "<article><p>" + "long word " * 100_000, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    result = main_text(pages, model)
    assert result.columns == ["page_id", "url", "text", "n_chars"]
    got = result.collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == "Title of it\nFirst paragraph énds here.\nSecond paragraph of the text, with an end."
    assert by_id[2] == by_id[3] == "" and by_id[5].count("long word") == 100_000
    assert main_text(pages.limit(0), model).count() == 0
