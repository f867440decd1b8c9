import numpy as np
import pytest

from tickweave.llm.crf import viterbi, with_neighbours
from tickweave.llm.dom_blocks import leaf_blocks
from tickweave.llm.main_text import Layouts, fit_blocks, main_texts, page_features, train_blocks, with_main_text

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body><div id="cookie-consent"><p>We use cookies to improve this site.</p></div><header class="site-header"><h1>News</h1>
<p>The best news</p></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- no <p>comment</p> --><article>
<h1>Caf&eacute; &amp; bar</h1><p>First   paragraph of the&nbsp;story,\n with <b>bold</b>face.<br>Same block.<p>Second one &lt;here&gt;.
<div class="ad-slot">Buy now, buy cheap!</div><ul><li>item one<li>item two</ul></article>
<aside class="sidebar"><h3>Popular</h3><ul><li><a>some story</a></ul></aside><section id="comments"><h2>1 comment</h2>
<div class="comment"><p>Great article, I liked it very much.</p></div></section>
<form><label>Email</label><button>Send</button></form><footer>&copy; 2024 News &middot; all of it</footer></body></html>"""
TEXT = "Café & bar\nFirst paragraph of the story, with boldface. Same block.\nSecond one <here>.\nitem one\nitem two"


@pytest.fixture(scope="module")
def chain():
    words = "the quick brown fox jumps over a lazy dog while seven small birds sing songs about green hills".split()
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, 60)) + "." for _ in range(50)]
    return fit_blocks(texts)


def test_blocks_are_read_tolerantly():
    texts = [b.text for b in leaf_blocks(PAGE)]
    assert [t for t in texts if t.startswith("no")] == [] and "No" not in texts
    assert TEXT.split("\n")[1] in texts and texts[:2] == ["We use cookies to improve this site.", "News"]
    cut = [b.text for b in leaf_blocks(PAGE[:900])]
    assert cut[: len(cut) - 1] == texts[: len(cut) - 1]
    for html in (None, "", "   ", "<", "<p", "<p title='x", "<!--", "</p></p></div>", "<script>x", "&", "a < b"):
        assert all(b.text == " ".join(b.text.split()) for b in leaf_blocks(html))
    assert [b.text for b in leaf_blocks("a < b &amp &lt;c>")] == ["a < b & <c>"]
    deep = leaf_blocks("<div>" * 3000 + "x" + "</div>" * 3000)
    assert [b.text for b in deep] == ["x"]


def test_main_text_of_one_page(chain):
    assert main_texts(chain, [PAGE], {}) == [TEXT]


def test_held_out_layouts(chain):
    layouts = Layouts(["other words for other pages that nobody has seen so far at all"] * 5, seed=77)
    right = total = 0
    for _ in range(300):
        blocks = leaf_blocks(layouts.page())
        if blocks:
            x, n = page_features(blocks, {}), np.array([len(blocks)])
            labels = viterbi(chain, chain.scores(with_neighbours(x, n)), n)
            right += sum((y == 1) == (b.mark == "1") for y, b in zip(labels, blocks))
            total += len(blocks)
    assert right / total > 0.97


def test_frames_with_nulls_repeats_and_nothing(spark, chain):
    rows = [(1, "u", PAGE, "keep"), (1, "u", PAGE, "keep"), (None, None, None, None), (2, "v", "", ""), (3, "w", "<p>" * 500, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT_ string")
    got = with_main_text(df, chain).collect()
    assert [r.text for r in got] == [TEXT, TEXT, "", "", ""] and got[0].TEXT_ == "keep"
    assert with_main_text(df.limit(0), chain).count() == 0
    fitted = train_blocks(df, max_pages=3)
    assert with_main_text(df, fitted).first().text == TEXT
    assert train_blocks(df.limit(0)).emit.shape == chain.emit.shape
