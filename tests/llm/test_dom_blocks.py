import pytest

from tickweave.llm.dom_blocks import leaf_blocks


def texts(html):
    return [b.text for b in leaf_blocks(html)]


@pytest.mark.parametrize(
    "attributes",
    [
        'style="overflow:hidden"', 'style="overflow: hidden"', 'href="/the/hidden/valley"', "href=/the/hidden/valley", 'title="a hidden gem"',
        'aria-label="hidden costs explained"', 'class="hidden lg:block"', 'title="display:none"', 'data-x="aria-hidden=true"',
        'aria-hidden="false"', 'style="display:none; display:block"', 'style="x-display:none"', "data-hidden", "title='a > hidden'",
    ],
)
def test_words_in_values_hide_nothing(attributes):
    assert texts(f"<div {attributes}><p>one</p></div><p>two <a {attributes}>three</a> four") == ["one", "two three four"]


@pytest.mark.parametrize(
    "attributes",
    [
        "hidden", "HIDDEN", 'hidden=""', "class=x hidden id=y", 'aria-hidden="true"', "aria-hidden = true", 'style="display:none"',
        "style='color:red; DISPLAY : none !important; display:block'", "style=display:none",
    ],
)
def test_hidden_elements_are_left_out(attributes):
    assert texts(f"<div {attributes}><p>one</p></div><p>two") == ["two"]


def test_names_and_marks():
    block = leaf_blocks("<div CLASS='a b' id=c data-id=no title='class=no' data-y=1 class=no>x")[0]
    assert block.path[-1].names == "a b c" and block.mark == "1"


HEAD = "<html><head><meta charset=utf-8><title>No</title><link rel=x><style>p{}</style><script>no()</script><noscript><img></noscript>"


@pytest.mark.parametrize("start", ["<body>", "", "<div>", "<article>", "<h1>", "<main>", "<a href=x>", "<br>", "<header>", "<x-story>"])
def test_a_head_without_end_tag_ends_where_the_body_begins(start):
    assert texts(HEAD + f"\n{start}one<p>two<title>no</title></html>") == ["one", "two"]


def test_what_stands_in_a_head_stays_out():
    assert texts(HEAD + "<template><div>no</div></template>\n<!-- no --></head>\n<body><p>one") == ["one"]
    assert texts("<head><noscript><p>no</p></noscript><body>one") == ["one"]
