"""Attributes that only look like those of what is not main text, and closing tags of very deep elements."""

import pytest

from watchloom.llm import wrappers

TEXT = "a text of some length that is the main text of its page " * 3


@pytest.mark.parametrize("attributes", [
    'style="overflow: hidden"', 'class="post hidden-xs"', 'title="the hidden cost"', 'class="content with-sidebar"',
    'class="social-enabled"', 'data-note="x hidden y"', 'style="--my-display:none-of-it"',
])
@pytest.mark.parametrize("tag", ["div", "article"])
def test_main_text_is_kept(tag, attributes):
    assert wrappers.main_text(f"<body><{tag} {attributes}><p>{TEXT}</p></{tag}></body>", None) == TEXT.strip()


@pytest.mark.parametrize("name", ["no-sidebar", "sidebar", "menu social"])
def test_names_of_a_body_say_nothing(name):
    assert wrappers.main_text(f'<body class="{name}"><div><p>{TEXT}</p></div></body>', None) == TEXT.strip()


@pytest.mark.parametrize("attributes", [
    "hidden", "HIDDEN", 'hidden=""', 'style="color:red; display : none"', 'aria-hidden="true"', 'class="x sidebar"', 'id="comments"',
])
def test_what_is_not_main_text_still_goes(attributes):
    page = f"<body><article><p>{TEXT}</p><div {attributes}>other words</div></article></body>"
    assert wrappers.main_text(page, None) == TEXT.strip()


def test_closing_tags_below_the_deepest_level_match_their_own_elements():
    deep = "<div>" * 200
    page = f"<article>{deep}in{'</div>' * 60}<p>mid</p>{'</div>' * 140}<p>{TEXT}</p></article><div>out</div>"
    assert wrappers.main_text(page, None) == f"in\n\nmid\n\n{TEXT.strip()}"
    items = "<article>" + "<div>" * 200 + "<p>one<p>two<ul><li>three<li>four</ul></div>" + "</div>" * 199 + "<p>five</article><p>out"
    assert wrappers.main_text(items, None) == "one\n\ntwo\n\nthree\n\nfour\n\nfive"


def test_an_element_stays_open_while_deeper_ones_close():
    page = f"<body><div>{'<div>' * 200}in{'</div>' * 200}<p>{TEXT}</p></div><section>out</section></body>"
    assert wrappers.main_text(page, None) == f"in\n\n{TEXT.strip()}"
