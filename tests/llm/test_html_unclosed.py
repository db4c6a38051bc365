"""Elements that are not closed, and attribute values that hold telling words, do not cost the article."""
import time

import pytest

from stancekit.llm import html_extract as H

A = "The first paragraph of the article says something of some length, as paragraphs do."
B = "A second one follows, and it goes on for a while before it comes to its end."
ARTICLE = f"<article><h1>Title</h1><p>{A}</p><p>{B}</p></article>"
WANT = f"Title\n\n{A}\n\n{B}"


@pytest.mark.parametrize("name", sorted(H.SKIPPED - {"script", "style", "head"}))
def test_unclosed_element_in_the_header(name):
    assert H.main_text(f"<body><header><{name} class=x>Menu</header>{ARTICLE}</body>") == WANT
    # the end tag of a later one does not end it
    assert H.main_text(f"<body><header><{name}></header>{ARTICLE}<footer><{name}>Share</{name}></footer></body>").endswith(
        WANT if name not in H.RAW else "")


def test_unclosed_select_loses_its_options_only():
    page = f"<body><form><select><option>One thing of a list to choose from.<option>Another thing of it.</form>{ARTICLE}</body>"
    assert H.main_text(page) == WANT


@pytest.mark.parametrize("name", ["svg", "object", "canvas"])
def test_nested_self_closing(name):
    assert H.main_text(f"<body><header><{name}>x<{name} a='b'/></{name}></header>{ARTICLE}</body>") == WANT
    assert H.main_text(f"<body><{name}><{name}>x</{name}>not this</{name}>{ARTICLE}</body>") == WANT


@pytest.mark.parametrize("attrs", ['title="The hidden valley"', "data-x='hidden'", 'data-hidden="1"', 'class="overflow-hidden"',
                                   'class="overflow-x-hidden text"', 'data-class="sidebar"', 'alt="id=menu"'])
def test_words_in_values_do_not_hide(attrs):
    assert H.main_text(f"<body><article><h1>Title</h1><p {attrs}>{A}</p><p>{B}</p></article></body>") == WANT


@pytest.mark.parametrize("attrs", ["hidden", 'class="x" hidden', 'hidden=""', "aria-hidden=true", 'class="is-hidden"', "style='display: none'"])
def test_hidden_still_hides(attrs):
    assert H.main_text(f"<body><article><h1>Title</h1><p {attrs}>{A}</p><p>{B}</p></article></body>") == f"Title\n\n{B}"


def test_many_unclosed_take_linear_time():
    start = time.time()
    page = "<body>" + "<div><button>x<textarea>y</div>" * 20_000 + ARTICLE + "<button>z</button></body>"
    assert {A, B} <= {b.text for b in H.blocks(page)}
    assert time.time() - start < 20
