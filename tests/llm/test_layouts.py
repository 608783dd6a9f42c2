"""Main text of pages written by hand, in layouts and words that the training pages don't have."""

import time
from itertools import product

import numpy as np
import pytest

from assaymill.llm import html

PAGES = {
    "magazine": (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>Rivers — The Weekly</title><link rel=stylesheet href=a.css></head><body class="home single">
<div id="skip"><a href="#c">Skip to text</a></div><div class="topbar navbar"><a href="/">Home</a> <a href="/world">World</a> <a href="/local">Local</a></div>
<main id="c"><h1>The river that came back</h1><p class="lead">For forty years nobody swam here.</p><p>Then the mills closed, one after another, and the water cleared.</p>
<figure><img src=a.jpg><figcaption>The old bridge in May.</figcaption></figure><h2>Fish return</h2><p>Trout were seen first in 1998, and salmon followed ten years later.</p>
<aside class="related"><h3>Read next</h3><ul><li><a href="/1">Ten lakes to visit</a></li><li><a href="/2">Boats for rent</a></li></ul></aside>
<p>Today the town plans a beach.</p></main><footer><p>&copy; 2021 The Weekly. All rights reserved.</p></footer></body></html>""",
        ["The river that came back", "For forty years nobody swam here.", "Then the mills closed, one after another, and the water cleared.", "Fish return", "Trout were seen first in 1998, and salmon followed ten years later.", "The old bridge in May.", "Today the town plans a beach."],
    ),
    "blog": (
        """<html><head><title>x</title></head><body><div id="wrap"><div id="header"><h1>My garden</h1><p>Notes of an amateur</p></div><div class="menu"><ul><li><a href=/>Start</a></li><li><a href=/about>About</a></li></ul></div>
<div class="post"><h2>Planting beans</h2><p>Beans need warmth, so wait until the nights are mild.</p><ul><li>Soak them overnight.</li><li>Plant them two fingers deep.</li></ul><p>Water them sparingly.</p></div>
<div id="comments"><h3>3 replies</h3><div class="comment"><p>Thanks, that worked for me too.</p></div></div><div id="sidebar"><h3>Archive</h3><a href=/2019>2019</a></div><div id="footer">Made with love &middot; 2020</div></div></body></html>""",
        ["Planting beans", "Beans need warmth, so wait until the nights are mild.", "Soak them overnight.", "Plant them two fingers deep.", "Water them sparingly."],
    ),
    "manual": (
        """<html><body><nav role="navigation"><ol><li><a href=1>Install</a></li><li><a href=2>Configure</a></li><li><a href=3>Run</a></li></ol></nav><article><header><h1>Configure</h1></header>
<section><h2>Files</h2><p>The program reads one file, which lists its folders.</p><pre>folders = a, b</pre><p>Changes count from the next start on.</p></section><section><h2>Limits</h2><p>There is no limit on folders.</p></section></article>
<form action="/search"><input name=q><button>Search</button></form><footer>Version 3</footer></body></html>""",
        ["Files", "The program reads one file, which lists its folders.", "Changes count from the next start on.", "Limits", "There is no limit on folders."],
    ),
    "notice": (
        """<html><body><div class="cookie-consent"><p>We use cookies to make this site better.</p><button>Accept</button></div><header class="masthead"><a href="/">Daily</a></header><article class="story"><h1>Bakers strike</h1>
<p>Bread was short in the city on Monday.</p><div class="advert"><p>Ovens at half price!</p></div><p>Talks are to resume on Thursday, said both sides.</p></article><div class="newsletter"><p>Get our letter every morning.</p></div>
<section class="comments"><h2>Comments</h2><p>About time, I say.</p></section></body></html>""",
        ["Bakers strike", "Bread was short in the city on Monday.", "Talks are to resume on Thursday, said both sides."],
    ),
    "drawing": ("<html><body><nav><a href=/>Home</a></nav><article><svg/><p>Hello there, this follows a drawing.</p><p>A <math><mi/></math> in a line stays, too.</p><svg><path d='M0'/></svg><p>The end comes last.</p></article></body></html>",
                ["Hello there, this follows a drawing.", "A in a line stays, too.", "The end comes last."]),
}


def test_pages_by_hand():
    field, right, wrong = html.trained(), 0, []
    for name, (page, want) in PAGES.items():
        blocks = [b[1] for b in html.blocks_of(page)]
        got = html.main_text(page, field).split("\n\n")
        for b in blocks:
            right += (b in want) == (b in got)
            wrong += [(name, b)] * ((b in want) != (b in got))
        assert set(want) <= set(blocks), name
    assert len(wrong) <= 0.05 * (right + len(wrong)), wrong


def test_self_closed_elements():
    field = html.trained()
    assert html.main_text("<article><svg/><p>Hello there, again and again.</p></article>", field) == "Hello there, again and again."
    assert html.blocks_of("<p>a<svg><g/><text>no</text></svg>b</p>")[0][1] == "ab"
    assert html.blocks_of("<div/>text")[0][1] == "text"


BARE = {
    "body": "<html><body><p>The first paragraph tells of a town by the sea.</p><p>The second one goes on about its harbour, which is old.</p></body></html>",
    "boxes": "<body><div class='c1'><p>The first paragraph tells of a town by the sea.</p><p>The second one goes on about its harbour, which is old.</p></div></body>",
    "grid": "<body><ul><li><a href=/>Start</a></li><li><a href=/a>About</a></li><li><a href=/b>Contact</a></li></ul><div class=container><div class=row><div class='col-md-8'><p>The first paragraph tells of a town by the sea.</p>"
    "<p>The second one goes on about its harbour, which is old.</p></div><div class='col-md-4'><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></div></div></div><p>&copy; 2020 Town</p></body>",
    "table": "<table><tr><td><a href=/>Home</a> <a href=/x>News</a></td><td><p>The first paragraph tells of a town by the sea.</p><p>The second one goes on about its harbour, which is old.</p></td></tr></table>",
}


@pytest.mark.parametrize("name", BARE)
def test_pages_that_name_nothing(name):
    """Neither tags nor classes say where the text is."""
    assert html.main_text(BARE[name], html.trained()) == "The first paragraph tells of a town by the sea.\n\nThe second one goes on about its harbour, which is old."


def test_choices_of_forms_are_no_text():
    page = "<article><p>Choose a colour, says the text here.</p><select><option>red<option>blue</select><p>Then go on with the rest of it.</p></article>"
    assert html.main_text(page, html.trained()) == "Choose a colour, says the text here.\n\nThen go on with the rest of it."


@pytest.mark.parametrize("page", ["<div>x" * 20_000, "<a " * 40_000, "<p><b>x" * 15_000, "<div><span>" * 10_000 + "x", "</i>" * 30_000 + "<p>x", "<!--" * 20_000, "<ul><li>x" * 15_000, "<a href='" * 20_000 + ">", "<article>" + "x <i>y " * 20_000])
def test_deep_and_broken_pages_take_linear_time(page):
    began = time.process_time()
    html.features_of(html.blocks_of(page))
    assert time.process_time() - began < 4


def test_unfinished_tags_are_no_text():
    assert [b[1] for b in html.blocks_of("<p>one</p>two <b class=x")] == ["one", "two"]
    assert [b[1] for b in html.blocks_of("a < b and 3 <4")] == ["a < b and 3 <4"]


def test_decoding_against_all_labellings():
    """Viterbi finds the labelling of the greatest weight, and weights of a fitted field make its labels likeliest."""
    g = np.random.default_rng(1)
    field = html.ChainField({f"f{i}": i for i in range(6)}, g.normal(size=(6, 2)), g.normal(size=(2, 2)))
    for _ in range(200):
        page = [[f"f{j}" for j in range(6) if g.random() < 0.4] for _ in range(g.integers(1, 8))]

        def total(labels, page=page):
            local = sum(field.weight[field.index[f], y] for b, y in zip(page, labels, strict=True) for f in b)
            return local + sum(field.pair[a, b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(product((0, 1), repeat=len(page)), key=total)
        assert total(field.decode(page)) == pytest.approx(total(best))


def test_empty_table(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0
    with pytest.raises(StopIteration):
        next(iter(html.blocks_of("")))
