"""Pages whose article was lost: open heads, early ends of the body, wrappers with words of boilerplate."""

from __future__ import annotations

import pytest

from ledgerscope.llm.html_extract import main_text

TEXT = "<h1>Head line</h1><p>First text, long enough to be one.</p><p>Second text of the page.</p>"
WANT = "Head line\nFirst text, long enough to be one.\nSecond text of the page."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta charset=utf-8><body><article>{TEXT}</article></body></html>",
        f"<head><title>T</title><style>p {{}}</style><div>{TEXT}</div>",
        f"<html><head><title>T</title></head><body></body>{TEXT}</html>",
        f"<html><body></body><body><div>{TEXT}</div></body></html>",
        f"<html><head></head><body><h1>Head line</h1></body></html>{TEXT.split('</h1>')[1]}",
        f"<head><template><p>No</p></template></head><body>{TEXT}",
    ],
)
def test_open_heads_and_early_ends(page):
    assert main_text(page) == WANT


def test_text_ends_a_head():
    assert main_text("<head><title>T</title>Bare text") == "Bare text"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='content has-sidebar'>{TEXT}</div></body>",
        f"<body><div class='nav-open'><div class='header-fixed'><article>{TEXT}</article></div></div></body>",
        f"<body><form action=/x><div>{TEXT}</div><input></form></body>",
        f"<body><div class='sidebar layout'><main>{TEXT}</main><div class=comments><p>A reader.</p></div></div></body>",
        f"<body><article>{TEXT.replace('<h1>', '<h1 id=search-methods>').replace('<p>', '<p id=notice>')}</article></body>",
        f"<body><article>{TEXT.split('<p>Second')[0]}<section id=related-work><p>Second text of the page.</p></section></article></body>",
        f"<body><article>{TEXT.split('<p>Second')[0]}<section id=discussion><p>Second text of the page.</p></section></article></body>",
        f"<body><article>{TEXT}</article><div class=comments><article>{'A long comment of a reader. ' * 30}</article></div></body>",
    ],
)
def test_words_and_forms_around_the_article(page):
    assert main_text(page) == WANT


LONG = "<p>First text, long enough to be one.</p><p>Second text of the page.</p>"
PLAIN = ["First text, long enough to be one.", "Second text of the page."]
INSIDE = {
    "links in a sentence": ("<p>See <a href=1>one work</a> and <a href=2>another work</a>.</p>", ["See one work and another work."]),
    "sources": ("<h2>Sources</h2><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>", ["Sources", "One", "Two"]),
    "table": ("<table><tr><td><a href=1>Ada</a></td><td>1</td></tr><tr><td><a href=2>Bob</a></td><td>2</td></tr></table>", ["Ada 1", "Bob 2"]),
    "math": ("<p>Let <math><mi>x</mi></math> hold.</p>", ["Let x hold."]),
    "inline words": ("<p>Do <em class=skip>now</em> what <span class='notice-word'>is</span> said.</p>", ["Do now what is said."]),
    "strategy": ("<div class='search-strategy'><p>How it was found.</p></div>", ["How it was found."]),
    "related work": ("<div id='related-work'><p>What others did.</p></div>", ["What others did."]),
    "holders": ("<div class='share-holders'><p>Who owns it.</p></div>", ["Who owns it."]),
    "notice": ("<div class='cookie-notice'><p>We use cookies.</p></div>", []),
    "ads by a name": ("<div class='partner-ads-2'><p>Buy this now.</p></div>", []),
    "links by a name": ("<div class='share-corner'><a href=1>Here</a> <a href=2>there</a></div>", []),
    "form by a name": ("<div class='signup-corner'><p>Write to us.</p><input></div>", []),
    "comments": ("<div class='comments-thread'><p>A reader's words.</p></div>", []),
}


@pytest.mark.parametrize("name", sorted(INSIDE))
@pytest.mark.parametrize("tag", ["article", "div"])
def test_inside_the_text(name, tag):
    markup, texts = INSIDE[name]
    assert main_text(f"<body><{tag}>{LONG}{markup}</{tag}></body>") == "\n".join(PLAIN + texts)
    first, second = LONG.split("<p>Second")
    assert main_text(f"<body><{tag}>{first}{markup}<p>Second{second}</{tag}></body>") == "\n".join([PLAIN[0], *texts, PLAIN[1]])


@pytest.mark.parametrize(
    "page",
    [
        f"<body><h1>The Title</h1><div>{LONG}</div></body>",
        f"<body><div><h1>The Title</h1></div><div>{LONG}</div></body>",
    ],
)
def test_title_beside_the_text(page):
    assert main_text(page) in ("\n".join(["The Title", *PLAIN]),)


def test_sentences_beside_the_text():
    lead, last = "<div><p>A short lead.</p></div>", "<div><p>The end of it.</p></div>"
    menu = "<div><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></div>"
    page = f"<body>{menu}{lead}<div>{LONG * 3}</div>{last}Bare <b>text</b> after it.<div>Site name</div></body>"
    assert main_text(page) == "\n".join(["A short lead.", *PLAIN * 3, "The end of it.", "Bare text after it."])
