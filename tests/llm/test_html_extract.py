import time

import re

import pytest

from ledgerloom.llm.html_extract import extract, main_text

LONG = "word and more words of the story, " * 12

CASES = [
    (None, ""),
    ("", ""),
    ("<html><head><title>t</title></head><body></body></html>", ""),
    ("just &lt;text&gt; &amp;  more", "just <text> & more"),
    (f"<nav><a href='/'>Home</a></nav><article><h1>T</h1><p>{LONG}</p><p>x</p></article><footer>f</footer>", f"T\n{LONG.strip()}\nx"),
    (f"<article><h1>T</h1><p><b>a\n b<br><p>c &eacute;<p>{LONG}</article><p>outside</p>", f"T\na b\nc é\n{LONG.strip()}"),
    (f"<div class='cookie-notice'>We use cookies</div><div id=main><p>{LONG}</p><div class=ad>buy</div><p>end</p></div><div class='sidebar'><p>{LONG}</p></div>", f"{LONG.strip()}\nend"),
    (f"<article><p>{LONG}</p><form>mail <input></form><script>var a='<p>x</p>'</script><section class='comments'><article><p>{LONG * 3}</p></article></section></article>", LONG.strip()),
    (f"<article><header><h1>T</h1><span>by me</span></header><p>{LONG}</p><aside>more</aside></article>", f"T\n{LONG.strip()}"),
    (f"<body><div class=menu><ul><li><a>a</a><li><a>b</a></ul></div><div><div><p>{LONG}<p>{LONG}</div></div>", f"{LONG.strip()}\n{LONG.strip()}"),
    ("<article><p>" + "y" * 200_000 + "</p></article>", "y" * 200_000),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_cases(n):
    html, want = CASES[n]
    assert main_text(html) == want


S = LONG.strip()
REGIONS = [
    (f"<div id=content><p>{LONG}</p><p>{LONG}</p></div><article class=card><p>a teaser of some words</p></article>", f"{S}\n{S}\na teaser of some words"),
    (f"<div><section><p>{LONG[:33]}</p></section><section><p>{LONG}</p></section></div><ul><li><a href=/>Home</a></ul>", f"{LONG[:33].strip()}\n{S}"),
    (f"<div><h1>A title</h1><div><p>{LONG * 9}</p><p>{LONG}</p><p>{LONG}</p></div></div>", f"A title\n{(LONG * 9).strip()}\n{S}\n{S}"),
    (f"<div><p><a name=x>{LONG}</p><p>{LONG}</p></div>", f"{S}\n{S}"),
    (f"<div><p><a href=x>in a link<p>{LONG}</p><p><a href=y>{LONG}</a></p><p>{LONG}</p></div>", f"in a link\n{S}\n{S}\n{S}"),
    (f"<div><p>{LONG}</p></div><div><p><a href=x>one</a></p><p><a href=y>two</a></p></div><div><p>{LONG}</p></div>", f"{S}\n{S}"),
    (f"<main><article><p>{LONG}</p></article><article><p>{LONG}</p></article></main><div><p>x</p></div>", f"{S}\n{S}"),
]


NAMED = [
    (f"<div class='layout has-sidebar'><div><p>{LONG}</p></div><div class=sidebar><p>{LONG[:60]}</p></div></div>", S),
    (f"<div class='no-comments'><p>{LONG}</p></div>", S),
    (f"<div class='wide social'><article><p>{LONG}</p></article></div>", S),
    (f"<article class='post tag-social category-legal'><p>{LONG}</p></article>", S),
    (f"<article class='widget'><p>{LONG}</p></article>", S),
    (f"<article><div class='entry-header'><h1>T</h1><span>by me</span></div><p>{LONG}</p></article>", f"T\n{S}"),
    (f"<div><div class='entry-header'><h1>T</h1></div><p>{LONG}</p></div><div class='site-header'><h1>Site</h1></div>", f"T\n{S}"),
    (f"<main><div class='layout social'><p>{LONG}</p><p>a <span class=ad>buy</span> b</p></div></main>", f"{S}\na b"),
    (f"<article><p>{LONG}</p></article><div class='comments-area'><article><p>{LONG * 2}</p></article></div>", S),
    (f"<div><p>{LONG}</p></div><div class='cookie-notice'><p>{LONG[:90]}</p></div>", S),
]


@pytest.mark.parametrize("n", range(len(NAMED)))
def test_class_names(n):
    html, want = NAMED[n]
    assert main_text(html) == want


@pytest.mark.parametrize("n", range(len(REGIONS)))
def test_regions(n):
    html, want = REGIONS[n]
    assert main_text(html) == want


def plain_article(html):
    """The article's blocks by plain text cutting, for the well-formed test pages."""
    from html import unescape

    body = re.search(r"<article>(.*)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", body)
    texts = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_pages(spark):
    rows = extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    assert len(rows) == 250
    for r in rows:
        assert r["text"] == plain_article(r["html"]) and r["n_chars"] == len(r["text"])


def test_rows(spark):
    pages = spark.createDataFrame([(1, None, "k"), (1, None, "k"), (None, CASES[4][0], "k")], "page_id long, html string, text string")
    out = extract(pages).collect()
    assert [r["text"] for r in out] == ["", "", CASES[4][1]]
    assert extract(pages.limit(0)).count() == 0


STORY = "A long story that goes on and on, with many words and hardly any tags, as articles do. "


@pytest.mark.parametrize("opened", ["<div>", "<div class='nav'>", "<span>", "<article>", "<b><div>", "<p><i>", "<div class='nav'><article>x"])
def test_deep_nesting_takes_linear_time(opened):
    def seconds(n):
        began = time.process_time()
        main_text(opened * n + STORY * 3 + "</b></i>" * n)
        return time.process_time() - began

    seconds(1000)
    assert seconds(80_000) < 30 * max(seconds(8_000), 0.05)


def test_what_stands_inside_the_article_stays():
    page = f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{STORY * 3}</p><p id='legal'>{STORY}</p><p><a href=/x>{STORY}</a></p><p>in<img src=x>side</p></article><footer>end</footer>"
    assert main_text(page) == "\n".join(["Title", (STORY * 3).strip(), STORY.strip(), STORY.strip(), "inside"])


BLOCKS = [f"Block {i}. {STORY}".strip() for i in range(7)]
BODY = "".join(f"<p>{b}</p>" for b in BLOCKS)
MENU = "<nav><a href=/>Home</a> <a href=/a>All</a></nav>"
FRAMED = {
    "a page-wide form": f"<form id=aspnetForm><input name=q><button>Go</button>{MENU}<article>{BODY}</article><footer>End of page</footer></form>",
    "a form around a div": f"<form id=aspnetForm><select><option>de<option>en</select><div class=content>{BODY}</div></form>",
    "a header around an article": f"<header><h2>Site</h2><article>{BODY}</article></header>",
    "a dialog": f"<div role=dialog><article>{BODY}</article></div>",
    "a dialog element": f"<dialog open><main>{BODY}</main></dialog>",
    "hidden until loaded": f"<div aria-hidden=true><article>{BODY}</article></div>",
    "not displayed until loaded": f"<div style='display:none'><main>{BODY}</main></div>",
    "an open menu": f"<nav><a href=/>Home</a><a href=/a>All</a><article>{BODY}</article>",
    "an open list of choices": f"<select><option>de<option>en<article>{BODY}</article>",
    "an open list before a div": f"<select><option>de<option>en<div>{BODY}</div>",
    "an aside": f"<aside role=complementary><article>{BODY}</article></aside>",
    "a banner": f"<div role=banner><article>{BODY}</article></div>",
    "frames in frames": f"<form><div role=dialog><header>{MENU}<article>{BODY}</article></header></div></form>",
    "a form with a class": f"<form class=search-form><div class=wrapper><article>{BODY}</article></div></form>",
    "beside a hidden notice": f"<div hidden><p>{STORY}</p></div><article>{BODY}</article>",
    "beside a form": f"<article>{BODY}</article><form><p>Write to us. {STORY}</p><textarea>x</textarea></form>",
    "beside a footer with an article": f"<main>{BODY}</main><footer><article>{STORY}</article></footer>",
    "a div beside a long footer": f"<div>{BODY}</div><footer><p>{STORY * 4}</p></footer>",
    "a div beside an aside": f"<div>{BODY}</div><aside><p>{STORY}</p><p>{STORY}</p></aside>",
    "a menu and a search": f"{MENU}<search><p>Find {STORY}</p></search><main>{BODY}</main>",
    "tables": f"<table><tr><td>{MENU}</td><td><form>{BODY}</form></td></tr></table>",
}


@pytest.mark.parametrize("name", FRAMED)
def test_what_frames_the_page_marks_nothing(name):
    assert main_text(f"<html><body>{FRAMED[name]}</body></html>") == "\n".join(BLOCKS)
