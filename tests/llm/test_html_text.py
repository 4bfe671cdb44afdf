import html
import random

import pytest

from molspark.llm import html_text
from tests.llm.helpers import FOLDER, prose

LONG = "A paragraph that is long enough to make the windows surge, with &amp; and <b>bold</b> words in it for good measure."
PLAIN = "A paragraph that is long enough to make the windows surge, with & and bold words in it for good measure."
NOISE = "Text of a part that belongs to no article, although it is long enough to be taken for one by its length alone."

DROPPED = [
    f"<nav><ul><li><a href='/x'>{NOISE}</a></li></ul></nav>", f"<header>{NOISE}</header>", f"<footer><p>{NOISE}</p></footer>",
    f"<aside>{NOISE}</aside>", f"<form><p>{NOISE}</p><input></form>", f"<script>var a = '<p>{NOISE}</p>';</script>", f"<style>{NOISE}</style>",
    f"<!-- <p>{NOISE}</p> -->", f'<div class="ad">{NOISE}</div>', f'<div class="sidebar-left"><div>{NOISE}</div></div>',
    f'<section id="comments"><article class="comment"><p>{NOISE}</p></article></section>', f'<div class="cookie-notice">{NOISE}</div>',
    f'<div role="navigation">{NOISE}</div>', f"<div hidden>{NOISE}</div>", f'<div style="display: none">{NOISE}</div>', f"<noscript>{NOISE}</noscript>",
]


@pytest.mark.parametrize("noise", DROPPED)
@pytest.mark.parametrize("frame", ["<article>{}</article>", '<div class="content">{}</div>', "<main>{}</main>", "{}"])
def test_noise_goes_and_paragraphs_stay(noise, frame):
    body = f"<h1>Title</h1><p>{LONG}</p>{noise}<p>{LONG}</p><p>Short.</p>"
    page = f"<!DOCTYPE html><html><head><title>x</title></head><body>{frame.format(body)}{noise}</body></html>"
    assert html_text.main_text(page) == "\n\n".join(["Title", PLAIN, PLAIN, "Short."])


def test_lines_of_links_go_unless_the_article_holds_them():
    links = f"<div><a href=x>{NOISE}</a></div>" * 4
    assert html_text.main_text(f"{links}<div class=ad>x</div><p>{LONG}</p>") == PLAIN
    assert html_text.main_text(f"<article><p>{LONG}</p><p><a href=x>{NOISE}</a></p></article>") == f"{PLAIN}\n\n{NOISE}"


def test_short_lines_away_from_the_text_go():
    page = f"<div>Home</div><div>News</div><div class=ad>x</div><div><h2>Title</h2><p>{LONG}</p><p>End.</p></div><div class=ad>x</div><div>Imprint</div>"
    assert html_text.main_text(page) == f"Title\n\n{PLAIN}\n\nEnd."


@pytest.mark.parametrize("noise", DROPPED)
@pytest.mark.parametrize("after, lines", [
    ("<p>A last short paragraph.</p>", ["A last short paragraph."]), ("<ul><li>one</li><li>two</li></ul><p>End.</p>", ["one", "two", "End."]),
    ("<p>\u77ed\u3044\u6bb5\u843d\u3067\u3059\u3002</p><p>\u7d42\u308f\u308a\u3002</p>", ["\u77ed\u3044\u6bb5\u843d\u3067\u3059\u3002", "\u7d42\u308f\u308a\u3002"]),
])
@pytest.mark.parametrize("frame", ["<div>{}</div>", "<body>{}", "<div><div><section>{}</section></div></div>"])
def test_short_lines_after_noise_in_the_text_stay(noise, after, lines, frame):
    page = frame.format(f"<p>{LONG}</p>{noise}{after}{noise}<p>Last.</p>") + f"{noise}"
    assert html_text.main_text(page) == "\n\n".join([PLAIN, *lines, "Last."])


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("<p>only this", "only this"), ("<a href=x>link</a>", ""), ("<!-- never closed <p>x</p>", ""),
    ("<script>never closed <p>x</p>", ""), ("a < b and &lt;c&gt; &#233; &nbsp; d", "a < b and <c> é d"), ("<p>cut off <b cla", "cut off"),
    ("<article><p>one\n\t two<br>three</p><p></p><p>four", "one two three\n\nfour"), ("</div></p>x</article>", "x"), ("<p title='a>b'>x</p>", "x"),
    ("<body class='has-sidebar'><article class='post'>x</article>", "x"), ("<ul><li>a<li>b</ul>", "a\n\nb"),
])
def test_cases(page, text):
    assert html_text.main_text(page) == text


def test_generated_articles():
    """Random articles in random frames: the text is what was put in."""
    rnd = random.Random(2)
    for _ in range(150):
        blocks = [prose(rnd, rnd.choice((1, 3, 30, 80))) + rnd.choice(("", " & <x>", " 'é'")) for _ in range(rnd.randrange(1, 12))] + [prose(rnd, 60)]
        body = ""
        for b in blocks:
            body += rnd.choice(("<p>{}</p>", "<p>{}", "<div>{}</div>", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>")).format(html.escape(b).replace(" ", rnd.choice((" ", "\n  ")), 3))
            body += rnd.choice(("", "", rnd.choice(DROPPED)))
        page = f"<html><body>{rnd.choice(DROPPED)}<article>{body}</article>{rnd.choice(DROPPED)}</body></html>"
        assert html_text.main_text(page) == "\n\n".join(" ".join(b.split()) for b in blocks)


def test_very_long_page_takes_linear_time():
    page = "<div>" * 20_000 + f"<p>{LONG}</p>" * 5000 + "</span>" * 20_000 + "<" * 1000 + '<a href="' * 200
    assert html_text.main_text(page).startswith("\n\n".join([PLAIN] * 100))


def test_extract(spark):
    data = [(1, "u", f"<article><p>{LONG}"), (1, "u", f"<article><p>{LONG}"), (2, None, None), (None, "v", ""), (3, "w", "<p>é")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS _0")
    wanted = [(i, u, html_text.main_text(h), len(html_text.main_text(h))) for i, u, h in data]
    found = html_text.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)
    assert html_text.extract(pages.limit(0)).collect() == []


def test_driver_pages(spark):
    found = html_text.extract(spark.read.parquet(f"{FOLDER}/pages.parquet")).collect()
    assert len(found) == 50 and all(r.n_chars > 0 and "&copy;" not in r.text and "<" not in r.text[:1] for r in found)


def test_many_unclosed_links_take_linear_time():
    import time
    page = "<div>" + "".join(f"<a href=x>link {i}" for i in range(100_000)) + "</div><p>" + "A real sentence of the text. " * 20 + "</p>"
    began = time.time()
    text = html_text.main_text(page)
    assert time.time() - began < 6 and text.endswith("A real sentence of the text.")


def test_open_link_is_forgotten_with_its_parent():
    lines = html_text.lines_of("<div><a>one<a>two</div>three<a>four</a>five")
    assert [(line[0], line[1]) for line in lines if line] == [("onetwo", 6), ("threefourfive", 4)]
