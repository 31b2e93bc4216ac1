"""Article text outside the container that holds most of it."""

import re
import time
from html import unescape

import pyarrow.parquet as pq

from quill.llm.html_text import extract, main_text

LONG = " ".join(["A sentence of the article that is long enough to count."] * 12)
AROUND = "<body><nav><a href=x>Menu</a><a href=y>More</a></nav>{}<footer>foot of the page</footer></body>"


def text(inner):
    return main_text(AROUND.format(inner)).split("\n")


def test_heading_and_lead_outside_a_body_div():
    parts = f"<h1>Title</h1><p>The lead, short.</p><div class=body><p>{LONG}</p></div><aside>An aside.</aside>"
    for tag in ("article", "main"):
        assert text(f"<{tag}>{parts}</{tag}>") == ["Title", "The lead, short.", LONG]
    assert text(f"<main><div class=promo>Buy now.</div><article>{parts}</article></main>") == ["Title", "The lead, short.", LONG]


def test_sections_of_unequal_length():
    assert text(f"<article><section><p>{LONG}</p></section><section><p>Short end.</p></section></article>") == [LONG, "Short end."]


def test_prose_around_a_large_table_or_quotation():
    assert text(f"<article><p>Before.</p><table><tr><td>{LONG}</td></tr></table><p>After.</p></article>") == ["Before.", LONG, "After."]
    for tag in ("blockquote", "details"):
        assert text(f"<div><p>Before.</p><{tag}><p>{LONG}</p></{tag}><p>After.</p></div>") == ["Before.", LONG, "After."]


def test_what_is_never_text_goes_piece_by_piece():
    assert main_text("<p>Hello there <script>var a=1;</script> world</p>") == "Hello there world"
    assert main_text('<p>Hello <style>p{}</style>there<button>Go</button> <span class="ad">Buy <b>now</b></span> world</p>') == "Hello there world"
    assert main_text("<pre>x = 1 <span class=comment># why</span></pre>") == "x = 1 # why"


def test_a_form_around_the_page_and_unlucky_names():
    assert main_text(f"<form><h1>T</h1><p>{LONG}</p><label>Name</label><select><option>o</option></select></form>") == f"T\n{LONG}"
    assert main_text(f"<form><article><p>{LONG}</p></article><input></form>") == LONG
    for tag in ("article", "div"):
        assert main_text(f'<body><nav>menu</nav><{tag} class="social-history"><p>{LONG}</p><div class=sponsor>Buy this.</div></{tag}></body>') == LONG
    assert text(f"<article><p>Short.</p></article><form><p>{LONG}</p></form><div class=comments><p>{LONG}</p></div>") == ["Short."]


def test_an_articles_own_header_stays():
    assert text(f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{LONG}</p><footer>By me</footer></article>") == ["Title", LONG]
    assert text(f"<div><div class=entry-header><h2>Title</h2></div><p>{LONG}</p></div>") == ["Title", LONG]


def test_an_article_in_sibling_containers():
    short = ["Two short ones here.", "And some more words of it."]
    assert text(f"<div><p>{short[0]}</p><p>{short[1]}</p></div><div><p>{LONG}</p><p>{LONG}</p></div>") == [*short, LONG, LONG]


def test_the_ratio_finds_the_article_without_any_names():
    menu = "<div>" + "".join(f"<a href={k}>item {k}</a><br>" for k in range(9)) + "</div>"
    page = f"<body>{menu}<div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>{menu}<table><tr><td><a href=x>one</a></td><td><a href=y>two</a></td></tr></table></body>"
    assert main_text(page).split("\n") == [LONG, "Short.", LONG]


def test_the_articles_of_the_test_pages():
    """A plain reading of what stands between the article's tags, by regular expressions, with the pages' class names and without."""
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    kept = 0
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert main_text(r["html"]) == want
        kept += main_text(re.sub(r' class="[^"]*"', "", r["html"])) == want
    assert kept >= 0.98 * len(rows)


def test_time_is_linear_in_depth_and_in_unfinished_markup():
    began = time.perf_counter()
    for t in ("<span>" * 20_000 + "x" + "</span>" * 20_000, "<div>" * 20_000 + "<p>words</p>" + "</i></div>" * 20_000, "<div class=ad>" * 20_000 + "<p>words</p>", "text" + "<a " * 50_000, "text" + "<!--" * 50_000, "text" + "</" * 50_000, "<![x[" * 50_000):
        assert isinstance(main_text(t), str)
    assert time.perf_counter() - began < 20


def test_clashing_names_and_other_columns(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", 9, "t"), (1, "u", f"<p>{LONG}</p>", 9, "t"), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, _html string")
    got = extract(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted((str(r.page_id), r.n_chars) for r in got.collect()) == [("1", len(LONG)), ("1", len(LONG)), ("None", 0)]
    assert extract(frame.limit(0)).count() == 0
