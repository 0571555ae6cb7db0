"""Whether templates are found by counting, when no tag or class tells them."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from fieldtally.llm import html_text
from fieldtally.llm.tables import table

LARGER = "/root/testdata/sf0.1"


def article_text(page):
    article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def nameless(spark):
    """The pages with menus, adverts and articles as plain elements. Footers keep their tag, as most of them stand on one page
    of their host only, which no counting can tell."""
    plain = F.regexp_replace("html", r'<(/?)(?:nav|article)>|<div class="ad">', "<$1div>")
    return table(spark, LARGER, "pages").select("page_id", "url", F.col("html").alias("before"), plain.alias("html"))


def right(rows, found):
    return sum(found[r["page_id"]] == article_text(r["before"]) for r in rows) / len(rows)


def test_counts_find_menus_and_adverts(nameless, spark, monkeypatch):
    rows = nameless.select("page_id", "before").collect()
    found = {r["page_id"]: r["text"] for r in html_text.page_texts(nameless).collect()}
    assert right(rows, found) >= 0.98
    empty = spark.createDataFrame([], "host string, few boolean, marks array<bigint>, main_marks array<bigint>")
    monkeypatch.setattr(html_text, "site_templates", lambda *a: empty)
    without = {r["page_id"]: r["text"] for r in html_text.page_texts(nameless).collect()}
    assert right(rows, without) <= 0.02  # nothing but the counts did it


def test_plain_elements_of_a_site(spark):
    page = (
        "<body><div><div><a>Home</a> <a>News</a></div><div>Today: %d</div></div><div>We use cookies.</div><div><div>Title %d</div><div>A long text of page %d, longer than any other block here.</div>"
        "<div>Short %d.</div></div><div><p>All rights reserved.</p><p>Printed on page %d.</p></div></body>"
    )
    rows = [(i, f"http://plain.example/{i}", page % ((i,) * 5)) for i in range(40)] + [(100, "http://other.example/", page % ((7,) * 5))]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    found = {r["page_id"]: r["text"].split("\n\n") for r in html_text.page_texts(pages).collect()}
    for i in range(40):  # what recurs goes, what is of the page stays
        assert found[i] == [f"Today: {i}", f"Title {i}", f"A long text of page {i}, longer than any other block here.", f"Short {i}.", f"Printed on page {i}."]
    assert found[100][0] == "Today: 7"  # what recurs on one site is known on others


def test_templates_joined_by_host_give_the_same(nameless, monkeypatch):
    pages = nameless.where("page_id % 5 = 0")
    a = {r["page_id"]: r["text"] for r in html_text.page_texts(pages).collect()}
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", -1)
    assert {r["page_id"]: r["text"] for r in html_text.page_texts(pages).collect()} == a


def test_names_in_articles_do_not_count(spark):
    page = (
        '<body><div class="top-menu nav">Go</div><div class="advert-free">Own words %d outside.</div><article><h1 id="comments">T%d</h1><p>Words of page %d and more of them, which are its own.</p>'
        '<h2 id="related-work">Related work %d</h2><section id="social-policy"><p>Policy %d.</p></section><h2 class="notice-board">Board %d</h2><aside>not this</aside></article></body>'
    )
    rows = [(i, "http://h.example/", page % ((i,) * 6)) for i in range(12)]
    found = {r["page_id"]: r["text"] for r in html_text.page_texts(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert all(found[i].endswith(f"T{i}\n\nWords of page {i} and more of them, which are its own.\n\nRelated work {i}\n\nPolicy {i}.\n\nBoard {i}") for i in range(12))
    assert all("Go" not in t and "not this" not in t for t in found.values())
    one = {r["page_id"]: r["text"] for r in html_text.page_texts(spark.createDataFrame(rows[:1], "page_id int, url string, html string")).collect()}
    assert one[0].startswith("T0")  # a host of few pages: the article alone


def test_parsing_time_follows_length():
    def seconds(page):
        begin = time.perf_counter()
        html_text.main_text(page)
        return time.perf_counter() - begin

    for piece in ("<div>", "<b><p>x", "<li>", "<b>", "<table><tr><td>", "</i>", "<p>"):
        short, long = min(seconds(piece * 4_000) for _ in range(3)), seconds(piece * 32_000)
        assert long <= 40 * short + 0.2, piece
