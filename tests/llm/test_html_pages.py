"""Broken and unusual pages, each read in linear time; and pages through Spark."""

import time

from pyspark.sql import Row

from lekhani.llm import html

TREE = html.grow()


def test_article_in_a_form():
    assert html.main_text("<body><form><nav>a b</nav><article><h1>T</h1><p>hello world this is prose</p></article></form></body>", TREE) == "T\nhello world this is prose"
    prose = "word " * 40
    assert html.main_text(f"<form><p>{prose}</p></form>", TREE) == prose.strip()
    assert html.main_text(f"<p>{prose}</p><form><p>Your name and address, please, and what else you would like to tell us here.</p></form>", TREE) == prose.strip()


def test_names_inside_an_article():
    page = "<article><p class='related-work'>Prior work did this.</p><p class='notice-text'>Notice text.</p><p class='ad'>Buy it</p><p class='cookie-notice'>We bake</p><div class='comment-list'><p>So good, I read it all.</p></div></article>"
    assert html.main_text(page, TREE) == "Prior work did this.\nNotice text."


def test_raw_ends_are_sought_in_the_page():
    assert html.main_text("<p>" + "İ" * 60 + "</p><SCRIPT>var x='</p>';</sCript ><p>the next one stays whole</p>", TREE) == "İ" * 60 + "\nthe next one stays whole"


def test_tags():
    assert html.main_text("<article><p title='a>b' class=it's>One <a href=\"x>y\">two</a> three &amp; 1 < 2</p></article>", TREE) == "One two three & 1 < 2"
    assert html.main_text("<article><p>One <b", TREE) == "One <b"


def test_time_is_linear():
    for page in ("<a " * 80_000, '<a "' * 80_000, '<a ">"' * 40_000, "<a '\">'\"" * 40_000 + ">", "<p " + "x" * 300_000 + ">hi", "<p>" + "<b>x</b> " * 60_000, '<a ="' * 60_000 + ">", "<!--" * 50_000, "<script>" * 40_000, "<div>" * 50_000 + "x"):
        began = time.time()
        html.main_text(page, TREE)
        assert time.time() - began < 1, page[:10]


def test_through_spark(spark):
    page = "<nav><a href=x>Home</a></nav><article><h1>T</h1><p>Some prose about it.</p></article>"
    long = "<article>" + "<p>Some prose about it.</p>" * 50_000 + "</article>"
    rows = [Row(page_id=1, url="u", html=page, text=1, n_chars="x"), Row(page_id=1, url="u", html=page, text=2, n_chars="y"), Row(page_id=2, url=None, html=None, text=3, n_chars=""), Row(page_id=None, url="v", html="", text=4, n_chars=""), Row(page_id=3, url="w", html=long, text=5, n_chars="")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, text int, n_chars string")
    out = html.extract(pages)
    assert out.dtypes == [("page_id", "int"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: r[0] or 0)
    assert got[0] == (None, "v", "", 0) and got[1] == got[2] == (1, "u", "T\nSome prose about it.", 22) and got[3] == (2, None, "", 0)
    assert got[4][2] == "\n".join(["Some prose about it."] * 50_000) and got[4][3] == len(got[4][2])
    assert html.extract(pages.limit(0)).count() == 0
