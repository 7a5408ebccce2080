"""Main text of pages with known articles."""

import pytest
from pyspark.sql import functions as F

from cuegrid.llm import lineblocks

LONG = "Rain fell on the valley for nine days and the mill wheel turned all night."
CASES = {
    "article": (f"<nav><a href=/>Home</a></nav><article><h1>Rain &amp; mill</h1><p>{LONG}</p><p>Short.</p></article><footer>Us</footer>", f"Rain & mill {LONG} Short."),
    "classes": (f"<body class='has-sidebar'><div id=menu>Home News</div><div class=post><p>{LONG}<div class='ad-box'>Buy</div><p>{LONG}</div><div class=comments><p>{LONG}</p></div></body>", f"{LONG} {LONG}"),
    "inline": ("<p>a<b>b</b>c<i> d</i><br>e</p>", "abc d e"),
    "entities": ("<p>x &lt; y &#233; &#x1F600; &nbsp; z &unknown; &am", "x < y é 😀 z &unknown; &am"),
    "raw": ("<script>if (a < b) '</p>'</script><style>p{}</style><title>T</title><p>ok</p><!-- <p>no</p> -->", "ok"),
    "cut": (f"<article><p>{LONG}</p><p>And then <a href='x", f"{LONG} And then"),
    "open advert": (f"<div class='advert'>Buy <article><p>{LONG}</p></article>", LONG),
    "reader article": (f"<article><p>{LONG}</p><section><article class='comment'><p>Nice</p></article></section></article>", LONG),
    "form": (f"<main><form><label>Name</label><button>Go</button></form><p>{LONG}</p></main><aside>More</aside>", LONG),
    "hidden": (f"<p>{LONG}</p><div style='display: none'>x</div><p hidden>y</p>", LONG),
    "nothing": ("<html><body><nav><a>Home</a></nav></body></html>", ""),
    "text only": ("one\n two\t three", "one two three"),
    "list": (f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", f"{LONG} one two a b"),
    "no article": ("<div>" + "".join(f"<li><a href=/{k}>Menu {k}</a>" for k in range(6)) + "</div>" + f"<div><p>{LONG}</p><p>{LONG}</p></div>"
                   + "".join(f"<li><a href=/{k}>Link {k}</a>" for k in range(6)) + "<p>End.</p>", f"{LONG} {LONG}"),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    page, want = CASES[name]
    assert lineblocks.main_text(page) == want


def test_table(spark):
    rows = [(1, "u", CASES["article"][0], 5, "old"), (1, "u", CASES["article"][0], 5, "old"), (None, None, None, 5, "old"), (2, "v", "", 5, "old"),
            (3, "w", "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>", 5, "old"), (4, "x", "<div>" * 30_000 + "deep", 5, "old")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string")
    out = lineblocks.extract(pages)
    got = {r["page_id"]: r for r in out.collect()}
    assert out.count() == 6 and sorted(out.columns) == ["n_chars", "page_id", "text", "url"] and got[None]["text"] == got[2]["text"] == ""
    assert got[3]["n_chars"] == 5000 * (len(LONG) + 1) - 1 == len(got[3]["text"]) and got[4]["text"] == "deep"
    assert lineblocks.extract(pages.limit(0)).count() == 0


def test_corpus_pages(spark):
    """Articles of the corpus, which has them between article tags, whole and alone."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    inner = F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    blocks = F.regexp_replace(F.regexp_replace(inner, "</?(p|h1|br)>", " "), "<[^>]*>", "")
    import html

    want = {r[0]: " ".join(html.unescape(r[1]).split()) for r in pages.select("page_id", blocks).collect()}
    assert {r["page_id"]: r["text"] for r in lineblocks.extract(pages).collect()} == want


def test_distribution_chooses_beside_an_article():
    """A short card in an article element does not hide the long text beside it, and a long card does not replace it."""
    body = "<div class=story>" + f"<p>{LONG}</p>" * 9 + "</div>"
    assert lineblocks.main_text(f"<article><h3>See too</h3></article>{body}") == " ".join([LONG] * 9)
    assert lineblocks.main_text(f"{body}<article><p>{LONG}</p></article>") == " ".join([LONG] * 10)
    # trimmed at the edges of an article that holds nearly all
    assert lineblocks.main_text("<div>Daily paper</div><article>" + f"<p>{LONG}</p>" * 9 + "<p><a href=/>Next part</a></article><div>Printed daily</div>") == " ".join([LONG] * 9 + ["Next part"])
    # articles with a list of links between them stay, however short
    links = "".join(f"<li><a href=/{k}>Link {k}</a>" for k in range(5))
    assert lineblocks.main_text("<article>" + f"<p>{LONG}</p>" * 9 + f"</article><ul>{links}</ul><article><p>Short.</p></article>") == " ".join([LONG] * 9 + ["Short."])


def test_corpus_pages_without_article_tags(spark):
    """The distribution finds the corpus articles by itself."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    texts = lambda t: {r["page_id"]: r["text"] for r in lineblocks.extract(t).collect()}
    assert texts(bare) == texts(pages)


LINKS = "<ul>" + "".join(f"<li><a href=/{k}>See {k}</a>" for k in range(4)) + "</ul>"
ADVERT = "<div class='ad-box'>" + "<p>Buy now</p>" * 5 + "</div>"
SHARE = "<div class=share>" + "<p>Send it</p>" * 5 + "</div>"


@pytest.mark.parametrize("box", [LINKS, ADVERT, SHARE, LINKS + ADVERT])
@pytest.mark.parametrize("part", ["", "section"])
@pytest.mark.parametrize("page", ["<body>{}</body>", "<body><nav><a href=/>Home</a></nav><div class=story>{}</div></body>", "<main>{}</main>", "<article>{}</article>"])
def test_split_by_boxes(box, part, page):
    """A short first and a short last part stay, whatever stands between them and the long one."""
    parts = ["<p>It rained.</p>", f"<p>{LONG}</p>" * 10, "<p>Then it stopped.</p>"]
    got = lineblocks.main_text(page.format(box.join(f"<{part}>{x}</{part}>" if part else x for x in parts)))
    for link in ("See 0", "See 1", "See 2", "See 3"):  # links within an article stay in it
        got = got.replace(link, "")
    assert " ".join(got.split()) == " ".join(["It rained.", *[LONG] * 10, "Then it stopped."])


def test_split_by_a_box_in_blocks_of_their_own():
    rows = f"<div><p>It rained.</p></div>{ADVERT}<div>" + f"<p>{LONG}</p>" * 10 + f"</div>{SHARE}<div><p>Then it stopped.</p></div>"
    assert lineblocks.main_text(f"<body>{rows}</body>") == " ".join(["It rained.", *[LONG] * 10, "Then it stopped."])


def test_split_into_single_lines():
    """A block with one line is a paragraph, not what holds the text."""
    assert lineblocks.main_text(f"<div class=story><div>It rained.</div>{LINKS}<div>{LONG * 9}</div>{LINKS}<div>It stopped.</div></div>") == f"It rained. {LONG * 9} It stopped."


@pytest.mark.parametrize("named", ["", " class=part"])
def test_split_by_links_in_blocks_alike(named):
    parts = ["<p>It rained.</p>", f"<p>{LONG}</p>" * 10, "<p>Then it stopped.</p>"]
    page = "<body><div class=top><p>Daily paper</p></div>" + LINKS + LINKS.join(f"<div{named}>{x}</div>" for x in parts) + LINKS + "<div class=end><p>Printed daily</p></div>"
    assert lineblocks.main_text(page) == " ".join(["It rained.", *[LONG] * 10, "Then it stopped."])


@pytest.mark.parametrize("part", ["<section id='discussion'>{}</section>", "<section id='related-work'>{}</section>", "<div class='legal-analysis'>{}</div>", "<div id=search>{}</div>", "<div class='legal-notice'>{}</div>"])
@pytest.mark.parametrize("page", ["<article>{}</article>", "<main><div class=post>{}</div></main>"])
def test_parts_of_an_article_by_name(page, part):
    body = f"<h2 id='search'>Search</h2><p>{LONG}</p><p>{LONG}</p>"
    assert lineblocks.main_text(page.format(body + part.format(f"<h2 class='social'>What of it</h2><p>{LONG}</p>"))) == f"Search {LONG} {LONG} What of it {LONG}"


@pytest.mark.parametrize("name", ["ad", "ad-box", "comments", "comment-list", "related", "related-posts", "share-links", "social", "newsletter-form", "google-ad-300x250"])
def test_boxes_in_an_article_by_name(name):
    assert lineblocks.main_text(f"<article><p>{LONG}</p><div class='{name}'><p>Look here</p></div><p>{LONG}</p></article>") == f"{LONG} {LONG}"


@pytest.mark.parametrize("attributes", ["class=main data-t=it's", 'title=5"', "data-x=a'b\"c'", "data-x = \"a>b\" title='it\">'", "a=b/c' d", "= x='1'", 'x="a"y=\'b\'z', "disabled x=", "'", '"', "a'b=c"])
def test_quotes_in_bare_attributes(attributes):
    told = [f"The {k}th paragraph of the story has quite a number of words, as stories do." for k in range(5)]
    body = "".join(f"<p>{x}</p>" for x in told)
    assert lineblocks.main_text(f"<html><body><div {attributes}>{body}</div></body></html>") == " ".join(told)


def test_attributes_take_linear_time():
    text = lineblocks.main_text("<div " + "a=' b " * 20000 + "><p>" + "x=\"" * 20000)
    assert isinstance(text, str)
