"""Main texts of written-out pages, and of the table's pages against what they mark."""

import duckdb
import pytest

from tidewatch.llm import htmltext
from tidewatch.llm.htmltext import main_text

LONG = "This sentence stands for an article and is long enough to be told from what surrounds it on the page."
MORE = "A second paragraph follows the first one, with as many words as are needed to be taken for running text."
MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"

MARKED = {
    "plain article": (f"<html><body>{MENU}<article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; x</footer></body></html>", f"Title\n{LONG}\nShort."),
    "only a short article": (f"{MENU}<article><p>Hi.</p></article><div>{LONG} {MORE}</div>", "Hi."),
    "header, aside, advert and comments inside": (
        f"<article><header class='entry-header'><h1>Title</h1><span>by Ann</span></header><p>{LONG}</p><aside>{MORE}</aside><div class='ad'>Buy</div><p>End.</p>"
        f"<section id='comments'><article class='comment'><p>{MORE}</p></article></section></article>", f"Title\n{LONG}\nEnd."),
    "site header": (f"<header><h1>Site</h1>{MENU}</header><main><h2>Title</h2><p>{LONG}</p></main>", f"Title\n{LONG}"),
    "form and script": (f"<article><p>{LONG}</p><form><p>Your name</p><input></form><script>var x = '</p><p>no';</script><p>Last</p></article>", f"{LONG}\nLast"),
    "style, noscript and template": (f"<article><style>p {{}}</style><noscript><p>no</p></noscript><template><p>no</p></template><p>{LONG}</p></article>", LONG),
    "unclosed paragraphs": (f"<article><p><b>One.<br><p>Two<p>{LONG}</article>", f"One.\nTwo\n{LONG}"),
    "inline tags leave no trace": ("<article><p>un<b>der</b>stand <i>it</i>, <a href=x>all</a></p></article>", "understand it, all"),
    "references": ("<article><p>a &amp; b &lt;c&gt; &eacute;&#233;&#xE9; &amp;lt; &nbsp; x &amp y &am</p></article>", "a & b <c> ééé &lt; x & y &am"),
    "white space": ("<article>\n <p> a \n\t b&nbsp;&nbsp;c </p>\n\n<p> </p> d </article>", "a b c\nd"),
    "list, table, quotation": ("<article><ul><li>one<li>two</ul><table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table><blockquote>said</blockquote></article>", "one\ntwo\n1 2\n3\nsaid"),
    "unclosed advert before the article": (f"<div class=ad>Buy<article><p>{LONG}</p></article>", LONG),
    "unclosed article": (f"{MENU}<article><p>{LONG}</p><p>and the page ends he", f"{LONG}\nand the page ends he"),
    "cut-off tag": (f"<article><p>{LONG}</p><p>end<a hre", f"{LONG}\nend"),
    "comment and doctype": (f"<!DOCTYPE html><!-- <article>no</article> --><article>{LONG}<!-- never closed", LONG),
    "hidden": (f"<article><p hidden>no</p><div style='color:red; display: none'>no</div><p>{LONG}</p></article>", LONG),
    "negated names are no sidebars": (f"<body class='has-sidebar'><div class='no-sidebar'><article><p>{LONG}</p></article></div>", LONG),
    "role and property": (f"<div role=main><div class=breadcrumbs>x</div><p>{LONG}</p></div>", LONG),
    "cookie notice": (f"<div id='cookieConsent'><p>{MORE}</p></div><article><p>{LONG}</p><div class='newsletter-signup'>Sign up</div></article>", LONG),
    "upper case": (f"<ARTICLE><P>{LONG}</P><SCRIPT>x</SCRIPT></ARTICLE><FOOTER>f</FOOTER>", LONG),
    "signs that are no tags": ("<article><p>1 < 2 and 3 > 2, a<b>c</b> <3</p></article>", "1 < 2 and 3 > 2, ac <3"),
}
UNMARKED = {
    "menus and a footer by name": (f"<div id=menu><a href=1>One</a> <a href=2>Two</a></div><div class=content><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{MORE}</p></div><div id=footer>Imprint</div>",
                                   f"Title\n{LONG}\nShort.\n{MORE}"),
    "links by number": (f"<table><tr><td><a href=1>One</a></td></tr><tr><td><a href=2>Two</a></td></tr></table><div><div><p>{LONG}</p><p>{MORE}</p></div></div>", f"{LONG}\n{MORE}"),
    "far-off remark": (f"<div><div>Remark</div></div><div></div><table><tr></tr></table><div><p>{LONG}</p></div>", None),
    "short page": ("<p>Only this.</p>", "Only this."),
    "no tags": ("just text", "just text"),
}


@pytest.mark.parametrize("name", [*MARKED, *UNMARKED])
def test_written_out_pages(name):
    html, text = {**MARKED, **UNMARKED}[name]
    if text is not None:
        assert main_text(html) == text
    else:
        assert LONG in main_text(html)


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p>", "</p></p>", "<article></article>", "<!--", "<script>", "<a b='", "<nav>only</nav>", "&", "<![CDATA[x]]>"])
def test_nothing_to_find(html):
    assert main_text(html) in ("", "<", "&")


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "<p>" + LONG + "</p>" + "</div>" * 3000
    assert main_text(f"<article>{deep}</article>") == LONG
    assert main_text("<b>" * 5000 + f"<article>{LONG}</article>") == LONG
    body = "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(20_000))
    assert main_text(f"{MENU}<article>{body}</article>").count("\n") == 19_999


def test_pages_of_the_table(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    want = sorted(con.execute(htmltext.HTML_SQL).fetchall())
    assert sorted(map(tuple, htmltext.page_texts(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect())) == want


def test_odd_tables(spark):
    rows = [(1, "u", f"<article>{LONG}</article>", "x", "y"), (None, None, None, None, None), (1, "u", f"<article>{LONG}</article>", "x", "y"), (2, None, "", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    assert sorted(map(tuple, htmltext.page_texts(pages).collect()), key=repr) == sorted([(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0), (2, None, "", 0)], key=repr)
    assert htmltext.page_texts(pages.limit(0)).count() == 0
    out = htmltext.with_text(pages)
    assert out.columns == ["page_id", "url", "html", "n_chars", "text"] and out.where("page_id = 1").first()["text"] == LONG
