"""Main text of pages, on pages of several shapes and on the given ones."""

import html
import re

import pytest

from opslens.llm.main_text import extracted, main_text

LONG = "This paragraph of the article is long enough to weigh more than what stands around it, as paragraphs are."
PAGES = {
    "article": (f"<body><nav><a href=a>Home</a><a href=b>Shop</a></nav><article><h1>T &amp; t</h1><p>{LONG}<p>Second  &lt;one&gt;\n here</article><footer>&copy; us</footer>",
                f"T & t\n{LONG}\nSecond <one> here"),
    "divisions": (f"<div class=header>Site</div><div id=sidebar><ul><li><a href=x>x</a></ul></div><div class=post><h2>Head</h2><p>{LONG}</p><div class=ad>Buy</div><p>{LONG}</p>"
                  f"<div class='comments'><p>{LONG} {LONG}</p></div></div><div class='cookie-notice'>{LONG}</div>", f"Head\n{LONG}\n{LONG}"),
    "sections": (f"<main><h1>Top</h1><section><h2>A</h2><p>{LONG}</section><section><h2>B</h2><p>{LONG}</p><ul><li>one<li>two</ul></section></main><aside>{LONG}</aside>",
                 f"Top\nA\n{LONG}\nB\n{LONG}\none\ntwo"),
    "own header": (f"<header><h1>Site</h1></header><article><header class=entry-header><h1>Mine</h1><span>by me</span></header><p>{LONG}</p><form><label>Mail</label></form></article>",
                   f"Mine\n{LONG}"),
    "classes that say what stands beside": (f"<div class='page with-sidebar'><h1>Top</h1><p>{LONG}</p></div>", f"Top\n{LONG}"),
    "scripts": (f"<script>var a='<p>no</p>';</script><style>p{{}}</style><p>{LONG}<!-- no <p>no</p> --><noscript>no</noscript></p>", LONG),
    "inline": ("<p>a<b>b</b> c<br>d<i> e</i>", "ab c d e"),
    "cut off": (f"<article><p>{LONG}<p>and the end is mis", f"{LONG}\nand the end is mis"),
    "hidden": (f"<p>{LONG}</p><p hidden>no</p><div style='display:none'>no</div>", LONG),
    "plain": ("just text &eacute; &#233;", "just text é é"),
    "empty": ("<html><body></body></html>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_shapes(name):
    page, text = PAGES[name]
    assert main_text(page) == text

SIDE = "<div><h3>More</h3><p>Shoes <a href=s>Buy cheap shoes here</a></p><p>Win <a href=c>a car of your own</a></p><p>Ten <a href=t>tricks to know</a></p></div>"
LINKS = "<div><p><a href=a>One other story</a></p><p><a href=b>Two other stories</a></p></div>"
WRAPPED = {
    "side columns": (f"<div>{SIDE}<div><h1>Top</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>{LINKS}</div>", f"Top\n{LONG}\n{LONG}\n{LONG}"),
    "title above": (f"<div><div>{LINKS}</div><div><h1>Top</h1><div>by me</div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>{SIDE}</div></div>",
                    f"Top\nby me\n{LONG}\n{LONG}\n{LONG}"),
    "parts": (f"<div><div><div><h2>A</h2><p>{LONG}</p><p>{LONG}</p></div><div><h2>B</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div>{SIDE}{LINKS}</div>",
              f"A\n{LONG}\n{LONG}\nB\n{LONG}\n{LONG}\n{LONG}"),
    "advert between parts": (f"<div><div><p>{LONG}</p><p>{LONG}</p></div><div><p>Buy</p><p>now</p></div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div>",
                             "\n".join([LONG] * 5)),
    "one rich paragraph": (f"<div><p>{LONG} {LONG} {LONG} <b>{LONG}</b> <i>{LONG}</i> <b>{LONG}</b></p><p>Short.</p><ul><li>one<li>two</ul><p>End.</p>{SIDE}</div>",
                           f"{' '.join([LONG] * 6)}\nShort.\none\ntwo\nEnd."),
    "single wrappers": (f"<div><div><div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div><div><p>{LONG}</p><p>{LONG}</p></div></div>{SIDE}</div>", "\n".join([LONG] * 5)),
}


@pytest.mark.parametrize("name", WRAPPED)
def test_wrapped_pages_without_article(name):
    page, text = WRAPPED[name]
    assert main_text(page) == text


WRAPPERS = (
    "<form id=aspnetForm><input name=q>{}</form>", "<div id='content-sidebar-wrap'>{}</div>", "<div class='layout sidebar-right'>{}</div>",
    "<div class='container comments-open'>{}</div>", "<div id=page class=search><div class='widget menu'>{}</div></div>", "<header>{}</header>",
    "<form><div class='layout sidebar-left'>{}</div><button>Go</button></form>", "<div style='visibility: hidden'>{}</div>", "<aside>{}</aside>")


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_of_the_article_stay(wrapper):
    other = f"<div class=sidebar><p>{LONG}</p></div><div class=comments><p>{LONG}</p></div>"
    inside = f"<h1>Top</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>"
    text = f"Top\n{LONG}\n{LONG}\n{LONG}"
    assert main_text(wrapper.format(f"<article>{inside}</article>{other}") + "<footer>us</footer>") == text
    assert main_text(wrapper.format(f"<main>{inside}</main>") + f"<div>{LONG}</div>") == text
    assert main_text(wrapper.format(f"<div class=post>{inside}</div>{other}") + "<footer>us</footer>") == text


def test_comments_longer_than_the_article_go():
    comments = f"<div class=comments>{f'<p>{LONG}</p>' * 5}</div>"
    assert main_text(f"<div><h1>Top</h1><p>{LONG}</p><p>{LONG}</p></div>{comments}") == f"Top\n{LONG}\n{LONG}"
    assert main_text(f"<article><p>{LONG}</p></article><aside><article>{comments}</article></aside>") == LONG
    assert main_text(f"<article><p>Short.</p></article><footer>{LONG}</footer>") == "Short."
    assert main_text(f"<form><label>Mail</label><input><p>{LONG}</p><select><option>no</select></form>") == LONG


def test_deep_and_broken_pages():
    assert main_text("<div>" * 5000 + LONG + "</div>" * 5000) == LONG
    assert main_text("</p></div><<>><p" + "<p>x") and main_text("<") == "" and main_text("a < b") == "a < b"


def test_frame(spark):
    rows = [(1, "u", PAGES["article"][0], "t"), (2, None, None, "t"), (3, "u", "", "t"), (3, "u", "", "t"), (4, "u", f"<p>{LONG * 3000}</p>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extracted(pages).orderBy("page_id").collect()
    assert [(r.page_id, r.text if r.page_id < 4 else "", r.n_chars) for r in found] == [
        (1, PAGES["article"][1], len(PAGES["article"][1])), (2, "", 0), (3, "", 0), (3, "", 0), (4, "", 3000 * len(LONG))]
    assert extracted(pages.where("false")).count() == 0


def test_given_pages(spark, sf_dir):
    """The given pages mark their article; everything else is to go."""
    for r in extracted(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.DOTALL)[1]
        lines = re.sub(r"<[^>]*>", " ", re.sub(r"</?(p|h1)>", "\n", inside)).split("\n")
        assert r.text == "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in lines) if x)


IN_ARTICLE = f"<article><h1>T</h1><p>{LONG}</p>%s<p>{LONG}</p></article>"
COMMENTS = f"<div class=comment><p>{LONG}</p></div>"
FAULTY = {
    "stray quote": (f'<p class="x"">{LONG}</p><p>{LONG}</p>', f"{LONG}\n{LONG}"),
    "apostrophe without quotes": (f"<article><p>{LONG}</p><p title=Don't>{LONG}</p><p>{LONG}</p><p title='x'>End</p></article>", "\n".join([LONG] * 3 + ["End"])),
    "quote that nothing closes": (f'<article><p>{LONG}</p><p class="x>{LONG}</p></article>', f"{LONG}\n{LONG}"),
    "signs in values": (f'<article><p><img alt="a > b" src=x>{LONG}</p><p title = "<p>no</p>">{LONG}</p></article>', f"{LONG}\n{LONG}"),
    "empty comments": (f"<article><p>{LONG}</p><!--><p>{LONG}</p><!---><p>{LONG}<!-- no --!></p><p>{LONG}</p><!-- no --></article>", "\n".join([LONG] * 4)),
    "several articles": (f"<article><h1>A</h1><p>{LONG}</p><p>{LONG}</p></article><article><h1>B</h1><p>{LONG}</p></article><article class=teaser><p>{LONG}</p></article>"
                         f"<article><p><a href=a>One other story</a></p></article>", f"A\n{LONG}\n{LONG}\nB\n{LONG}"),
    "sources": (IN_ARTICLE % "<h2>Sources</h2><ul><li><a href=a>First</a><li><a href=b>Second</a><li><a href=c>Third</a></ul>",
                f"T\n{LONG}\nSources\nFirst\nSecond\nThird\n{LONG}"),
    "subjects": (IN_ARTICLE % f"<section class=legal><h2>Law</h2><p>{LONG}</p></section><div class=poll-results><p>{LONG}</p></div><section id=discussion><h2>Discussion</h2><p>{LONG}</p></section>",
                 f"T\n{LONG}\nLaw\n{LONG}\n{LONG}\nDiscussion\n{LONG}\n{LONG}"),
    "a discussion of readers": (IN_ARTICLE % f"<section id=discussion><h2>Discussion</h2>{COMMENTS}{COMMENTS}</section>", f"T\n{LONG}\n{LONG}"),
    "a search form": (IN_ARTICLE % f"<div class=search><form><input name=q><p>{LONG}</p></form></div><div class='social share'><p>{LONG}</p></div>", f"T\n{LONG}\n{LONG}"),
    "a subject outside the article": (f"<div class=legal><p>{LONG}</p></div>" + IN_ARTICLE % "", f"T\n{LONG}\n{LONG}"),
}


@pytest.mark.parametrize("name", FAULTY)
def test_faulty_pages_and_parts_of_articles(name):
    page, text = FAULTY[name]
    assert main_text(page) == text


def slow_density(node, body):
    """Density of an element from its definition, its whole text gathered anew."""
    import math

    def gathered(n, in_link):
        for c in n.children:
            if isinstance(c, str):
                yield len("".join(c.split())), 0, in_link, 0
            else:
                yield 0, 1, in_link or c.name == "a", c.name == "a" and not in_link
                yield from gathered(c, in_link or c.name == "a")

    def of(n):
        seen = list(gathered(n, n.name == "a"))
        return sum(x[0] for x in seen), sum(x[1] for x in seen), sum(x[0] for x in seen if x[2]), sum(x[3] for x in seen)

    c, t, lc, lt = of(node)
    whole, _, linked, _ = of(body)
    if not c:
        return 0.0
    t, lt = max(1, t), max(1, lt)
    base = math.log(c / max(1, c - lc) * lc + linked / max(1, whole) * c + math.e)
    ratio = c / max(1, lc) * t / lt
    return c / t * (max(0.0, math.log(ratio) / math.log(base)) if base > 1 else max(1.0, math.log(ratio) + 1))


def test_densities_against_their_definition(spark):
    from opslens.llm.main_text import measure, prune, tree

    pages = [p for p, _ in (*PAGES.values(), *WRAPPED.values(), *FAULTY.values())]
    pages += [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect() if r.html][::5]
    for page in pages:
        root = tree(page)
        prune(root)
        for n in measure(root):
            assert n.density == pytest.approx(slow_density(n, root)), (n.name, page[:80])
            assert n.total == pytest.approx(sum(slow_density(c, root) for c in n.elements()))
