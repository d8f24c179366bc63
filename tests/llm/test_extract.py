"""Main texts against the known articles of planted layouts and, on the given pages, against a plain cut of the article."""

import random
import re
from html import escape, unescape

import pytest

from markertree.llm import extract

SCHEMA = "page_id long, url string, html string, text string, host string, paths int, n_chars string"


def sentence(r, n=12):
    return " ".join("".join(r.choices("abcdeéñlost", k=r.randint(2, 8))) for _ in range(n)).capitalize() + "."


def article(r):
    return [sentence(r, 5)] + [sentence(r, r.randint(8, 60)) for _ in range(r.randint(1, 6))]


def menu(r, n=5):
    return "<ul>" + "".join(f"<li><a href='/{i}'>{sentence(r, 2)}</a></li>" for i in range(n)) + "</ul>"


def comments(r, n):
    return "".join(f"<div class='c-item n{i}'><p>{sentence(r, 25)}</p></div>" for i in range(n))


def semantic(r, a, i):
    return f"""<!doctype html><html><head><title>{a[0]}</title><style>p{{}}</style><script>var x = "<p>no</p>"; if (a < b) f();</script></head>
    <body class="has-sidebar"><header><h1>Site name</h1><nav>{menu(r)}</nav></header><!-- <p>hidden</p> -->
    <main><article><header><h1>{escape(a[0])}</h1><span class="ad">{sentence(r)}</span></header>{"".join(f"<p>{escape(t)}" for t in a[1:])}
    <aside><p>{sentence(r, 30)}</p></aside><footer>{sentence(r)}</footer></article>
    <section id="comments"><article><p>{sentence(r, 90)}</p></article></section></main><footer><p>{sentence(r)}</p></footer></body></html>"""


def classes(r, a, i):
    return f"""<html><body><div id="page"><div class="top-header"><b>{sentence(r)}</b></div><div class="cookie-notice"><p>{sentence(r, 40)}</p></div>
    <div class="wrap"><div class="post post-{i}"><h1>{a[0]}</h1>{"".join(f"<div class='par p{n}'>{t}<br></div>" for n, t in enumerate(a[1:]))}
    <div class="advert-box"><p>{sentence(r)}</p></div><form><p>{sentence(r)}</p><input name=q><select><option>One</select></form>
    <div class="share">{sentence(r)}</div><noscript><p>{sentence(r)}</p></noscript></div>
    <div class="side-column">{menu(r)}</div></div><div class="commentlist">{comments(r, 9)}</div></div>"""


def unnamed(r, a, i):
    """Neither the article nor its reader comments bear telling names; on every fourth page the comments outweigh it."""
    return f"""<body><div class="x1"><div class="q7">{"".join(f"<p>{t}</p>" for t in a)}</div>
    <div class="z3">{comments(r, 40 if i % 4 == 0 else 1)}</div></div></body>"""


@pytest.mark.parametrize("layout", [semantic, classes, unnamed])
def test_articles_of_planted_layouts(spark, layout):
    r = random.Random(4)
    want, rows = {}, []
    for i in range(40):
        a = article(r)
        want[i] = a
        rows.append((i, f"https://user@News.example.org:80/{i}?q=1", layout(r, a, i), "x", "y", 1, "z"))
    found = extract.main_texts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {f.page_id: f.text.split("\n\n") for f in found} == want


def test_host_consensus_corrects_single_pages():
    """Read alone, a page with many comments gives the comments."""
    r = random.Random(4)
    a = article(r)
    page = extract.read(unnamed(r, a, 0))
    assert page.extract(page.best()) != a


def test_given_pages_equal_a_plain_cut(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for p in pages.collect():
        inner = p.html[p.html.index("<article>") + 9:p.html.index("</article>")]
        blocks = [" ".join(unescape(re.sub("<br>|</?b>", " ", b)).split()) for b in re.split("</?p>|</?h1>", inner)]
        want[p.page_id] = "\n\n".join(b for b in blocks if b)
    assert {f.page_id: f.text for f in extract.main_texts(pages).collect()} == want


def test_nulls_repeats_and_broken_markup(spark):
    body = "<div class=a><p>One &lt;two&gt;\n three&nbsp;&amp four<p>Five<b> six</div>"
    rows = [(1, None, None), (2, "", ""), (3, "http://h.example/", None), (None, "http://h.example/", body), (None, "http://h.example/", body),
            (4, "no url", body), (5, "http://h.example/1", body + "<div><!-- open <p>lost"), (6, "http://h.example/2", body + "<script>lost"),
            (7, "http://h.example/3", body + '<p class="open>lost'), (8, "http://i.example/", "< 5 <3 plain & text </ >"),
            (9, "http://i.example/2", "<div>" * 20_000 + "deep text " * 3 + "</p>" * 20_000),
            (10, "http://i.example/4", "<p>" + "long " * 200_000), (11, "http://i.example/5", "<a '" * 20_000 + "<p>x")]
    found = extract.main_texts(spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA)).collect()
    text = {f.page_id: f.text for f in found}
    one = "One <two> three & four\n\nFive six"
    assert len(found) == len(rows) and all(f.n_chars == len(f.text) for f in found)
    assert [text[i] for i in (1, 2, 3, 4, 5, 6, 7, None)] == ["", "", "", one, one, one, one, one]
    assert text[8] == "< 5 <3 plain & text" and text[9] == "deep text deep text deep text" and text[10] == ("long " * 200_000).strip()
    empty = extract.main_texts(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]


def test_paths_are_counted_by_host_and_path(spark):
    """A busy host's pages meet only as partial sums."""
    rows = [(i, "http://busy.example/", f"<div class='k{i}'><p>text {i}</p></div>", "x", "y", 1, "z") for i in range(30)]
    found = extract.host_paths(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(f.host, len(f.paths)) for f in found] == [("busy.example", 1)]
