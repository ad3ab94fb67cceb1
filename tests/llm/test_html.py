import random

import pytest

from hushlake.llm import html

STOPS = "the of and to in a is that it for on with as was are".split()


def paragraph(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(STOPS) if r.random() < 0.4 else f"word{r.randrange(500)}" for _ in range(n))


def page(k, body):
    links = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(6))
    return f"<html><head><title>t</title></head><body><nav><ul>{links}</ul></nav><ul>{links}</ul>{body}<div class='comments'><p>{paragraph(-k)}</p></div><footer>&copy; {k}</footer></body></html>"


def test_both_passes_without_an_article_element():
    for k in range(30):
        parts = [paragraph(10 * k + j) for j in range(4)]
        body = f"<h1>A heading</h1><p>{parts[0]}</p><p>Short one.</p><p>{parts[1]}</p><h2>More</h2><p>{parts[2]}</p><p>{parts[3]}</p>"
        assert html.main_text(page(k, body)) == " ".join(["A heading", parts[0], "Short one.", parts[1], "More", parts[2], parts[3]])
        assert html.main_text(page(k, f"<article>{body}</article>")) == html.main_text(page(k, body))


def test_open_blocks_take_the_nearest_decided_label():
    b = lambda t, linked=0: {"text": t, "linked": linked, "heading": False, "mark": html.CLEAR, "article": False}
    long = paragraph(1)
    found = [b("menu", 4), b("near menu"), b("far"), b("farther"), b(long), b("between"), b(long)]
    labels = [html.first_pass(x) for x in found]
    assert labels == ["bad", "open", "open", "open", "good", "open", "good"]
    want = []
    for k, x in enumerate(labels):  # by brute force
        decided = sorted((abs(j - k), j > k, y) for j, y in enumerate(labels) if y != "open")
        want.append(decided[0][2] == "good" if x == "open" else x == "good")
    assert html.second_pass(found, labels) == want == [False, False, False, True, True, True, True]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<script src=//cdn.x/y/>var leaked = 1;</script><p>x</p>", "x"),
        ("<article><header><h1>Title of it</h1></header><p class='legal-analysis'>Real para.</p></article><header>site</header>", "Title of it Real para."),
        ("<div class='has-sidebar no-comments'><article><p>kept</p></article></div>", "kept"),
        ("<div class='footer-wrap'><p>x</p></div><article class='nav'><p>a &lt;b&gt; &#233;</p></article>", "a <b> é"),
        ("<article><p>one<aside>note</aside><form>f</form><p>two</article>", "one two"),
        ("<article><p><a href=a>A sentence</a> <a href=b>all of links</a>, and so is this.</p></article>", "A sentence all of links, and so is this."),
        ("<svg/><p>after</p>", "after"),
        ("plain", "plain"),
    ],
)
def test_fixtures(source, want):
    assert html.main_text(source) == want


def test_work_is_linear_in_the_page():
    deep = 100_000
    assert html.main_text("<div>" * deep + "x" + "<b>" * deep + "</i>" * deep) == "x"


def test_pages_as_rows(spark):
    body = f"<article><p>{paragraph(3)}</p></article>"
    rows = [(1, "u", page(1, body), "t", 5), (1, "u", page(1, body), "t", 5), (None, None, None, None, None), (2, "v", "", "x", 0), (3, "w", f"<article><p>{paragraph(4, 100_000)}</p></article>", "", 1)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted([(r.page_id, r.url, r.text, r.n_chars) for r in got], key=str) == sorted([(i, u, html.main_text(h), len(html.main_text(h))) for i, u, h, *_ in rows], key=str)
    assert {r.page_id: r.n_chars for r in got}[3] == len(paragraph(4, 100_000))
    empty = html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string"))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]
