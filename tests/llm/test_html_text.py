import random
import re
import time

import pytest

from quern.llm.html_text import Node, blocks_of, expression, extract, infer, likeness, main_text, pairs, stream

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body class="has-menu">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/a>A</a></ul></nav>
<main><article class="post"><h1>{title}</h1><p>{a}</p><ul><li>one{n}<li>two</ul><p>{b}<br>next &lt;line&gt;&nbsp;x</p></article>
<div class="ad-box">Buy now</div><aside>More</aside><section id="comments"><p>Great post!</p></section></main>
<div class="cookie-notice">We use cookies</div><form><p>Name</p></form><footer>c 2020</footer></body></html>"""


def page(n):
    return PAGE.format(title=f"Title {n}", a=f"First  paragraph\n{n} of <b>bold</b> text.", b=f"Second {n}", n=n)


def text(n):
    return f"Title {n}\nFirst paragraph {n} of bold text.\none{n}\ntwo\nSecond {n} next <line> x"


SCHEMA = "page_id long, url string, html string"


def test_pages_of_a_host(spark):
    data = [(i, f"https://site{i % 3}.example/p/{i}", page(i)) for i in range(30)]
    found = {r.page_id: r for r in main_text(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()}
    assert len(found) == 30
    for i, r in found.items():
        assert r.text == text(i) and r.n_chars == len(text(i)) and r.url == data[i][1]


def test_single_page_and_odd_markup():
    assert extract(page(1), None) == text(1)
    assert extract("<p>just <i>text</i>", None) == "just text"
    assert extract("plain & simple &copy; <", None) == "plain & simple © <"
    assert extract("<div><p>a<p>b</div><!-- <p>no</p> -->", None) == "a\nb"
    assert extract("<script>never closed <p>x", None) == ""
    assert extract("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>", None) == "deep"
    assert extract('<p title="a > b">x</p><table><tr><td>1<td>2</table>', None) == "x\n1\n2"
    assert extract(None, None) == extract("", None) == ""


def test_ids_of_topics_inside_an_article_are_kept():
    for outer in ("article", "main"):
        inside = '<p>a</p><section id="discussion"><p>b</p></section><h2 id="related-work">c</h2><p>d</p>'
        beside = '<section id="comments"><p>x</p></section><section class="related"><p>x</p></section><div id="related"><p>x</p></div>'
        assert extract(f"<body><{outer}>{inside}{beside}</{outer}></body>", None) == "a\nb\nc\nd"
    assert extract('<body><section id="related"><p>x</p></section><article><p>a</p></article></body>', None) == "a"


def test_host_of_several_layouts_and_unlisted_names():
    # Two layouts with names that no list has; one line is the same on all pages of the first.
    first = lambda n: f'<body><div class="zq">Top</div><div class="qx"><article class="ko"><h1>t{n}</h1>{"<p>more</p>" * (n % 3)}<p>{"<b>y</b>" * n}a{n}</p><div class="wv">Desk line</div></article></div></body>'
    second = lambda n: f'<body><div class="vv">Top</div><main class="lu"><h2 id="share-prices">s{n}</h2><p>b{n}</p></main></body>'
    one = lambda n: "\n".join([f"t{n}", *["more"] * (n % 3), "y" * n + f"a{n}"])
    wrapper = infer([first(n) for n in range(8)])
    assert [extract(first(n), wrapper) for n in range(20)] == [one(n) for n in range(20)]
    assert [extract(second(n), wrapper) for n in range(5)] == [f"s{n}\nb{n}" for n in range(5)]


def test_wrapper_has_optional_and_repeated_groups():
    some = [f"<article><h1>t{i}</h1>{'<h2>s</h2>' if i % 2 else ''}{'<p>x</p>' * (i + 1)}</article>" for i in range(4)]
    from quern.llm.html_text import Node, aligned

    wrapper = stream(blocks_of(some[0]))
    for other in some[1:]:
        wrapper = Node("", aligned(wrapper.children, stream(blocks_of(other)).children))
    said = expression(wrapper)
    assert "(<h2>" in said and "</>)?" in said and "+" in said and "#text" in said
    assert infer(some)["main"] == ["article"]


def test_all_cases(spark):
    data = [(1, None, page(1)), (2, "not a url", None), (3, "http://h/x", ""), (4, "http://h/x", page(4)), (4, "http://h/x", page(4)), (None, None, "<p>x</p>"), (5, "http://long/", "<article>" + "<p>word word</p>" * 20_000 + "</article>")]
    df = spark.createDataFrame([(*d, "x", "y", "z", 1) for d in data], f"{SCHEMA}, text string, host string, wrapper string, h int")
    found = main_text(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in found) == sorted([(1, len(text(1))), (2, 0), (3, 0), (4, len(text(4))), (4, len(text(4))), (0, 1), (5, 10 * 20_000 - 1)])
    assert main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_on_test_table(spark, sf):
    from quern.llm.queries import op7_html_main_text

    found = op7_html_main_text(spark, sf).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert {r.page_id for r in found} == set(pages)
    for r in found:
        assert r.n_chars == len(r.text) and "<p" not in r.text and not any(line != " ".join(line.split()) for line in r.text.split("\n"))


WORDY = "the river ran past old mills and wide fields while carts went to market".split()


def anonymous(n, rng):
    """A page of unnamed ``div``s: menu, notice, article, comments, links to other pages, and a last line."""
    say = lambda k: " ".join(rng.choice(WORDY) for _ in range(k)) + f" {rng.randrange(10**6)}"
    body = [f"<h1>{say(4)}</h1>"] + [f"<p>{say(rng.randint(20, 60))}</p>" for _ in range(rng.randint(2, 6))]
    if n % 3 == 0:
        body.insert(2, f"<h2>{say(3)}</h2>")
    text = [re.sub("<[^>]*>", "", x) for x in body]
    menu = "".join(f'<a href="/{k}">{say(1)}</a> ' for k in range(5))
    comments = "".join(f"<div><div>{say(2)}</div><div>{say(rng.randint(5, 25))}</div></div>" for _ in range(n % 5))
    others = "".join(f'<div><a href="/p{k}">{say(6)}</a></div>' for k in range(4))
    notice = "<div>Our cookies keep this place going</div>" if n % 2 else ""
    return f"<html><body><div>{menu}</div>{notice}<div><div>{''.join(body)}<div>Sign up for our weekly letter</div></div><div>{comments}</div></div><div>{others}</div><div>All rights kept by the mill</div></body></html>", "\n".join(text)


def test_wrapper_finds_articles_that_nothing_names():
    rng = random.Random(3)
    pages = [anonymous(n, rng) for n in range(60)]
    wrapper = infer([html for html, _ in pages[:8]])
    right = sum(extract(html, wrapper) == text for html, text in pages)
    alone = sum(extract(html, None) == text for html, text in pages)
    assert right == len(pages) and alone == 0, (right, alone)


def test_expression_decides_and_not_the_lists(monkeypatch):
    from quern.llm import html_text

    pages = [page(n) for n in range(12)]
    for name in ("ASIDE", "ROLES", "WORDS"):
        monkeypatch.setattr(html_text, name, frozenset())
    wrapper = infer(pages[:8])
    assert [extract(p, wrapper) for p in pages] == [text(n) for n in range(12)]


def plain_alignment(a, b):
    """The greatest likeness of all alignments, by trying each."""
    if not a or not b:
        return 0.0
    like = likeness(a[0], b[0])
    return max(plain_alignment(a[1:], b), plain_alignment(a, b[1:]), like + plain_alignment(a[1:], b[1:]) if like else 0.0)


def test_alignment_is_the_best_one():
    rng = random.Random(8)
    node = lambda: Node(rng.choice(["div", "p", "ul"]), [Node(x) for x in rng.sample(["a", "b", "c"], rng.randint(0, 3))])
    for _ in range(300):
        a, b = [node() for _ in range(rng.randint(0, 6))], [node() for _ in range(rng.randint(0, 6))]
        found = pairs(a, b)
        assert [i for i, _ in found if i is not None] == list(range(len(a))) and [j for _, j in found if j is not None] == list(range(len(b)))
        assert abs(sum(likeness(a[i], b[j]) for i, j in found if i is not None and j is not None) - plain_alignment(a, b)) < 1e-9


def test_text_is_kept_whatever_its_names_and_depth():
    assert extract('<div class="post-share related-content"><p>the whole text</p></div>', None) == "the whole text"
    for depth in (5, 210, 3000):
        assert extract("<article>" + "<div>" * depth + "<nav>MENU</nav><p>a</p><p>b</p>" + "</div>" * depth + "</article>", None) == "a\nb"


def test_odd_pages_take_time_in_proportion():
    began = time.monotonic()
    for one in ('<a "', "<div>x", "<b><p>x", "<span>", "<li>x<span>", "<ul><li>x", "<td>x", "</div>", "<a href=x", "<!--", "<p>x</p><h2>y</h2>", "<div><p>x</div>", "&amp;", "<"):
        for page in (one * 20_000, "<article>" + one * 20_000 + "<p>end</p>"):
            wrapper = infer([page, page + "<p>1</p>", page + "<p>2</p>"])
            extract(page, wrapper)
    assert time.monotonic() - began < 240


def test_pages_without_id_and_url(spark):
    data = [(None, None, page(n % 4)) for n in range(80)]
    found = main_text(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()
    assert sorted(r.text for r in found) == sorted(text(n % 4) for n in range(80))
