import math
import re
import time

import pytest

from logweave.llm import main_text as module
from logweave.llm.main_text import extract, main_text

LONG = "This sentence stands for an article paragraph and is long enough to carry weight."


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("<script>var a='<p>x</p>';</script>", ""),
        ("<title>t</title><nav><a href=x>only a menu</a></nav>", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b &lt;c&gt;", "a\nb <c>"),
        (f"<article><h1>T</h1><p><b>{LONG}<br><p>second\n one</article><footer>foot", f"T\n{LONG}\nsecond one"),
        (f"<body><header>H</header><main><section><p>{LONG}</p></section><section><p>short</p></section></main><aside>S</aside>", f"{LONG}\nshort"),
        (f"<div class='cookie-notice'>we use cookies</div><div id=content><p>{LONG}</p><p>{LONG}</p><div class='comments'><p>{LONG} I agree!</p></div></div><form>mail</form>", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", f"{LONG}\none\ntwo\nc1\nc2"),
        (f"<div id='cookiebar'>{LONG}</div><div class='topNav'>{LONG}</div><div class='commentary'><p>{LONG}</p></div>", LONG),
        (f"<div class=ad>buy</div><article>{LONG}<!-- a <p>comment</p> --><p hidden>no</p></article>", LONG),
        (f"<div class=ad>{LONG}</div><article><header><h1>Head</h1></header><p>{LONG}</p></article>", f"Head\n{LONG}"),
        (f"<div><section class='related-work'><p>{LONG}</p><p>{LONG}</p></section></div><footer>foot</footer>", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><div class='market-share'><p>{LONG}</p></div><div class='dialogue response'><p>{LONG}</p></div></article>", f"{LONG}\n{LONG}\n{LONG}"),
        (f"<body><form><nav><a href=1>a</a><a href=2>b</a></nav><div><p>{LONG}</p><p>{LONG}</p></div><input value=x><button>Send</button></form></body>", f"{LONG}\n{LONG}"),
        (f"<div class='page-with-sidebar'><h1>Head</h1><div><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div></div>", f"Head\n{LONG}\n{LONG}"),
        (f"<article><h2><a href='#x'>Linked head</a></h2><p>{LONG}</p><ul><li><a href=1>one</a><li><a href=2>two</a></ul></article>", f"Linked head\n{LONG}"),
        (f"<div id=post><p>{LONG}</p></div><div class='reader-comments'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", LONG),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_link_lists_lose_to_text():
    menu = "".join(f"<li><a href=/x{i}>some menu entry {i}</a></li>" for i in range(60))
    page = f"<body><div><ul>{menu}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert main_text(page) == f"{LONG}\n{LONG}"


PAGE = re.compile(r"<(/?)([a-z0-9]+)[^>]*>|([^<]+)")


def _plain_sums(page):
    """Density sums of a well-formed page by reading the definition: own text and children, each by its composite density."""
    root = ["#", [], []]
    stack = [root]
    for end, tag, text in PAGE.findall(page):
        if text:
            stack[-1][1].append(text)
        elif end:
            stack.pop()
        else:
            stack.append([tag, [], []])
            stack[-2][2].append(stack[-1])

    def counts(node, linked):
        linked = linked or node[0] == "a"
        c = sum(len(" ".join(x.split())) for x in node[1])
        parts = [counts(x, linked) for x in node[2]]
        return (c + sum(p[0] for p in parts), (c if linked else 0) + sum(p[1] for p in parts), sum(p[2] + 1 for p in parts), sum(p[3] for p in parts) + sum(x[0] == "a" for x in node[2]))

    all_chars, all_links, _, _ = counts(root, False)

    def density(c, lc, t, lt):
        return c / max(1, t) * math.log((c + 1) / (lc + 1) * (t + 1) / (lt + 1)) / math.log(1 + math.log(c * lc / (c - lc + 1) + all_links / all_chars * c + math.e))

    out = []

    def walk(node, linked):
        linked = linked or node[0] == "a"
        own = sum(len(" ".join(x.split())) for x in node[1])
        out.append((density(own, 0, 0, 0) if own and not linked else 0) + sum(density(*counts(x, linked)) for x in node[2]))
        for x in node[2]:
            walk(x, linked)

    walk(root, False)
    return out


def test_density_sums_are_those_of_the_definition():
    page = f"<html><body><div><ul><li><a>one</a></li><li><a>two</a> x</li></ul></div><div><h1>Head</h1><p>{LONG} <a>link</a> and <b>more</b></p>tail<p>{LONG}</p></div></body></html>"
    tree = module._Tree(page)
    tree.measure()
    assert tree.densities()[1] == pytest.approx(_plain_sums(page))


def test_density_alone_tells_text_from_furniture(monkeypatch):
    """Without the names of furniture the sums still find the article; without densities nothing does."""
    page = f"<body><nav><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul></nav><div class=ad>buy this</div><div><p>{LONG}</p><p>{LONG}</p></div><footer>foot of the page</footer></body>"
    monkeypatch.setattr(module._Tree, "_kind", lambda *a: "")
    assert main_text(page) == f"{LONG}\n{LONG}"
    monkeypatch.setattr(module, "composite", lambda *a: 1.0)
    assert main_text(page) != f"{LONG}\n{LONG}"


def test_hostile_pages_take_linear_time():
    began = time.time()
    for page in ("<b>" * 50_000, "<p>x" * 50_000, '<a href="' + '"x ' * 50_000, "<!--" * 50_000, "<" * 100_000, "</p>" * 50_000, "<li>" * 20_000 + "x", "&amp" * 50_000):
        main_text(page)
    assert time.time() - began < 20


def test_column(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "clash"), (1, "u", f"<p>{LONG}</p>", None), (2, None, None, "c"), (None, None, "", "c")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(2)
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(df).collect())
    assert got == [(0, "", 0), (1, LONG, len(LONG)), (1, LONG, len(LONG)), (2, "", 0)]
    assert extract(df.limit(0)).collect() == []


def test_very_long_page_and_clashing_columns(spark):
    body = f"<p>{LONG}</p>" * 60_000
    df = spark.createDataFrame([(1, f"<article>{body}</article><footer>f</footer>", 5, "x"), (2, "<p>b", 6, "y")], "page_id long, html string, n_chars int, piece string")
    got = {r.page_id: (len(r.text), r.n_chars, r.piece) for r in extract(df).collect()}
    assert got == {1: ((len(LONG) + 1) * 60_000 - 1, (len(LONG) + 1) * 60_000 - 1, "x"), 2: (1, 1, "y")}
