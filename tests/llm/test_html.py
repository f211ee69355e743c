"""HTML extraction: densities against a recursive version, what the densities decide, time on bad pages."""

import random
import time
from math import e, log

import pyarrow.parquet as pq
import pytest

from tarnbrook.llm import html_text

GIVEN = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()


def random_tree(rng, depth=0):
    """(tag, [text or tree])"""
    inside = []
    for _ in range(rng.randint(0, 4)):
        if rng.random() < 0.5 or depth > 4:
            inside.append("".join(rng.choices("abcd ", k=rng.randint(1, 60))))
        else:
            inside.append(random_tree(rng, depth + 1))
    return rng.choice(["div", "section", "span", "a", "b"] if depth else ["div"]), inside


def as_html(tree):
    return f"<{tree[0]}>" + "".join(x if isinstance(x, str) else as_html(x) for x in tree[1]) + f"</{tree[0]}>"


def counts(tree, linked=False):
    """Characters, tags, and characters of links under a node."""
    linked = linked or tree[0] == "a"
    c = t = lc = 0
    for x in tree[1]:
        if isinstance(x, str):
            n = len(x) - x.count(" ") if x.strip() else 0
            c, lc = c + n, lc + n * linked
        else:
            own = counts(x, linked)
            c, t, lc = c + own[0], t + own[1] + 1, lc + own[2]
    return c, t, lc


def nodes(tree):
    yield tree
    for x in tree[1]:
        if not isinstance(x, str):
            yield from nodes(x)


@pytest.mark.parametrize("seed", range(40))
def test_densities_equal_a_recursive_version(seed):
    tree = random_tree(random.Random(seed))
    page = html_text.Page(as_html(tree))
    got = html_text.Measured(page)
    whole = counts(tree)
    assert page.tag[1:] == [x[0] for x in nodes(tree)]
    for i, x in enumerate(nodes(tree)):
        c, t, lc = counts(x)
        assert (got.chars[i + 1], got.tags[i + 1], got.link_chars[i + 1]) == (c, t, lc)
        lt = got.link_tags[i + 1]
        assert (lt == 0) == (not any(y[0] == "a" for y in nodes(x))) and lt <= t + 1
        base = max(2.0, log(c / max(c - lc, 1) * lc + whole[2] / max(whole[0], 1) * c + e))
        expected = c / max(t, 1) * max(0.0, log(max(1.0, c / max(lc, 1) * max(t, 1) / max(lt, 1))) / log(base)) if c else 0.0
        assert got.density[i + 1] == pytest.approx(expected)
    sums, own = got.sums()
    kids = [[j for j in range(len(page.tag)) if page.parent[j] == i] for i in range(len(page.tag))]
    for i, k in enumerate(kids):
        blocks = [j for j in k if not got.inline[j]]
        assert sums[i] == pytest.approx(sum(got.density[j] for j in (blocks or k)) + (own[i] if blocks else 0))


def test_density_selects_on_the_given_pages(monkeypatch):
    picked = [html_text.Page(h) for h in GIVEN]
    tags = [p.tag[html_text.select(html_text.Measured(p))[0]] for p in picked]
    assert not {"#page", "html", "body"} & set(tags)
    texts = [html_text.extract(h) for h in GIVEN]
    monkeypatch.setattr(html_text, "_unwanted", lambda *a: 0)  # density alone, no tag and class names
    assert sum(html_text.extract(h) == t for h, t in zip(GIVEN, texts)) >= 0.97 * len(GIVEN)
    monkeypatch.setattr(html_text, "density_of", lambda c, *rest: float(c))
    assert sum(html_text.extract(h) == t for h, t in zip(GIVEN, texts)) < 0.1 * len(GIVEN)


P = ["<p>" + "A sentence of some length that belongs to the article, as any other does. " * k + "</p>" for k in (3, 2, 4)]
TEXT = "\n".join(html_text.extract(p) for p in P)
SOUP = [
    # no class, no id and no telling tag anywhere: the density alone decides
    f"<body><div>Buy cheap watches now</div><div>{''.join(P)}</div><div>All rights reserved</div></body>",
    f"<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>About us and all the others</a></div><div>{''.join(P)}</div><div><a href=4>Imprint of this page</a></div></body>",
    f"<body><table><tr><td><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></td><td>{''.join(P)}</td></tr></table></body>",
    f"<body><form action=x><div><input><label>Search</label></div><div>{''.join(P)}</div></form></body>",
    f"<body><div>{''.join(P)}<form><label>Your name</label><input><button>Send</button></form></div></body>",
    f"<body><article>{''.join(P)}</article><div class=comments>{''.join('<p>' + 'I do not think so at all, dear author. ' * 9 + '</p>' for _ in range(9))}</div></body>",
]


@pytest.mark.parametrize("page", SOUP)
def test_pages_without_telling_names(page):
    assert html_text.extract(page) == TEXT


def test_text_between_blocks_and_titles():
    long = "Words of a text that stands right in the body, with no element of its own. " * 9
    assert html_text.extract(f"<body>{long}<b>bold</b> end<br>{long}<div>x</div></body>") == " ".join(f"{long}bold end {long}".split()) + "\nx"
    assert html_text.extract(f"<body><div><h1>My site</h1></div><div><h1>T</h1></div><div>{''.join(P)}</div></body>") == "T\n" + TEXT
    assert html_text.extract(f"<body><h1>My site</h1><article><h2>T</h2>{''.join(P)}</article></body>") == "T\n" + TEXT
    assert html_text.extract(f"<main><h1>T</h1><article>{''.join(P)}</article></main>") == "T\n" + TEXT


def test_a_container_that_says_it_is_an_article():
    body = f"<h1>A title</h1><div>By Ann</div><div>{''.join(P)}</div><div>End</div>"
    around = f"<body><div><a href=1>Home</a></div><div>Ad</div><div {{}}>{body}</div><div>Rights</div></body>"
    for name in ("class='post single'", "id=story", "role=article"):
        assert html_text.extract(around.format(name)) == f"A title\nBy Ann\n{TEXT}\nEnd"
    assert html_text.extract(around.format("class=posts")) == f"A title\n{TEXT}"


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 100_000 + "x", '<a "' * 250_000, "<a x='>" * 150_001 + '"<b>', "<p><object>" + "<div>" * 100_000, "<article>" * 100_000, "<svg>" * 200_000, "<b>" * 100_000 + "</i>" * 100_000])
def test_time_is_linear(page):
    began = time.perf_counter()
    html_text.extract(page)
    assert time.perf_counter() - began < 5
