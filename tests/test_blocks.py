"""Blocks of pages: nearest container of a seed, nested duplicates, time in proportion to the page."""

import random
import time

import pytest

from postforge.functions import fixed as K
from postforge.functions import html as H

FILL = "a role for people who like hard problems and short meetings"


def blocks(page):
    return [(b["title"], b["text"]) for b in H.parse_page(page, "https://a.com/")["blocks"]]


def test_the_smaller_of_two_nested_blocks_stays():
    inner = f"<div><h3>FPGA Engineer</h3> {FILL}</div>"
    assert blocks(f"<section><h2>Engineering roles</h2>{inner}</section>") == [("FPGA Engineer", f"FPGA Engineer {FILL}")]
    assert blocks(f"<section><h2>Our kitchen</h2>{inner}</section>") == [("FPGA Engineer", f"FPGA Engineer {FILL}")]
    assert len(blocks(f"<section><h2>Engineering roles</h2>{inner}{inner}</section>")) == 2
    assert [t for t, _ in blocks(f"<div><h3>Trader</h3></div>{FILL}")] == []  # too short, and nothing encloses it
    assert [t for t, _ in blocks(f"<article><div><h3>Trader</h3></div>{FILL}</article>")] == ["Trader"]


def test_texts_beyond_the_bounds_are_no_blocks():
    long = "word " * 500
    assert blocks(f"<section>{long}<div><h3>Trader</h3></div></section>") == []
    assert blocks(f"<section>{' ' * 5000}<h3>Trader</h3>{chr(160) * 3000}{FILL}</section>") == [("Trader", f"Trader {FILL}")]


def by_walking(tree):
    """The rule over a tree of ("div", children), ("h3", text) and texts: each
    heading that names a role climbs to the first block that fits."""
    found = []

    def text(node):
        if isinstance(node, str):
            return node.split()
        return node[1].split() if node[0] == "h3" else [w for child in node[1] for w in text(child)]

    def walk(node, path):
        if isinstance(node, str):
            return
        if node[0] == "h3":
            if any(t in node[1].lower() for t in K.ROLE_TERMS):
                for depth in range(len(path) - 1, -1, -1):
                    whole = " ".join(text(path[depth]))
                    if H.SHORTEST <= len(whole) <= H.LONGEST and any(t in whole.lower() for t in K.ROLE_TERMS):
                        if not any(path[depth] is node for _, _, node in found):
                            found.append((node[1], whole, path[depth]))
                        break
            return
        for child in node[1]:
            walk(child, [*path, node])

    walk(tree, [])

    def inside(a, b):
        return a is not b and not isinstance(b, str) and b[0] == "div" and any(c is a or inside(a, c) for c in b[1])

    return sorted((t, w) for t, w, node in found if not any(inside(other, node) for _, _, other in found))


def render(node):
    if isinstance(node, str):
        return f" {node} "
    return f"<h3>{node[1]}</h3>" if node[0] == "h3" else f"<div>{''.join(map(render, node[1]))}</div>"


@pytest.mark.parametrize("seed", range(5))
def test_blocks_equal_a_walk_over_the_tree(seed):
    r = random.Random(seed)

    def grow(depth):
        kids = []
        for _ in range(r.randint(1, 4)):
            kind = r.random()
            if depth and kind < 0.5:
                kids.append(grow(depth - 1))
            elif kind < 0.75:
                kids.append(("h3", r.choice(["FPGA Engineer", "Chef de partie", "Trader", "Our kitchen"])))
            else:
                kids.append(r.choice([FILL, "short", "word " * 480]))
        return ("div", kids)

    seen = 0
    for _ in range(300):
        tree = grow(4)
        assert sorted(blocks(render(tree))) == by_walking(tree)
        seen += len(by_walking(tree))
    assert seen > 100  # the draw is not empty


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<div>" * n + f"<h3>Engineer</h3>{FILL}" + "</div>" * n,
        lambda n: "<div><a href='/x'>Chef</a>" * n + "</div>" * n,
        lambda n: "<div><a href='/x'>Engineer</a>" * n + "</div>" * n,
        lambda n: "<div>" * n + "</li>" * n,
        lambda n: "<li><ul>" * n + "</li>" * n,
    ],
)
def test_nesting_takes_time_in_proportion(page):
    def seconds(n):
        text = page(n)
        began = time.process_time()
        H.parse_page(text)
        return time.process_time() - began

    seconds(500)
    assert seconds(4000) < 1
    assert seconds(16000) < 10 * max(seconds(4000), 0.02)
