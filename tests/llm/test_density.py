"""Composite text density against a plain recursive version, and pages made to stall a parser."""

import math
import random
import time

import pytest

from strandlake.llm import html_text


def made(rng, depth=0):
    """A random well-formed tree: (tag, children)."""
    if depth > 4 or rng.random() < 0.25:
        return " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 25)))
    tag = rng.choice(["div", "section", "span", "a", "b", "i"] if depth else ["div"])
    return tag, [made(rng, depth + 1) for _ in range(rng.randrange(1, 5))]


def write(node):
    return node if isinstance(node, str) else f"<{node[0]}>" + "".join(map(write, node[1])) + f"</{node[0]}>"


def counts(node):
    """(characters, tags, link characters, link tags) below the node, by recursion."""
    if isinstance(node, str):
        return len("".join(node.split())), 0, 0, 0
    c = t = lc = lt = 0
    for x in node[1]:
        a, b, d, e = counts(x)
        c, t, lc, lt = c + a, t + b + (not isinstance(x, str)), lc + d, lt + e
    return (c, t, c, lt + 1) if node[0] == "a" else (c, t, lc, lt)


def density(node, share):
    c, t, lc, lt = counts(node)
    if not c:
        return 0.0
    x = c / max(lc, 1) * max(t, 1) / max(lt, 1)
    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    return c / max(t, 1) * (math.log(x) / math.log(base) if base > 1 and x > 0 else math.log(max(x, 1.0)))


def flat(node):
    yield node
    for x in node[1]:
        if not isinstance(x, str):
            yield from flat(x)


@pytest.mark.parametrize("seed", range(40))
def test_densities_and_sums(seed):
    tree = ("body", [made(random.Random(3 * seed + k)) for k in range(3)])
    root = html_text.parse("<body>" + "".join(map(write, tree[1])) + "</body>")
    order = html_text._measure(root)
    c, _, lc, _ = counts(tree)
    want = list(flat(tree))
    assert [n.tag for n in order] == [n[0] for n in want]
    share = lc / c if c else 0.0
    assert [n.density for n in order] == pytest.approx([density(n, share) for n in want])
    sums = [sum(density(x, share) for x in n[1] if not isinstance(x, str)) for n in want]
    assert [n.total for n in order] == pytest.approx(sums)


def extracted(tree):
    """The text of a tree by recursion: every density, sum and rule computed anew for each node."""
    c, _, lc, _ = counts(tree)
    share = lc / c if c else 0.0
    if not c:
        return ""
    where = {}  # node -> path from the body

    def walk(node, path):
        where[id(node)] = path = [*path, node]
        for x in node[1]:
            if not isinstance(x, str):
                walk(x, path)

    walk(tree, [])
    nodes = list(flat(tree))
    total = lambda n: sum(density(x, share) for x in n[1] if not isinstance(x, str))
    top = max((total(n), n[0] in ("article", "main")) for n in nodes)
    best = next(n for n in nodes if (total(n), n[0] in ("article", "main")) == top) if top[0] > 0 else tree
    path = where[id(best)]
    least = min(density(n, share) for n in path)
    peak = lambda n: max(density(x, share) for x in flat(n))
    kept, held = [best], counts(best)[0]
    for frame, middle in zip(path[-2::-1], path[:0:-1]):
        here = next(i for i, x in enumerate(frame[1]) if x is middle)
        dense = [i for i, x in enumerate(frame[1]) if not isinstance(x, str) and (i == here or counts(x)[0] and peak(x) >= least or x[0] in ("h1", "h2"))]
        held += sum(counts(frame[1][i])[0] for i in dense if i != here)
        whole = frame[0] in ("article", "main") and 2 * held >= counts(frame)[0]

        def fits(i, x):
            if i in dense:
                return True
            between = whole or dense[0] <= i <= dense[-1]
            return between and (isinstance(x, str) or 2 * counts(x)[2] < counts(x)[0] or not counts(x)[0])

        kept = [x for i, x in enumerate(frame[1][:here]) if fits(i, x)] + kept + [x for i, x in enumerate(frame[1]) if i > here and fits(i, x)]

    def text(node):
        if isinstance(node, str):
            return node
        inner = "".join(map(text, node[1]))
        return inner if node[0] in ("span", "a", "b", "i") else f"\n{inner}\n"

    return "\n".join(" ".join(line.split()) for line in "".join(map(text, kept)).split("\n") if line.strip())


def page(rng, depth=0):
    """A random tree that looks like a page: paragraphs, link lists, sections, articles and headings."""
    words = lambda a, b: " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(a, b)))
    kind = rng.random()
    if depth > 3 or kind < 0.45:
        return rng.choice([("p", [words(1, 60)]), ("p", [words(3, 30), ("b", [words(1, 4)]), words(1, 20)]), ("h2", [words(1, 5)]), ("div", [("a", [words(1, 3)]) for _ in range(rng.randint(1, 9))]), words(1, 12)])
    return rng.choice(["div", "div", "section", "article"]), [page(rng, depth + 1) for _ in range(rng.randint(1, 6))]


def test_extraction_equals_brute_force(monkeypatch):
    rng = random.Random(12)
    trees = [("body", [page(rng) for _ in range(rng.randint(1, 5))]) for _ in range(400)]
    pages = ["<body>" + "".join(map(write, t[1])) + "</body>" for t in trees]
    got = [html_text.main_text(p) for p in pages]
    assert got == [extracted(t) for t in trees]
    # the densities decide: other ones give other texts
    monkeypatch.setattr(html_text, "_density", lambda n, share: rng.random())
    assert sum(html_text.main_text(p) != g for p, g in zip(pages, got)) > 150


LONG = "<p>" + "A sentence of the text that says a good deal about rivers and stones. " * 4 + "</p>"
LINKS = "<ul>" + "".join(f"<li><a href='/{k}'>Topic {k}</a></li>" for k in range(12)) + "</ul>"


@pytest.mark.parametrize(
    "page,inside,outside",
    [
        # the sum of the paragraphs' densities tells the text's node, no element name does
        (f"<div><div>{LINKS}</div><div>{LONG * 4}</div><div>{LINKS}</div></div>", 4, "Topic"),
        # two dense sections: the path's threshold brings in the one beside the best
        (f"<div><div>{LINKS}</div><div><div>{LONG * 5}</div><div>{LONG * 3}</div></div><div>{LINKS}</div></div>", 8, "Topic"),
        # a short part between dense ones belongs to the text
        (f"<div><div>{LINKS}</div><section><div>{LONG * 3}</div><div><p>Short.</p></div><div>{LONG * 2}</div></section></div>", 5, "Topic"),
    ],
)
def test_density_chooses(page, inside, outside):
    text = html_text.main_text(f"<body>{page}</body>")
    assert text.count("A sentence of the text") == 4 * inside and outside not in text
    assert ("Short." in page) == ("Short." in text)


@pytest.mark.parametrize("part", ['<a x="', "<a b", "<div>", "<div><p>", "<b><p>", "<li>", "<table><tr><td>", "<!--", "</p>", "<script>", "<a href=x>y", "<", "<p title='", "<b>", "</", "<!", "&", "<p class=a id=", "<ul><li>"])
def test_broken_pages_take_linear_time(part):
    def seconds(n):
        start = time.process_time()
        html_text.main_text(part * (n // len(part)))
        return time.process_time() - start

    small, large = min(seconds(100_000) for _ in range(2)), seconds(400_000)
    assert large < 0.5 + 8 * small


def test_markup_that_the_end_cuts_off_is_no_text():
    assert html_text.main_text("<p>kept text</p><p class='x") == "kept text"
    assert html_text.main_text("<p>kept text</p><!-- never closed") == "kept text"
    assert html_text.main_text('<p title="a > b" lang=en>one</p><p title=it\'s>two</p>') == "one\ntwo"
