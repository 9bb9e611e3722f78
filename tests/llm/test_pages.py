"""Rendering: what stands loose in tables, the cascade of display, wide tables, and generated pages against a plain recursion."""

import random
import time

import pytest

from ledgerloom.llm.html_render import render


def test_loose_children_of_tables():
    assert render('<table><img alt="logo"><tr><td>a</td></tr></table>').split() == ["logo", "a"]
    assert render('<table><input value="v"><tr><td>a</td></tr></table>').split() == ["v", "a"]
    assert render('<table><tr><img alt="x"><td>a</td></tr></table>').split() == ["x", "a"]
    assert render('<table><tr><td>a</td></tr><p style="display:none">gone</p></table>') == "a"
    assert render('<table><input type="hidden" value="v"><tr><td>a</td></tr></table>') == "a"


def test_the_last_winning_display():
    css = "<style>.x{display:none}#y{display:block}p.z{display:none}.z{display:block}</style>"
    assert render(css + '<p class=x style="display:block">shown</p>') == "shown"
    assert render(css + "<p class=x>gone</p>") == ""
    assert render(css + "<p class=x id=y>shown</p>") == "shown"  # an id over a class
    assert render(css + "<p class=z>gone</p>") == ""  # a class with a tag over a class, whatever comes last
    assert render('<style>.x{display:none!important}</style><p class=x style="display:block">gone</p>') == ""
    assert render('<p style="display:none;display:inline">shown</p>') == "shown"
    assert render('<style>.a{visibility:hidden}.b{visibility:visible}</style><p class="a b">shown</p>') == "shown"
    assert render('<style>.a{visibility:hidden}</style><p class="a">no<b style="visibility:visible">yes</b></p>') == "yes"
    assert render('<p style="content-visibility:hidden">gone</p>') == ""


def test_tables_take_time_and_room_in_proportion():
    sizes, took = [], []
    for n in (1000, 8000):
        page = "<table>" + "<tr><td rowspan=65534>x" * n + "</table>"
        t = time.process_time()
        text = render(page)
        took.append(time.process_time() - t)
        sizes.append(len(text))
        assert text.split() == ["x"] * n
    assert sizes[1] < 12 * sizes[0] and took[1] < 30 * max(took[0], 0.05)
    big = "y" * 5000
    assert render(f"<table><tr><td>{big}<td>b</tr><tr><td>c<td>d</tr></table>") == f"{big}  b\nc  d"


@pytest.mark.parametrize("seed", range(12))
def test_columns_keep_their_places_in_tables_of_any_width(seed):
    """Cells that are left out, in tables of 12 to some 9000 columns of text: what stands where tells the column."""
    rng = random.Random(seed)
    n, m, most = rng.randint(2, 6), rng.randint(2, 9), (9, 300, 990)[seed % 3]
    cells = [["".join(rng.choice("abc") for _ in range(rng.randint(1, most))) for _ in range(m)]]  # a row without gaps
    cells += [[rng.choice(["", "d" * rng.randint(1, 9)]) for _ in range(m)] for _ in range(n)]
    wide = [max(len(r[k]) for r in cells) for k in range(m)]
    lines, room = [[]], 1000  # the columns of each line of a row
    for k in range(m):
        if lines[-1] and sum(wide[i] + 2 for i in (*lines[-1], k)) > room:
            lines.append([])
        lines[-1].append(k)
    want = []
    for r in cells:
        texts = ["  ".join(r[k].ljust(wide[k]) for k in line).rstrip() for line in lines]
        want += "\n".join(texts).rstrip("\n").split("\n")
    page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in cells) + "</table>"
    assert render(page).split("\n") == "\n".join(want).strip("\n").split("\n")


def test_wide_tables():
    y, z, big = "y" * 600, "z" * 600, "x" * 3000
    assert render(f"<table><tr><td>{y}<td>{z}<td>q<tr><td>c<td><td>d</table>") == f"{y}\n{z}  q\nc\n{' ' * 602}d"
    # one long cell takes no column of other rows away
    assert render(f"<table><tr><td>a<td><td>b<td>c<tr><td>dd<td>ee<td>{big}<td>f<tr><td><td>g<td>h<td>i</table>") == f"a       b  c\ndd  ee\n{big}  f\n    g   h  i"
    assert render(f"<table><tr><td rowspan=2>{y}<td>{z}<tr><td>c<tr><td>d<td>e</table>") == f"{y}\n{z}\n\nc\nd\ne"
    # which cells are left out can be told
    three = f"<table><tr><td>{y}<td>{y}<td>{y}"
    assert render(f"{three}<tr><td>a<td><td>c</table>") == f"{y}\n{y}\n{y}\na\n\nc"
    assert render(f"{three}<tr><td>a<td>c<td></table>") == f"{y}\n{y}\n{y}\na\nc"
    assert render(f"<table><tr><td>a<td>b<tr><td><td>{big}<tr><td>{big}<td></table>") == f"a  b\n\n{big}\n{big}"
    assert render(f"<table><tr><td>{y}<br>1<td>{z}<br>2<br>3<tr><td>日<td>語</table>") == f"{y}\n1\n{z}\n2\n3\n日\n語"


def test_steps_of_spans_are_aligned():
    """Every row one column further, 333 columns of three in a line, blank lines for those before."""
    text = render("<table>" + "<tr><td rowspan=65534>x" * 1000 + "</table>")
    assert text.split("\n") == [t for r in range(1000) for t in (*[""] * (r // 333), " " * (3 * (r % 333)) + "x")]


def test_wide_tables_take_room_and_time_in_proportion():
    """Nested, none pads what is longer than a line again; cells of many lines beside many cells."""
    sizes, took = [], []
    for n in (40, 160):
        page = ("<table><tr><td>" + "y" * 400 + "<td>") * n + "<p>" + "w" * 1200 + "<p>v" * n + "</table>" * n
        sizes.append(len(render(page)) / len(page))
        page = "<table><tr><td>" + "a<br>" * (40 * n) + "<td>b" * (40 * n) + "</table>"
        t = time.process_time()
        assert len(render(page).split()) == 80 * n
        took.append(time.process_time() - t)
    assert sizes[1] < 3 * sizes[0] and took[1] < 10 * max(took[0], 0.05)


def test_spans():
    assert render("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == "a  b\n   c\nd  e"
    assert render("<table><tr><td colspan=999999999>a<tr><td>b<td>c</table>") == "a\nb  c"
    assert render("<table><tr><td>p<td rowspan=2>q<td>r<tr><td>s<td>t<tr><td>u<td>v<td>w</table>") == "p  q  r\ns     t\nu  v  w"


def made(rng, depth=0):
    """A page as a tree: a word, or (tag, hidden, children)."""
    if depth > 5 or rng.random() < 0.3:
        return f"w{rng.randint(0, 99)}"
    return rng.choice(["div", "section", "span", "b", "em"]), rng.random() < 0.15, [made(rng, depth + 1) for _ in range(rng.randint(0, 4))]


def source(node):
    if isinstance(node, str):
        return f" {node} "
    tag, hidden, children = node
    return f"<{tag}{' hidden' if hidden else ''}>" + "".join(map(source, children)) + f"</{tag}>"


def plain(node, lines):
    """Words in lines; a block starts a line and ends one."""
    if isinstance(node, str):
        lines[-1].append(node)
        return
    tag, hidden, children = node
    if hidden:
        return
    block = tag in ("div", "section")
    if block:
        lines.append([])
    for c in children:
        plain(c, lines)
    if block:
        lines.append([])


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages(seed):
    rng = random.Random(seed)
    page = ("div", False, [made(rng) for _ in range(6)])
    lines = [[]]
    plain(page, lines)
    assert render(source(page)).split("\n") == ([" ".join(x) for x in lines if x] or [""])


@pytest.mark.parametrize("seed", range(20))
def test_generated_tables(seed):
    """Tables without spans: every column as wide as its widest cell, two spaces between."""
    rng = random.Random(seed)
    n, m = rng.randint(1, 6), rng.randint(1, 5)
    cells = [["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(m)] for _ in range(n)]
    wide = [max(len(r[k]) for r in cells) for k in range(m)]
    want = ["  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in cells]
    close = rng.random() < 0.5
    page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" + "</td>" * close for c in r) for r in cells) + "</table>"
    assert render(page).split("\n") == want
