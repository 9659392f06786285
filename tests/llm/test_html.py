"""Template deduction on generated hosts, and pages that are hard to read."""

import random
import time

import pytest

from siftstone.llm.html_template import _above, _blocks, _walk, extract_main_text, slot_text, template, template_blocks


def _words(rng, n):
    return " ".join("".join(rng.choice("aeioklmnrst") for _ in range(rng.randint(3, 8))) for _ in range(n))


def _site(rng, layout, pages):
    """(html, main text) of each page of a host."""
    out = []
    for i in range(pages):
        title, a, b, lead = _words(rng, 4), _words(rng, rng.randint(30, 60)), _words(rng, rng.randint(20, 50)), _words(rng, 8)
        if layout == "two containers":
            body = f"<div class='top'>Our site</div><div class='a'><h1>{title}</h1><p>{a}</p></div><div class='b'><p>{b}</p></div>"
        elif layout == "notice":
            body = f"<article><h1>{title}</h1><p>{a}</p><div class='x9'>Share this story with friends</div><p>{b}</p></article>"
        elif layout == "equal paragraph":
            body = f"<div class='q'><h1>{title}</h1><p>{a}</p><p>Reading takes <b>two</b> minutes</p><p>{b}</p></div>"
        elif layout == "list":
            body = f"<div class='w-1/2'><div class='w-2/3'><h1>{title}</h1><p>{a}</p><ul class='z'><li>First place</li><li>Second place</li></ul><p>{b}</p></div></div>"
        else:
            body = f"<main><h1>{title}</h1><p>{a}</p><p>{b}</p></main>"
        want = f"{title} {a} {b}"
        if layout == "lead":
            body, want = body.replace("</h1>", f"</h1><p class='lead'>{lead}</p>"), f"{title} {lead} {a} {b}"
        out.append((f"<html><head><title>{title}</title></head><body><nav>Home</nav>{body}<footer>{i}</footer></body></html>", want))
    return out


LAYOUTS = ("two containers", "notice", "equal paragraph", "list", "lead")


def test_template_text_inside_the_slot_is_left_out(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for h, layout in enumerate(LAYOUTS):
        for i, (page, text) in enumerate(_site(rng, layout, 9)):
            rows.append((100 * h + i, f"http://h{h}.example/{i}", page))
            want[100 * h + i] = text
    # a page of another layout on the host does not hide what the others share
    rows.append((190, "http://h1.example/odd", "<html><body><p>Nothing here</p></body></html>"))
    # two pages are no evidence, nor are pages that are copies of one another
    same = [f"<body><article><h1>Copy</h1><p>{'one long text ' * 20}</p><p>end {i}</p></article></body>" for i in range(5)]
    rows += [(800 + i, "http://copies.example/", s) for i, s in enumerate(same)]
    want |= {800 + i: "Copy " + "one long text " * 20 + f"end {i}" for i in range(5)}
    rows += [(900 + i, "http://pair.example/", f"<body><article><h1>Untitled</h1><p>{'ab'[i] * 200}</p></article></body>") for i in range(2)]
    want |= {900 + i: "Untitled " + "ab"[i] * 200 for i in range(2)}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 7):  # blocks are counted alike whatever pages a task holds
        got = {r["page_id"]: r["text"] for r in extract_main_text(pages.repartition(parts)).collect()}
        assert {i: got[i] for i, t in want.items() if got[i] != t} == {}


def test_block_counts_equal_plain_counts():
    rng = random.Random(6)
    pages = [_walk(p) for p, _ in _site(rng, "notice", 6)]
    seen = {}
    for _, elements, shut, found in pages:
        for e, block in _blocks(found):
            if not shut[e]:
                seen.setdefault(block, []).append(elements[e][1])
    assert [b for b, roles in seen.items() if len(roles) == len(pages)] == ["Share this story with friends"]


HOSTILE = {
    "open quotes": '<a "' * 250_000,
    "open values": '<a x="' * 170_000,
    "nested": "<div class='deep'>" * 50_000 + "x",
    "ends that match nothing": "<div>" * 50_000 + "</section>" * 50_000,
    "open data": "<![CDATA[" * 100_000 + ">",
    "brackets": "<" * 1_000_000,
    "open script": "<script>" + "</script  " * 100_000,
    "long class": "<div class='" + "a" * 1_000_000 + "'>" + "<div>" * 1_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    started = time.process_time()
    roles, elements, outside, found = _walk(HOSTILE[name])
    _, slot = template({r: ((c,), c, 1, size, out) for r, (c, size, out, _) in roles.items()})
    text = slot_text(elements, outside, found, slot)
    assert time.process_time() - started < 4
    assert sum(map(len, roles)) < 320 * (len(roles) + 1)
    assert name != "nested" or text == "x" and len(roles) == 50_001


def test_quotes_count_behind_an_equals_sign_only():
    def text(page):
        _, *rest = _walk(page)
        return slot_text(*rest, "")

    assert text("<p title=don't>it's here</p>") == "it's here"
    assert text("<p title='a > b' x = \"c > d\">kept</p>") == "kept"
    assert text("<p \"a>b</p>") == "b"
    assert text("a < b and <3 <p>c") == "a < b and <3 c"
    assert text("<!-- <p>no</p> --><![CDATA[yes <b>]]> <!doctype x>end<!-- open <p>") == "yes <b> end"
    # all brackets after the open value are inside of quotes: it ends at the next one
    assert text("<p x=\"<b>one</b> <i y=\">two") in ("two", "one two")


def test_long_roles_keep_their_parents():
    page = "<body>" + "<div class='a-rather-long-class-name-of-an-element'>" * 30 + "<p>in</p>"
    roles, *_ = _walk(page)
    above = _above(roles)
    assert all(above(r) in roles for r in roles if r)
    tops = [r for r in roles if r]
    assert max(map(len, tops)) <= 256 + 60
    assert template_blocks({}, "", []) == []
