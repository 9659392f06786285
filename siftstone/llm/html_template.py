"""Main text of web pages by equivalence-class template deduction.

Elements of all pages of a host are differentiated by their role: the path of block elements above them with their classes and ids, digits left out. Over the
host's pages every role has an occurrence vector. Roles with the same vector form an equivalence class. A class that reaches enough pages is
valid when the roles directly above its members lie in one other class (or in itself), so that valid classes nest into the host's template.
What the template leaves open are its slots; the main slot is found by descending from the body into the once-per-page container that holds all
of the open text but what is equal on the host's pages, past roles that are menus, forms or notices by name. Text blocks are tokens too: a block that
stands exactly once on every page that has its role belongs to the template, not to the slot around it. A page's text is what its main slot holds besides.

Vectors are compared by two order-free fingerprints summed over pages, texts by the least and the greatest fingerprint, so a host of any size costs one row per role and task before the shuffle, and
a template holds only roles and blocks that at least half the host's pages share. A task ships a block only if all pages of its batch that have the block's role
hold it, which loses none and leaves little but template text of hosts with several pages in a batch.

A page is read in time linear in its length, whatever its quotes, brackets and nesting: a quote counts only behind ``=`` and only if it is closed, and from
the first tag on whose quotes hide every further ``>``, tags end at the next ``>``.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.words import blocks
from siftstone.plans.skew import durable

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+))")
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: fixed values of HTML: elements without content, elements whose content is no markup, elements within a line
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl li dt dd tr td th thead tbody tfoot caption figure figcaption hr".split())
#: elements, attribute words and landmark roles that hold no main text
OUTSIDE = frozenset("head nav header footer aside form script style noscript template iframe svg button select option textarea title dialog menu object canvas audio video".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe signup menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead comment comments respond disqus social share sharing "
    "related recommended pagination pager widget toolbar login search".split()
)
#: elements that are never outside by their name, and those of them that an element left open above does not put outside either
CORE, OUTER = frozenset("html body main article".split()), frozenset("html body main".split())
#: all that a head can hold; anything else ends one that is left open
HEAD = frozenset("base basefont bgsound link meta title script style noscript template".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

SHARE = 0.5  # of a host's pages a template role occurs on
MOST = 0.5  # of a page's text above which an element is not outside by its name
FEW = 3  # pages below which equal text is no evidence of a template
LONG = 256  # characters of a role or name above which its hash stands for it


def _short(name: str) -> str:
    return f"~{xxhash.xxh64_hexdigest(name)}" if len(name) > LONG else name


def _named(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Role name of an element, whether it holds no main text by its tag, and whether it seems to hold none by its attributes (or as a form)."""
    hard, soft = tag in OUTSIDE and tag != "form", tag == "form"
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return tag, hard, soft
    name = tag
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            name += ("." if key == "class" else "#") + re.sub(r"\d+", "", " ".join(sorted(value.split())))
            soft = soft or any(w.lower() in OUTSIDE_WORDS for w in _WORD.findall(value))
        elif key == "role":
            soft = soft or value.lower() in OUTSIDE_ROLES
        elif key == "hidden":
            soft = True
    name = name.replace("/", "|")
    return name if len(name) <= LONG else f"{tag}.{_short(name)}", hard, soft and tag not in CORE


def _parse(page: str) -> tuple[list[tuple[str, str, int, bool, bool]], list[tuple[int, str]]]:
    """Elements of a page as (tag, role, element above, outside by tag, outside by name), the first being the page, and its text as (element, text); a break is empty."""
    elements: list[tuple[str, str, int, bool, bool]] = [("", "", -1, False, False)]
    pieces: list[tuple[int, str]] = []
    stack = [0]
    opened: Counter[str] = Counter()  # elements on the stack by tag
    at, n = 0, len(page)

    def leave() -> None:
        opened[elements[stack.pop()][0]] -= 1

    def say(text: str) -> None:
        if text:
            if elements[stack[-1]][0] == "head" and text.strip():
                leave()
            pieces.append((stack[-1], text))

    last, last_cdata, plain = page.rfind(">"), page.rfind("]]>"), False
    begin = 0
    while m := _OPEN.search(page, at):
        at = m.end()
        tag, data = m["tag"], ""
        if m[0] == "<!--":
            end = page.find("-->", at)
            end = end + 3 if end >= 0 else n
        elif m[0] == "<![CDATA[" and at <= last_cdata:
            end = page.find("]]>", at) + 3
            data = page[at : end - 3]
        elif at > last:
            continue
        else:
            rest = _REST.match(page, at) if tag and not plain else None
            plain = plain or bool(tag) and rest is None
            end = rest.end() if rest else page.find(">", at) + 1
        say(page[begin : m.start()])
        attrs = page[at : end - 1]
        begin = at = end
        if tag is None:
            say(data)
            continue
        tag = tag.lower()
        if m["end"]:
            if tag not in INLINE:
                pieces.append((stack[-1], ""))
                if opened[tag]:
                    while elements[stack[-1]][0] != tag:
                        leave()
                    leave()
            continue
        if elements[stack[-1]][0] == "head" and tag not in HEAD:
            leave()
        if tag == "body" and opened["head"]:
            while elements[stack[-1]][0] != "head":
                leave()
            leave()
        if tag in INLINE:
            continue
        pieces.append((stack[-1], ""))
        if tag in VOID:
            continue
        top = elements[stack[-1]][0]
        if tag in PARAGRAPH and top == "p" or tag in ("li", "dt", "dd", "tr", "td", "th") and top == tag:
            leave()
        name, hard, soft = _named(tag, attrs)
        elements.append((tag, f"{_short(elements[stack[-1]][1])}/{name}", stack[-1], hard, soft))
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
            begin = at = close.end() if close else n
            continue
        stack.append(len(elements) - 1)
        opened[tag] += 1
    say(page[begin:])
    return elements, pieces


def walk(page: str, opened: frozenset[str] | set[str] = frozenset()) -> tuple[dict[str, list[int]], list[tuple[str, bool, str]]]:
    """Roles of a page as role: [occurrences, open text below, named as outside], and its text pieces as (role, outside, text); a break is an empty piece."""
    roles, elements, outside, found = _walk(page, opened)
    return {r: v[:3] for r, v in roles.items() if r}, [(elements[e][1], outside[e], text) for e, text in found]


def _walk(page: str, opened: frozenset[str] | set[str] = frozenset()) -> tuple[dict[str, list[int]], list[tuple], list[bool], list[tuple[int, str]]]:
    """Roles as of :func:`walk` with a fingerprint of the open text below each, "" as the role of a page that holds anything; elements, which are outside, pieces.

    A name does not put an element outside that holds a main element or more than MOST of the page's text, nor one whose role is in ``opened``.
    """
    elements, found = _parse(page)
    n = len(elements)
    own, print_ = [0] * n, [0] * n
    main = [e[0] == "main" for e in elements]
    for e, text in found:
        if text := text.strip():
            own[e] += len(text)
            print_[e] += xxhash.xxh64_intdigest(text)
    size, shut = own[:], [False] * n  # text below, and whether a tag closes it
    for e in range(1, n):
        tag, _, above, hard, _ = elements[e]
        shut[e] = tag not in OUTER and (hard or shut[above])
        if shut[e]:
            size[e] = 0
    for e in range(n - 1, 0, -1):
        above = elements[e][2]
        size[above] += size[e]
        main[above] = main[above] or main[e]
    outside = [False] * n
    for e in range(1, n):
        tag, role, above, hard, soft = elements[e]
        named = soft and not main[e] and size[e] <= MOST * size[0] and role not in opened
        outside[e] = tag not in OUTER and (hard or named or outside[above])
    below = [0 if out else x for x, out in zip(own, outside, strict=True)]
    print_ = [0 if out else x for x, out in zip(print_, outside, strict=True)]
    for e in range(n - 1, 0, -1):
        below[elements[e][2]] += below[e]
        print_[elements[e][2]] += print_[e]
    roles: dict[str, list[int]] = {}
    for e in range(0 if n > 1 or own[0] else 1, n):
        entry = roles.setdefault(elements[e][1], [0, 0, int(outside[e]), 0])
        entry[0] += 1
        entry[1] += below[e]
        entry[2] = min(entry[2], int(outside[e]))
        entry[3] = entry[3] + print_[e] & 0x7FFFFFFFFFFFFFFF
    return roles, elements, outside, found


def _blocks(found: list[tuple[int, str]]) -> Iterator[tuple[int, str]]:
    """Text blocks as (element, text): the pieces between two breaks, white space as one space."""
    at, parts = 0, []
    for e, text in [*found, (0, "")]:
        if text:
            at = e
            parts.append(text)
        elif parts:
            if block := " ".join("".join(parts).split()):
                yield at, block
            parts = []


def _block_code(role: str, block: str) -> int:
    return xxhash.xxh64_intdigest(f"{role}\n{block}") & 0x7FFFFFFFFFFFFFFF


def _tag(role: str) -> str:
    return role.rpartition("/")[2].partition(".")[0].partition("#")[0]


def _above(roles: Iterable[str]) -> Callable[[str], str]:
    """Role of the element above a role."""
    longer = {_short(r): r for r in roles if len(r) > LONG}

    def above(role: str) -> str:
        name = role.rpartition("/")[0]
        return longer.get(name, name)

    return above


def template(roles: dict[str, tuple]) -> tuple[set[str], str]:
    """Template roles and main slot of roles given as role: (vector, occurrences, pages, open text, outside[, text below equal on all pages])."""
    classes: dict[tuple, list[str]] = {}
    for role, (vector, *_) in roles.items():
        classes.setdefault(vector, []).append(role)
    above = _above(roles)
    below: dict[str, list[str]] = {}
    for role in roles:
        if role:
            below.setdefault(above(role), []).append(role)
    valid: set[str] = set()
    for vector, members in classes.items():
        parents = {roles[above(m)][0] for m in members if above(m) in roles} - {vector}
        if len(parents) <= 1:
            valid.update(members)
    slot = next((r for r in sorted(roles, key=len) if _tag(r) == "body"), "")
    same = lambda r: len(roles[r]) > 5 and roles[r][5]
    while True:
        inside = [r for r in below.get(slot, ()) if not roles[r][4]]
        down = [r for r in inside if r in valid and roles[r][1] == roles[r][2] and _tag(r) not in PARAGRAPH]
        best = max(down, key=lambda r: (roles[r][3], r), default=None)
        # what is equal on all pages is the template's, unless all of the slot is
        open_text = roles[slot][3] if slot in roles else sum(roles[r][3] for r in inside)
        if slot not in roles or not same(slot):
            open_text -= sum(roles[r][3] for r in inside if r in valid and r != best and same(r))
        if best is None or roles[best][3] < max(1, open_text):
            return valid, slot
        slot = best


def main_text(pieces: list[tuple[str, bool, str]], slot: str) -> str:
    """Text of the pieces inside a slot, references decoded, blocks joined by one space."""
    out = []
    for role, outside, text in pieces:
        if not text:
            out.append(" ")
        elif not outside and (role == slot or role.startswith(slot + "/") or not slot):
            out.append(entities.unescape(text))
    return " ".join("".join(out).split())


def slot_text(elements: list[tuple], outside: list[bool], found: list[tuple[int, str]], slot: str, fixed: frozenset[int] | set[int] = frozenset()) -> str:
    """Text below the slot's elements but for outside elements and the blocks of the template."""
    inside = [not slot] * len(elements)
    for e in range(1, len(elements)):
        inside[e] = inside[e] or elements[e][1] == slot or inside[elements[e][2]]
    kept = [(elements[e][1], outside[e] or not inside[e], text) for e, text in found]
    if fixed:
        start = 0
        for end in [*(n for n, (_, text) in enumerate(found) if not text), len(found)]:
            for e, block in _blocks(found[start:end]):
                if _block_code(elements[e][1], block) in fixed:
                    kept[start:end] = [(role, True, text) for role, _, text in kept[start:end]]
            start = end
    return main_text(kept, "")


def _role_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[tuple[str | None, str], list[int]] = {}
        texts: dict[tuple[str | None, str], tuple[int, int]] = {}
        tokens: dict[tuple[str | None, str, int], list[int]] = {}
        for key, host, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            mark = xxhash.xxh64_intdigest(str(key))
            roles, elements, shut, pieces = _walk(page or "")
            for role, (count, size, outside, text) in roles.items():
                s = found.setdefault((host, role), [0] * 6)
                for i, v in enumerate((1, count, size, (mark & 0x7FFFFFFF) * count, (mark >> 33) * count, outside)):
                    s[i] += v
                low, high = texts.get((host, role), (text, text))
                texts[host, role] = min(low, text), max(high, text)
            held: dict[tuple[str, int], list[int]] = {}
            for e, block in _blocks(pieces):
                if not shut[e]:
                    role = elements[e][1]
                    held.setdefault((role, _block_code(role, block)), []).append(len(block))
            for (role, code), sizes in held.items():
                if len(sizes) == 1:
                    s = tokens.setdefault((host, role, code), [0, 0])
                    s[0], s[1] = s[0] + 1, s[1] + sizes[0]
        rows = [(*k, 0, *v, *texts[k]) for k, v in found.items()]
        # a block of the template stands on every page of its role, so on all of this batch
        for (host, role, code), (pages, size) in tokens.items():
            if pages == found[host, role][0]:
                rows.append((host, role, code, pages, pages, size, 0, 0, 0, 0, 0))
        cols = list(zip(*rows, strict=True)) or [[]] * 11
        types = [pa.string(), pa.string(), *[pa.int64()] * 9]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["host", "role", "block", "pages", "occurs", "open", "f1", "f2", "outside", "low", "high"])


def template_blocks(roles: dict[str, tuple], slot: str, tokens: list[tuple[str, int, int, int]]) -> list[int]:
    """Codes of the template's text blocks out of (role, code, pages, size): those on every page that has their role, on at least FEW pages.

    None where these blocks are half of the slot's text or more: such pages are copies of one another, not fillings of a template.
    """
    every = [(role, code, size) for role, code, pages, size in tokens if role in roles and pages >= FEW and pages == roles[role][2]]
    above, inside = _above(roles), {slot: True, "": not slot}

    def below_slot(role: str) -> bool:
        path = []
        while role not in inside:
            path.append(role)
            role = above(role)
        inside.update(dict.fromkeys(path, inside[role]))
        return inside[role]

    equal = sum(size for role, _, size in every if below_slot(role) and not roles[role][4])
    return [] if 2 * equal >= (roles[slot][3] if slot in roles else 0) else sorted(code for _, code, _ in every)


def _deduce_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots, kept, opened, fixed = [], [], [], []
        for found in batch.column(1).to_pylist():
            rows = [r for r in found if not r["block"]]
            # a role is outside where at least half of its pages have it so; where fewer have, all pages are read with it open
            out = {r["role"]: 2 * r["outside"] >= r["pages"] for r in rows}
            given = {
                r["role"]: ((r["pages"], r["f1"], r["f2"]), r["occurs"], r["pages"], r["open"], out[r["role"]], r["pages"] > 1 and r["low"] == r["high"]) for r in rows
            }
            valid, slot = template(given)
            slots.append(slot)
            kept.append(sorted(valid))
            opened.append(sorted({r["role"] for r in rows if r["outside"] and not out[r["role"]]} | {slot}))
            fixed.append(template_blocks(given, slot, [(r["role"], r["block"], r["pages"], r["open"]) for r in found if r["block"]]))
        lists = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(slots, pa.string()), pa.array(kept, lists), pa.array(opened, lists), pa.array(fixed, pa.list_(pa.int64()))],
            ["host", "slot", "roles", "opened", "fixed"],
        )


def _extract_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch, "html"):
            texts, slots = [], []
            for page, slot, opened, fixed in zip(*(part.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                roles, *rest = _walk(page or "", frozenset(opened or ()))
                if not slot or slot not in roles:
                    # no template of the host fits: the page's own roles are all there is
                    roles, *rest = _walk(page or "")
                    slot = template({r: ((c,), c, 1, size, out) for r, (c, size, out, _) in roles.items()})[1]
                texts.append(slot_text(*rest, slot, frozenset(fixed or ())))
                slots.append(slot)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(slots, pa.string())], ["page_id", "url", "text", "slot"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, slot, roles, opened, fixed) of every host with at least two pages; ``pages`` has page_id, url, html."""
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), host_of(F.col("url")).alias("host"), "html")
    found = rows.mapInArrow(_role_task, "host string, role string, block long, pages long, occurs long, open long, f1 long, f2 long, outside long, low long, high long")
    sums = [F.sum(c).alias(c) for c in ("pages", "occurs", "open", "f1", "f2", "outside")]
    roles = durable(found.groupBy("host", "role", "block").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high")), "roles")
    total = roles.groupBy("host").agg(F.max("pages").alias("most")).where("most > 1")
    common = roles.join(total, "host").where(F.col("pages") >= F.col("most") * share)
    # a host's template has no more roles than pages have on average, divided by the share
    sets = common.groupBy("host").agg(F.collect_list(F.struct("role", "block", "pages", "occurs", "open", "f1", "f2", "outside", "low", "high")).alias("found"))
    return durable(sets.mapInArrow(_deduce_task, "host string, slot string, roles array<string>, opened array<string>, fixed array<bigint>"), "templates")


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, slot (role of the main slot): one row per page.

    Null or empty html gives an empty text. Pages without a usable url form one host; a host with one page, or a page its host's template does not
    fit, is read by its own roles. Text that stands once on all pages with its role is the template's and left out, also inside an article. Repeated rows and null ids are kept as rows. Unclosed elements end with the element around them. Other
    columns are ignored; an empty table gives no rows.
    """
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    slots = templates(narrow).select("host", "slot", "opened", "fixed")
    # Spark broadcasts the slots while their written size is small and otherwise shuffles, splitting hot hosts
    rows = narrow.withColumn("__host", host_of(F.col("url"))).join(slots, F.col("__host") == F.col("host"), "left").select("page_id", "url", "html", "slot", "opened", "fixed")
    id_type = narrow.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extract_task, f"page_id {id_type}, url string, text string, slot string")
