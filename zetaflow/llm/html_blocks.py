"""Leaf blocks of an HTML page: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())  # their content isn't markup
SKIPPED = frozenset("noscript template iframe svg math select datalist object head".split())  # markup that isn't shown as text
INLINE = frozenset("br a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr".split())  # they break no block
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SECTIONS = frozenset("article aside body footer form header main nav section".split())
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"), "td": ("tr", "table"), "th": ("tr", "table")}

#: Ancestors of a block that its features look at; text is kept at any depth.
LEVELS = 64

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "path", "names", "link", "near")

    def __init__(self, text: str, path: tuple, names: tuple, link: int, near: str):
        self.text, self.path, self.names, self.link, self.near = text, path, names, link, near


def _tags(page: str) -> list[tuple]:
    """(start, end, name, whether it closes, attributes) of every tag in page order; comments and declarations have no
    name, and the content of scripts and the like belongs to their tag. Positions only move forward, and what isn't
    there is looked for once, so the time is linear in the page."""
    end, at = len(page), 0
    out: list[tuple] = []
    ahead: dict[str, int] = {}
    never: set[str] = set()

    def find(what: str, start: int) -> int:
        got = ahead.get(what, -1)
        if got < start:
            got = page.find(what, start)
            ahead[what] = got = end if got < 0 else got
        return got

    while m := _OPEN.search(page, at):
        start = m.start()
        if page[start + 1] in "!?":
            if page.startswith("<!--", start):
                at = min(end, find("-->", start + 4) + 3)
            else:
                at = min(end, find(">", start) + 1)
            out.append((start, at, "", False, ""))
            continue
        closing = page[start + 1] == "/"
        name = _NAME.match(page, start + 1 + closing)
        i = find_from = name.end()
        if find(">", i) == end:
            break  # no tag ends any more: the rest is text
        while i < end:
            i = min(find(">", i), find('"', i), find("'", i))
            if i == end or page[i] == ">":
                break
            close = find(page[i], i + 1)
            i = i + 1 if close == end else close + 1  # a quote that stays open is a character like others
        if i >= end:  # its last '>' is inside quotes
            i = page.find(">", find_from)
        tag, at = name[0].lower(), i + 1
        attributes = page[find_from:i]
        if tag in RAW and not closing and tag not in never:
            close = _RAW_END[tag].search(page, at)
            if close:
                at = min(end, find(">", close.end()) + 1)
            elif tag in ("script", "style"):
                at = end
            else:
                never.add(tag)
        out.append((start, at, tag, closing, attributes))
    return out


def _skips(tags: list[tuple]) -> dict[int, int]:
    """For each start tag of a skipped element that is closed, the number of its end tag; nested ones are paired."""
    open_: dict[str, list[int]] = {}
    out = {}
    for k, (_, _, tag, closing, attributes) in enumerate(tags):
        if tag in SKIPPED:
            if not closing and not attributes.endswith("/"):
                open_.setdefault(tag, []).append(k)
            elif closing and open_.get(tag):
                out[open_[tag].pop()] = k
    return out


def blocks(page: str) -> list[Block]:
    """Non-empty blocks in page order. Character references are decoded, white space is one space, ends are trimmed.

    Text inside skipped elements, options, scripts, styles, comments and titles is no text. An element that is never
    closed ends with the page, but hides nothing; only an open comment, script or style swallows the rest, as in
    browsers.
    """
    out: list[Block] = []
    stack: list[tuple] = [((), (), "-", "", 0)]  # (path, names, nearest meaning, tag, open links before)
    places: dict[str, list[int]] = {}  # tag -> where it is open
    parts: list[str] = []
    link = links = at = 0
    muted = False

    def flush() -> None:
        nonlocal link
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path, names, near, _, _ = stack[-1]
                out.append(Block(text, path, names, link, near))
            parts.clear()
        link = 0

    def pop_to(i: int) -> None:
        nonlocal links
        links = stack[i][4]
        while len(stack) > i:
            places[stack.pop()[3]].pop()

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    tags = _tags(page)
    skips = _skips(tags)
    k = 0
    while k <= len(tags):
        start = tags[k][0] if k < len(tags) else len(page)
        if start > at and not muted:
            parts.append(page[at:start])
            link += (start - at) * bool(links)
        if k == len(tags):
            break
        _, at, tag, closing, attributes = tags[k]
        if k in skips:
            k = skips[k]
            at = tags[k][1]
        k += 1
        if not tag:
            continue
        muted = tag in ("option", "optgroup") and not closing
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = max(stack[-1][4], links - 1) if closing else links + 1
            continue
        if tag in RAW or tag in SKIPPED or tag in ("option", "optgroup"):
            if tag == "head":
                flush()
            else:
                parts.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if last(tag):
                pop_to(last(tag))
            continue
        if tag in CLOSES_P and stack[-1][3] == "p":
            pop_to(len(stack) - 1)
        if tag in SIBLINGS and last(tag) > max(map(last, SIBLINGS[tag])):
            pop_to(last(tag))
        names = tuple(dict.fromkeys(x for g in _NAMES.findall(attributes) for x in _TOKEN.findall("".join(g).lower()))) if attributes else ()
        path, above, near, _, _ = stack[-1]
        places.setdefault(tag, []).append(len(stack))
        stack.append(((*path, tag)[-LEVELS:], (*above, *names)[-LEVELS:], names[0] if names else tag if tag in SECTIONS else near, tag, links))
    flush()
    return out


def features(block: Block, index: int, count: int) -> list[str]:
    """Names of the binary features of a block."""
    text = block.text
    words = text.count(" ") + 1
    parent = block.path[-1] if block.path else "-"
    got = ["one", f"parent={parent}", f"words={min(8, words.bit_length())}", f"parent={parent},words={min(8, words.bit_length())}"]
    got += {f"under={t}" for t in block.path} | {f"named={n}" for n in block.names}
    got += [f"near={block.near}", f"near={block.near},parent={parent}"]
    got.append(f"link={min(4, 4 * block.link // max(1, len(text)))}")
    got.append(f"end={text[-1] if text[-1] in '.!?:;,' else 'x'}")
    got.append(f"commas={min(3, text.count(','))}")
    got.append(f"stops={min(3, text.count('. '))}")
    if "©" in text or "(c)" in text:
        got.append("rights")
    if index == 0 or index == count - 1:
        got.append("first" if index == 0 else "last")
    return got
