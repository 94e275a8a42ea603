"""HTML to leaf blocks: runs of text between block-level tags, with the path of elements above each."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: No text of the page: code, drawings, form controls, and what a browser that runs scripts doesn't show.
RAW = frozenset("script style template textarea title noscript iframe noembed noframes svg select button head annotation annotation-xml".split())
RAW_BLOCKS = frozenset("head title noframes".split())
#: Formulas are text of the sentence that they stand in; so are the words beside a media element's sources.
MATH = "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom menclose merror msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd semantics".split()
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var video wbr img".split()
    + MATH
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: Opening one of these ends an open sibling named in the set, up to the nearest of the stops.
SIBLINGS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
P_STOPS = frozenset("article aside body div section main td th li table form footer header nav blockquote".split())

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE | re.ASCII) for tag in RAW}
_BODY = re.compile(r"<body(?=[\s/>])", re.IGNORECASE | re.ASCII)
#: Elements above a block that are told apart, from the outermost and from the innermost: deeper nesting keeps its text.
PATH_ENDS = 64


@dataclass(slots=True)
class Block:
    """One run of text: its words, the elements above it as (tag, names), and how much of it is link text."""

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    link_chars: int


def names_of(attributes: str) -> tuple[str, ...]:
    """Lower-case words in class, id, role and itemprop, with ``hidden`` for elements not shown."""
    if not attributes or attributes.isspace():
        return ()
    out: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("hidden", "aria-hidden"):
            if key == "hidden" or value == "true":
                out.append("hidden")
        elif key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out.append("hidden")
        else:
            out += [x.lower() for x in _PIECES.findall(value)]
    return tuple(dict.fromkeys(out))


def leaf_blocks(html: str) -> list[Block]:
    """Blocks in page order; scripts, styles, comments, form controls and other unseen elements (RAW) give none and
    don't end a block."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    endless: set[str] = set()
    blocks: list[Block] = []
    pieces: list[str] = []
    state = {"links": 0, "path": None}
    anchors = 0

    def flush() -> None:
        if pieces:
            text = _SPACE.sub(" ", unescape("".join(pieces))).strip()
            if text:
                blocks.append(Block(text, state["path"], min(len(text), state["links"])))
            pieces.clear()
        state["links"], state["path"] = 0, None

    def add(text: str) -> None:
        if not text:
            return
        if state["path"] is None and not text.isspace():
            above = stack if len(stack) <= 2 * PATH_ENDS else stack[:PATH_ENDS] + stack[-PATH_ENDS:]
            state["path"] = tuple(x for x in above if x[0] not in INLINE)
        if state["path"] is not None:
            pieces.append(text)
            if anchors:
                state["links"] += len(text)

    def close(i: int) -> None:
        nonlocal anchors
        for tag, _ in stack[i:]:
            opened[tag] -= 1
            anchors -= tag == "a"
        del stack[i:]

    def pop_to(names: frozenset[str], stops: frozenset[str]) -> None:
        if not any(opened[x] for x in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            tag = stack[i][0]
            if tag in names:
                close(i)
                return
            if tag in stops:
                return

    at = 0
    while True:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = m[1] if m[2] else m[4]
        attributes = (m[3] if m[2] else m[6]) or ""
        if tag == "br":
            add(" ")
            continue
        inline = tag in INLINE or (tag in RAW and tag not in RAW_BLOCKS)
        if closing:
            if not inline:
                flush()
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    close(i)
                    break
                if inline and stack[i][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            if tag in RAW_BLOCKS:
                flush()
            if attributes.endswith("/") or tag in endless:
                continue
            end = _ENDS[tag].search(html, at)
            if end is None and tag == "head":
                end = _BODY.search(html, at)
            if end is not None:
                at = end.start()
            elif tag in ("script", "style", "title", "textarea"):
                break
            else:
                endless.add(tag)
            continue
        if not inline:
            flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            pop_to(frozenset(["p"]), P_STOPS)
        elif tag in SIBLINGS:
            pop_to(*SIBLINGS[tag])
        if tag == "a":
            anchors += 1
        opened[tag] += 1
        stack.append((tag, names_of(attributes)))
    flush()
    return blocks
