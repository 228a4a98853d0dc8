"""HTML pages as DOM leaf blocks: text runs between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

# fixed values: element names of the HTML standard
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output picture "
    "progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr math svg object".split()
)
HIDDEN = frozenset(
    "head script style noscript template textarea select option iframe audio video canvas title annotation annotation-xml".split()
)
#: elements whose inner elements stand in the line, whatever their names, and those of them that are not shown
FOREIGN = frozenset({"math", "svg"})
FOREIGN_HIDDEN = frozenset("desc metadata defs".split())

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: an opening tag closes an open element of these names, up to the nearest element in the third list
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

#: elements nested deeper than this add nothing to the path of a block
MAX_DEPTH = 512

_TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)"
    r"|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z)))",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|aria-label|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in HIDDEN - {"head", "template", "select", "option", "annotation", "annotation-xml"}}


@dataclass
class Node:
    name: str
    hints: str  # class, id and role, lower case
    hidden: bool
    inline: bool = False


@dataclass
class Block:
    text: str
    path: tuple[Node, ...]
    chars: int
    linked: int


def _hints(rest: str) -> tuple[str, bool]:
    """Class, id and role of a tag, and whether it is hidden."""
    if "=" not in rest and "hidden" not in rest.lower():
        return "", False
    words, hidden = [], False
    for name, *values in _ATTRIBUTE.findall(rest):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
        else:
            words.append(value)
    return " ".join(words), hidden


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; character references decoded, white space made single."""
    out: list[Block] = []
    stack: list[Node] = []
    parts: list[tuple[str, bool]] = []
    links = foreign = 0
    deeper: list[tuple[str, bool]] = []  # elements below the greatest depth: name, hidden
    names_below: Counter = Counter()

    def flush() -> None:
        if parts:
            whole = " ".join("".join(x for x, _ in parts).split())
            if whole:
                linked = sum(len("".join(x.split())) for x, inside in parts if inside)
                path = tuple(n for n in stack if not n.inline)
                out.append(Block(whole, path, len(whole.replace(" ", "")), linked))
            parts.clear()

    def text(raw: str) -> None:
        if raw and not (stack and stack[-1].hidden) and not (deeper and deeper[-1][1]):
            parts.append((html.unescape(raw) if "&" in raw else raw, links > 0))

    def pop(to: int) -> None:
        nonlocal links, foreign
        links -= sum(n.name == "a" for n in stack[to:])
        foreign -= sum(n.name in FOREIGN for n in stack[to:])
        del stack[to:]

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = m["name"].lower()
        if name == "br" or name == "hr":
            if name == "hr":
                flush()
            else:
                text(" ")
            continue
        if m["end"] and deeper:
            if name not in INLINE:
                flush()
            if names_below[name]:
                while True:
                    last, _ = deeper.pop()
                    names_below[last] -= 1
                    if last == name:
                        break
            continue
        if m["end"]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if place is None:
                continue
            if any(not n.inline for n in stack[place:]):
                if name in INLINE:  # a stray end tag does not close the block around it
                    continue
                flush()
            pop(place)
            continue
        if name in _RAW:
            if name not in INLINE and name != "textarea" and not foreign:
                flush()
            end = _RAW[name].search(page, at)
            at = page.find(">", end.end()) + 1 if end else len(page)
            at = at or len(page)
            continue
        inline = name in INLINE or foreign > 0
        if not inline:
            flush()
            if name == "body" and stack and stack[-1].name == "head":
                pop(len(stack) - 1)
            if name not in ("html", "body") and stack and any(n.name == "p" for n in stack):
                place = max(i for i, n in enumerate(stack) if n.name == "p")
                if all(n.inline for n in stack[place + 1 :]):
                    pop(place)
            if name in CLOSES:
                closed, until = CLOSES[name]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name in until:
                        break
                    if stack[i].name in closed:
                        pop(i)
        if name in VOID or m["rest"].endswith("/>") and (foreign or name in FOREIGN):
            continue
        hints, hidden = _hints(m["rest"])
        above = stack[-1].hidden if stack else False
        if deeper:
            above = deeper[-1][1]
        hidden = hidden or name in HIDDEN or above or foreign > 0 and name in FOREIGN_HIDDEN
        if len(stack) >= MAX_DEPTH:
            deeper.append((name, hidden))
            names_below[name] += 1
            continue
        stack.append(Node(name, hints, hidden, inline))
        links += name == "a"
        foreign += name in FOREIGN
    text(page[at:])
    flush()
    return out
