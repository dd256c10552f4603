"""A small HTML reader: elements with their style paths, and runs of text.

Not a full HTML tree builder: it knows raw text, comments, void elements, implied end
tags of the common elements, and truncated input.  That is what text extraction needs.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass, field

_TAG = re.compile(
    r"<!--(?:(?=-?>)-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>|<(?=[a-zA-Z/!?])[^>]*\Z", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ABOUT = re.compile(r"(?:has|with|without|no|is|hide|show)(?:[-_]|(?=[A-Z]))")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option
    p pre search section select summary table tbody td tfoot th thead title tr ul""".split())
CLOSES_P = BLOCK - frozenset("caption dd dt head html body legend li option optgroup tbody td tfoot th thead title tr".split())
#: Start tags that end an open element of these names, looked for up to the nearest of the second set.
IMPLIED = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"),
           "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
           "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table")}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
#: Levels of a style path; what lies deeper counts as part of its ancestor at this level.
MAX_DEPTH = 48


@dataclass
class Element:
    tag: str
    words: frozenset  # words of class, id and role
    parent: int
    path: str
    depth: int
    children: list = field(default_factory=list)  # names, without repeats next to each other


@dataclass
class Run:
    owner: int  # element
    block: int
    text: str
    link: str | None = None


@dataclass
class Page:
    elements: list
    runs: list


@functools.lru_cache(maxsize=1 << 14)
def _attrs(source: str) -> tuple[str, frozenset, dict]:
    """(name part of the path, words, attributes)"""
    if not source.strip(" /"):
        return "", frozenset(), {}
    found = {m[1].lower(): next((html.unescape(x) for x in m.groups()[1:] if x is not None), "") for m in _ATTR.finditer(source)}
    names = " ".join(found.get(k, "") for k in ("class", "id"))
    style = "".join("." + re.sub(r"\d+", "9", x.lower())[:40] for x in sorted(set(names.split())))
    # "has-sidebar" says what else is on the page, not what the element is
    told = " ".join(n for n in [*names.split(), *found.get("role", "").split()] if not _ABOUT.match(n))
    words = re.split(r"[\W_\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", told).lower())
    return style, frozenset(w for w in words if w), found


def parse(source: str) -> Page:
    elements = [Element("#root", frozenset(), -1, "", 0)]
    runs: list[Run] = []
    stack, block, at, n = [0], 0, 0, len(source)

    def text(value: str) -> None:
        if value:
            runs.append(Run(stack[-1], block, html.unescape(value)))

    def close_to(k: int) -> None:
        nonlocal block
        if any(elements[i].tag in BLOCK for i in stack[k:]):
            block += 1
        del stack[k:]

    while at < n:
        m = _TAG.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at:m.start()])
        at = m.end()
        if name := m["end"]:
            name = name.lower()
            for k in range(len(stack) - 1, 0, -1):
                if elements[stack[k]].tag == name:
                    close_to(k)
                    break
            else:
                if name == "br" and runs:
                    text(" ")
        elif name := m["start"]:
            name = name.lower()
            style, words, attrs = _attrs(m["attrs"])
            if name in CLOSES_P or name in IMPLIED:
                ends, stop = IMPLIED.get(name, (frozenset(), frozenset()))
                for k in range(len(stack) - 1, 0, -1):
                    tag = elements[stack[k]].tag
                    if tag in ends or (tag == "p" and name in CLOSES_P):
                        close_to(k)
                        if not tag == "p" and name != "tr" and not name.startswith("t"):
                            break
                    elif tag in stop or (tag in BLOCK and name not in IMPLIED):
                        break
            parent = elements[stack[-1]]
            label = name + style
            if not parent.children or parent.children[-1] != label:
                parent.children.append(label)
            deep = parent.depth >= MAX_DEPTH
            elements.append(Element(name, words, stack[-1], parent.path if deep else f"{parent.path}/{label}",
                                    parent.depth if deep else parent.depth + 1))
            me = len(elements) - 1
            if name in BLOCK:
                block += 1
            link = attrs.get("href") or attrs.get("src")
            if link and name in ("a", "img"):
                runs.append(Run(me, block, "", link))
            if name == "br":
                text(" ")
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
            elif name not in VOID:
                stack.append(me)
    return Page(elements, runs)


def squeeze(text: str) -> str:
    return _SPACE.sub(" ", text).strip()
