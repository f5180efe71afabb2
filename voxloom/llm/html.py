"""HTML to leaf blocks: the texts between block-level tags, with their tag paths.

Bad markup never fails: stray end tags are ignored, unclosed elements end with their
parents, an unfinished tag at the end is dropped. Character references are decoded, white
space within a block becomes one space. Comments, scripts, styles and form controls hold
no text. Raw text elements without an end tag reach to the end of the page, as in browsers;
buttons and the like without one reach to the next block-level tag, so that one slip in a
header does not silence an article.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

#: Fixed values of HTML: elements within a line, without content, of no text, and ended by their like.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe noembed noframes xmp".split())
SILENT = frozenset("template noscript svg canvas object select button".split())
SELF_ENDING = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div main aside nav header footer form blockquote td th".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters within links


@lru_cache(1 << 14)
def _element(tag: str, attributes: str) -> str:
    """The tag with the words of its class, id and role."""
    names = [x for m in _NAME.finditer(attributes) for x in _PART.findall(next(g for g in m.groups() if g is not None))]
    return " ".join([tag, *dict.fromkeys("." + x.lower() for x in names)])


BLOCK_LEVEL = SCOPES | ENDS_P | SELF_ENDING.keys() - {"option"}


def _marks(html: str):
    """The tags of the page, as (start, end, name, closing, attributes); comments and raw text
    elements, to their end, have no name."""
    pos = 0
    while m := _MARK.search(html, pos):
        tag, closing, pos = (m[2] or "").lower(), bool(m[1]), m.end()
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                e = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
                pos = e.end() if e else len(html)
            tag = " " if tag not in ("script", "style") else ""
        yield m.start(), pos, tag, closing, m[3]


def _silent_ends(marks: list) -> dict[int, int]:
    """Of each opening silent element, the mark that its silence goes up to."""
    ends, open_ = {}, {t: [] for t in SILENT}
    for k, (_, _, tag, closing, attributes) in enumerate(marks):
        if tag in SILENT:
            if not closing and not attributes.endswith("/"):
                open_[tag].append(k)
            elif closing and open_[tag]:
                ends[open_[tag].pop()] = k
    unclosed = sorted((k for ks in open_.values() for k in ks), reverse=True)
    if unclosed:
        following = len(marks)
        for k in range(len(marks) - 1, -1, -1):
            if unclosed and unclosed[0] == k:
                ends[unclosed.pop(0)] = following
            if marks[k][2] in BLOCK_LEVEL:
                following = k
    return ends


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    linked, in_link, pos = 0, 0, 0

    def end_block():
        nonlocal linked, held
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append(Block(tuple(e for _, e in stack), text, min(linked, len(text))))
            held = []
        linked = 0

    marks = list(_marks(html))
    silent = _silent_ends(marks)
    until = -1  # the mark up to which text is silent
    for k, (start, end, tag, closing, attributes) in enumerate(marks):
        if start > pos and k > until:
            piece = html[pos:start]
            held.append(piece)
            if in_link:
                linked += len(piece.strip())
        pos = end
        if k < until:
            continue
        if tag in SILENT or tag == " " or tag == "br":
            held.append(" ")
            if k in silent:
                until = silent[k]
            continue
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        end_block()
        if tag in VOID:
            continue
        if closing:
            for j in range(len(stack) - 1, -1, -1):
                if stack[j][0] == tag:
                    del stack[j:]
                    break
                if tag not in SCOPES and stack[j][0] in SCOPES:
                    break
        else:
            ends = SELF_ENDING.get(tag, {"p"} if tag in ENDS_P else ())
            while stack and stack[-1][0] in ends:
                stack.pop()
            stack.append((tag, _element(tag, attributes)))
            in_link = 0
    if pos < len(html) and until < len(marks):
        held.append(html[pos:])
    end_block()
    return out
