"""HTML to blocks: leaf texts in page order, each with the names along its tag path."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple
from zlib import crc32

#: Element names by the role they play here.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "canvas math mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover object semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg annotation annotation-xml noembed noframes xmp".split())
#: Raw elements that a slash before the tag's end closes; HTML ignores it on the others.
FOREIGN = frozenset("svg annotation annotation-xml".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside body div footer form main nav ol section table td th ul".split())

#: A quoted value begins after an equals sign only, and its end is followed by the end of the attribute; other quotes are just characters.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+"[^"]*+"(?=[\s/>])|=\s*+'[^']*+'(?=[\s/>])|[^>])*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/!?][^>]*\Z""", re.S
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")
#: Names are hashed to so many numbers; paths of more than DEEP elements are kept as how often each number is there.
NAMES, DEEP = 1_024, 48


class Block(NamedTuple):
    path: tuple[str, ...] | tuple[int, ...]  # names, or their numbers where ``counts`` are given
    text: str
    linked: int  # characters inside links
    counts: tuple[int, ...] = ()


def number_of(name: str) -> int:
    return crc32(name.encode("utf-8", "surrogatepass")) % NAMES


def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the words of its class, id and role."""
    if not attributes:
        return (tag,)
    found = [tag]
    for match in NAMED.finditer(attributes):
        found += ["." + word for word in PART.findall((match[2] or match[3] or match[4] or "").lower())]
    return tuple(found)


def blocks(html: str | None) -> list[Block]:
    """Blocks of a page.  Tags that don't break a line leave their text in its block; comments and raw elements are dropped.
    Formulas and what stands in for objects and canvases are text; annotations of formulas, which aren't shown, are raw.

    Forgiving as browsers are: a new block ends an open paragraph, a new item its sibling, a stray end tag is ignored,
    and a tag, comment or raw element that the page's end cuts off is dropped.  A quote that doesn't enclose a value swallows nothing.
    """
    page, out = html or "", []
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_: Counter[str] = Counter()  # elements of the stack by name: what isn't there needn't be looked for
    inside: Counter[int] = Counter()  # numbers of the names along the stack
    held: list[str] = []
    links, linked, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                if len(stack) <= DEEP:
                    out.append(Block(tuple(n for _, names in stack for n in names), text, linked))
                else:
                    counted = {n: c for n, c in inside.items() if c}
                    out.append(Block(tuple(counted), text, linked, tuple(counted.values())))
            held.clear()
        linked = 0

    def pop_to(index: int) -> None:
        nonlocal links
        flush()
        gone = Counter(name for name, _ in stack[index:])
        links -= gone["a"]
        open_.subtract(gone)
        inside.subtract(number_of(n) for _, names in stack[index:] for n in names)
        del stack[index:]

    while True:
        token = TOKEN.search(page, at)
        piece = page[at : token.start()] if token else page[at:]
        if piece:
            held.append(piece)
            if links:
                linked += len(piece)
        if not token:
            break
        at = token.end()
        tag = token[2]
        if tag is None:
            continue
        tag = tag.lower()
        if token[1]:
            for index in range(len(stack) - 1 if open_[tag] else -1, -1, -1):
                if stack[index][0] == tag:
                    if tag in INLINE:
                        links -= tag == "a"
                        open_[tag] -= 1
                        inside.subtract(map(number_of, stack[index][1]))
                        del stack[index]
                    else:
                        pop_to(index)
                    break
                if tag in INLINE and stack[index][0] not in INLINE or stack[index][0] in SCOPES and tag not in SCOPES and tag not in ("body", "html"):
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag in FOREIGN and token[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)|\Z", re.I).search(page, at)
            at = end.end()
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE and tag not in ("img", "input"):
                flush()
            continue
        if tag in INLINE:
            links += tag == "a"
        else:
            flush()
            enders = SIBLINGS.get(tag, ())
            wanted = open_["p"] and tag in CLOSES_P or any(open_[name] for name in enders)
            for index in range(len(stack) - 1 if wanted else -1, -1, -1):
                name = stack[index][0]
                if name == "p" and tag in CLOSES_P or name in enders:
                    pop_to(index)
                    break
                if name in SCOPES:
                    break
        if not token[3].rstrip().endswith("/"):
            stack.append((tag, names_of(tag, token[3])))
            open_[tag] += 1
            inside.update(map(number_of, stack[-1][1]))
        elif tag == "a":
            links -= 1
    flush()
    return out
