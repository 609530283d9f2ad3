"""Text blocks of a page with the zone of markup they stand in."""

from __future__ import annotations

import re
from html import unescape

import xxhash

RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NOISE_TAGS = frozenset("nav aside form footer header menu dialog head button fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog menu menubar form alert".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments comentarios kommentare disqus consent cookie cookies footer gdpr header login masthead menu modal "
    "nav navbar navigation newsletter notice notices notification pagination pager paywall popup promo promoted promotion recommended related replies share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_SPLIT = re.compile(r"[\s_-]+")
_QUOTE = re.compile(r"[\"'>]")

BODY, NOISE, ARTICLE = 0, 1, 2


def _tag_end(html: str, at: int, last: int) -> int:
    """Where the tag that opens at `at` ends; quotes hide a >, unless they are never closed."""
    k = at
    while True:
        m = _QUOTE.search(html, k, last + 1)
        if m is None:
            return html.find(">", at)
        if m[0] == ">":
            return m.start()
        k = html.find(m[0], m.end())
        if k < 0:
            return html.find(">", at)
        k += 1


def zone_of(tag: str, inside: str, above: int) -> int:
    """The zone below a tag; noise inside noise stays noise."""
    if above == NOISE or tag in NOISE_TAGS and not (tag == "header" and above == ARTICLE):
        return NOISE
    if "=" in inside:
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(inside)}
        role = values.get("role", "").lower()
        if role in NOISE_ROLES or values.get("aria-hidden", "").lower() == "true":
            return NOISE
        words = set(_SPLIT.split(f"{values.get('class', '')} {values.get('id', '')}".lower()))
        if above == ARTICLE:
            words.discard("header")  # an article's own head holds its title
        if tag not in ("html", "body", "article", "main") and NOISE_WORDS & words:
            return NOISE
        if tag == "article" and {"comment", "comments", "reply"} & set(_SPLIT.split(values.get("class", "").lower())):
            return NOISE
        if role in ("main", "article"):
            return ARTICLE
    return ARTICLE if tag in ("article", "main") else above


def blocks(html: str) -> list[tuple[str, int]]:
    """(text, zone) of each block in page order: references decoded, white space runs as one space, never empty."""
    return [(text, zone) for text, zone, _ in placed_blocks(html)]


def place_below(tag: str, inside: str, above: tuple[int, str]) -> tuple[int, str]:
    """(hash of the block tags and their classes from the root, last tag); inline tags and repeats of a tag add nothing."""
    if tag in INLINE or tag in ("html", "body"):
        return above
    named = next((m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(inside) if m[1].lower() == "class"), "") if "=" in inside else ""
    own = f"{tag}.{named.lower()}"
    return above if own == above[1] else (xxhash.xxh3_64_intdigest(f"{above[0]} {own}"), own)


def placed_blocks(html: str) -> list[tuple[str, int, int]]:
    """(text, zone, place) of each block; the place is a hash of the markup that it stands in.

    A tag that is never closed by > ends the page; an unclosed comment does too.
    """
    out: list[tuple[str, int, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int, tuple[int, str]]] = [("", BODY, (0, ""))]
    last = html.rfind(">")

    def flush() -> None:
        if text:
            t = " ".join(unescape("".join(text)).split())
            if t:
                out.append((t, stack[-1][1], stack[-1][2][0]))
            text.clear()

    at = 0
    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            text.append(html[at:])
            break
        if lt > at:
            text.append(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = len(html) if end < 0 else end + 3
            continue
        head = html[lt + 1 : lt + 2]
        if not (head.isalpha() and head.isascii() or head in ("/", "!", "?")):
            text.append("<")
            at = lt + 1
            continue
        end = _tag_end(html, lt + 1, last) if lt < last else -1
        if end < 0:
            break
        inside, at = html[lt + 1 : end], end + 1
        m = _NAME.match(inside)
        if not m:
            continue
        tag = m[1].lower()
        closing = inside.startswith("/")
        if tag in RAW and not closing:
            if tag not in INLINE:
                flush()
            if not inside.endswith("/"):
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                at = len(html) if close is None else max(html.find(">", close.end()) + 1, close.end())
            continue
        if tag not in INLINE:
            flush()
        if closing:
            k = len(stack) - 1
            while k and stack[k][0] != tag:
                k -= 1
            if k:
                if any(stack[j][1] != stack[k - 1][1] for j in range(k, len(stack))):
                    flush()
                del stack[k:]
        elif tag not in VOID and not inside.endswith("/"):
            zone = zone_of(tag, inside, stack[-1][1])
            if zone != stack[-1][1]:
                flush()
            stack.append((tag, zone, place_below(tag, inside, stack[-1][2])))
    flush()
    return out
