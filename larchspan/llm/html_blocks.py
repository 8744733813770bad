"""Splits a web page into leaf blocks of text with the features that the extraction model reads.

The scan is one pass over the page with a stack of open elements.  Each stack entry carries a bit mask of what its
ancestors are, so a block's features cost the same at any depth.
"""

from __future__ import annotations

import re
from html import unescape

#: Elements that do not end a block, elements whose content is not text, elements without an end tag.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element ends open elements of these kinds when it starts.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Ancestor tags and name parts that count as features, by their group.
TAGS = "nav header footer aside form article main section ul ol table dl figure figcaption blockquote pre button select label fieldset dialog menu address details head".split()
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar topbar skip",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp outbrain taboola",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay paywall warning message",
    "comment": "comment comments disqus reply replies respond discussion reviews commentlist",
    "side": "sidebar side widget widgets related recommended trending popular share sharing social newsletter subscribe signup archive tags tagcloud",
    "foot": "footer foot copyright legal credits colophon bottom",
    "top": "header masthead logo branding hero sitehead",
    "form": "form search login signin contact subscribe",
    "content": "content article post entry story main body text maincontent articlebody postcontent entrycontent",
}
ROLES = {"navigation": "menu", "banner": "top", "contentinfo": "foot", "complementary": "side", "search": "form", "main": "content", "article": "content", "alert": "notice", "dialog": "notice"}
_TAG_BIT = {t: 1 << i for i, t in enumerate(TAGS)}
_GROUP_BIT = {g: 1 << (len(TAGS) + i) for i, g in enumerate(NAMES)}
_NAME_BIT: dict[str, int] = {}
for _g, _n in NAMES.items():
    for _w in _n.split():
        _NAME_BIT[_w] = _NAME_BIT.get(_w, 0) | _GROUP_BIT[_g]
_IN_ARTICLE_HEADER = 1 << (len(TAGS) + len(NAMES))
_HIDDEN = _IN_ARTICLE_HEADER << 1
#: Above the bits of all ancestors stand the groups of the innermost ancestor that has any.
_INNERMOST = len(TAGS) + len(NAMES) + 2
_GROUPS = ((1 << len(NAMES)) - 1) << len(TAGS)
_BELOW = (1 << _INNERMOST) - 1
MASK_BITS = _INNERMOST + len(NAMES)
#: Tags of the block itself that count as features.
OWN = "p h1 h2 h3 h4 h5 h6 li td th dt dd div a article section blockquote pre figcaption button label option span main body".split()
_OWN = {t: i for i, t in enumerate(OWN)}
N_FEATURES = MASK_BITS + len(OWN) + 1 + 6 + 4 + 6

_ATTRS = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_LETTERED = re.compile(r"[.!?…:»”\"')\]]$")


def _own_mask(name: str, attrs: str, parent: int) -> int:
    mask = _TAG_BIT.get(name, 0)
    if name == "header" and parent & (_TAG_BIT["article"] | _TAG_BIT["main"]):
        mask = _IN_ARTICLE_HEADER
    if attrs and "=" in attrs or "hidden" in attrs:
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                mask |= _HIDDEN
            elif key == "role":
                mask |= _GROUP_BIT.get(ROLES.get(value.lower(), ""), 0)
            elif key in ("class", "id"):
                for token in value.split():
                    mask |= _NAME_BIT.get(token.lower().replace("-", "").replace("_", ""), 0)
                    for part in _PART.findall(token):
                        mask |= _NAME_BIT.get(part.lower(), 0)
    return mask


def blocks(page: str) -> list[tuple[str, int, str, int, int]]:
    """Leaf blocks in page order: text with its white space made single and trimmed, mask, tag, characters in links, where it begins."""
    out: list[tuple[str, int, str, int, int]] = []
    stack: list[tuple[str, int]] = [("", 0)]  # block elements: name, mask
    opened: dict[str, int] = {}
    parts: list[str] = []
    begin, link, linked, loose = -1, 0, 0, False
    at, n, last_gt = 0, len(page), page.rfind(">")

    def add(raw: str, where: int) -> None:
        nonlocal begin, linked
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if begin < 0 and not raw.isspace():
                begin = where
            if link:
                linked += len(raw.strip())

    def flush() -> None:
        nonlocal begin, linked
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append((text, stack[-1][1], stack[-1][0], linked, begin))
            parts.clear()
        begin, linked = -1, 0

    def pop(name: str) -> None:
        while len(stack) > 1:
            top = stack.pop()[0]
            opened[top] -= 1
            if top == name:
                return

    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last_gt:
            add(page[at:], at)
            break
        add(page[at:lt], at)
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = _NAME.match(page, lt + 1)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                at = page.find(">", lt) + 1
            else:
                add("<", lt)
                at = lt + 1
            continue
        name, closing = m[1].lower(), page[lt + 1] == "/"
        tail = None if loose else _ATTRS.match(page, m.end())
        if tail:
            at = tail.end()
        else:
            loose = True  # an unclosed quote: from here on a tag ends at the next ">", so the scan stays linear
            at = page.find(">", m.end()) + 1
        attrs = page[m.end() : at - 1]
        if name in RAW:
            if not closing and not attrs.endswith("/"):
                end = _END[name].search(page, at)
                at = n if end is None else page.find(">", end.start()) + 1
                if at == 0:
                    at = n
            continue
        if name in INLINE:
            if name == "br":
                parts.append("\n")
            elif name == "a":
                link = max(0, link + (-1 if closing else 1))
            continue
        flush()
        if name in VOID:
            continue
        if closing:
            if opened.get(name):
                pop(name)
            link = 0
            continue
        if opened.get("p"):
            pop("p")
        for other in CLOSES.get(name, ()):
            if opened.get(other) and stack[-1][0] == other:
                pop(other)
        mask = stack[-1][1]
        own = _own_mask(name, attrs, mask)
        if groups := (own & _GROUPS) >> len(TAGS):
            mask = (mask & _BELOW) | groups << _INNERMOST
        stack.append((name, mask | own))
        opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def features(found: list[tuple[str, int, str, int, int]]) -> list[list[int]]:
    """Active feature numbers of each block: ancestors, own tag, length, share of linked text, look of the text."""
    out = []
    for i, (text, mask, tag, linked, _) in enumerate(found):
        f = [b for b in range(MASK_BITS) if mask >> b & 1]
        f.append(MASK_BITS + _OWN.get(tag, len(OWN)))
        base = MASK_BITS + len(OWN) + 1
        n = text.count(" ") + 1
        f.append(base + (0 if n <= 2 else 1 if n <= 5 else 2 if n <= 10 else 3 if n <= 20 else 4 if n <= 60 else 5))
        share = linked / len(text)
        f.append(base + 6 + (0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3))
        base += 10
        if _LETTERED.search(text):
            f.append(base)
        if "©" in text or "(c)" in text.lower():
            f.append(base + 1)
        if i == 0:
            f.append(base + 2)
        if i == len(found) - 1:
            f.append(base + 3)
        if "," in text:
            f.append(base + 4)
        if "|" in text or "·" in text or "»" in text:
            f.append(base + 5)
        out.append(f)
    return out
