"""A page as a tree of blocks: tags are read with one pattern, end tags that may be left out are implied.

Small helper of `site_templates`, without Spark. A block is the text between two starts or ends of block
elements; references are decoded, white space (a line break tag too) is one space.
"""

from __future__ import annotations

import re
from html import unescape

import xxhash

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is no markup; all of them go.
RAW = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for n in ("script", "style", "title", "textarea", "iframe", "noscript", "noembed", "noframes", "xmp")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold running text.
PROSE = HEADINGS | frozenset("p blockquote pre li dd dt td th caption figcaption".split())
#: Elements that never belong to an article.
OUT = frozenset("nav aside footer button select dialog menu svg canvas audio video object template datalist map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words of class and id names that mark menus, sidebars, notices, adverts, forms and comments.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsbygoogle sponsor sponsors sponsored promo promos "
    "promoted promotion banner banners nav navbar navigation menu menus topbar toolbar breadcrumb breadcrumbs pagination pager sidebar "
    "sidebars widget widgets related recommended recommendations comment comments commentlist disqus respond replies share sharing "
    "social newsletter subscribe subscription signup paywall login cookie cookies cookiebar consent gdpr notice notices notification "
    "notifications alert popup modal overlay lightbox toast footer copyright masthead form search searchbox".split())
#: First words of class names that tell what a page has, not what the element is.
ABOUT = frozenset("has no with without is hide".split())
#: What an open element is closed by.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}


class Page:
    """Nodes in the order of their start tags; node 0 is the root. `blocks` are (node, text, characters in
    links) in page order. `gone`: the node is a menu, advert, form and so on."""

    def __init__(self, html: str):
        self.tag, self.parent, self.gone, self.soft, self.header, self.main = ["#root"], [-1], [False], [False], [False], [""]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(html)
        self._settle()

    def _read(self, html: str) -> None:
        # Open elements: name, node (of blocks and marked elements), block or not. Text around a marked
        # inline element is held back, since it is one block.
        open_, at, buffer, links, in_link, held = [("#root", 0, True)], 0, [], 0, 0, []
        tag, parent, blocks = self.tag, self.parent, self.blocks

        def flush() -> None:
            nonlocal buffer, links
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    blocks.append((next(n for _, n, _ in reversed(open_) if n is not None), text, min(links, len(text))))
                buffer, links = [], 0

        def close(i: int) -> None:
            nonlocal buffer, links, in_link
            while len(open_) > i:
                name, node, block = open_[-1]
                if node is not None:
                    flush()
                    if not block:
                        buffer, links = held.pop()
                in_link -= name == "a"
                open_.pop()

        end = len(html)
        while at < end:
            m = TOKEN.search(html, at)
            stop = m.start() if m else end
            if stop > at:
                text = html[at:stop]
                if "&" in text:
                    text = unescape(text)
                buffer.append(text)
                if in_link > 0:
                    links += len(text)
            if not m:
                break
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if m.group(1):
                inline = name in INLINE
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i][0] == name:
                        close(i)
                        break
                    if inline and open_[i][2]:
                        break
                else:
                    if name == "p":
                        flush()
                continue
            if name in RAW:
                m = RAW[name].search(html, at)
                at = m.end() if m else end
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                elif name == "br":
                    buffer.append(" ")
                continue
            attributes = m.group(3)
            inline = name in INLINE
            soft = header = out = False
            main = "article" if name == "article" else "main" if name == "main" else ""
            if "=" in attributes:
                for key, *values in ATTRIBUTE.findall(attributes):
                    value = unescape(values[0] or values[1] or values[2])
                    key = key.lower()
                    if key == "role":
                        out |= value.strip().lower() in ROLES
                        main = main or ("main" if value.strip().lower() == "main" else "")
                    elif key == "itemprop":
                        main = main or ("main" if value.strip().lower() == "articlebody" else "")
                    elif name not in ("html", "body", "main"):
                        for one in value.split():
                            words = [one.lower()] if name == "article" else [w.lower() for w in WORD.findall(one)]
                            if words and words[0] not in ABOUT:
                                soft |= not MARKS.isdisjoint(words)
                                header |= "header" in words and name != "article"
            if inline and not (soft or out):
                in_link += name == "a"
                open_.append((name, None, False))
                continue
            if not inline:
                flush()
                # A paragraph ends where another block starts; a list item where the next one does.
                closes, scope = CLOSES.get(name, ()), SCOPE.get(name, ())
                cut = 0
                for i in range(len(open_) - 1, 0, -1):
                    n, _, block = open_[i]
                    if n == "p" or n in closes or (n in HEADINGS and name in HEADINGS):
                        cut = i
                        if n == "p" and not closes:
                            break
                    elif (block and not closes) or n in scope:
                        break
                if cut:
                    close(cut)
            else:
                held.append((buffer, links))
                buffer, links = [], 0
            tag.append(name)
            parent.append(next(n for _, n, _ in reversed(open_) if n is not None))
            self.gone.append(name in OUT or out)
            self.soft.append(soft or name in ("form", "fieldset"))
            self.header.append(header or name == "header")
            self.main.append(main)
            open_.append((name, len(tag) - 1, not inline))
        close(1)
        flush()

    def _settle(self) -> None:
        """Which nodes go, and which are part of the main text. An element that only its names mark stays
        if it holds an article; of a header in the article the headings stay."""
        size = len(self.tag)
        holds = [False] * size
        for i in range(size - 1, 0, -1):
            if holds[i] or (self.main[i] and not self.soft[i] and not self.gone[i]):
                holds[self.parent[i]] = True
        gone, inside, headed, heading = [False] * size, [""] * size, [False] * size, [False] * size
        for i in range(1, size):
            p = self.parent[i]
            gone[i] = gone[p] or self.gone[i] or (self.soft[i] and not holds[i])
            inside[i] = inside[p] or ("" if gone[i] else self.main[i])
            headed[i] = headed[p] or (self.header[i] and not holds[i])
            heading[i] = heading[p] or self.tag[i] in HEADINGS
            if self.main[i] == "article" and not gone[i]:
                inside[i] = "article"
        for want in ("article", "main", ""):
            self.blocks_kept = [(n, t, a) for n, t, a in self.blocks if not gone[n] and (not want or inside[n] == want)
                                and (not headed[n] or (want and heading[n]))]
            if self.blocks_kept:
                return

    def subtrees(self) -> tuple[list[int], list[int], list[int]]:
        """For each node the hash of its tag and of all main text and elements below it (0: none), the
        hash of its parent's subtree, and its characters. The hash is odd if most of the subtree is
        running text."""
        size = len(self.tag)
        parts: list[list] = [[] for _ in range(size)]
        chars, prose = [0] * size, [0] * size
        live = [False] * size
        for n, text, links in self.blocks_kept:
            chars[n] += len(text)
            prose[n] += len(text) - links if self.tag[n] in PROSE and 2 * links <= len(text) else 0
            parts[n].append(text)
            while n >= 0 and not live[n]:
                live[n] = True
                if self.parent[n] >= 0:
                    parts[self.parent[n]].append(n)
                n = self.parent[n]
        hashes = [0] * size
        for i in range(size - 1, -1, -1):
            if live[i]:
                own = "\x02".join([self.tag[i], *(f"\x01{hashes[x]}" if isinstance(x, int) else x for x in parts[i])])
                hashes[i] = (xxhash.xxh3_64_intdigest(own.encode("utf-8", "replace")) - (1 << 63)) & ~1 | (2 * prose[i] >= chars[i])
                if i:
                    chars[self.parent[i]] += chars[i]
                    prose[self.parent[i]] += prose[i]
        above = [hashes[p] if p >= 0 else 0 for p in self.parent]
        return hashes, above, chars

    def text(self, recurring: set[int] = frozenset()) -> str:
        """The main text, without the subtrees whose hash is recurring and that hold no more than half
        of it."""
        if not recurring:
            return "\n".join(t for _, t, _ in self.blocks_kept)
        hashes, _, chars = self.subtrees()
        gone = [False] * len(hashes)
        for i in range(1, len(hashes)):
            gone[i] = gone[self.parent[i]] or (hashes[i] in recurring and 2 * chars[i] <= chars[0])
        return "\n".join(t for n, t, _ in self.blocks_kept if not gone[n])
