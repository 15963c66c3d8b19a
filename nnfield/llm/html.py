"""Main text of web pages by consensus paths of their hosts.

Every page is read into blocks of text and the containers around them. Parts that are never article text (menus, hidden
ones) are left out. A part that a class, id, role or form marks as noise (adverts, comments and the like) is left out unless it
holds most of the page's text that is no link, or the only article; marks of comments and consent (``STRONG``) stay unless
nothing else has text. A page's own choice is its largest ``article`` or ``main``, else the lowest container of all its text
that is not mostly links; mostly linked blocks count only within the container that has ``SHARE`` of it. Each page votes for
the generalised path of its choice (tags with their classes, numbers in them replaced) with its score, and names the text of
its small parts; Spark adds both by host. A host's path is used for the pages whose own main text it covers, the others keep
their own choice. Small parts that say the same on most different pages of a host are its template: their path is left out
on every page of the host that names no article.

Inside a block white space is one space; blocks are joined by two line ends in page order; character references are
decoded. ``header`` counts as a page header only outside the chosen container. Nulls: a null page is empty, a null url has
the empty host. A page without text gives the empty string. Repeated rows are extracted once each. Pages of any length,
nesting and number of unclosed tags are read forward once; a < that opens no tag is text. Extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnfield.llm.common import batches
from nnfield.session import cut_lineage

SHARE = 0.8
# Winning paths up to this many bytes are broadcast, so that pages needn't be shuffled by host.
BROADCAST_BYTES = 32 * 1024 * 1024

# Elements by their part in a page.
CONTAINERS = frozenset("html body main article section div td table tbody tr center fieldset details figure".split())
BLOCKS = CONTAINERS | frozenset("""p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre address header footer nav aside form
    hr th thead tfoot caption figcaption summary menu hgroup search dialog title""".split())
NEVER = frozenset("nav footer aside menu search dialog head title noscript template button select svg iframe object canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of a class or id that mark parts which are no article text.
NOISE = frozenset("""ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments
    commentlist cookie cookies consent disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter
    notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply
    respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets""".split())
# Marks that stay even on most of a page's text, by last word, or by first word before a word for a part.
STRONG = frozenset("comment comments commentlist consent cookie cookies disqus gdpr replies reply respond".split())
PARTS = frozenset("area banner body box list section thread wrapper".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
# A tag whose attributes hold no < or >: nearly all are, and a try never reads past the next <.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*+)((?:[^"'<>]++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_STOP = re.compile("[\"'>]")
_RAW_NAMES = ("script", "style", "textarea", "xmp")
_RAW = re.compile(rf"({'|'.join(_RAW_NAMES)})\b", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW_NAMES}
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"\d+")


def _tokens(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag name or None, is an end tag, attributes) of the markup, in one pass forward.

    A tag ends at the first > outside quotes; a < from which none is reached is text. A failed search is remembered by the
    quotes it opened: a later one that opens the same quote fails alike, so no part is read more than a few times.
    """
    dead: set[int] = set()
    known = -1  # the first quote or > from any place since the last search; len(html) if there is none
    closing = html.find(">")  # the first > from any place since the last search; -1 if there is none
    at = html.find("<")
    while at >= 0:
        plain = _PLAIN.match(html, at)
        if plain:
            slash, name, attributes = plain.groups()
            name, end = name.lower(), plain.end()
            if slash or not name.startswith(_RAW_NAMES):
                yield at, end, name, slash == "/", attributes
                at = html.find("<", end)
                continue
        follow = html[at + 1 : at + 2]
        if follow and follow in "!?":
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                end = len(html) if end < 0 else end + 3
            else:
                if 0 <= closing < at:
                    closing = html.find(">", at)
                end = closing + 1
            if end > 0:
                yield at, end, None, False, ""
        else:
            raw, end = _RAW.match(html, at + 1), 0
            name = None if raw else _NAME.match(html, at + 2 if follow == "/" else at + 1)
            if raw:
                if 0 <= closing < at:
                    closing = html.find(">", at)
                if closing >= 0:
                    found = _RAW_END[raw.group(1).lower()].search(html, closing + 1)
                    end = found.end() if found else len(html)
                    yield at, end, None, False, ""
            elif name:
                opened = []
                if known < name.end():
                    stop = _STOP.search(html, name.end())
                    known = stop.start() if stop else len(html)
                place = known
                while place < len(html) and html[place] != ">" and place not in dead:
                    opened.append(place)
                    shut = html.find(html[place], place + 1)
                    stop = _STOP.search(html, shut + 1) if shut >= 0 else None
                    place = stop.start() if stop else len(html)
                if place < len(html) and html[place] == ">":
                    end = place + 1
                    yield at, end, name.group().lower(), follow == "/", html[name.end() : place]
                else:
                    dead.update(opened)
        at = html.find("<", max(end, at + 1))


def _key(path: str) -> int:
    """The hash of a path: that of its parent's and its own last part, so that paths of any depth are told apart."""
    key = 0
    for label in path.split("/")[1:]:
        key = _step(key, label)
    return key


@lru_cache(1 << 16)
def _step(parent: int, label: str) -> int:
    return _hash(f"{parent}/{label}")


class Page:
    """Containers [hash of the path, parent, tag, mark] and blocks [container, text, link characters] in page order.

    Text in parts marked as noise by name or form is kept with its mark until the whole page is read.
    """

    def __init__(self, html: str | None) -> None:
        self.elements: list[tuple[int, int, str, int]] = [(0, -1, "", 0)]
        self._labels, self._depths = [""], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.marks: list[tuple[int, bool]] = [(-1, False)]  # mark around it, strong
        self._stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, True, 0)]  # tag, container, never text, is a block, mark
        self._blocks = [0]  # places of the blocks on the stack
        self._open: dict[str, int] = {}
        self._pieces: list[tuple[int, str, bool]] = []  # mark, text, in a link
        self._raw: list[tuple[int, list[tuple[int, str, bool]]]] = []
        self._link = False
        html = html or ""
        at = 0
        for start, end, name, closes, attributes in _tokens(html):
            if start > at:
                self._text(html[at:start])
            at = end
            if name is not None:
                if closes:
                    self._end(name)
                else:
                    self._start(name, attributes)
        if at < len(html):
            self._text(html[at:])
        self._flush()
        self._resolve()

    def _text(self, raw: str) -> None:
        if self._stack[-1][2]:
            return
        text = unescape(raw) if "&" in raw else raw
        self._pieces.append((self._stack[-1][4], text, self._link))

    def _flush(self) -> None:
        if self._pieces:
            self._raw.append((self._stack[-1][1], self._pieces))
            self._pieces = []

    def _resolve(self) -> None:
        """Which marks hold, and the blocks without the text of those that do."""
        n = len(self.marks)
        self.noisy, self.rescued = [False] * n, False
        if n > 1:
            self._judge()
        for container, pieces in self._raw:
            kept = [p for p in pieces if not self.noisy[p[0]]]
            text = " ".join("".join(p[1] for p in kept).split())
            if text:
                self.blocks.append((container, text, min(sum(len(p[1]) for p in kept if p[2]), len(text))))
        self._raw = []

    def _judge(self) -> None:
        n = len(self.marks)
        chars, weight = [0] * n, [0] * len(self.elements)
        for container, pieces in self._raw:
            for mark, text, link in pieces:
                if not link:
                    size = len("".join(text.split()))
                    chars[mark] += size
                    if mark == self.elements[container][3]:
                        weight[container] += size
        for k in range(n - 1, 0, -1):
            if not self.marks[k][1]:
                chars[self.marks[k][0]] += chars[k]
        for k in range(len(self.elements) - 1, 0, -1):
            if self.elements[self.elements[k][1]][3] == self.elements[k][3]:
                weight[self.elements[k][1]] += weight[k]
        # A part with most of the page's text isn't noise by its name.
        holds = [k > 0 and (self.marks[k][1] or 2 * chars[k] <= chars[0]) for k in range(n)]
        held, strong = [0] * n, [False] * n  # marks that hold around each one, itself included
        for k in range(1, n):
            held[k] = held[self.marks[k][0]] + holds[k]
            strong[k] = strong[self.marks[k][0]] or (holds[k] and self.marks[k][1])
        articles = [
            (-held[mark], weight[k], -k) for k, (_, _, tag, mark) in enumerate(self.elements)
            if tag in ("article", "main") and weight[k] > 0 and not strong[mark]
        ]
        # Nor is one around the article, if no article stands outside.
        if articles:
            mark = self.elements[-max(articles)[2]][3]
            self.rescued = held[mark] > 0
            while mark > 0:
                holds[mark], mark = False, self.marks[mark][0]
        self._spread(holds)
        if not any(not self.noisy[m] and text.strip() for _, pieces in self._raw for m, text, _ in pieces):
            self._spread([False] * n)

    def _spread(self, holds: list[bool]) -> None:
        for k in range(1, len(holds)):
            self.noisy[k] = holds[k] or self.noisy[self.marks[k][0]]

    def _pop_to(self, k: int) -> None:
        if any(s[3] for s in self._stack[k:]):
            self._flush()
        for tag, *_ in self._stack[k:]:
            self._open[tag] -= 1
        while self._blocks[-1] >= k:
            self._blocks.pop()
        del self._stack[k:]

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text("\n")
            return
        if tag == "hr":
            self._flush()
        if tag in VOID:
            return
        if tag == "a":
            self._link = True
        block = tag in BLOCKS
        if block:
            self._close_open(tag)
        never, marked, strong, classes = tag in NEVER, tag == "form", False, ()
        if attributes and ("=" in attributes or "hidden" in attributes):
            hidden, named, by, classes = _named(attributes)
            # The body and the whole page are never noise by name.
            if tag not in ("html", "body", "main", "article"):
                never, marked, strong = never or hidden, marked or named, by
        if not block and not never and not marked:
            return
        _, container, inside, _, mark = self._stack[-1]
        never |= inside
        if block:
            self._flush()
        if marked and not never:
            self.marks.append((mark, strong))
            mark = len(self.marks) - 1
        if not never and (tag in CONTAINERS or tag == "header"):
            label = ".".join((tag, *classes))
            self.elements.append((_step(self.elements[container][0], label), container, tag, mark))
            self._labels.append(label)
            self._depths.append(self._depths[container] + 1)
            container = len(self.elements) - 1
        if block:
            self._blocks.append(len(self._stack))
        self._open[tag] = self._open.get(tag, 0) + 1
        self._stack.append((tag, container, never, block, mark))

    def _close_open(self, tag: str) -> None:
        """End tags that may be left out."""
        ends = ("p", *CLOSES.get(tag, ()))
        while len(self._blocks) > 1 and self._stack[self._blocks[-1]][0] in ends:
            open_tag = self._stack[self._blocks[-1]][0]
            self._pop_to(self._blocks[-1])
            if open_tag != "p" or len(ends) == 1:
                return

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._link = False
        if not self._open.get(tag):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == tag:
                self._pop_to(k)
                return

    def _main(self, templates: frozenset[int] = frozenset()) -> tuple[int, float, int]:
        """The page's own container, its score, and the container within it whose lists of links belong to the text."""
        own, plain = [0.0] * len(self.elements), [0.0] * len(self.elements)
        for container, text, linked in self.blocks:
            if self.elements[container][0] not in templates:
                own[container] += len(text) - linked
                if 2 * linked <= len(text):
                    plain[container] += len(text) - linked
        children: dict[int, list[int]] = {}
        for k in range(len(self.elements) - 1, 0, -1):
            _, parent, tag, mark = self.elements[k]
            if tag == "header" or self.noisy[mark]:
                continue
            own[parent] += own[k]
            plain[parent] += plain[k]
            children.setdefault(parent, []).append(k)
        # Parts that name themselves as the article win over their surroundings.
        named = [k for k in range(1, len(self.elements)) if self.elements[k][2] in ("article", "main") and not self.noisy[self.elements[k][3]] and own[k] > 0]
        if named:
            best = max(named, key=lambda k: (own[k], k))
            if not self.rescued or 2 * own[best] >= own[0]:
                return best, own[best], best
        chosen = core = 0
        while True:  # down to the lowest container of all text that is not mostly links
            best = max(children.get(chosen, []), key=lambda k: own[k], default=None)
            if best is None or own[best] <= 0 or plain[best] < plain[chosen] or own[best] < SHARE * own[chosen]:
                break
            chosen = core = best
        while True:  # and on to the container of most of it
            best = max(children.get(core, []), key=lambda k: own[k], default=None)
            if best is None or own[core] <= 0 or own[best] < SHARE * own[core]:
                return chosen, own[chosen], core
            core = best

    def choice(self) -> tuple[str, float]:
        """Path and score of the page's own container."""
        at, score, _ = self._main()
        return self._path(at), score

    def vote(self) -> tuple[int, int, float]:
        """Hash of the path, depth and score of the page's own container."""
        at, score, _ = self._main()
        return self.elements[at][0], self._depths[at], score

    def _path(self, at: int) -> str:
        labels = []
        while at > 0:
            labels.append(self._labels[at])
            at = self.elements[at][1]
        return "".join(f"/{label}" for label in reversed(labels))

    def repeats(self) -> list[tuple[int, int, int, int]]:
        """Path, its depth, hash of its text and of the page's text for every container with text of its own, if nothing is named as the
        article. A text that is more than a small part of the page never counts as repeated: it has the page's hash."""
        at = self._main()[0]
        if self.elements[at][2] in ("article", "main"):
            return []
        texts: dict[tuple[int, int], list[str]] = {}
        for container, text, _ in self.blocks:
            texts.setdefault((self.elements[container][0], self._depths[container]), []).append(text)
        page, size = _hash("\n".join(t for _, t, _ in self.blocks)), sum(len(t) for _, t, _ in self.blocks)
        return [(*p, _hash("\n".join(t)) if sum(map(len, t)) < (1 - SHARE) * size else page, page) for p, t in texts.items()]

    def _kept(self, path: int, templates: frozenset[int] = frozenset()) -> list[int] | None:
        """Blocks in the containers of a path; None if there is none."""
        inside, headed = [False] * len(self.elements), [False] * len(self.elements)
        cored = [False] * len(self.elements)
        found = False
        core = self._main(templates)[2]
        for k, (own, parent, tag, _) in enumerate(self.elements):
            within = parent >= 0 and inside[parent]
            inside[k] = within or own == path
            cored[k] = k == core or tag in ("article", "main") or (parent >= 0 and cored[parent])
            # A header around or beside the article is the page's.
            headed[k] = (parent >= 0 and headed[parent]) or (tag == "header" and not within)
            found |= inside[k]
        if not found:
            return None
        kept = enumerate(self.blocks)
        return [i for i, (c, t, linked) in kept if inside[c] and not headed[c] and (cored[c] or 2 * linked <= len(t)) and self.elements[c][0] not in templates]

    def text(self, path: str) -> str | None:
        """Text of the blocks in the containers of a path; None if there is none."""
        kept = self._kept(_key(path))
        return None if kept is None else "\n\n".join(self.blocks[i][1] for i in kept)

    def extract(self, winner: int | None, templates: frozenset[int]) -> tuple[str, str]:
        """Text and path: the host's path where it covers the page's own main text, else the page's own."""
        at = self._main(templates)[0]
        if templates and self.elements[at][2] in ("article", "main"):
            return self.extract(winner, frozenset())
        own = self._kept(self.elements[at][0], templates) or []
        if not own and templates:
            return self.extract(winner, frozenset())
        if winner:
            kept = self._kept(winner, templates)
            if kept and set(own) <= set(kept):
                at, own = next(k for k, e in enumerate(self.elements) if e[0] == winner), kept
        return "\n\n".join(self.blocks[i][1] for i in own), self._path(at)


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _is_noise(token: str) -> bool:
    """A class or id whose first or last word marks a part that is no article text; "has-sidebar" only speaks of one."""
    words = _WORD.findall(token)
    if not words or words[0] in ("has", "with", "without", "no", "is", "not"):
        return False
    if words[-1] == "header":
        return len(words) == 1 or words[0] in ("site", "page", "global", "main", "top")
    return words[0] in NOISE - {"header"} or words[-1] in NOISE


def _is_strong(token: str) -> bool:
    words = _WORD.findall(token)
    return _is_noise(token) and (words[-1] in STRONG or words[0] in STRONG and words[-1] in PARTS)


def _named(attributes: str) -> tuple[bool, bool, bool, tuple[str, ...]]:
    hidden, noise, strong, classes = False, False, False, ()
    for m in _NAMES.finditer(attributes):
        name, value = m.group(1).lower(), next((g for g in m.groups()[1:] if g is not None), "")
        if name == "hidden" or name == "aria-hidden":
            hidden = hidden or name == "hidden" or value.lower() == "true"
            continue
        tokens = value.lower().split()
        noise = noise or any(map(_is_noise, tokens))
        strong = strong or noise and any(map(_is_strong, tokens))
        if name == "class":
            classes = tuple(sorted({_NUMBER.sub("#", c) for c in value.lower().replace("/", " ").split()}))
    return hidden, noise, strong, classes


_VOTES = pa.schema([("host", pa.string()), ("path", pa.int64()), ("depth", pa.int32()), ("part", pa.int64()), ("page", pa.int64()), ("weight", pa.float64())])
_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("path", pa.string())])


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce(F.col("url").cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host.alias("host"))


def consensus(pages: DataFrame) -> DataFrame:
    """host, path, votes, templates: the winning path of each host, ties to the deeper, then the greater hash; and the paths
    of small parts that say the same on most of its different pages, three at least. Paths are their hashes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                tally: dict[tuple[str, int, int], float] = {}
                for html, host in zip(part.column(0), part.column(1).to_pylist()):
                    page = Page(html.as_py())
                    path, depth, score = page.vote()
                    if score > 0:
                        tally[host, path, depth] = tally.get((host, path, depth), 0.0) + score
                        yield from ((host, p, d, h, whole, 0.0) for p, d, h, whole in page.repeats())
                yield from ((h, p, d, None, None, w) for (h, p, d), w in tally.items())

        return batches(rows(), _VOTES)

    votes = _hosted(pages).select("html", "host").mapInArrow(run, "host string, path long, depth int, part long, page long, weight double")
    once = votes.groupBy("host", "path", "part", "page").agg(F.sum("weight").alias("votes"), F.max("depth").alias("depth"))
    said = once.groupBy("host", "path", "part").agg(F.sum("votes").alias("votes"), F.count("page").alias("pages"), F.max("depth").alias("depth"))
    paths = said.groupBy("host", "path").agg(
        F.sum("votes").alias("votes"), F.max("pages").alias("most"), F.sum("pages").alias("pages"), F.max("depth").alias("depth"))
    order = F.struct("votes", "depth", "path")
    template = F.when((F.col("most") >= 3) & (2 * F.col("most") > F.col("pages")), F.col("path"))
    return paths.groupBy("host").agg(F.max_by("path", order).alias("path"), F.max("votes").alias("votes"), F.collect_list(template).alias("templates"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path of every page."""
    winners = cut_lineage(consensus(pages).select(F.col("host").alias("_host"), F.col("path").alias("winner"), "templates"))
    hosted = _hosted(pages)
    size = winners.agg(F.sum(F.length("_host") + 8 * F.size("templates") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        winners = F.broadcast(winners)
    met = hosted.join(winners, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "winner", "templates")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for page_id, url, html, winner, templates in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist(), part.column(4).to_pylist()):
                    text, path = Page(html.as_py()).extract(winner, frozenset(templates or ()))
                    yield page_id, url, text, len(text), path

        return batches(rows(), _TEXTS)

    return met.mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")
