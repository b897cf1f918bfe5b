"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its path of open tags from the root.
Per path, text length, punctuation and occurrences are summed; their ratios (characters
and marks per occurrence) are smoothed over paths that share a container and fused with
the mass of the container. What tags and class names say only weighs the ratios: no visible
path is left out, and none is taken, for its names alone. Paths over the threshold are
content; all their nodes are kept, short ones included, block by block in page order.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, record

#: Share of the best path's fused ratio that a path needs.
THRESHOLD = 0.1
#: Weights of names, by tag and by words of class, id and role: an article's ratio is multiplied by the first,
#: and what is around or between articles by the second, once for each such element around it.
BY_TAG, BY_WORD = (8.0, 1 / 32), (3.0, 1 / 16)
#: Inside an article, a ratio relative to the best counts with this power, as titles and list items are short.
EVEN = {8.0: 0.5, 3.0: 0.75}

_OPENS = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z]|/)")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
#: A longer path is known by its hash from there on, so that deep pages take no more time per tag.
_PATH_CHARS = 2000
_SPACE = re.compile(r"[\s\x00]+")
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_MARKS = re.compile(r"[.,;:!?…。、，]")

# HTML element groups.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template noscript textarea title iframe svg math object select xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ENDS_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
# Tags and words of class, id and role that speak against or for the article.
_NOT_CONTENT = frozenset("nav header footer aside form button menu dialog fieldset noscript head".split())
#: Of these, what frames a page: it never sets the measure for the rest.
_FRAME = frozenset("nav header footer aside menu button head".split())
_NOT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments respond disqus reply replies related recommended recommendations share sharing social toolbar widget pagination pager search contentinfo complementary sr only skip tags meta copyright legal disclaimer".split())
_BUT = frozenset("has with no without".split())  # as in "has-sidebar"
#: Words of what readers wrote, unless one of the second set follows, as in "comments-open".
_READERS = frozenset("comment comments respond disqus replies".split())
_STATE = frozenset("open opened closed on off enabled disabled allowed count counts link links number".split())
_CONTENT = frozenset("article main".split())
_CONTENT_WORDS = frozenset("article content post entry story main body text".split())


class _Open:
    """An open element: name, path, block number, whether it is hidden, and its weights (see ``Signs``)."""

    __slots__ = ("name", "path", "block", "hidden", "signs")

    def __init__(self, name, path, block, hidden, signs):
        self.name, self.path, self.block, self.hidden, self.signs = name, path, block, hidden, signs


class Signs(NamedTuple):
    """What the names on a path say: weight as an article (1 if none), weight as something else,
    whether a tag for the frame of a page is on the path, and whether it is named as readers' comments."""

    home: float = 1.0
    out: float = 1.0
    frame: bool = False
    readers: bool = False


class Scanner:
    """Tags of a page, each read once from its start to its end; what is no tag is text."""

    def __init__(self, page: str):
        self.page, self.n = page, len(page)
        self.gone: set[str] = set()  # characters that no later place has

    def find(self, what: str, at: int) -> int:
        """Place of ``what`` from ``at`` on, or -1; a search to the page's end is made once."""
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def next(self, at: int) -> tuple[int, int, str, dict[str, str]] | None:
        """(start, end, name, attributes) of the next tag from ``at`` on; the name is ``/name`` for an end tag
        and empty for comments and declarations. None if only text is left."""
        while (m := _OPENS.search(self.page, at)) is not None:
            start, page = m.start(), self.page
            if m.group() == "<!--":
                end = self.find("-->", start + 4)
                return start, self.n if end < 0 else end + 3, "", {}
            if m.group()[-1] in "!?/":
                end = self.find(">", start)
                if end < 0:
                    return None
                return start, end + 1, "", {}
            if self.find(">", start) < 0:
                return None
            name = _NAME.match(page, start)
            end, attributes = self._attributes(name.end())
            if end < 0:  # a quote that is never closed: the tag ends where it would without
                end = self.find(">", start) + 1
            return start, end, ("/" if page[start + 1] == "/" else "") + name.group(1).lower(), attributes
        return None

    def _attributes(self, at: int) -> tuple[int, dict[str, str]]:
        """End of a tag and its attributes, the first of each name; a value is quoted only if a quote
        follows the equals sign. -1 if a quote or the tag is not closed."""
        out: dict[str, str] = {}
        page = self.page
        while (m := _ATTRIBUTE.match(page, at)) is not None:
            at, value = m.end(), ""
            if m.group(2):
                if (quote := page[at:at + 1]) in ("'", '"'):
                    end = self.find(quote, at + 1)
                    if end < 0:
                        return -1, out
                    value, at = page[at + 1:end], end + 1
                else:
                    value = _UNQUOTED.match(page, at).group()
                    at += len(value)
            out.setdefault(m.group(1).lower(), value)
        end = self.find(">", at)
        return (-1, out) if end < 0 else (end + 1, out)


def _signals(name: str, attributes: dict[str, str], above: Signs) -> tuple[str, bool, Signs]:
    """Path label of a tag, whether it is hidden, and the weights below it."""
    inside = above.home > 1
    words: set[str] = set()
    readers = above.readers
    label = f"{name}.{'.'.join(sorted(html.unescape(attributes['class']).lower().split()))}" if "class" in attributes else name
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in "".join(attributes.get("style", "").split()).lower()
    for key in ("class", "id", "role"):
        if key in attributes:
            for word in html.unescape(attributes[key]).split():
                parts = [w.lower() for w in _PART.findall(word)]
                told = [w for w, before in zip(parts, ["", *parts]) if before not in _BUT]
                words.update(told)
                if name not in ("html", "body", "article", "main"):
                    readers |= any(w in _READERS and after not in _STATE for w, before, after in zip(parts, ["", *parts], [*parts[1:], ""]) if before not in _BUT)
    home = name in _CONTENT or name in ("div", "section", "td") and not _CONTENT_WORDS.isdisjoint(words)
    if inside or home:  # an article's own header (title, byline) is part of it; a page's is not
        words.discard("header")
    named = name not in ("html", "body", "article", "main") and not _NOT_WORDS.isdisjoint(words)
    tagged = name in _NOT_CONTENT and not (inside and name == "header")
    if named or tagged:
        signs = Signs(above.home, above.out * min(BY_TAG[1] if tagged else 1.0, BY_WORD[1] if named else 1.0), above.frame or name in _FRAME and tagged, readers)
        return f"{label}!" if named else label, hidden, signs
    above = above._replace(readers=readers)
    if home:
        return label if name in _CONTENT else f"{label}+", hidden, above._replace(home=max(above.home, BY_TAG[0] if name in _CONTENT else BY_WORD[0]))
    return label, hidden, above


def text_nodes(page: str) -> list[tuple[str, str, int, bool, Signs]]:
    """(text, path, block, hidden, weights) of the text nodes in page order; raw elements are skipped."""
    nodes: list[tuple[str, str, int, bool, Signs]] = []
    root = _Open("", "", 0, False, Signs())
    stack, block, at, n = [root], 0, 0, len(page)
    opened: Counter[str] = Counter()  # elements on the stack by name

    def close(k: int) -> None:
        opened.subtract(e.name for e in stack[k:])
        del stack[k:]

    def add(a: int, b: int) -> None:
        if a < b:
            top = stack[-1]
            nodes.append((html.unescape(page[a:b]), top.path, block, top.hidden, top.signs))

    scanner = Scanner(page)
    while at < n:
        found = scanner.next(at)
        if found is None:
            add(at, n)
            break
        start, end, name, attributes = found
        add(at, start)
        at = end
        if not name:
            continue
        if name[0] == "/":
            if opened[name[1:]]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name[1:]))
            if name[1:] not in _INLINE:
                block += 1
            continue
        closed = page[end - 2] == "/"
        if name in _RAW:
            if not closed or name not in ("svg", "math", "object"):
                end = _CLOSERS[name].search(page, at)
                at = n if end is None else end.end()
            nodes.append((" ", stack[-1].path, block, stack[-1].hidden, stack[-1].signs))
            continue
        if name == "br":
            nodes.append((" ", stack[-1].path, block, stack[-1].hidden, stack[-1].signs))
            continue
        if name not in _INLINE:
            block += 1
        if name in _ENDS_P:
            for k in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[k].name == "p":
                    close(k)
                    break
                if stack[k].name not in _INLINE:
                    break
        elif name in _ENDS_SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name or name == "dd" and stack[k].name == "dt" or name == "dt" and stack[k].name == "dd":
                    close(k)
                    break
                if stack[k].name in _ENDS_SAME[name]:
                    break
        if name in _VOID or closed and name in _INLINE:
            continue
        top = stack[-1]
        label, hidden, signs = _signals(name, attributes, top.signs)
        path = top.path if name in _INLINE else f"{top.path}/{label}"
        if len(path) > _PATH_CHARS:
            path = f"/#{hashlib.sha256(path.encode()).hexdigest()}"
        opened[name] += 1
        stack.append(_Open(name, path, block, top.hidden or hidden, signs))
    return nodes


_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}


def path_scores(nodes: list[tuple[str, str, int, bool, Signs]]) -> dict[str, float]:
    """Fused tag-path ratios of all visible paths, relative to the page's best path outside the frame
    (navigation, page header, footer, ...); none if all text is in the frame. What is named as readers'
    comments has none either, unless all text outside the frame is."""
    length, marks, blocks, signs = defaultdict(int), defaultdict(int), defaultdict(set), {}
    for text, path, block, hidden, sign in nodes:
        if not hidden and not text.isspace():
            length[path] += len(_SPACE.sub(" ", text).strip())
            marks[path] += len(_MARKS.findall(text))
            blocks[path].add(block)
            signs[path] = sign
    # smoothing: a path shares what its siblings in the container have
    whole: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for path in length:
        total = whole[path.rpartition("/")[0]]
        total[0] += length[path]
        total[1] += marks[path]
        total[2] += len(blocks[path])
    fused = {}
    for path in length:
        n = len(blocks[path])
        c = whole[path.rpartition("/")[0]]
        ratio = 0.5 * length[path] / n + 0.5 * c[0] / c[2]
        mark_ratio = 0.5 * (marks[path] + 1) / n + 0.5 * (c[1] + 1) / c[2]
        # the container's mass tells a page's body from single blocks
        fused[path] = math.sqrt(ratio * mark_ratio) * math.log1p(c[0]) * signs[path].home * signs[path].out
    if any(not s.readers and not s.frame for s in signs.values()):
        fused = {path: v for path, v in fused.items() if not signs[path].readers}
    best = max((v for path, v in fused.items() if not signs[path].frame), default=0.0)
    if not best:
        return {}
    return {path: (v / best) ** (EVEN.get(signs[path].home, 1.0) if signs[path].out == 1 else 1.0) for path, v in fused.items()}


def main_text(page: str, threshold: float = THRESHOLD) -> str:
    """The article's blocks, joined by a line feed; empty if there is none."""
    nodes = text_nodes(page)
    content = {path for path, score in path_scores(nodes).items() if score >= threshold}
    blocks: dict[int, list[str]] = {}
    for text, path, block, hidden, _ in nodes:
        if not hidden and (path in content or text.isspace() and block in blocks):
            blocks.setdefault(block, []).append(text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text, n_chars) for every row. Null or empty html gives an
    empty text; null ids and urls stay null; repeated rows give repeated results; an empty
    table gives no rows. Broken markup is read as far as it goes."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for part, _, _ in chunks(batches, "html"):
            texts = [main_text(t.as_py(), threshold) for t in part.column("html")]
            yield record(schema, part.column("page_id"), part.column("url"), texts, [len(t) for t in texts])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
