"""Main text of web pages by tag-path ratios.

Every block of text hangs on a root-to-leaf tag path.  For each path of a page,
text length and punctuation per block are aggregated; both ratios are smoothed
along the page, fused, and thresholded, which tells content paths from
menus and notices.  Content roots are the article and main elements; without
any, the container that holds most of what the fused score finds and those of
all other paths with a score like it.  Tag names and class tokens that name
page furniture rule a path out.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

#: Elements by their role in the page.
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog button select fieldset noscript iframe object svg canvas template audio video map".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ROOT_TAGS = frozenset(["article", "main"])
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Short parts that belong together: a run of them is weighed as one.
RUN_TAGS = frozenset("li dt dd td th".split())
#: In a marked root the mean score counts as this at most, so that long paragraphs don't rule out short ones.
ROOT_MEAN = 40.0
#: Share of links from which a path of a marked page is nothing else.
MOST_LINKED = 0.8
CONTAINERS = frozenset("html body div section td".split())
#: Elements whose start ends an open paragraph are the block elements; these also end their like.
CLOSES_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE_OF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: A paragraph outside of these is not ended by a block within them.
ENDS_PARAGRAPHS = ("td", "th", "button", "html", "table")
#: Words in class and id attributes that name page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted recommended related replies reply "
    "respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Every attribute in order, its quoted value taken whole, so that no name is found within a value.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
MARKS = re.compile(r"[.,;:!?。、،؟]")


class _Paths:
    """The tag paths of a page as numbers: 0 is the empty path; a path's parent has a smaller number."""

    def __init__(self):
        self.tags, self.parents, self._known = [""], [0], {}

    def child(self, path: int, tag: str) -> int:
        found = self._known.setdefault((path, tag), len(self.tags))
        if found == len(self.tags):
            self.tags.append(tag)
            self.parents.append(path)
        return found

    def depths(self) -> list[int]:
        out = [0]
        for p in self.parents[1:]:
            out.append(out[p] + 1)
        return out

    def summed(self, own: dict[int, float]) -> list[float]:
        """For each path, the values of itself and all paths under it."""
        total = [own.get(p, 0.0) for p in range(len(self.tags))]
        for p in range(len(total) - 1, 0, -1):
            total[self.parents[p]] += total[p]
        return total

    def under(self, tops: set[int]) -> list[bool]:
        """For each path, whether it or a path above it is among ``tops``."""
        out = [0 in tops]
        for p in range(1, len(self.tags)):
            out.append(p in tops or out[self.parents[p]])
        return out


class _Block:
    __slots__ = ("path", "parts", "links", "banned")

    def __init__(self, path: int, banned: bool):
        self.path, self.parts, self.links, self.banned = path, [], 0, banned


def _furniture(tag: str, attrs: str) -> bool:
    """Whether an element is page furniture by its name, role, class or id."""
    if tag in FURNITURE_TAGS:
        return True
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            if tag not in ("html", "body", "article", "main") and FURNITURE_WORDS & set(re.split(r"[^a-z]+", value)):
                return True
            if tag == "article" and {"comment", "reply"} & set(re.split(r"[^a-z]+", value)):
                return True
        elif name == "role" and value in FURNITURE_ROLES:
            return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def blocks_of(page: str) -> tuple[list[_Block], _Paths]:
    """The page's blocks of text in order, each with its root-to-leaf tag path, and the paths.

    The time is linear in the page, however deep its elements nest: the places of
    open elements are kept by tag, so none is searched for.
    """
    stack: list[tuple[str, bool, bool, int]] = []  # tag, furniture, block element, path
    paths = _Paths()
    places: defaultdict[str, list[int]] = defaultdict(list)  # of a tag's open elements in the stack
    blocks_at: list[int] = []  # of open block elements
    blocks: list[_Block] = []
    current: _Block | None = None
    banned = links = 0

    def pop(to: int) -> None:
        nonlocal banned, links, current
        while len(stack) > to:
            tag, furniture, block, _ = stack.pop()
            places[tag].pop()
            banned -= furniture
            links -= tag == "a"
            if block:
                blocks_at.pop()
                current = None

    def innermost(tags) -> int:
        """The place of the innermost open element of any of these tags; -1 without."""
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    def add(text: str) -> None:
        nonlocal current
        if current is None:
            if not text or text.isspace():
                return
            current = _Block(stack[-1][3] if stack else 0, banned > 0)
            blocks.append(current)
        elif banned and not current.banned:
            return  # furniture within a line of text, such as a button
        current.parts.append(text)
        if links:
            current.links += len(text)

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            add(html.unescape(page[at:]))
            break
        if m.start() > at:
            add(html.unescape(page[at:m.start()]))
        token, at = m[0], m.end()
        named = NAME.match(token)
        if named is None:
            continue
        if not token.endswith(">"):
            break  # the page ends within a tag
        tag = named[1].lower()
        if token[1] == "/":
            if tag == "br":
                add(" ")
                continue
            at_tag = innermost((tag,))
            # an inline end tag doesn't close blocks
            if at_tag >= 0 and (tag in BLOCK_TAGS or not blocks_at or blocks_at[-1] < at_tag):
                pop(at_tag)
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            add(" ")
            continue
        is_block = tag in BLOCK_TAGS
        if is_block:
            # a block ends an open paragraph, and list or table parts end their like
            if innermost(("p",)) > innermost(ENDS_PARAGRAPHS):
                pop(innermost(("p",)))
            if innermost(CLOSES_LIKE.get(tag, ())) > innermost(SCOPE_OF.get(tag, ())):
                pop(innermost(CLOSES_LIKE[tag]))
            current = None
        if tag in VOID_TAGS or token.endswith("/>") and not is_block:
            if tag == "hr":
                current = None
            continue
        furniture = _furniture(tag, token[named.end():])
        above = stack[-1][3] if stack else 0
        stack.append((tag, furniture, is_block, paths.child(above, tag) if is_block else above))
        places[tag].append(len(stack) - 1)
        if is_block:
            blocks_at.append(len(stack) - 1)
        banned += furniture
        links += tag == "a"
    return blocks, paths


def _smooth(x: list[float]) -> list[float]:
    """Weighted means over neighbours in page order."""
    out = []
    for i in range(len(x)):
        lo, hi = max(0, i - 1), min(len(x), i + 2)
        weights = [2 if j == i else 1 for j in range(lo, hi)]
        out.append(sum(w * x[j] for w, j in zip(weights, range(lo, hi))) / sum(weights))
    return out


def _free(leaf: str, linked: float, marked: bool) -> float:
    """How far a tag path is free of links; in a marked root a few words besides them don't count, and a table is free unless all of it links."""
    if not marked:
        return 1 - linked
    if leaf in ("td", "th"):
        return float(linked < 1)
    return max(0.0, 1 - linked / MOST_LINKED)


def main_text(page: str | None, *, threshold: float = 0.15) -> str:
    """The main text of one page: its content blocks in order, joined by an empty line."""
    if not page:
        return ""
    blocks = []
    found, paths = blocks_of(page)
    tags = paths.tags
    for b in found:
        text = " ".join("".join(b.parts).split())
        if text:
            blocks.append((b, text))
    open_ = [(b, t) for b, t in blocks if not b.banned]
    if not open_:
        return ""

    # text length, punctuation and link length per tag path; parts of a list or table count as one run
    per: dict[int, list[float]] = {}
    last = None
    for b, t in open_:
        s = per.setdefault(b.path, [0, 0, 0, 0])
        s[0] += not (b.path == last and tags[b.path] in RUN_TAGS)
        s[1] += len(t)
        s[2] += len(MARKS.findall(t))
        s[3] += 0 if tags[b.path] in HEADING_TAGS else min(b.links, len(t))  # a title often links to its page
        last = b.path
    lengths = _smooth([per[b.path][1] / per[b.path][0] for b, _ in open_])
    marks = _smooth([per[b.path][2] / per[b.path][0] for b, _ in open_])
    marked_under = paths.under({p for p, t in enumerate(tags) if t in ROOT_TAGS})
    marked = any(marked_under[b.path] for b, _ in open_)
    text_only = [_free(tags[b.path], per[b.path][3] / per[b.path][1], marked) for b, _ in open_]
    fused = [math.sqrt(n * (1 + m)) * free for n, m, free in zip(lengths, marks, text_only)]

    # the content roots: main elements if there are any, else the deepest
    # container with most of the fused score and those of all paths that
    # score well for themselves, wherever they are
    mean = sum(fused) / len(fused)
    if marked:
        # a marked root lowers the threshold: only what is next to nothing but links falls under it
        limit = threshold / 3 * min(mean, ROOT_MEAN)
        inside = marked_under
    else:
        own_score: dict[int, float] = {}
        for (b, t), f in zip(open_, fused):
            own_score[b.path] = own_score.get(b.path, 0.0) + f * len(t) ** 0.5
        score, depth = paths.summed(own_score), paths.depths()
        containers = [p for p in range(len(tags)) if not p or tags[p] in CONTAINERS]
        tops = {max((p for p in containers if score[p] >= 0.6 * score[0] and score[p] > 0), key=depth.__getitem__, default=0)}
        # by characters, as menus have many blocks; by each path's own length and marks, as neighbours lend theirs
        own = {p: math.sqrt(chars / n * (1 + m / n)) * _free(tags[p], links / chars, marked) for p, (n, chars, m, links) in per.items()}
        usual = sum(own[b.path] * len(t) for b, t in open_) / sum(len(t) for _, t in open_)
        tops |= {p if tags[p] in CONTAINERS else paths.parents[p] for p in own if own[p] >= usual / 2}
        inside = paths.under(tops)
        limit = threshold * mean
    kept = []
    for (b, t), f in zip(open_, fused):
        if f >= limit and inside[b.path]:
            kept.append(t)
    return "\n\n".join(kept)


def _extract(batches):
    for b in batches:
        texts = [main_text(p) for p in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """One row per page: ``id, url, text, n_chars`` (code points).

    Character references are decoded; white space inside a block becomes one
    space; blocks are joined in page order by two line feeds.

    Defined cases: a null or empty page, or one without content, has an empty
    text; a page that ends within a tag or a reference yields what came
    before; repeated rows are extracted alike; an empty table gives no rows.
    Other columns are not read.

    Scale: a page is worked on where it is read; there is no shuffle.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = in_batches(rows, _extract, "page_id long, url string, text string")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
