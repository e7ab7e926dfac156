"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. First pass: blocks inside scripts,
styles, navigation, footers, sidebars, forms and the like, or under a class, id or role
that names such a part, are bad; so are blocks that are mostly links. If the page marks
its article, blocks outside are bad; inside, long blocks and blocks with function words
are good, and a class, id or role counts only if all its words name boilerplate ('related-posts', not 'social-history').
The article itself and what encloses it are bad only by a whole class, id or role
('sidebar', not 'has-sidebar'). Without a marked article, length and stop-word density decide. Second pass:
undecided short blocks take the label of the nearest decided neighbour (equally near:
the one before); the edge of a marked article counts as good.

Kept blocks have character references decoded and white space joined to one space; they
stand in page order, one line each.

Defined results: null or empty html: empty text. Cut-off tags and comments at the end
are markup. Repeated pages keep their rows. Empty table: no rows. Other columns are
ignored. Pages are independent: nothing is shuffled, no page or host can be hot.
"""

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from volpanel.llm.common import per_batch
from volpanel.llm.quality_rules import STOP_WORDS

_STOP = frozenset(w.decode() for w in STOP_WORDS)
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Tags (fixed values): raw text, never text of a page, boilerplate parts, blocks.
_RAW = frozenset("script style textarea title xmp noembed noframes noscript template svg math iframe object select button canvas audio video map".split())
_PARTS = frozenset("nav footer aside form dialog menu fieldset".split())
_CONTAINERS = frozenset("html body article main section div header hgroup ul ol dl table thead tbody tfoot tr figure blockquote details center head".split()) | _PARTS
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre address caption figcaption summary hr legend".split()) | _CONTAINERS
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Words in a class, id or role that name a part which is no article (fixed values).
_NAMED = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
                   "footer sidebar side aside widget related recommended comment comments commentlist disqus replies respond cookie cookies consent gdpr notice "
                   "notices alert popup modal newsletter subscribe subscription signup share sharing social login search pagination pager toolbar skip complementary contentinfo "
                   "form".split())
#: Words that may stand beside them where only a whole name counts (fixed values).
_BOX = frozenset("area article bar block bottom box button buttons container entry icons inline item items leaderboard left link links list mobile page panel "
                 "post posts reader right section site slot stories thread top unit user wrapper".split())
_HEADS = frozenset("header masthead topbar".split())
SHORT, LONG, SOME_STOP, MANY_STOP, LINKS = 70, 200, 0.1, 0.2, 0.5
BAD, NONE, GOOD = 0, 1, 2


def _box(attributes: str) -> bool:
    """Whether a class, id or role is made of boilerplate words alone ('share', 'related-posts', not 'social-history')."""
    return any(words & _NAMED and words <= _NAMED | _BOX for name in _names(attributes, r"\s+")
               for words in [{w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()}])


def _names(attributes: str, split: str = r"[^a-z0-9]+") -> set[str]:
    return {t for m in _NAMES.finditer(attributes) for t in re.split(split, (m[1] or m[2] or m[3] or "").lower())}


def blocks(page: str, wraps: frozenset[int] = frozenset()) -> list[tuple[str, int, bool, bool]]:
    """(text, link characters, under boilerplate, in a marked article) of each non-empty block.

    ``wraps``: numbers of the containers that enclose an article. If a part of a name condemned one of them,
    the page is read again with their numbers."""
    out, text, links = [], [], 0
    stack: list[tuple[str, bool, bool]] = []  # tag, boilerplate, article
    numbers: list[int] = []  # of the containers in the stack
    opened, around, by_part = 0, set(), set()
    open_, n_bad, n_article = Counter(), 0, 0
    bad_block, in_link, at, end = False, False, 0, len(page)

    def flush():
        nonlocal links, bad_block
        joined = " ".join("".join(text).split())
        if joined:
            out.append((joined, links, bad_block or n_bad > 0, n_article > 0))
        text.clear()
        links, bad_block = 0, False

    while at < end:
        m = _MARKUP.search(page, at)
        piece = html.unescape(page[at:m.start() if m else end])
        if piece:
            text.append(piece)
            if in_link:
                links += len(" ".join(piece.split()))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if not tag:
            continue
        if not closing and tag in _RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            text.append(" ")
        elif tag in _BLOCKS:
            flush()
            if tag in _CONTAINERS:
                while closing and open_[tag]:
                    last, bad, article = stack.pop()
                    numbers.pop()
                    open_[last], n_bad, n_article = open_[last] - 1, n_bad - bad, n_article - article
                    closing = last != tag
                if not (m[1] or m[4]):
                    names, page_level = _names(attributes), tag in ("html", "body")
                    whole = _names(attributes, r"\s+")
                    marks = not page_level and (tag in ("article", "main") or "main" in whole)
                    if marks:
                        for k in reversed(numbers):
                            if k in around:
                                break
                            around.add(k)
                    article = not page_level and (marks or "main" in names)
                    if marks or opened in wraps:
                        names = whole
                    elif (names & _NAMED and not whole & _NAMED) or (names & _HEADS and not whole & _HEADS):
                        by_part.add(opened)
                    named = _box(attributes) if n_article and not marks else bool(names & _NAMED)
                    bad = not page_level and (tag in _PARTS or tag == "head" or named or bool(_HIDDEN.search(attributes))
                                              or not n_article and (tag == "header" or bool(names & _HEADS)))
                    numbers.append(opened)
                    opened += 1
                    stack.append((tag, bad, article))
                    open_[tag], n_bad, n_article = open_[tag] + 1, n_bad + bad, n_article + article
            elif not closing and attributes:
                bad_block = (_box(attributes) if n_article else bool(_names(attributes) & _NAMED)) or bool(_HIDDEN.search(attributes))
    flush()
    return out if wraps or not around & by_part else blocks(page, frozenset(around))


def labels(found: list[tuple[str, int, bool, bool]]) -> list[int]:
    marked = any(article and not bad for _, _, bad, article in found)
    first = []
    for text, links, bad, article in found:
        words = text.split()
        stop = sum(w.lower().strip(".,;:!?\"'()") in _STOP for w in words) / len(words)
        if bad or (marked and not article) or (links > LINKS * len(text)):
            first.append(BAD)
        elif marked:
            first.append(GOOD if len(text) >= SHORT or stop >= SOME_STOP else NONE)
        elif len(text) < SHORT:
            first.append(NONE)
        else:
            first.append(GOOD if stop >= MANY_STOP or (len(text) >= LONG and (links == 0 or stop >= SOME_STOP)) else NONE if links == 0 or stop >= SOME_STOP else BAD)
    fixed = [label != NONE or (marked and not block[3]) for label, block in zip(first, found, strict=True)]
    n, before, after = len(first), [-1] * len(first), [len(first)] * len(first)
    for k in range(1, n):
        before[k] = k - 1 if fixed[k - 1] else before[k - 1]
    for k in range(n - 2, -1, -1):
        after[k] = k + 1 if fixed[k + 1] else after[k + 1]
    out = list(first)
    for k, label in enumerate(first):
        if label == NONE:
            near = before[k] if before[k] >= 0 and (after[k] == n or k - before[k] <= after[k] - k) else after[k]
            # beyond the edge of the article lies no judgement on it
            out[k] = GOOD if near == n or (marked and not found[near][3]) else first[near]
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, label in zip(found, labels(found), strict=True) if label == GOOD)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: ``key``, ``url``, ``text`` and ``n_chars``, its code points."""
    schema = T.StructType([T.StructField("key", pages.schema[key].dataType), T.StructField("url", pages.schema[url].dataType),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batch):
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        yield {"key": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return per_batch(pages.select(pages[key].alias("key"), pages[url].alias("url"), pages[source].alias("html")), run, schema).withColumnsRenamed({"key": key, "url": url})
