"""Main text of web pages by two-pass block rules.

First pass: each block of text is good, bad or ambiguous by its link density, length and
density of stop words; blocks in containers of site furniture (menus, adverts, forms,
footers, comments) are bad. Second pass: ambiguous blocks take the label of their nearest
decided neighbours, the earlier one on a tie; inside the page's article they take it only
from blocks of the article that are not site furniture, and are good if it has no decided block.
Text without a known stop word is not bad for that; on a page whose longer texts have too
few on the whole (another language) length and links decide.

A null or empty page has the empty text. Markup that never closes, repeated rows and very
long pages need nothing special: one pass over the tags, linear whatever is broken; memory as one page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small

#: Frequent function words of English, French, German, Spanish, Italian and Portuguese.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by can do for from had has have he her his i if in into is it its more no not of
    on or our she so than that the their them then there these they this to up was we were what when which who will
    with would you your
    au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais me même mes ne nos notre nous
    on ou où par pas pour qu que qui sa se ses son sont sur ta te tu un une vos votre vous
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat
    ich ihr im in ist kann man mit nach nicht noch nur oder sein sich sie sind über um und von vor war was wenn wie wir
    zu zum zur
    al como con cual de del desde donde e el ella en entre era es esta este fue ha hay la las le lo los más me mi muy
    no o para pero por que se ser si sin sobre su sus también un una y ya
    che da dei della di gli il nel non per si sono
    ao com da das do dos em foi mais na não nos os pela pelo são seu sua uma
    """.split()
)
#: Elements whose text is never content.
SKIPPED = frozenset("aside button canvas footer form head header iframe input math menu nav noscript object option script select style svg template textarea title".split())
#: Skipped elements whose content is raw text: tags inside them do not count.
RAW = frozenset("script style textarea title".split())
#: Elements that break the text into blocks.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre section select summary svg table tbody td template textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset("article main".split())
#: A class, id or role with one of these words marks site furniture.
FURNITURE = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo related replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
MOST_LINKS, FEW_LINKS = 0.5, 0.2
SHORT, LONG, LOW_STOP, HIGH_STOP = 70, 200, 0.12, 0.25

_tag_name = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_quote_or_end = re.compile("[>\"']")
_raw_end = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_marks = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_hidden = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_name_parts = re.compile(r"[^a-z]+")
_space = re.compile(r"\s+")
_letters = re.compile(r"[^\W\d_]+")


def _furniture(attributes: str) -> bool:
    if not attributes:
        return False
    if _hidden.search(attributes):
        return True
    for m in _marks.finditer(attributes):
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", m.group(1)).lower()
        if any(x in FURNITURE for x in _name_parts.split(value)):
            return True
    return False


class _Tags:
    """The tags of a page in order; each place is looked at a bounded number of times."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.next = {">": -1}  # where it was last found
        self.dead: set[int] = set()  # places behind a quoted value from which no tag ends

    def find(self, mark: str, at: int) -> int:
        """The first ``mark`` from ``at`` on, or the page's length; asked with rising places it never goes over one twice."""
        if self.next[mark] < at:
            found = self.html.find(mark, at)
            self.next[mark] = len(self.html) if found < 0 else found
        return self.next[mark]

    def end(self, at: int) -> int:
        """The ``>`` that ends a tag whose attributes begin at ``at``; -1 if none follows at all.

        A ``>`` in quotes ends none, unless the quotes swallow every one up to the page's end.
        """
        html, seen = self.html, []
        first = self.find(">", at)
        if first == len(html):
            return -1
        while True:
            m = _quote_or_end.search(html, at)
            if not m:
                break
            if m.group() == ">":
                return m.start()
            at = html.find(m.group(), m.end()) + 1
            if not at or at in self.dead:
                break
            seen.append(at)
        self.dead.update(seen)
        return first

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """``(start, end, name, closing, attributes)``; comments and declarations have no name."""
        html, at = self.html, 0
        n = len(html)
        while True:
            start = html.find("<", at)
            if start < 0:
                return
            if html.startswith(("<!", "<?"), start):
                if html.startswith("<!--", start):
                    end = html.find("-->", start + 4)
                    at = n if end < 0 else end + 3
                elif html.startswith("<![CDATA[", start):
                    end = html.find("]]>", start + 9)
                    at = n if end < 0 else end + 3
                elif (end := self.find(">", start)) < n:
                    at = end + 1
                else:
                    at = start + 1
                    continue
                yield start, at, "", False, ""
                continue
            m = _tag_name.match(html, start)
            end = self.end(m.end()) if m else -1
            if end < 0:
                at = start + 1  # a bare sign
                continue
            at = end + 1
            skip = yield start, at, m.group(2).lower(), bool(m.group(1)), html[m.end() : end]
            if skip is not None:
                at = skip


def blocks(html: str) -> Iterator[tuple[str, int, bool, int]]:
    """``(text, characters in links, in furniture, article number or 0)`` for each block."""
    parts: list[str] = []
    links = 0
    open_: list[tuple[str, bool, int]] = []  # name, furniture from here, article number before
    depth: Counter[str] = Counter()
    bad, article, articles, in_link = 0, 0, 0, 0
    at, n = 0, len(html)

    def add(raw: str) -> int:
        if raw:
            parts.append(raw)
        return len(raw.strip()) if in_link else 0

    def close() -> str:
        nonlocal bad, article
        top, was_bad, before = open_.pop()
        depth[top] -= 1
        bad -= was_bad
        article = before if top in ARTICLE else article
        return top

    tags = iter(_Tags(html))
    step = next(tags, None)
    while step is not None:
        start, end, name, closing, attributes = step
        skip = None
        links += add(html[at:start])
        at = end
        if name in BLOCKS:
            if parts and (text := _space.sub(" ", unescape("".join(parts))).strip()):
                yield text, links, bad > 0, article
            parts, links = [], 0
        if not name:
            pass
        elif closing:
            if name == "a":
                in_link = 0
            elif depth[name]:
                while close() != name:
                    pass
        elif name == "a":
            in_link = 1
        elif name in RAW:
            found = _raw_end[name].search(html, at)
            at = skip = found.end() if found else n
        elif name not in VOID and (name in BLOCKS or not attributes.endswith("/")):
            if name == "p":  # a paragraph ends where the next begins
                while open_ and open_[-1][0] in ("p", "b", "i", "em", "strong", "span"):
                    close()
            marked = name in SKIPPED or name not in ("html", "body") and _furniture(attributes)
            if name == "header" and article and not _furniture(attributes):
                marked = False  # the article's own heading
            if name in BLOCKS or marked:
                open_.append((name, marked, article))
                depth[name] += 1
                bad += marked
                if name in ARTICLE and not bad:
                    articles += 1
                    article = articles
        try:
            step = tags.send(skip) if skip is not None else next(tags)
        except StopIteration:
            break
    links += add(html[at:])
    if parts and (text := _space.sub(" ", unescape("".join(parts))).strip()):
        yield text, links, bad > 0, article


GOOD, BAD, AMBIGUOUS = 1, 0, -1


def _stop_words(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = _letters.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def _foreign(found: list[tuple[str, int, bool, int]]) -> bool:
    """Whether the longer texts of a page, without furniture and links, have too few stop words."""
    counts = [_stop_words(t) for t, k, bad, _ in found if not bad and len(t) >= SHORT and k <= FEW_LINKS * len(t)]
    return sum(x[0] for x in counts) < LOW_STOP * sum(x[1] for x in counts)


def classify(text: str, links: int, furniture: bool, in_article: bool, foreign: bool = False) -> int:
    """First pass over one block; ``foreign``: of a page that stop words tell nothing about."""
    if furniture:
        return BAD
    density = links / max(1, len(text))
    if density > MOST_LINKS:
        return BAD
    if foreign:
        return GOOD if len(text) >= SHORT and density <= FEW_LINKS else AMBIGUOUS
    known, n_words = _stop_words(text)
    stop = known / max(1, n_words)
    if len(text) >= SHORT and stop >= LOW_STOP and density <= FEW_LINKS and (len(text) >= LONG or stop >= HIGH_STOP):
        return GOOD
    if in_article or len(text) < SHORT or stop >= LOW_STOP or not known:
        return AMBIGUOUS
    return BAD


def main_text(html: str) -> str:
    """The article's text: its blocks in page order, one space between them."""
    found = list(blocks(html))
    foreign = _foreign(found)
    labels = [classify(t, k, bad, bool(article), foreign) for t, k, bad, article in found]
    homes = [x[3] for x in found]

    def nearest(step: int) -> list[tuple[int, int]]:
        """Distance in blocks to the last decided block in this direction of the same article, and its label."""
        out, last = [(0, AMBIGUOUS)] * len(found), {}
        for i in range(len(found))[::step]:
            if labels[i] != AMBIGUOUS:
                if not (homes[i] and found[i][2]):  # furniture says nothing about an article's text
                    last[homes[i]] = i
            elif homes[i] in last:
                k = last[homes[i]]
                out[i] = (abs(i - k), labels[k])
        return out

    before, after = nearest(1), nearest(-1)
    kept = []
    for i, (text, *_) in enumerate(found):
        label = labels[i]
        if label == AMBIGUOUS:
            near = [x for x in (before[i], after[i]) if x[0]]
            label = min(near, key=lambda x: x[0])[1] if near else (GOOD if homes[i] else BAD)
            if homes[i]:
                label = GOOD if not near or any(x[1] == GOOD for x in near) else label
        if label == GOOD:
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep``, text and n_chars (code points) for each row of ``pages``."""
    names = [*keep, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [main_text(x.as_py() or "") for x in batch.column(len(keep))]
            out = [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *out], names=names)

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)
    return pages.select(*keep, html).mapInArrow(run, f"{kinds}{', ' if kinds else ''}text string, n_chars bigint")
