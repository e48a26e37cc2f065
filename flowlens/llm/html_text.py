"""HTML extraction by line-block distribution.

Markup is stripped into lines of text: a line ends at a block tag or <br>, and a tag that opens or closes a container
leaves an empty line, and one that opens or closes a holder (a <div> and the like) as many as the window is long, so that a
block never runs from one into the next. Elements that never hold main text (menus, scripts, forms, and what a class, id or role names as
such) leave nothing; of a form around text only controls and labels are dropped. A name that holds such a word among
others (`market-share`) only lowers the weight of its lines.

The weights of the lines, their characters outside links, are summed over a sliding window. The page's own sums set the
threshold: half the mean of those that are not zero. A surge point is where the sum leaves zero on its way over the
threshold, a dive point where it is back at zero. The text between a surge and its dive is a stretch of main text; all
text of the innermost container is kept that holds all stretches, so an article that tables, lists and sections cut stays
whole; holders with attributes that lie in it before the first stretch or after the last hold something else. Names that only suggest what a
container is lower the weight of its lines and decide nothing alone.

An <article> or <main> that holds at least half as much as the heaviest stretch is taken at its word: all of the outermost
one with most text is kept, and of those beside it that are at least half as long.
"""

from __future__ import annotations

import os.path
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.session import ship

WINDOW = 3
#: A form with a line of so many characters is around text.
PROSE = 80
#: What a line weighs whose container has a doubtful name.
DOUBTFUL = 0.25

#: HTML's element kinds as far as they matter here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article aside body center content div dl fieldset footer header html main nav ol section table tbody td th tr ul".split())
MAIN = frozenset("article main".split())
#: Containers that hold a whole article; tables, lists and sections are parts of one.
HOLDERS = frozenset("center content div fieldset".split())
RAW = ("script", "style", "textarea", "xmp")  # of these, an open one holds all that follows
OBJECTS = ("noscript", "template", "svg", "math", "canvas", "object", "iframe")
DROPPED = frozenset("head title nav footer aside form button select option datalist dialog menu menuitem audio video map".split())
#: Words of a class, id or role that name something other than main text.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot alert banner banners billboard breadcrumb breadcrumbs "
    "captcha comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus dropdown "
    "feedback footer form gdpr login masthead megamenu menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination paywall popup promo promoted promotion recommended related remarks replies reply respond responses search share sharing shoutbox "
    "sidebar sidenav signup skip social sponsor sponsored subscribe subscription tagcloud teaser toast toc toolbar topbar tracking trending widget widgets".split())
#: The same, only outside an article: inside one these hold its own title.
OUTSIDE = frozenset("header banner".split())
#: Words that name a part of a page's layout and nothing else; with one of the above they make a name of that.
LAYOUT = frozenset(
    "area article articles bar block body bottom box btn button buttons center col column container content cta desktop fixed float full global google group head "
    "heading horizontal icon icons inline inner item items js left link links list main message mobile module outer page panel post posts primary right row secondary section "
    "site slot small sticky tab tabs text title top unit ui vertical view wrap wrapper".split())
#: Words of the above that say so beside any other word, but for those that tell a state (`comments-open`).
PLAIN = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adslot breadcrumb breadcrumbs comment comments commentlist disqus navbar sidebar".split())
STATES = frozenset("allowed closed count disabled enabled has no off on open with without".split())
#: Words that suggest something other than main text: they lower the weight of lines outside an article.
SUGGESTING = frozenset("about address author bio byline colophon contact credits extra foot hint imprint info legal license meta policy privacy related terms tools utility".split())
#: Words that a part of an article may be about; a <section> with such an id in a marked article stays if it is prose.
SUBJECTS = frozenset("copyright discussion disclaimer related remarks replies responses search share sharing tracking".split())

_NOISE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(?:" + "|".join(OBJECTS) + r")\b[^>]*/>|<(" + "|".join(OBJECTS) + r")\b[^>]*>.*?</\2\s*>|<[!?][^>]*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)/?>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)([^<>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"'>]++)))?")  # whole names, from left to right
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BLOCK = re.compile(r"<(?:article|main|p|h[1-6])\b", re.I)
_CONTROL = re.compile(r"<(label|legend|button|select|datalist)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_ENTRY = re.compile(r"<(?:article|cite|form|li|textarea|time)\b|\b(?:author|avatar|comment|reply|user)", re.I)
_SECTION = re.compile(r"<(/?)section\b", re.I)
_FORM_END = re.compile(r"</form\b", re.I)


def _wraps_page(html: str, start: int) -> bool:
    """Whether the form that opens before start holds text: an article, a paragraph, a heading or a line of prose."""
    end = _FORM_END.search(html, start)
    held = html[start:end.start() if end else len(html)]
    return bool(_BLOCK.search(held)) or any(len(" ".join(x.split())) >= PROSE for x in re.split("<[^>]*>", _CONTROL.sub("<br>", held)))


def _is_prose_section(html: str, start: int) -> bool:
    """Whether the <section> whose tag ends at start holds prose: at least a line of it, mostly outside links, and nothing that looks
    like entries by readers."""
    depth, end = 1, len(html)
    for tag in _SECTION.finditer(html, start):
        depth += -1 if tag[1] else 1
        if depth == 0:
            end = tag.start()
            break
    held = html[start:end]
    if _ENTRY.search(held):
        return False
    plain = lambda x: len(" ".join(re.sub("<[^>]*>", " ", x).split()))
    outside = plain(re.sub(r"<a\b.*?(?:</a\s*>|\Z)", " ", held, flags=re.S | re.I))
    return outside >= PROSE and 2 * outside > plain(held)


def _named(value: str, words: frozenset[str]) -> tuple[bool, bool]:
    """Whether a class, id or role has a name made of these words, and whether one holds such a word among others."""
    doubtful = False
    for name in value.split():
        parts = _WORDS.findall(_CAMEL.sub(" ", name).lower())
        hits = [p for p in parts if p in words]
        if hits and not STATES.isdisjoint(parts):
            continue
        if hits and (len(parts) == len(hits) + sum(p in LAYOUT and p not in words for p in parts) or not PLAIN.isdisjoint(hits)):
            return True, False
        doubtful |= bool(hits) or not SUGGESTING.isdisjoint(parts)
    return False, doubtful


def _is_subject(attributes: str) -> bool:
    """Whether an element's id, and no class or role, is what speaks against it, and is one of SUBJECTS."""
    found = {key.lower(): a or b or c for key, a, b, c in _ATTRIBUTE.findall(attributes)}
    return found.get("id", "").lower() in SUBJECTS and "class" not in found and "role" not in found and "hidden" not in found and "style" not in found and "aria-hidden" not in found


def _is_boilerplate(name: str, attributes: str, inside: bool, wraps: bool = False) -> tuple[bool, bool]:
    """Whether an element is dropped, and whether its name is doubtful. wraps: it is a form around text, which is kept
    unless an attribute names more than a form."""
    if name in DROPPED and not wraps or (name == "header" and not inside):
        return True, False
    if not attributes or name in ("html", "body") or name in MAIN and "comment" not in attributes.lower():
        return False, False
    words = BOILERPLATE - OUTSIDE if inside else BOILERPLATE | OUTSIDE
    doubtful = False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True, False
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False
        elif key in ("class", "id", "role"):
            drops, unsure = _named(value, words - {"form"} if wraps else words)
            if drops:
                return True, False
            doubtful |= unsure
    return False, doubtful


def page_lines(html: str) -> list[tuple[str, float, int, tuple[int, ...]]]:
    """The page as lines: text, its weight (characters outside links; inside a marked article all), the number of the
    outermost <article> or <main> it is in (0: none), and the HOLDERS around it, by number (those with attributes below zero)."""
    html = _NOISE.sub(lambda m: "" if m[1] is None and m[2] is None else "<br>", html)
    lines: list[tuple[str, float, int, tuple[int, ...]]] = []
    piece: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements; whether they drop what they hold; whether their name is doubtful
    opened: Counter[str] = Counter()
    dropping = links = inside = count = doubts = 0
    mains: list[int] = []
    path: list[int] = []
    holders = spared = 0  # spared: how deep the section lies that is kept although its name is one of SUBJECTS

    def flush() -> None:
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            if text:
                out = len("".join(text.split())) - len("".join(unescape("".join(linked)).split()))
                lines.append((text, len(text) if inside else max(0, out) * (DOUBTFUL if doubts else 1), inside, tuple(path)))
            piece.clear()
            linked.clear()

    def pop() -> None:
        nonlocal dropping, links, inside, doubts
        nonlocal spared
        if spared == len(stack):
            spared = 0
        name, drops, doubt = stack.pop()
        opened[name] -= 1
        dropping -= drops
        doubts -= doubt
        links -= name == "a"
        if name in HOLDERS:
            flush()
            path.pop()
            lines.extend([("", 0, inside, tuple(path))] * WINDOW)
        if name in MAIN and not drops and not dropping and mains:
            flush()
            lines.extend([("", 0, 0, ())] * WINDOW)
            mains.pop()
            inside = mains[-1] if mains else 0

    at = 0
    for tag in _TAG.finditer(html):
        if not dropping and tag.start() > at:
            piece.append(html[at:tag.start()])
            if links:
                linked.append(html[at:tag.start()])
        at = tag.end()
        close, name, attributes = (tag[1], tag[2].lower(), tag[3]) if tag[2] else (tag[4], tag[5].lower(), tag[6])
        if name not in INLINE and not dropping:
            flush()
            if name in CONTAINERS:
                lines.append(("", 0, inside, tuple(path)))
        if close:
            if opened[name] > 0:
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name not in VOID:
            if name not in INLINE and stack:  # a block tag ends an open paragraph; an item ends the item before
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == "p" or stack[depth][0] == name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                        while len(stack) > depth:
                            pop()
                        break
                    if stack[depth][0] not in INLINE:
                        break
            wraps = name == "form" and not dropping and _wraps_page(html, at)
            drops, doubt = _is_boilerplate(name, attributes or "", bool(inside), wraps)
            if drops and name == "section" and inside and not dropping and spared == 0 and _is_subject(attributes or "") and _is_prose_section(html, at):
                drops, spared = False, len(stack) + 1
            drops |= name in ("label", "legend") and opened["form"] > 0
            stack.append((name, drops, doubt))
            opened[name] += 1
            dropping += drops
            doubts += doubt
            links += name == "a"
            if name in HOLDERS:
                holders += 1
                path.append(-holders if attributes and attributes.strip() else holders)
                lines.extend([("", 0, inside, tuple(path))] * WINDOW)
            if name in MAIN and not dropping:
                lines.extend([("", 0, 0, ())] * WINDOW)
                if not mains:
                    count += 1
                mains.append(count)
                inside = count
    if not dropping and at < len(html):
        piece.append(html[at:])
        if links:
            linked.append(html[at:])
    flush()
    return lines


def stretches(weight: np.ndarray) -> list[tuple[int, int, float]]:
    """The surge and dive points that enclose main text, and what lies between them: first line, end line, weight."""
    n = len(weight)
    total = np.concatenate([[0], np.cumsum(np.concatenate([weight, np.zeros(WINDOW)]))])
    sums = total[WINDOW:] - total[:-WINDOW]
    sums = np.concatenate([[0], np.where(sums[:n] > 1e-6, sums[:n], 0), [0]])
    if not sums.any():
        return []
    threshold = sums[sums > 0].mean() / 2
    surge = np.flatnonzero((sums[1:] > 0) & (sums[:-1] == 0))
    dive = np.flatnonzero((sums[1:] == 0) & (sums[:-1] > 0))
    return [(a, min(b, n), float(total[b] - total[a])) for a, b in zip(surge.tolist(), dive.tolist(), strict=True) if sums[a + 1:b + 1].max() >= threshold]


def main_text(html: str | None) -> str:
    """The main text of a page; empty if it has none or html is None."""
    lines = page_lines(html or "")
    if not lines:
        return ""
    marked: dict[int, float] = {}
    for _, size, mark, _ in lines:
        if mark and size:
            marked[mark] = marked.get(mark, 0) + size
    found = stretches(np.array([0 if x[2] else x[1] for x in lines], float))
    most = max(marked.values(), default=0)
    if marked and 2 * most >= max((x[2] for x in found), default=0):
        return " ".join(x[0] for x in lines if x[0] and 2 * marked.get(x[2], 0) >= most)
    if not found:
        return ""
    inside = np.zeros(len(lines), bool)
    for first, last, _ in found:
        inside[first:last] = True
    around = os.path.commonprefix([x[3] for x, main in zip(lines, inside, strict=True) if main and x[1]])
    held = {x[3][:len(around) + 1] for x, main in zip(lines, inside, strict=True) if main and x[1]}  # holders right below that have a stretch
    own = [(x[3][:len(around)] == around, x, main) for x, main in zip(lines, inside, strict=True)]
    edges = [i for i, (near, x, main) in enumerate(own) if near and main and x[1]]
    kept = [x for i, (near, x, _) in enumerate(own) if near and (edges[0] <= i <= edges[-1] or x[3] == around or x[3][:len(around) + 1] in held or x[3][len(around)] > 0)]
    solid = [i for i, x in enumerate(kept) if x[1]]
    first, last = solid[0], solid[-1] + 1
    while first and kept[first - 1][0] and kept[first - 1][3] == kept[first][3]:  # lines that are links alone, right beside
        first -= 1
    while last < len(kept) and kept[last][0] and kept[last][3] == kept[last - 1][3]:
        last += 1
    return " ".join(x[0] for x in kept[first:last] if x[0])


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of `keep`, text and n_chars (code points) of every page. A null or empty page, and one that is only
    markup, gives an empty text. A very long page is one row of a task. Of equally long articles side by side all are kept.
    Repeated rows are each extracted; other columns of pages are not read."""
    ship(pages.sparkSession)
    base = pages.select(*keep, F.col(html_col).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                texts = [main_text(x) for x in rows.column(rows.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    kinds = dict(base.dtypes)
    return base.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long")
