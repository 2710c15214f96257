"""HTML extraction by tag-path ratios.

Every text block of a page belongs to a root-to-leaf tag path (block-level tags only, so unclosed inline
markup does not split paths). Per path the text length and the punctuation count are summed over its blocks;
their ratios to the number of blocks are smoothed, along the page (a Gaussian over neighbouring blocks) and
along the tree (paths share with those under the same parent and, less by level, near ancestors; lists and tables cost nothing), fused into one
score and held against a threshold, inside article and main elements as elsewhere. Tags and names are factors of the
score: paths outside article and main count a quarter, those marked as surroundings a twentieth. A mark is a step of
the path of its own (``div!``); it says nothing about an article or main in it, nor, on a page without these, about
most of the page's text. Blocks under paths that pass form the main text.

Defined cases: null or empty html gives an empty text; html without any tag is one block; unclosed comments,
tags and scripts reach to the end; repeated rows give equal results; extra columns are ignored. Time and
memory are linear in the page, however deep its elements nest and whatever it leaves open.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendwright.llm.common import blocks

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg object annotation annotation-xml".split())
#: Shown inside a line, so they end no block, whatever they hold; none of their text is read.
CONTROLS = frozenset("button select canvas audio video map datalist".split())
#: Never part of an article, whatever their text looks like.
DROPPED = RAW | CONTROLS | {"head"}
#: Marked as surroundings.
AROUND = frozenset("nav footer aside form menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
                   "math semantics mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split())  # fmt: skip
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd".split())
CONTAINER = frozenset("article main section div td body html".split())
#: Words in class, id or role names that mark what surrounds an article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice outbrain pager pagination "
    "popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidenav signup skip social "
    "sponsor sponsored subscribe taboola teaser toolbar topbar widget widgets navigationbar contentinfo complementary alert alertdialog".split()
)
#: Name and attributes; a quote opens a value after = alone, as in browsers, so an odd one is part of a name. No part gives back what it took.
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""")
TAG_BEGINS, LOOSE_TAG = re.compile(r"</?[A-Za-z]"), re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
#: Tags of a page that may search it to its end for their own; after so many, tags end at the first >.
MOST_ODD = 16
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.IGNORECASE | re.ASCII) for tag in RAW}
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|([^\s=/\"'>]+)")
NAME_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?。，、；？！]")
SPACE = re.compile(r"\s+")
#: Levels of ancestors that a path shares with, and what is left of a share a level up: lists and tables only wrap, plain wrappers cost less.
NEAR = 8
SHARE = dict.fromkeys("ul ol dl table thead tbody tfoot tr".split(), 1.0) | {"div": 0.75}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _cue(tag: str, attributes: str) -> str:
    """"drop" for an element that is not text to read, "mark" for one that its tag, class, id or role call surroundings, else ""."""
    if tag in DROPPED:
        return "drop"
    found = "mark" if tag in AROUND else ""
    if not attributes or tag in ("html", "body", "article", "main") or tag in INLINE and tag not in ("span", "a"):
        return found
    for m in ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or m[3] or "").lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return "drop"
        if name in ("class", "id", "role") and any(p.lower() in NOISE for p in NAME_PART.findall(value)):
            found = "mark"
    return found


class PathTree:
    """Tag paths as numbers: each has its parent's number and its last step; 0 is the empty path."""

    def __init__(self) -> None:
        self.parents, self.steps = [0], [""]
        self.depths = [0]
        self._known: dict[tuple[int, str], int] = {}

    def child(self, path: int, step: str) -> int:
        found = self._known.get((path, step))
        if found is None:
            found = self._known[path, step] = len(self.parents)
            self.parents.append(path)
            self.steps.append(step)
            self.depths.append(self.depths[path] + 1)
        return found

    def near(self, path: int) -> list[tuple[int, float]]:
        """The parent and the ancestors up to NEAR levels above the path, with the part of a score that is shared there; the empty path is its own."""
        out, part = [], 1.0
        for _ in range(min(NEAR, max(1, self.depths[path]))):
            if out:
                part *= SHARE.get(self.steps[path], 0.5)
            path = self.parents[path]
            out.append((path, part))
        return out


#: Groups of elements that end the open one of their group when they begin, and the tags that bar the way to it. The first is ended by CLOSES_P.
ENDS = [("p", (*CONTAINER, "table", "blockquote")), ("li", ("ul", "ol", "menu")), ("dt dd", ("dl",)), ("tr", ("table",)), ("td th", ("tr", "table"))]
GROUP_OF = {tag: g for g, (same, _) in enumerate(ENDS) for tag in same.split()}
BARRED_BY = {tag: [g for g, (_, until) in enumerate(ENDS) if tag in until] for tag in {t for _, until in ENDS for t in until}}
NOTHING_OPEN = (-1,) * len(ENDS)


def page_blocks(page: str) -> tuple[list[tuple[int, str, int]], PathTree]:
    """(path, text, characters of it in links) of each text block in page order, without dropped elements; marked ones have a ! in the path.

    A named span or link is a part of its block; a block more than half of which stands in such (code apart) has a marked step of its own.
    """
    tree = PathTree()
    # open block elements: tag, dropped, path of the element before it, and the nearest element that each group of ENDS would end
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = []
    open_tags: dict[str, int] = {}
    inline: dict[str, list[str]] = {}  # cues of open inline elements of the innermost block: none reaches over the next one
    out, parts, links = [], [], 0
    chars = named_chars = named = code = 0  # of the block's characters, those in named inline elements; how many such are open
    path = noisy = of_path = 0

    def flush(ended: bool = False) -> None:
        """Ends the block, but not from inside an element whose text isn't read, unless the page has ended."""
        nonlocal parts, links, chars, named_chars
        if parts and (ended or not noisy):
            text = SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                out.append((tree.child(of_path, "span!") if 2 * named_chars > chars else of_path, text, links))
            parts, links, chars, named_chars = [], 0, 0, 0

    def add(text: str) -> None:
        nonlocal of_path, links, chars, named_chars
        if not parts:
            of_path = path
        parts.append(text)
        chars += len(text)
        if inline.get("a"):
            links += len(text)
        if named and not code and not inline.get("code"):
            named_chars += len(text)

    def close_inline() -> None:
        nonlocal noisy, named
        if inline:
            noisy -= sum(x.count("drop") for x in inline.values())
            named = 0
            inline.clear()

    def pop(to: int) -> None:
        nonlocal noisy, path, code
        close_inline()
        while len(stack) > to:
            tag, bad, path, _ = stack.pop()
            noisy -= bad
            code -= tag == "pre"
            open_tags[tag] -= 1

    at, end, odd = 0, len(page), 0
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and not noisy:
            add(page[at:lt])
        if lt == end:
            break
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = TAG.match(page, lt) if odd < MOST_ODD else None
        if not m:
            if TAG_BEGINS.match(page, lt):
                close = page.find(">", lt)
                if close < 0:
                    break  # a tag that never ends
                odd += 1  # no > but in values
                m = LOOSE_TAG.match(page[lt : close + 1])
                at = close + 1
            if not m:
                if not noisy:
                    add("<")
                at = lt + 1
                continue
        else:
            at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if closing:
            if tag in INLINE:
                if inline.get(tag):
                    cue = inline[tag].pop()
                    noisy -= cue == "drop"
                    named -= cue == "mark"
                continue
            if open_tags.get(tag):
                flush()
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop(k)
                if tag not in CONTROLS:
                    flush()  # what a control left open had held back
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            if not attributes.endswith("/"):  # not shown, so it ends no block
                close = RAW_END[tag].search(page, at)
                close = page.find(">", close.start()) if close else -1
                at = end if close < 0 else close + 1
            continue
        if tag == "br":
            if not noisy:
                add(" ")
            continue
        if tag in INLINE:
            if tag == "img" or attributes.endswith("/") and tag.startswith("m"):
                continue
            cue = _cue(tag, attributes)
            inline.setdefault(tag, []).append(cue)
            noisy += cue == "drop"
            named += cue == "mark"
            continue
        if tag not in CONTROLS:
            flush()
            group = GROUP_OF.get(tag, 0)
            for g in {0, group} if tag in CLOSES_P else {group} if group else ():
                if stack and stack[-1][3][g] >= 0:
                    pop(stack[-1][3][g])
                    flush()
        if tag in VOID:
            continue
        if tag not in CONTROLS:
            close_inline()
        cue = _cue(tag, attributes) or ("mark" if tag == "header" and not open_tags.get("article") and not open_tags.get("main") else "")
        bad = cue == "drop"
        near = stack[-1][3] if stack else NOTHING_OPEN
        if tag in BARRED_BY or tag in GROUP_OF:
            changed = list(near)
            for g in BARRED_BY.get(tag, ()):
                changed[g] = -1
            if tag in GROUP_OF:
                changed[group] = len(stack)
            near = tuple(changed)
        stack.append((tag, bad, path, near))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        noisy += bad
        code += tag == "pre"
        path = tree.child(path, f"{tag}!" if cue == "mark" else tag)
    flush(ended=True)
    return out, tree


def path_scores(found: list[tuple[int, str, int]], tree: PathTree, width: float = 1.0) -> dict[int, float]:
    """Fused score of each tag path: text and punctuation per block, smoothed over the page and the tree."""
    sums: dict[int, list[float]] = {}
    for path, text, links in found:
        x = sums.setdefault(path, [0, 0, 0, 0])
        x[0] += len(text)
        x[1] += len(PUNCTUATION.findall(text))
        x[2] += 1
        x[3] += min(links, len(text))
    raw = {p: (x[0] / x[2]) * (1 + x[1] / x[2]) * (1 - x[3] / x[0]) for p, x in sums.items()}
    # along the page
    kernel = [math.exp(-(k * k) / (2 * width * width)) for k in range(-2, 3)]
    along: dict[int, list[float]] = {}
    line = [raw[p] for p, _, _ in found]
    for i, (path, _, _) in enumerate(found):
        near = [(kernel[k + 2], line[i + k]) for k in range(-2, 3) if 0 <= i + k < len(line)]
        x = along.setdefault(path, [0, 0])
        x[0] += sum(w * v for w, v in near) / sum(w for w, _ in near)
        x[1] += 1
    # along the tree: the best score under the same parent, or under an ancestor up to NEAR levels above it
    under: dict[int, float] = {}
    for p, v in raw.items():
        for above, part in tree.near(p):
            under[above] = max(under.get(above, 0), v * part)
    shared = {p: max(under[above] * part for above, part in tree.near(p)) for p in raw}
    cues = path_cues({p: x[0] - x[3] for p, x in sums.items()}, tree)
    return {p: (0.5 * raw[p] + 0.25 * along[p][0] / along[p][1] + 0.25 * shared[p]) * (1 - sums[p][3] / sums[p][0]) ** 2 * cues[p] for p in raw}


def path_cues(chars: dict[int, int], tree: PathTree) -> dict[int, float]:
    """The factor that tags and names give each path. chars: characters outside links of each path."""
    size = len(tree.parents)
    article = [step in ("article", "main") for step in tree.steps]
    inside = article[:]
    held = [0] * size  # characters under each path, but for those in an article or main below it
    for p, n in chars.items():
        held[p] += n
    for p in range(size - 1, 0, -1):  # parents have lower numbers
        if not article[p]:
            held[tree.parents[p]] += held[p]
    for p in range(1, size):
        inside[p] = article[p] or inside[tree.parents[p]]
    any_article = any(inside[p] for p in chars)
    most = sum(chars.values()) / 2
    marked = [False] * size
    for p in range(1, size):
        marked[p] = not article[p] and (marked[tree.parents[p]] or tree.steps[p].endswith("!") and (any_article or held[p] <= most))
    return {p: (1 if inside[p] else 0.25) * (0.05 if marked[p] else 1) for p in chars}


def main_text(page: str | None, threshold: float = 0.1) -> str:
    """The blocks under paths whose score reaches ``threshold`` times the best one, joined by line feeds."""
    if not page:
        return ""
    found, tree = page_blocks(page)
    if not found:
        return ""
    scores = path_scores(found, tree)
    cut = threshold * max(scores.values())
    kept = {p for p, s in scores.items() if s >= cut}
    return "\n".join(text for path, text, _ in found if path in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames, column="html"):
            text = [main_text(h) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = pages.schema[id_col].dataType.simpleString()
    cols = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return cols.mapInPandas(work, f"page_id {kind}, url string, text string, n_chars long")
