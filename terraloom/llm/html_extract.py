"""Main text of web pages by a tree-structured graphical model over the DOM.

*Tree.* A page's block elements are the nodes; inline elements and text belong to the block around them. Elements that
are never read (scripts, styles, templates, frames and the controls of forms) are cut off with all that is in them. Formulas,
pictures' texts and image maps are inline text; dialogs, objects, media fallbacks and ``noscript`` are blocks like others.
So are forms, because whole pages are wrapped in one; their potentials speak against content, but not against what is in
them.

*Model.* Every node is content or not. A node has a potential from its tag, its words of class, id and role (each word by
a hash, and what public word lists say of whole words: strongly where a name holds nothing but such words and words of
layout, as in ``related-posts``; weakly where others are among them, as in ``search-methods``), its text's length, share of links and punctuation; an edge has one from
the two states, the child's tag, and whether the parent is the page's frame (root, html or body), in which any part may
begin. Sum-product messages go from the leaves to the root and back, and give every node the exact marginal of being
content. The text of nodes with a marginal over one half is the page's text, in page order.

*Training.* The potentials are smoothed counts over a bounded sample of labelled pages, counted by Spark: pages that mark
their main part themselves by a single ``article`` or ``main`` element label their own nodes; what such a part holds of
navigation, asides, footers, forms, and of names that say nothing but adverts, notices or comments, is labelled as not
content; everything else in it is content, whatever words its names hold. Each such page counts three times: as it is;
with the marking element as a plain ``div`` and no class words; and with the marking element taken away, its children put
in its place. So what is learned is how content looks, not how it is announced. What the tags and word lists say in general
are counts as well, of stated weights: a sample soon outweighs those of 3 nodes, but hardly what is said of navigation,
asides, footers and plain names of boilerplate, which is meant to hold. The bounds on what single features may say are
stated with them.

*Time.* A page is read once from left to right. Elements nest ``MAX_DEPTH`` deep, as in browsers; deeper ones become
neighbours, and no text is lost.

Defined results: null and empty pages give an empty text; markup that is not closed is closed as browsers do for
paragraphs, list items and table cells; a head ends at the first text or element that may not stand in it; an element that
is cut off and not closed ends with the element around it, or where another button or select begins; ``</form>`` closes
no element but the form, and a form within a form is none; text outside any element belongs to the page's root; a null page_id or url is
kept; repeated rows get equal results; extra columns pass through ``extract``; without any labelled page the prior counts
decide; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that training reads on average, at any size of the corpus.
SAMPLE = 2000
CUT = frozenset("script style template iframe button select textarea input datalist head title".split())
RAW = frozenset("script style textarea title iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = tuple("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption address hr header footer nav aside menu center details summary fieldset form dialog noscript object canvas audio video".split())
TAG = {name: k for k, name in enumerate(BLOCKS)}
OTHER = len(BLOCKS)
#: Elements by which pages mark their main part.
MARKS = frozenset((TAG["article"], TAG["main"]))
#: What a start tag closes, and where the search for it ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: What an end tag of a form closes on its way, if open last.
IMPLIED = frozenset("p li dt dd option optgroup".split())
ENDS_P = frozenset(BLOCKS) - frozenset("html body td th tr tbody thead tfoot noscript object canvas audio video".split())
#: Whole words that name boilerplate, readers' comments, and content; words of layout say nothing of either.
BOILER = frozenset(
    "nav navs navbar navigation menu menus menubar sidebar sidebars footer footers ad ads adsense advert adverts advertisement advertisements advertising banner banners promo promos promotion "
    "promotions sponsor sponsors sponsored cookie cookies consent notice notices notification notifications alert alerts share sharing social socials related recommended recommendations "
    "breadcrumb breadcrumbs subscribe subscription newsletter login signin signup popup modal masthead topbar pagination pager widget widgets toolbar skip complementary contentinfo search "
    "searchbox searchbar searchform".split()
)
COMMENT = frozenset("comment comments commentlist disqus reply replies respond guestbook".split())
CONTENT = frozenset("article articles content main post entry story body text".split())
LAYOUT = frozenset(
    "box block bar container wrap wrapper list lists item items link links area section sections inner outer row col column columns left right top bottom site page primary secondary global "
    "header head content body main post posts article articles story stories button buttons btn form icon icons group panel module unit slot text title thread form small large mobile desktop "
    "sticky fixed js to".split()
)
BOILER_TAGS = frozenset("nav aside footer menu form".split())
#: What these hold is shown where they can't be played or drawn.
MEDIA = frozenset("canvas audio video".split())
#: Containers whose tag says little about what they hold.
GENERIC = frozenset(TAG[name] for name in "div section table tbody tr td center ul ol li".split())
#: The page's frame, in which parts of any kind begin.
FRAME = frozenset((TAG["html"], TAG["body"], OTHER))
#: Elements nest no deeper, as in browsers.
MAX_DEPTH = 512
#: Buckets of class, id and role words.
WORDS = 1024

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9]*")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}", re.I) for name in RAW}
_NAMING = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def kind_of(naming: str) -> int:
    """What the names in class, id and role say: 0 nothing, 1 boilerplate, 2 comments, 3 content, 4 a word of the first two
    among others."""
    kinds = set()
    for name in naming.split():
        words = [w.lower() for w in _PART.findall(name)]
        said = BOILER.union(COMMENT).intersection([*words, "".join(words)])
        if said and all(w in BOILER or w in COMMENT or w in LAYOUT for w in words) or "".join(words) in said:
            kinds.add(2 if said & COMMENT else 1)
        else:
            kinds.add(4 if said else 3 if CONTENT.intersection(words) else 0)
    return next((k for k in (2, 1, 3, 4) if k in kinds), 0)


class _Tags:
    """Reads tags from a source in time that grows with its length: a quote that is never closed is looked for once."""

    def __init__(self, source: str):
        self.source, self.unclosed = source, set()

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The next tag or comment: start, end, closing, name (empty for comments and declarations), attributes."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            if source.startswith(("<!", "<?"), start):
                comment = source.startswith("<!--", start)
                end = source.find("-->" if comment else ">", start + 2)
                return start, len(source) if end < 0 else end + (3 if comment else 1), False, "", ""
            closing = source.startswith("/", start + 1)
            if name := _NAME.match(source, start + 1 + closing):
                end = self._end(name.end())
                return start, end, closing, name[0].lower(), source[name.end() : end - 1]
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        source = self.source
        while found := _STOP.search(source, at):
            at, mark = found.end(), found[0]
            if mark == ">":
                return at
            before = found.start() - 1
            while source[before].isspace():
                before -= 1
            if source[before] == "=" and mark not in self.unclosed:  # it begins an attribute's value
                close = source.find(mark, at)
                if close < 0:
                    self.unclosed.add(mark)
                else:
                    at = close + 1
        return len(source) + 1  # a tag that the page does not end


class Page:
    """The block tree of a page. Node 0 is the root; parents come before their children."""

    def __init__(self, source: str):
        self.parent, self.tag, self.kind, self.words = [-1], [OTHER], [0], [()]
        self.chars, self.link_chars, self.stops = [0], [0], [0]
        self.runs: list[tuple[int, str]] = []  # (node, text) in page order; a run of "\n" separates blocks
        self._parse(source)

    def _text(self, node: int, text: str, in_link: bool) -> None:
        if "&" in text:
            text = entities.unescape(text)
        self.runs.append((node, text))
        n = len(text.strip())
        self.chars[node] += n
        self.link_chars[node] += n * in_link
        self.stops[node] += text.count(".") + text.count(",")

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # (element, its block node)
        opened: Counter[str] = Counter()  # of the elements on the stack
        at, end, tags = 0, len(source), _Tags(source)
        cut: list[str] = []  # open elements from the first that is cut off
        in_cut: Counter[str] = Counter()

        def shut() -> str:
            name, _ = stack.pop()
            opened[name] -= 1
            return name

        def uncut(name: str = "") -> None:
            while cut:
                last = cut.pop()
                in_cut[last] -= 1
                if last == name:
                    break

        def begin_cut(name: str) -> int:
            cut.append(name)
            in_cut[name] += 1
            if name not in RAW:
                return at
            found = _RAW_END[name].search(source, at)
            return found.start() if found else end

        while at < end:
            found = tags.next(at)
            stop = found[0] if found else end
            if cut == ["head"] and source[at:stop].strip():
                uncut()
            if stop > at and not cut:
                self._text(stack[-1][1], source[at:stop], opened["a"] > 0)
            if not found:
                break
            _, at, closing, name, attributes = found
            if not name or at > end:
                continue
            if cut == ["head"] and not closing and name not in IN_HEAD:
                uncut()
            elif cut and closing and not in_cut[name] and opened[name]:
                uncut()  # the element around it ends, and with it what was not closed
            elif cut and not closing and name in ("button", "select") and in_cut[name]:
                uncut(name)
                if name == "select":
                    continue
            if cut:
                if closing and in_cut[name]:
                    uncut(name)
                elif not closing and name not in VOID and not attributes.endswith("/"):
                    at = begin_cut(name)
                continue
            if name == "form" and opened["form"]:
                if closing:
                    while stack[-1][0] in IMPLIED:
                        shut()
                    del stack[max(k for k, (x, _) in enumerate(stack) if x == "form")]
                    opened["form"] -= 1
                    self.runs.append((stack[-1][1], "\n"))
                continue
            if closing:
                if opened[name]:
                    while shut() != name:
                        pass
                if name in TAG:
                    self.runs.append((stack[-1][1], "\n"))
                continue
            if name in CUT:
                self.runs.append((stack[-1][1], "\n" if name == "head" else " "))
                if name not in VOID and not attributes.endswith("/"):
                    at = begin_cut(name)
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    self.runs.append((stack[-1][1], "\n"))
                continue
            if name in ENDS_P and opened["p"]:
                while shut() != "p":
                    pass
            if name in CLOSES and any(opened[x] for x in CLOSES[name][0]):
                closes, bound = CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in bound:
                        break
                    if stack[k][0] in closes:
                        while len(stack) > k:
                            shut()
                        break
            if len(stack) >= MAX_DEPTH:
                shut()
            node = stack[-1][1]
            if name in TAG:
                self.runs.append((node, "\n"))
                naming = " ".join(a or b or c for a, b, c in _NAMING.findall(attributes)) if "=" in attributes else ""
                self.parent.append(node)
                node = len(self.tag)
                self.tag.append(TAG[name])
                self.kind.append(kind_of(naming) if naming else 0)
                self.words.append(tuple(sorted({zlib.crc32(w.lower().encode()) % WORDS for w in _WORD.findall(naming)})) if naming else ())
                self.chars.append(0)
                self.link_chars.append(0)
                self.stops.append(0)
            opened[name] += 1
            stack.append((name, node))

    def features(self, node: int, plain: bool = False) -> list[int]:
        """The node's features as places of one table; ``plain``: as if it were a div without class words."""
        chars = self.chars[node]
        share = self.link_chars[node] / chars if chars else 0.0
        tag = TAG["div"] if plain and self.tag[node] in MARKS else self.tag[node]
        looks = (tag + (OTHER + 1) * (chars > 0), 0 if plain else self.kind[node])
        if chars:  # an element without text of its own does not look like anything
            looks += ((chars > 25) + (chars > 80) + (chars > 250), (share > 0) + (share > 0.3) + (share > 0.7), min(self.stops[node], 2))
        return [a + f for a, f in zip(_AT, looks)] + ([] if plain else [_AT[-1] + SHAPE[-1] + w for w in self.words[node]])

    def edge(self, node: int, parent: int, plain: bool = False) -> int:
        """Parts that are named boilerplate or comments hang on their parents as asides do."""
        tag = TAG["div"] if plain and self.tag[node] in MARKS else TAG["aside"] if not plain and self.kind[node] in (1, 2) else self.tag[node]
        return (self.tag[parent] not in FRAME) * (OTHER + 1) + tag

    def labels(self) -> list[int] | None:
        """1 for the nodes of the only article or main element, but for the parts of it that are not content."""
        roots = [k for k in range(len(self.tag)) if self.tag[k] in MARKS]
        if not roots or sum(self.parent[k] not in roots for k in roots) != 1:
            return None
        out = [0] * len(self.tag)
        for k in range(roots[0], len(self.tag)):
            if k == roots[0] or out[self.parent[k]]:
                out[k] = int(self.kind[k] not in (1, 2) and (self.tag[k] == OTHER or BLOCKS[self.tag[k]] not in BOILER_TAGS))
        return out

    def text(self, content: list[bool]) -> str:
        blocks, open_block = [], []
        for node, text in [*self.runs, (0, "\n")]:
            if text == "\n":
                if joined := " ".join("".join(open_block).split()):
                    blocks.append(joined)
                open_block = []
            elif content[node]:
                open_block.append(text)
        return " ".join(blocks)


#: Sizes of the groups of features: tag (without and with text of its own), kind of words, length, share of links, stops;
#: the words' buckets follow.
SHAPE = (2 * (OTHER + 1), 5, 4, 4, 3)
_AT = [0, *np.cumsum(SHAPE)[:-1].tolist()]
_LOOKS = sum(SHAPE) + WORDS
#: (parent in the frame or not, child's tag, parent's state, child's state)
_EDGES = 2 * (OTHER + 1) * 4
SIZE = 2 * _LOOKS + _EDGES


def counts_of(page: Page, labels: list[int], total: np.ndarray) -> None:
    """Adds a labelled page to the counts: as it is, with its marks hidden, and with its marks taken away."""
    n = len(labels)
    above = [page.parent[k] for k in range(n)]
    for k in range(1, n):  # the parents that are left if marks are taken away
        while above[k] > 0 and page.tag[above[k]] in MARKS:
            above[k] = page.parent[above[k]]
    for plain, gone in ((False, False), (True, False), (True, True)):
        for k, y in enumerate(labels):
            if gone and page.tag[k] in MARKS:
                continue
            for f in page.features(k, plain):
                total[2 * f + y] += 1
            if k:
                parent = above[k] if gone else page.parent[k]
                total[2 * _LOOKS + 4 * page.edge(k, parent, plain) + 2 * labels[parent] + y] += 1


def _prior() -> tuple[np.ndarray, np.ndarray]:
    """Log odds of content before any page is seen, and how many nodes that counts for, by feature."""
    odds, weight = np.zeros(_LOOKS), np.full(_LOOKS, 3.0)
    known = {"nav": -10, "aside": -10, "footer": -10, "menu": -10, "form": -5, "article": 4, "main": 4, "html": -2, "body": -2, "header": -2, "p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "dialog": -2, "noscript": -1, "object": -0.5, "canvas": -3, "audio": -3, "video": -3}
    for at, x in [*((TAG[name], x) for name, x in known.items()), (OTHER, -2)]:
        odds[[at, at + OTHER + 1]], weight[[at, at + OTHER + 1]] = x, 20 if x == -10 else 3
    odds[_AT[1] : _AT[1] + 5] = (0, -8, -10, 4, -1)  # names: none, boilerplate, comments, content, mixed
    odds[_AT[2] : _AT[2] + 4] = (0, 0.3, 1, 1)
    odds[_AT[3] : _AT[3] + 4] = (0, 0, -1, -3)
    odds[_AT[4] : _AT[4] + 3] = (0, 0.3, 0.7)
    return odds, weight


def _bounds() -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that a single feature may say, as log odds. The looks of a text together say less than an
    edge, and little against it if it is short: menus teach that short items are not content, but lists have such too."""
    most = np.full(_LOOKS, 2.0)
    for at in range(OTHER + 1):
        bound = 4 if at in MARKS else 2 if at == OTHER else 10 if BLOCKS[at] in BOILER_TAGS else 3 if BLOCKS[at] in MEDIA else None
        most[[at, at + OTHER + 1]] = bound or ((0.5, 1.5) if at in GENERIC else 2)
    most[_AT[1] : _AT[1] + 5] = 0.5, 10, 10, 4, 1
    most[_AT[2] : _AT[2] + 4] = most[_AT[4] : _AT[4] + 3] = 1
    most[_AT[3] : _AT[3] + 4] = 0.5, 1, 2, 3
    least = -most
    least[_AT[2] : _AT[2] + 4] = least[_AT[4] : _AT[4] + 3] = -0.3
    return least, most


def prior_edges() -> np.ndarray:
    """Counts of (parent's state, child's state): in the frame a child is free; elsewhere a state tends to persist."""
    total = np.ones((2, OTHER + 1, 2, 2))
    total[1] = (400, 0.5), (1, 60)
    for name in BOILER_TAGS:
        total[1, TAG[name], 1, 0] += 60
    for name in ("article", "main"):
        total[1, TAG[name], 0, 1] += 60
    return total


class TreeModel:
    def __init__(self, counts: np.ndarray | None = None):
        """From the sample's counts; without them the prior alone speaks."""
        counts = np.zeros(SIZE) if counts is None else counts
        looks = counts[: 2 * _LOOKS].reshape(-1, 2)
        tags = looks[: SHAPE[0]].sum(axis=0)  # nodes of either state: both weigh alike
        looks = looks * (tags.sum() / 2 / np.maximum(tags, 1))
        odds, weight = _prior()
        learned = np.log((looks[:, 1] + weight * np.exp(odds / 2)) / (looks[:, 0] + weight * np.exp(-odds / 2)))
        self.odds = np.clip(learned, *_bounds()).tolist()
        edge = counts[2 * _LOOKS :].reshape(2, OTHER + 1, 2, 2) + prior_edges()
        self.edge = (edge / edge.sum(axis=3, keepdims=True)).reshape(-1, 2, 2).tolist()  # P(child | parent)

    def marginals(self, page: Page) -> list[float]:
        """Sum-product over the tree, with messages as probabilities: upward in reverse order, then downward."""
        n = len(page.tag)
        own = []
        for k in range(n):
            odds = sum(self.odds[f] for f in page.features(k))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            own.append([1 - p, p])
        up, message = [list(x) for x in own], [(1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):
            (a, b), (c, d) = self.edge[page.edge(k, page.parent[k])]
            m0, m1 = a * up[k][0] + b * up[k][1], c * up[k][0] + d * up[k][1]
            total = m0 + m1
            message[k] = (m0 / total, m1 / total)
            up_p = up[page.parent[k]]
            x, y = up_p[0] * message[k][0], up_p[1] * message[k][1]
            up_p[0], up_p[1] = x / (x + y), y / (x + y)
        belief = [up[0]] + [None] * (n - 1)
        for k in range(1, n):
            # what the parent believes without this child, sent through the edge
            p0, p1 = belief[page.parent[k]][0] / max(message[k][0], 1e-300), belief[page.parent[k]][1] / max(message[k][1], 1e-300)
            (a, b), (c, d) = self.edge[page.edge(k, page.parent[k])]
            x, y = up[k][0] * (p0 * a + p1 * c), up[k][1] * (p0 * b + p1 * d)
            belief[k] = [x / (x + y), y / (x + y)]
        return [b[1] for b in belief]

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        return page.text([m > 0.5 for m in self.marginals(page)])


def train(pages: DataFrame, sample: int = SAMPLE) -> TreeModel:
    """Learns from the labelled pages among a sample of about ``sample`` pages, chosen by a hash of page_id and url."""
    share = sample / max(pages.count(), sample)
    chosen = pages.where(F.col("html").isNotNull() & (F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < share * (1 << 20)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIZE)
        for pdf in batches:
            for source in pdf["html"]:
                page = Page(source)
                if labels := page.labels():
                    counts_of(page, labels, total)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    # Spark sums the tasks' counts; one number per potential reaches the driver.
    total = np.zeros(SIZE)
    for row in chosen.select("html").mapInPandas(count, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[row["at"]] += row["n"]
    return TreeModel(total)


def extract(pages: DataFrame, model: TreeModel) -> DataFrame:
    """``pages`` with ``text``."""
    tables = vars(model)

    @F.pandas_udf("string")
    def main_text(sources: pd.Series) -> pd.Series:
        own = TreeModel.__new__(TreeModel)
        vars(own).update(tables)
        return pd.Series([own.extract(x) for x in sources], dtype=object)

    return pages.withColumn("text", main_text("html"))


def query(pages: DataFrame) -> DataFrame:
    found = extract(pages.select("page_id", "url", "html"), train(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
