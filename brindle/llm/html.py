"""Main text of web pages by the maximum-scoring contiguous region.

A page is a run of tags and words. Words score by what stands around them (names of elements, words of class and id) and by
the block that they stand in (its share of links, whether it is a fragment, whether it belongs to a series of like
containers), with weights that a logistic regression learns from labelled pages; tags score negative, by how often they
stand outside main text there. One linear scan finds the contiguous region with the largest sum. The blocks of the region, less those whose
own words score negative by their place alone (an advert or a form between two paragraphs), are the text.

Defined results: null, empty and tagless-empty html give empty text; repeated rows are extracted each; markup may be
unclosed or crossed; a tag that never ends, and what follows it, is no text; if a quoted value never ends, quotes mean nothing from there on.
One page is read in linear time and its text is never cut. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, labelled_pages

#: Elements that break the text into blocks, that hold no child elements, and whose content is never text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title template svg math canvas object audio video select option textarea button iframe noscript noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 title caption legend summary".split())
#: Elements whose content isn't markup, and what ends it.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style textarea title xmp noembed noframes iframe".split()}
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_TAG_END = re.compile(r"[>\"']")
_CLASS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Elements that say nothing about whether their words are main text.
PLAIN = frozenset("html body div section p span a b i u em strong small big font center h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th blockquote pre code figure figcaption hgroup q cite sub sup mark time abbr br hr img".split())
#: Closing one of these by opening the same (or, for p, any block) is usual.
_CLOSED_BY_SAME = frozenset("li dt dd tr td th option p".split())
#: Containers that can be a series of entries; members that a series has at least, and blocks of a member on average.
SERIES, MEMBERS, ENTRY_BLOCKS = frozenset("div section article li dd".split()), 3, 2
#: Words of a fragment at most; ends of a sentence; what a line of rights says.
FRAGMENT, _ENDS, _RIGHTS = 5, ".!?:;…。！？»”\"')", re.compile(r"©|&copy;|\bcopyright\b|\ball rights reserved\b", re.I)
#: What blocks say, beside the elements around them; only the first two decide about single blocks inside the region. Where
#: an element says that it is main text, only the first one is heard.
MAIN = frozenset(("<article>", "<main>"))
REPEATED, RIGHTS, LINKED, SHORT = "~series", "~rights", "~links", "~fragment"
#: Bounds of a word's score.
LOW, HIGH = -4.0, 2.0
#: Least score of one run of words, so that a long advert inside the text doesn't end its region.
RUN_LOW = -3.0


@lru_cache(maxsize=4096)
def _keys(name: str, attrs: str) -> tuple[str, ...]:
    """What an element says about the words in it."""
    keys = [] if name in PLAIN else [f"<{name}>"]
    for m in _CLASS.finditer(attrs):
        keys += _WORDS.findall((m[1] or m[2] or m[3] or "").lower())
    if attrs and _HIDDEN.search(attrs):
        keys.append("hidden")
    return tuple(keys)


def scan(html: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name or text, attributes, place) for each tag (open, close) and each text; comments and raw elements are left out.

    Every character is looked at a bounded number of times, whatever the markup.
    """
    size = len(html)
    at = text = 0
    quotes = True
    while True:
        at = html.find("<", at)
        if at < 0:
            break
        begin = at
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = size if end < 0 else end + 3
        elif html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            end = size if end < 0 else end + 3
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            end = size if end < 0 else end + 1
        else:
            closes = html.startswith("/", at + 1)
            m = _NAME.match(html, at + 1 + closes)
            if not m:  # a character of the text
                at += 1
                continue
            end = m.end()
            while quotes:
                q = _TAG_END.search(html, end)
                if q is None or q[0] == ">":
                    end = size if q is None else q.start()
                    break
                end = html.find(q[0], q.end()) + 1
                quotes = end > 0
            if not quotes:
                end = html.find(">", m.end())
                end = size if end < 0 else end
            if text < begin:
                yield "text", html[text:begin], "", text
            if end >= size:
                return
            name = m[0].lower()
            end += 1
            yield "close" if closes else "open", name, html[m.end() : end - 1], begin
            if not closes and name in RAW:
                m = RAW[name].search(html, end)
                if m is None:
                    return
                yield "close", name, "", m.start()
                end = m.end()
            at = text = end
            continue
        if text < begin:
            yield "text", html[text:begin], "", text
        at = text = end
    if text < size:
        yield "text", html[text:], "", text


class Page:
    """The tags and texts of a page outside of dropped elements, with what stands around them.

    ``items`` are (kind, value, place, keys of the elements around, keys of the block). Only keys in ``known`` are held, if given.
    """

    def __init__(self, html: str, known: frozenset[str] | None = None):
        # an open element: name, keys around its content, innermost member of a series, stack place of the nearest block, element number
        stack: list[tuple[str, tuple[str, ...], int, int, int]] = []
        opened: Counter = Counter()
        found: list[tuple[str, str, int, tuple[str, ...], int, bool, bool]] = []
        groups: dict[tuple[int, str, str], int] = {}
        group_of, parent_of, members = [-1], [-1], [0]  # member 0 is the page
        dropped = elements = 0

        def pop() -> str:
            nonlocal dropped
            name = stack.pop()[0]
            opened[name] -= 1
            dropped -= name in DROPPED
            return name

        for kind, value, attrs, place in scan(html):
            around, member = (stack[-1][1], stack[-1][2]) if stack else ((), 0)
            if kind == "text":
                if not dropped:
                    found.append((kind, value, place, around, member, opened["a"] > 0, any(opened[h] for h in HEADINGS)))
                continue
            if kind == "close":
                if opened[value] > 0:
                    while pop() != value:
                        pass
                if not dropped and value not in DROPPED:
                    found.append((kind, value, place, (), stack[-1][2] if stack else 0, False, False))
                continue
            if stack and ((stack[-1][0] == value and value in _CLOSED_BY_SAME) or (stack[-1][0] == "p" and value in BLOCKS)):
                pop()
            elif value in BLOCKS and len(stack) > 1 and stack[-1][0] not in BLOCKS:
                k = stack[-1][3]  # an unclosed inline element ends with the paragraph it stands in
                if k >= 0 and stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
            around, member = (stack[-1][1], stack[-1][2]) if stack else ((), 0)
            if not dropped and value not in DROPPED:
                found.append((kind, value, place, (), member, False, value in HEADINGS))
            if value in VOID or attrs.endswith("/"):
                continue
            keys = _keys(value, attrs)
            if value == "header" and (opened["article"] or opened["main"] or opened["section"]):
                keys = keys[1:]  # the head of an article, not of the site
            elements += 1
            if value in SERIES:
                parent = stack[-1][4] if stack else 0
                group_of.append(groups.setdefault((parent, value, " ".join(keys)), len(groups)))
                parent_of.append(member)
                member = len(group_of) - 1
            more = tuple(k for k in dict.fromkeys(keys) if k not in around and (known is None or k in known))
            nearest = len(stack) if value in BLOCKS else stack[-1][3] if stack else -1
            stack.append((value, around + more if more else around, member, nearest, elements))
            opened[value] += 1
            dropped += value in DROPPED
        self._finish(found, np.array(group_of), parent_of, len(groups))

    def _finish(self, found: list[tuple], group_of: np.ndarray, parent_of: list[int], n_groups: int) -> None:
        """Blocks: runs of texts between tags that break blocks; and the series that their containers make."""
        block = 0
        blocks: list[list] = []  # words, linked words, fragment, rights, member, heading
        place_of: list[int] = []
        now: list | None = None
        for kind, value, _, _, member, linked, heading in found:
            if kind == "text":
                n = len(value.split())
                if now is None:
                    now = [0, 0, "", False, member, False]
                    blocks.append(now)
                now[0] += n
                now[1] += n if linked else 0
                if n:
                    now[2] = value.rstrip()[-1:]
                    now[3] = now[3] or bool(_RIGHTS.search(value))
                now[5] = now[5] or heading
                place_of.append(len(blocks) - 1)
            else:
                place_of.append(-1)
                if value in BLOCKS:
                    now = None
        size, heads = [0] * len(group_of), [False] * len(group_of)
        for words, _, _, _, member, heading in blocks:
            size[member] += words > 0
            heads[member] = heads[member] or (heading and words > 0)
        for m in range(len(group_of) - 1, 0, -1):  # children come after their parents
            size[parent_of[m]] += size[m]
            heads[parent_of[m]] = heads[parent_of[m]] or heads[m]
        count, total, headed = np.zeros(n_groups, int), np.zeros(n_groups, int), np.zeros(n_groups, bool)
        for m in range(1, len(group_of)):
            count[group_of[m]] += size[m] > 0
            total[group_of[m]] += size[m]
            headed[group_of[m]] |= heads[m]
        series = (count >= MEMBERS) & (total >= ENTRY_BLOCKS * count) & ~headed
        inside = [False] * len(group_of)
        for m in range(1, len(group_of)):
            inside[m] = bool(inside[parent_of[m]] or series[group_of[m]])
        said: list[tuple[str, ...]] = []
        short = [words <= FRAGMENT and last not in _ENDS and not heading for words, _, last, _, _, heading in blocks]
        told = not all(s or not b[0] for s, b in zip(short, blocks, strict=True))  # a page of fragments alone is its text
        for (words, linked, _, rights, member, _), fragment in zip(blocks, short, strict=True):
            said.append(tuple(k for k, on in ((REPEATED, inside[member]), (RIGHTS, rights), (LINKED, 2 * linked >= words > 0), (SHORT, fragment and told)) if on))
        self.items = []
        for (kind, value, place, around, *_), b in zip(found, place_of, strict=True):
            own = said[b] if b >= 0 else ()
            self.items.append((kind, value, place, around, own[: own[:1] == (REPEATED,)] if own and not MAIN.isdisjoint(around) else own))


class Weights:
    """Scores of words by the keys around them and of their block, and of tags by name."""

    def __init__(self, pages: Iterable[list[tuple[str, bool]]], steps: int = 15, penalty: float = 0.0005):
        seen: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0])
        tags: dict[str, Counter] = defaultdict(Counter)
        for parts in pages:
            ends = np.cumsum([len(part) for part, _ in parts])  # each part ends at a known place of the page
            for kind, value, place, around, said in Page("".join(part for part, _ in parts)).items:
                main = parts[int(np.searchsorted(ends, place, side="right"))][1]
                if kind == "text":
                    seen[around + said][main] += len(value.split())
                else:
                    tags[value][main] += 1
        names = sorted({k for keys in seen for k in keys})
        place = {k: i for i, k in enumerate(names)}
        x = np.zeros((len(seen), len(names)))
        for row, keys in zip(x, seen, strict=True):
            row[[place[k] for k in keys]] = 1
        out, main = np.sqrt(np.array(list(seen.values()))).T  # damped, so that rare contexts count
        out, main = out / out.sum(), main / main.sum()  # both classes weigh the same
        x = np.hstack([x, np.ones((len(x), 1))])
        w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
        ridge[-1] = 0
        for _ in range(steps):  # Newton's method
            p = 1 / (1 + np.exp(-(x @ w)))
            grad = x.T @ (p * (out + main) - main) + ridge * w
            hess = (x * ((out + main) * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
            w -= np.linalg.solve(hess, grad)
        w, b = w[:-1], w[-1]
        self.words, self.base = dict(zip(names, w.tolist(), strict=True)), float(b)
        self.known = frozenset(names)
        self.tags = {t: -0.1 - (c[False] + 1) / (c[False] + c[True] + 2) for t, c in tags.items()}
        self.memo: dict[tuple[str, ...], float] = {}

    def word(self, keys: tuple[str, ...]) -> float:
        found = self.memo.get(keys)
        if found is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            found = self.memo[keys] = min(HIGH, max(LOW, self.base + sum(self.words.get(k, 0.0) for k in keys)))
        return found

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.6)


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    """Weights learned from :mod:`brindle.llm.labelled_pages`."""
    return Weights(labelled_pages.pages())


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the largest positive sum (the first and longest of equals); (0, 0) without one."""
    best, start, end = 0.0, 0, 0
    total, since = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, since = 0.0, i
        total += s
        if total > best or (total == best and since == start and end):
            best, start, end = total, since, i + 1
    return start, end


def extract(html: str | None, weights: Weights | None = None) -> str:
    """The main text of one page: blocks joined by an empty line."""
    if not html:
        return ""
    weights = weights or default_weights()
    items: list[tuple[float, float, str | None, bool]] = []  # score, score of its place alone, text, whether a block ends here
    for kind, value, _, around, said in Page(html, weights.known).items:
        if kind == "text":
            n = len(value.split())
            if n:
                alone = tuple(k for k in said if k in (REPEATED, RIGHTS))
                items.append((max(RUN_LOW, n * weights.word(around + said)), max(RUN_LOW, n * weights.word(around + alone)), value, False))
            elif value:
                items.append((0.0, 0.0, value, False))
        else:
            items.append((weights.tag(value), 0.0, " " if value == "br" else None, value in BLOCKS))
    start, end = best_region([s for s, _, _, _ in items])
    blocks: list[str] = []
    own: list[str] = []
    score = 0.0
    for _, alone, text, ends in [*items[start:end], (0.0, 0.0, None, True)]:
        if text is not None:
            own.append(text)
            score += alone
        if ends:
            block = " ".join(unescape("".join(own)).split()) if own else ""
            if block and score > 0:
                blocks.append(block)
            own, score = [], 0.0
    return "\n\n".join(blocks)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin("html")
        weights = default_weights()
        for part in common.slices(batches, "html"):
            texts = [extract(h, weights) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages", "page_id", "url", "html"))
