"""HTML main-text extraction by consensus host paths.

First scan: each page is cut into elements and text blocks, its containers are scored by the prose near them, and the scores are
votes for the containers' generalised tag-class paths (numbers in names replaced, html and body left out). Spark sums the votes by
host and path, combined map-side, so a host with a third of all pages costs rows of (host, path). Second scan: pages are joined
with the few winning paths of their host and extracted again from the elements on the first winning path they have. A page
whose comments outweigh its article is thus read like its neighbours. Pages without host or winning path use their own best.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markertree.llm.common import chunks
from markertree.session import materialize, sized

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Elements of HTML by how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
HEAD = frozenset("base link meta".split()) | RAW
ROOTS = frozenset("html body".split())
CONTAINERS = frozenset("div article main section td".split())
CELLS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "td": "td th", "th": "td th", "tr": "tr td th", "option": "option"}
CELLS = {k: frozenset(v.split()) for k, v in CELLS.items()}

# Names of what is not the article: in tags, roles, and the words of classes and ids.
NOISE_TAGS = frozenset(
    "head nav footer aside form dialog menu button select fieldset svg math template object canvas audio video map applet".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu submenu pager masthead topbar toolbar footer sidebar sidebars aside widget widgets popup modal overlay "
    "lightbox search form social related".split())
ASIDE_WORDS = frozenset(
    "ad ads adv adslot adbox adunit adsense adsbygoogle banner banners sponsor sponsored sponsors promo promos promotion promoted "
    "outbrain taboola cookie cookies consent gdpr notice notices notification notifications alert newsletter subscribe subscription "
    "signup login signin register share sharing recommended recommendations trending skip breadcrumb breadcrumbs pagination colophon "
    "copyright comment comments commentlist commentary respond replies reply discussion disqus reactions responses".split())
HEADER_WORDS = frozenset("header hdr".split())
BODY_WORDS = frozenset("article content post entry story body text main maincontent".split())
MODIFIERS = frozenset("has no not with without is show hide enable layout js".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

NONE, HEADER, NAMED, ASIDE, FIRM = range(5)
"""Kinds of noise: none; a header, of which headings inside the article stay; by names that wrappers bear too; by names of small
parts; firm. All but the firm are lifted when they hold the article."""
WINNER_SHARE = 10
"""A path that is the best of at least one page in this many of a host's pages is kept as a winning path."""
FAR = 8
"""Containers above a block that its prose still counts for, halved at each."""


class Page:
    """Elements (parallel lists, parents before children) and text blocks of one page; element 0 stands for html and body."""

    def __init__(self, html: str):
        self.tag, self.parent, self.path, self.noise, self.good = ["#root"], [-1], [0], [NONE], [1.0]
        self.blocks: list[tuple[int, str, int, str]] = []  # element, text, characters in links, nearest block tag
        self._parse(html)

    # reading

    def _parse(self, html: str) -> None:
        self.stack, self.open = [0], defaultdict(int)
        self.words, self.linked, self.link = [], 0, False
        at, end, pattern = 0, len(html), TAG
        while at < end:
            mark = html.find("<", at)
            if mark < 0:
                mark = end
            if mark > at:
                self._text(html[at:mark])
            if mark == end:
                break
            found = pattern.match(html, mark)
            if found is None:
                after = html[mark + 1:mark + 3]
                if after[:1] in ("!", "?"):
                    at = self._declaration(html, mark)
                    continue
                named = after[1:] if after[:1] == "/" else after[:1]
                if not (named.isalpha() and named.isascii()):
                    if after[:1] == "/":  # a bogus comment
                        at = html.find(">", mark) + 1 or end
                    else:
                        self._text("<")
                        at = mark + 1
                    continue
                pattern = LOOSE_TAG  # an unclosed quote: read the rest by the first closing bracket
                found = pattern.match(html, mark)
                if found is None:
                    break
            at = found.end()
            name = found[2].lower()
            if found[1]:
                self._close(name)
            elif name in RAW:
                self._before(name)
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                if close is None:
                    break
                at = html.find(">", close.end()) + 1 or end
            else:
                self._start(name, found[3])
        self._flush()

    def _declaration(self, html: str, mark: int) -> int:
        if html.startswith("<!--", mark):
            if html.startswith(">", mark + 4) or html.startswith("->", mark + 4):
                return html.index(">", mark) + 1
            close = html.find("-->", mark + 4)
            return len(html) if close < 0 else close + 3
        if html.startswith("<![CDATA[", mark):
            close = html.find("]]>", mark)
            return len(html) if close < 0 else close + 3
        return html.find(">", mark) + 1 or len(html)

    def _text(self, text: str) -> None:
        if self.open["head"] and not text.isspace():
            self._close("head")
        words = unescape(text) if "&" in text else text
        self.words.append(words)
        if self.link:
            self.linked += len(words)

    def _flush(self) -> None:
        """End the current block."""
        if self.words:
            text = " ".join("".join(self.words).split())
            if text:
                holder = self.stack[-1]
                self.blocks.append((holder, text, min(self.linked, len(text)), self.tag[holder]))
            self.words = []
        self.linked, self.link = 0, False

    def _before(self, name: str) -> None:
        if self.open["head"] and name not in HEAD and name != "head":
            self._close("head")

    def _start(self, name: str, attributes: str) -> None:
        self._before(name)
        if name == "br":
            self.words.append(" ")
            return
        if name in ROOTS or name in VOID and name != "hr":
            return
        names = {}
        if attributes and not attributes.isspace():
            for a in ATTRIBUTE.finditer(attributes):
                names.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        if name in INLINE:
            if self._noise(name, names) == NONE:
                if name == "a":
                    self.link = "href" in names
                return
            self._push(name, names, flush=True)
            return
        self._flush()
        while len(self.stack) > 1 and self.tag[self.stack[-1]] in INLINE and self.open["p"]:
            self._pop()
        if self.tag[self.stack[-1]] == "p":
            self._pop()
        closes = CELLS.get(name)
        if closes:
            while self.tag[self.stack[-1]] in closes or (self.tag[self.stack[-1]] in INLINE and any(self.open[c] for c in closes)):
                self._pop()
        if name != "hr":
            self._push(name, names)

    def _push(self, name: str, names: dict[str, str], flush: bool = False) -> None:
        if flush:
            self._flush()
        parent = self.stack[-1]
        number, step, bonus = len(self.tag), name, 1.0
        if names:
            labels = sorted({re.sub(r"\d+", "#", c) for c in names.get("class", "").split()})
            if names.get("id"):
                labels.append("@" + re.sub(r"\d+", "#", names["id"]))
            step = ".".join([name, *labels])
            if any(w in BODY_WORDS for w in self._name_words(names)):
                bonus = 1.25
            if names.get("role") in ("main", "article") or names.get("itemprop") == "articleBody":
                bonus = 1.5
        if name in ("article", "main"):
            bonus = 1.5
        self.tag.append(name), self.parent.append(parent)
        self.path.append(xxhash.xxh64_intdigest(step.encode("utf-8", "replace"), self.path[parent]))
        self.noise.append(self._noise(name, names))
        self.good.append(bonus)
        self.stack.append(number)
        self.open[name] += 1

    def _pop(self) -> None:
        self.open[self.tag[self.stack.pop()]] -= 1

    def _close(self, name: str) -> None:
        if name in INLINE and not self.open[name]:
            if name == "a":
                self.link = False
            return
        if name == "br" or name in ("p", "div") and not self.open[name]:
            self._flush() if name != "br" else self.words.append(" ")
            return
        if not self.open[name]:
            return
        self._flush()
        while self.tag[self.stack[-1]] != name:
            self._pop()
        self._pop()

    @staticmethod
    def _name_words(names: dict[str, str]) -> Iterator[str]:
        for label in (names.get("class", "") + " " + names.get("id", "")).split():
            words = [w.lower() for w in NAME_PART.findall(label)]
            if words and words[0] not in MODIFIERS:
                yield from words

    def _noise(self, name: str, names: dict[str, str]) -> int:
        if name in NOISE_TAGS:
            return NAMED if name == "form" else FIRM
        if not names:
            return HEADER if name == "header" else NONE
        if "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "").lower():
            return FIRM
        words = set(self._name_words(names))
        if words & ASIDE_WORDS or any(w.startswith("advert") for w in words):
            return ASIDE
        if names.get("role") in NOISE_ROLES or words & NOISE_WORDS:
            return NAMED
        return HEADER if name == "header" or words & HEADER_WORDS else NONE

    # choosing

    def settle(self) -> None:
        """Lift noise that holds the article, hand noise down, drop menus, and weigh the blocks' prose.

        An element holds the article when an article or main element lies in it, or, in a page without any, when it has more than
        half of the prose (nine tenths and the page's h1 for the names of small parts). Comments may be articles themselves, so
        an article or main element below a small part doesn't count.
        """
        size = len(self.tag)
        prose, total, headed = [0] * size, 0, [False] * size
        firm, aside = [False] * size, [False] * size
        for i in range(1, size):
            firm[i] = firm[self.parent[i]] or self.noise[i] == FIRM
            aside[i] = firm[i] or aside[self.parent[i]] or self.noise[i] == ASIDE
        for holder, text, linked, tag in self.blocks:
            if 2 * linked < len(text) and not firm[holder]:
                prose[holder] += len(text)
                total += len(text)
            headed[holder] |= tag == "h1"
        for i in range(size - 1, 0, -1):
            prose[self.parent[i]] += prose[i]
            headed[self.parent[i]] |= headed[i]
        article = [t in ("article", "main") and not f for t, f in zip(self.tag, aside)]
        if not any(article):  # a wrapper that bears a small part's name
            article = [t in ("article", "main") and not f and h for t, f, h in zip(self.tag, firm, headed)]
        for i in range(size - 1, 0, -1):
            article[self.parent[i]] |= article[i]
        marked = article[0]
        for i in range(1, size):
            own = self.noise[i]
            if own in (HEADER, NAMED) and (article[i] or not marked and 2 * prose[i] > total):
                self.noise[i] = NONE
            elif own == ASIDE and (article[i] and not aside[self.parent[i]] or not marked and headed[i] and 10 * prose[i] > 9 * total):
                self.noise[i] = NONE
            self.noise[i] = max(self.noise[i], self.noise[self.parent[i]])
        self.prose = prose
        self._drop_menus()
        self.weight = [
            len(text) if 2 * linked < len(text) and self.noise[holder] == NONE else 0 for holder, text, linked, _ in self.blocks]

    def _drop_menus(self) -> None:
        """A list of three items or more, all of them nothing but links, is a menu."""
        items, plain = Counter(), Counter()
        for holder, text, linked, tag in self.blocks:
            if tag == "li":
                items[self.parent[holder]] += 1
                plain[self.parent[holder]] += 10 * linked < 9 * len(text)
        for i in range(1, len(self.tag)):
            if items[i] >= 3 and not plain[i]:
                self.noise[i] = FIRM
            self.noise[i] = max(self.noise[i], self.noise[self.parent[i]])

    def scores(self) -> dict[int, float]:
        """Score of each container: its prose, halved for each container between. Like siblings with prose are one sequence,
        whose container is their parent."""
        alike = Counter((self.parent[i], self.path[i]) for i in range(1, len(self.tag)) if self.tag[i] in CONTAINERS and self.prose[i])
        holder = [0] * len(self.tag)  # nearest container at or above
        for i in range(1, len(self.tag)):
            own = self.tag[i] in CONTAINERS and alike[self.parent[i], self.path[i]] < 2
            holder[i] = i if own else holder[self.parent[i]]
        near = Counter()
        for (element, _, _, _), weight in zip(self.blocks, self.weight):
            near[holder[element]] += weight
        out: dict[int, float] = {}
        for element, weight in near.items():
            for n in range(FAR):
                if weight:
                    out[element] = out.get(element, 0.0) + weight / (1 << n)
                if element == 0:
                    break
                element = holder[self.parent[element]]
        return {e: s * self.good[e] for e, s in out.items()}

    def best(self, scored: dict[int, float] | None = None) -> int | None:
        """Path of the container with the highest score, the later one of equals."""
        scored = self.scores() if scored is None else scored
        return self.path[max(scored, key=lambda e: (scored[e], e))] if scored else None

    def votes(self) -> list[tuple[int, int, bool]]:
        """(path, millionths of the page's prose, whether it is the best), one for each path with a score."""
        scored, total = self.scores(), sum(self.weight)
        if not total:
            return []
        by_path = Counter()
        for e, s in scored.items():
            by_path[self.path[e]] += int(1_000_000 * s / total)
        best = self.best(scored)
        return [(p, v, p == best) for p, v in by_path.items()]

    def extract(self, path: int) -> list[str]:
        """Blocks of the elements on ``path``, noise apart, in page order, with the heading of the article that holds them."""
        size = len(self.tag)
        inside = [False] * size
        first = None
        for i in range(size):
            hit = self.path[i] == path and self.noise[i] in (NONE, HEADER)
            if hit and first is None:
                first = i
            inside[i] = hit or (i > 0 and inside[self.parent[i]])
        if first is None:
            return []
        out, headed = [], False
        for holder, text, _, tag in self.blocks:
            if inside[holder] and (self.noise[holder] == NONE or self.noise[holder] == HEADER and tag in HEADINGS):
                out.append(text)
                headed |= tag == "h1"
        top = first
        while top > 0 and self.tag[top] not in ("article", "main"):
            top = self.parent[top]
        if out and top > 0 and not headed:
            within = [False] * size
            for i in range(top, size):
                within[i] = i == top or within[self.parent[i]]
            heads = [text for holder, text, _, tag in self.blocks if tag == "h1" and holder < first and within[holder]
                     and self.noise[holder] in (NONE, HEADER)]
            out = heads[-1:] + out
        return out


def read(html: str) -> Page:
    page = Page(html)
    page.settle()
    return page


def host(url: str) -> Column:
    """Lower-case host of a url column; null where there is none."""
    found = F.regexp_extract(F.lower(F.col(url)), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def _signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        hosts, paths, votes, best = [], [], [], []
        for own, html in zip(batch.column("host").to_pylist(), batch.column("text").to_pylist()):
            for path, vote, top in read(html or "").votes():
                hosts.append(own), paths.append(_signed(path)), votes.append(vote), best.append(int(top))
        yield pa.RecordBatch.from_arrays([
            pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(votes, pa.int64()), pa.array(best, pa.int64())],
            ["host", "path", "votes", "best"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): each host's winning paths, most votes first. A path wins with the most votes, or when it is the best one of
    a tenth of the host's pages, so a host has at most eleven. Pages without host or prose don't vote."""
    ballots = pages.select(host("url").alias("host"), F.col("html").alias("text")).filter("host IS NOT NULL").mapInArrow(
        _vote, "host string, path long, votes long, best long")
    counted = materialize(ballots.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("best").alias("best")))
    totals = sized(counted.groupBy("host").agg(
        F.sum("best").alias("pages"), F.max(F.struct("votes", "path")).getField("path").alias("top")))
    kept = counted.join(totals, "host").filter((F.col("best") * WINNER_SHARE >= F.col("pages")) | (F.col("path") == F.col("top")))
    ranked = F.sort_array(F.collect_list(F.struct("votes", "path")), asc=False)
    return kept.groupBy("host").agg(F.transform(ranked, lambda p: p["path"]).alias("paths"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        texts = []
        for html, paths in zip(batch.column("text").to_pylist(), batch.column("paths").to_pylist()):
            page = read(html or "")
            blocks: list[str] = []
            for path in paths or []:
                blocks = page.extract(path % (1 << 64))
                if blocks:
                    break
            if not blocks:
                best = page.best()
                blocks = page.extract(best) if best is not None else []
            texts.append("\n\n".join(blocks))
        yield pa.RecordBatch.from_arrays([
            batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages`` (page_id, url, html); other columns are ignored.

    A null or empty html gives an empty text, as does a page without prose. Null ids and urls pass through; pages without host
    use their own best container. Repeated rows are extracted (and vote) each. Broken markup is read as far as it goes: an
    unclosed comment, script or tag hides the rest. Blocks are joined by an empty line; whatever their length, none is cut.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"))
    winners = sized(host_paths(rows))
    joined = rows.withColumn("host", host("url")).join(winners, "host", "left")
    return joined.select("page_id", "url", F.col("html").alias("text"), "paths").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
