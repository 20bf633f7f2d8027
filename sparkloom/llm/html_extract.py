"""Main text of web pages by consensus host paths.

Every page scores its containers (share of the page's text they hold, less links, a little for depth) under
generalised tag-class paths. Spark sums the scores by host and path, and each host's best path is
where its pages' articles are. All pages are read again and give the text under their host's path;
a page without that path gives the text under its own best container.

What recurs on a host is no article, whatever its class. A container path whose own text is the same on most of the host's different pages
(a quarter as many texts as pages, or fewer, on four pages or more, and less than half of those pages' text) goes; so does a block outside articles that stands on more than
half of the path's pages, if such blocks are less than half of the page's text. Copies of a page count once, and pages that share
most of their text with others keep it, so groups of copies and near copies lose nothing.

Scale: votes are pre-aggregated by (host, path), so a host with a third of all pages is a few rows a
task; recurring blocks are counted by (host, path, hash), which no host or path concentrates. Findings are one row a host (a path's
recurring blocks are fewer than twice its blocks of a page): broadcast if their counted rows are few, else joined by a shuffle, where AQE splits
a large host.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOP = 3
DEPTH = 12
#: What a level of depth is worth, as a share of the page's text; levels below an article element are worth nothing.
LEVEL = 0.12
#: On so many different pages of a host, at least, something can recur.
RECUR = 4
#: A container with such a share of links is a list of links.
LINKS = 0.9
#: A page's one main element decides if it holds more than this share of the text, first headings apart.
MAIN = 0.03

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template iframe svg math canvas object audio video nav footer button select textarea menu dialog".split())
#: Elements that are no article text unless they hold most of the page.
DOUBTFUL = frozenset("form fieldset aside header".split())
CONTAINER = frozenset("body div article main section td center blockquote figure".split())
BLOCK = CONTAINER | frozenset(
    "html address dd details dl dt figcaption footer form h1 h2 h3 h4 h5 h6 header hgroup hr li nav ol p pre summary table tbody tfoot thead th tr ul aside fieldset legend caption option select".split()
)
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
#: Open elements that a start tag ends, and where the search for them stops.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of a class or id that mark a part as no article text, if all other words of the same name are in ``PLAIN``.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside footer comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices banner popup modal overlay "
    "newsletter subscribe signup login share sharing social related recommended toolbar pagination pager skip masthead topbar widget "
    "discussion responses reviews feedback copyright disclaimer advertorial promos trending teaser teasers cta crumbs donate".split()
)
#: Words that say nothing about what a part is.
PLAIN = frozenset(
    "area background bar block body bottom box btn button buttons card cards center col column container content element footer form global group header "
    "holder home icon icons id in inner item items js layer left link links list lists main mobile module outer page panel placement posts post primary "
    "right root row secondary section side site slot small sticky sub tertiary text thread title top ui unit view widgets wrap wrapper zone desktop "
    "large google article articles story stories the more us on and for to bootstrap message messages media stack "
    "reader readers user users visitor policy legal strip tools count toggle read most popular new latest our your area feed stream line note".split()
)
#: Names of two words of which neither alone is a mark.
MARKED_PAIRS = frozenset({("most", "read"), ("most", "popular"), ("legal", "note"), ("privacy", "policy"), ("cookie", "policy"), ("read", "more"), ("site", "info")})
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
WORD = re.compile(r"[a-z]+")


def marked(tag: str, attrs: str, in_article: bool) -> tuple[bool, str]:
    """Whether an element is likely no article text, and its name in a path."""
    name, bad = tag, tag in DOUBTFUL and not (tag == "header" and in_article)
    if "=" in attrs:
        for key, value in ATTR.findall(attrs):
            value = value.strip("\"'").lower()
            key = key.lower()
            if key == "role":
                bad |= value in ROLES and tag not in ("body", "main", "article")
                continue
            if tag not in ("body", "html", "main"):
                for token in value.split():
                    words = WORD.findall(token)
                    rest = [w for w in words if w not in MARKS]
                    bad |= (len(rest) < len(words) or "header" in rest and not in_article) and PLAIN.issuperset(rest)
                    bad |= tuple(words[:2]) in MARKED_PAIRS and PLAIN.issuperset(words[2:])
            words = WORD.findall(value)
            if words:
                name += ("." if key == "class" else "#") + ".".join(words[:3])
    return bad, name


class Page:
    """``blocks``: (container number, text, length of link text, whether it is a first heading); ``paths`` and ``parents`` of containers (0 is the page).

    Marked elements are regions. A region is left out unless it holds the page's text: at least as much text without links as lies outside all
    regions, and (forms apart) a heading of the first rank, a main element or the page's one article; where nothing lies outside, at least half of
    all text. A header that holds the only first heading stays unless its name is marked or it is the site's (its parent is the body or a
    plain wrapper that holds all). Where a page has one main element, what lies outside it goes, but for that header.
    """

    def __init__(self, html: str):
        self.paths, self.parents, self.depths, self.levels = [""], [-1], [0], [0]
        self.blocks: list[tuple[int, str, int, bool]] = []
        self.outer, self.headed, self.headers = [-1], [False], [False]
        self.articles, self.mains = [0], 0
        self.regions: list[int] = []
        self.in_main: list[bool] = []
        self.text: list[str] = []
        self.links = 0
        # open elements: tag, dropped, container, within an article, region
        stack: list[tuple[str, bool, int, bool, int]] = []
        link = 0
        at = 0
        while True:
            m = TOKEN.search(html, at)
            end = m.start() if m else len(html)
            if end > at and not (stack and stack[-1][1]):
                piece = html[at:end]
                self.text.append(piece)
                if link:
                    self.links += len(piece.strip())
            if not m:
                break
            at = m.end()
            tag = m.group(2) or m.group(5)
            if not tag:
                continue
            tag = tag.lower()
            if m.group(1) or m.group(4):
                where = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
                if tag in BLOCK:
                    self.flush(stack)
                if where >= 0:
                    link -= sum(x[0] == "a" for x in stack[where:])
                    del stack[where:]
                continue
            attrs = m.group(3) or m.group(6) or ""
            if tag == "br":
                self.text.append(" ")
                continue
            if tag in BLOCK:
                self.flush(stack)
                if tag in CLOSES_P:
                    # a block ends an open paragraph and what is open in it
                    k = len(stack) - 1
                    while k >= 0 and stack[k][0] not in BLOCK:
                        k -= 1
                    if k >= 0 and stack[k][0] == "p":
                        link -= sum(x[0] == "a" for x in stack[k:])
                        del stack[k:]
                if tag in SIBLINGS:
                    ends, stop = SIBLINGS[tag]
                    k = len(stack) - 1
                    while k >= 0 and stack[k][0] not in stop:
                        if stack[k][0] in ends:
                            del stack[k:]
                        k -= 1
            if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
                continue
            drop, container, inside, region = stack[-1][1:] if stack else (False, 0, False, 0)
            drop |= tag in DROPPED
            bad, name = marked(tag, attrs, inside)
            if tag in ("h1", "main"):
                k = region
                while k > 0 and not self.headed[k]:
                    self.headed[k] = True
                    k = self.outer[k]
            if tag == "article" and not drop and not any(x[0] == "article" for x in stack):
                k = region
                while k >= 0:
                    self.articles[k] += 1
                    k = self.outer[k]
            self.mains += tag == "main" and not drop
            if bad and not drop:
                self.outer.append(region)
                self.headed.append(tag == "form")
                self.articles.append(int(tag == "article"))
                self.headers.append(tag == "header" and not marked("div", attrs, True)[0] and 'role' not in attrs.lower() and len(stack) > 0 and stack[-1][0] != "body")
                region = len(self.outer) - 1
            if tag in CONTAINER and not drop:
                if self.depths[container] < DEPTH:
                    self.paths.append(f"{self.paths[container]}>{name}")
                    self.parents.append(container)
                    self.depths.append(self.depths[container] + 1)
                    self.levels.append(self.levels[container] + (">article" not in self.paths[container]))
                    container = len(self.paths) - 1
            stack.append((tag, drop, container, inside or tag in ("article", "main"), region))
            link += tag == "a"
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                if tag == "noscript" and not close:
                    continue
                stop = close.start() if close else len(html)
                at = stop
        self.flush(stack)
        self.leave_out()

    def leave_out(self) -> None:
        own = [0] * len(self.outer)
        for (_, text, links, _), region in zip(self.blocks, self.regions, strict=True):
            own[region] += max(0, len(text) - links)
        kept, total = [True] * len(own), sum(own)
        for k in range(len(own) - 1, 0, -1):
            headed = self.headed[k] or self.articles[k] == self.articles[0] == 1
            kept[k] = own[k] >= own[0] and headed if own[0] else 0 < total <= 2 * own[k]
            if kept[k] and self.outer[k] > 0:
                own[self.outer[k]] += own[k]
        heads = [k for b, k in zip(self.blocks, self.regions, strict=True) if b[3]]
        # the headline's header: first headings stand nowhere else
        if heads and not any(kept[k] for k in heads) and self.headers[heads[0]]:
            kept[heads[0]] = True
        for k in range(1, len(own)):
            kept[k] &= kept[self.outer[k]]
        keep = [kept[region] for region in self.regions]
        sizes = [len(b[1]) if k else 0 for b, k in zip(self.blocks, keep, strict=True)]
        if self.mains == 1 and MAIN * sum(sizes) < sum(n for b, n, m in zip(self.blocks, sizes, self.in_main, strict=True) if m and not b[3]):
            inner_head = any(b[3] and k and m for b, k, m in zip(self.blocks, keep, self.in_main, strict=True))
            keep = [k and (m or b[3] and not inner_head) for b, k, m in zip(self.blocks, keep, self.in_main, strict=True)]
        self.blocks = [b for b, k in zip(self.blocks, keep, strict=True) if k]

    def flush(self, stack: list) -> None:
        if self.text:
            words = unescape("".join(self.text)).split()
            if words:
                top = any(x[0] == "h1" for x in stack[-4:])
                self.blocks.append((stack[-1][2] if stack else 0, " ".join(words), self.links, top))
                self.regions.append(stack[-1][4] if stack else 0)
                self.in_main.append(any(x[0] == "main" for x in stack))
            self.text, self.links = [], 0

    def scores(self) -> dict[str, float]:
        """Score of every path: the share of text below it, less links, and a little for depth; its best container counts.

        On a page without an article element, depth counts only for containers that leave out no text but links.
        """
        mass, linked = [0.0] * len(self.paths), [0.0] * len(self.paths)
        for c, text, links, _ in self.blocks:
            mass[c] += len(text)
            linked[c] += links
        for c in range(len(self.paths) - 1, 0, -1):
            mass[self.parents[c]] += mass[c]
            linked[self.parents[c]] += linked[c]
        out: dict[str, float] = {}
        found = any(">article" in path and m for path, m in zip(self.paths, mass, strict=True))
        own = max(0.0, mass[0] - linked[0])
        if mass[0]:
            for c, path in enumerate(self.paths):
                if mass[c]:
                    free = max(0.0, 1 - linked[c] / mass[c])
                    deep = found or mass[c] == mass[0] or mass[c] - linked[c] >= own > 0
                    out[path] = max(out.get(path, 0.0), mass[c] / mass[0] * free + LEVEL * self.levels[c] * deep)
        return out

    def own_texts(self) -> dict[str, list[str]]:
        """Texts of the blocks that lie directly in containers of each path."""
        out: dict[str, list[str]] = {}
        for c, text, _, _ in self.blocks:
            out.setdefault(self.paths[c], []).append(text)
        return out

    def leave_recurring(self, paths: frozenset[str], hashes: frozenset[int]) -> None:
        """Leave out blocks directly under recurring paths, and recurring blocks if they are less than half of what is left; never all."""
        left = [b for b in self.blocks if self.paths[b[0]] not in paths] if paths else self.blocks
        if hashes:
            again = [outside_articles(self.paths[b[0]]) and digest(self.paths[b[0]], b[1]) in hashes for b in left]
            if 2 * sum(len(b[1]) for b, x in zip(left, again, strict=True) if x) < sum(len(b[1]) for b in left):
                left = [b for b, x in zip(left, again, strict=True) if not x]
        self.blocks = left or self.blocks

    def leave_link_lists(self) -> None:
        """Leave out containers outside articles whose text is links alone, unless nothing else is there."""
        mass, linked = [0] * len(self.paths), [0] * len(self.paths)
        for c, text, links, _ in self.blocks:
            mass[c] += len(text)
            linked[c] += links
        left = [b for b in self.blocks if not (linked[b[0]] >= LINKS * mass[b[0]] and outside_articles(self.paths[b[0]]) and not b[3])]
        self.blocks = left or self.blocks

    def under(self, path: str) -> list[str]:
        """Texts of blocks in containers of that path; where they have no first heading, after the last one that stands before them beside their containers."""
        hit = [False] * len(self.paths)
        for c, p in enumerate(self.paths):
            hit[c] = p == path or (c > 0 and hit[self.parents[c]])
        at = [k for k, b in enumerate(self.blocks) if hit[b[0]]]
        out = [self.blocks[k][1] for k in at]
        if at and not any(self.blocks[k][3] for k in at):
            above = [k for k in range(at[0]) if self.blocks[k][3] and path.startswith(self.paths[self.blocks[k][0]] + ">")]
            out[:0] = [self.blocks[k][1] for k in above[-1:]]
        return out


def outside_articles(path: str) -> bool:
    return ">article" not in path and ">main" not in path


def digest(*parts: str) -> int:
    """A signed 64-bit hash."""
    x = xxhash.xxh3_64_intdigest("\x00".join(parts))
    return x - (1 << 64) if x >= 1 << 63 else x


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: A vote has a score; the own text of a path on a page has ``text`` and ``share``; a block has ``block``. ``page`` is the page's digest.
FOUND = "host string, path string, score double, page long, text long, share float, block long"


def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best paths of each page (the second for half and the third for a quarter), summed over the batch, and what each page's paths and blocks hold."""
    for batch in batches:
        total: dict[tuple[str, str], float] = {}
        rows: list[tuple] = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            html = html.as_py()
            if not html:
                continue
            page = Page(html)
            for rank, (path, s) in enumerate(sorted(page.scores().items(), key=lambda x: (-x[1], x[0]))[:TOP]):
                total[host, path] = total.get((host, path), 0.0) + s / 2**rank
            own = page.own_texts()
            whole = digest(*(t for texts in own.values() for t in texts))
            mass = sum(len(t) for texts in own.values() for t in texts)
            for path, texts in own.items():
                rows.append((host, path, None, whole, digest(*texts), sum(map(len, texts)) / mass, None))
                if outside_articles(path):
                    rows += [(host, path, None, whole, None, None, digest(path, t)) for t in dict.fromkeys(texts)]
        rows += [(host, path, s, None, None, None, None) for (host, path), s in total.items()]
        kinds = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float32(), pa.int64()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])


def findings(pages: DataFrame, done: common.Stages) -> DataFrame:
    """(host, path, paths, blocks): each host's path with the highest sum of scores (ties go to the smaller path), and its recurring paths and blocks."""
    found = done.stage(pages.select("host", "html").mapInArrow(common.tidy(votes), FOUND), "votes")
    total = found.filter("score is not null").groupBy("host", "path").agg(F.sum("score").alias("score"))
    # sums of doubles depend on their order: rounding keeps a rerun from choosing another path
    best = total.groupBy("host").agg(F.min_by("path", F.struct(-F.round("score", 6), "path")).alias("path"))
    # copies of a page count once
    own = found.filter("text is not null").groupBy("host", "path", "page").agg(F.max("text").alias("text"), F.max("share").alias("share"))
    own = own.groupBy("host", "path", "text").agg(F.count("*").alias("pages"), F.sum(F.col("share").cast("decimal(18,9)")).alias("share"))
    own = own.groupBy("host", "path").agg(F.count("*").alias("texts"), F.sum("pages").alias("pages"), F.sum("share").alias("share")).filter(f"pages >= {RECUR}")
    same = F.when((4 * F.col("texts") <= F.col("pages")) & (2 * F.col("share") < F.col("pages")), F.col("path"))
    own = done.stage(own.select("host", "path", "pages", same.alias("same")), "paths")
    again = found.filter("block is not null").select("host", "path", "block", "page").distinct().groupBy("host", "path", "block").agg(F.count("*").alias("n")).filter(f"n >= {RECUR}")
    again = again.join(own.filter("same is null"), ["host", "path"]).filter("2 * n > pages").groupBy("host").agg(F.collect_set("block").alias("blocks"))
    paths = own.filter("same is not null").groupBy("host").agg(F.collect_set("same").alias("paths"))
    return best.join(paths, "host", "left").join(again, "host", "left")


def article(html: str | None, path: str | None, paths: frozenset[str] = frozenset(), blocks: frozenset[int] = frozenset()) -> str:
    """The text of one page under ``path``, or under its own best container if it has no such text, without what recurs on its host."""
    if not html:
        return ""
    page = Page(html)
    page.leave_recurring(paths, blocks)
    page.leave_link_lists()
    texts = page.under(path) if path is not None else []
    if not texts:
        score = page.scores()
        if not score:
            return ""
        texts = page.under(min(score, key=lambda p: (-score[p], p)))
    return "\n\n".join(texts)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every (page_id, url, html).

    Null or empty html gives an empty text; a null url or one without a host shares the host ''. Repeated rows
    each give a row and a vote. Further columns are ignored. Containers nested deeper than ``DEPTH`` count for the one at that depth.
    """
    source = common.texts(pages, "page_id", "url", host_of(F.col("url")).alias("host"), "html")
    with common.Stages() as done:
        best = common.stage(findings(source, done), "winners")
    joined = source.join(common.small(best), "host", "left").select("page_id", "url", "path", "paths", "blocks", "html")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = zip(batch.column("path").to_pylist(), batch.column("paths").to_pylist(), batch.column("blocks").to_pylist(), strict=True)
            text = [article(h.as_py(), p, frozenset(a or ()), frozenset(b or ())) for h, (p, a, b) in zip(batch.column("html"), rest, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(common.tidy(run), f"page_id {kind}, url string, text string, n_chars long")


def op1_consensus_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
