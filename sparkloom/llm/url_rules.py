"""Verdicts on urls from many pattern rules, of which few are tried on each url.

A rule becomes a regular expression and the literal tokens that every fitting url holds as whole tokens. It is filed under the rarest of
these, by counts over all urls. The tokens of a url fetch the rules filed under them, and only those (and the few rules without a
whole token) run their expressions.

Two kinds of rules. Site rules are a host and the start of a path, ``example.net/en/``; they fit the host and its subdomains, and the longest fitting one
decides. Pattern rules decide about other urls, all of whose A-Z are lower-cased: ``*`` stands for anything, ``^`` for one character that is no digit, a-z or beyond
ASCII, or for an end, ``||`` at the start for the start of a host's label, ``|`` at the start or end for that end; ``@@`` before a pattern makes it an
exception, which allows what patterns block; what follows ``regex:`` is a regular expression.

Scale: two passes over the url column without a shuffle of urls (one sums counts of the rules' tokens, pre-aggregated by task; a hot host
is no key of anything). Rules are given by the caller and do not grow with the urls; they are broadcast.

Nulls: a null url is empty and has no host; a null id is kept. Urls without ``://`` have no host and path, and patterns judge them. Repeated rows get a row
each, very long urls are read whole, an empty table gives an empty result, other columns don't matter. Rules of one length that fit:
the one with the longer host, then block before allow.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
_BREAK = r"[\x00-/:-`{-\x7f]"
_LOW = {c: c + 32 for c in range(65, 91)}

#: Site rules: verdict, host and start of the path.
SITES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Pattern rules for other urls: hosts and paths of junk, and files that are no pages.
PATTERNS = (
    "^casino^", "^poker^", "^bets^", "^betting^", "^pills^", "^viagra^", "^adult^", "^xxx^", "^porn^", "^spam^", "^warez^", "^torrent^",
    "||ads.", "^ads^track^", "^adserver^", "^doubleclick^", "^click^track*redirect^", "^payday^loan*^", "^replica^watches^",
    "^wp-login.php", "^cgi-bin^", "^phpsessid=", "^sessionid=*^sort=", "^calendar^*^print^", "*.exe|", "*.zip|", "*.iso|",
    "@@^casino^history^", "@@||archive.org^", "@@^spam^filter*^howto^",
)

JUDGED = "id long, host string, path string, rule string, verdict string, pattern string, tried int"


def low(text: str) -> str:
    """A-Z as a-z."""
    return text.translate(_LOW)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``)."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return low(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def whole_tokens(parts: list[tuple[str, bool, bool]]) -> frozenset[str]:
    """Tokens of literal (text, bounded on the left, on the right) that can't be part of a longer token in a fitting url."""
    out = set()
    for text, left, right in parts:
        for m in TOKEN.finditer(text):
            if (m.start() or left) and (m.end() < len(text) or right):
                out.add(m[0])
    return frozenset(out)


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    site: bool
    expression: str
    tokens: frozenset[str]
    rank: tuple = ()


def site_rule(verdict: str, text: str) -> Rule:
    """``host/path`` fits a host and its subdomains if the url's path starts with the rule's (``/path``; nothing after the host fits any path)."""
    host, slash, rest = text.partition("/")
    path = slash + rest
    expression = rf"\A(?:[^/]*\.)?{re.escape(host)}" + (re.escape(path) if path else r"(?=/|\Z)")
    tokens = whole_tokens([(low(host), True, True), (low(path), True, False)])
    return Rule(text, verdict, True, expression, tokens, (-len(text), -len(host), verdict == "allow", text))


def pattern_rule(text: str) -> Rule:
    """A pattern as an expression that is searched in the lower-cased url."""
    verdict, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    if body.startswith("regex:"):
        return Rule(text, verdict, False, body[6:], frozenset())
    body = low(body)
    out, left = "", False
    for mark, start in (("||", r"\A[^/?#]*?://(?:[^/?#]*\.)?"), ("|", r"\A")):
        if body.startswith(mark):
            out, left, body = start, True, body[len(mark) :]
            break
    at_end = body.endswith("|")
    parts, pieces = [], re.split(r"([*^])", body.removesuffix("|"))
    for k, piece in enumerate(pieces):
        if piece == "*":
            out += ".*"
        elif piece == "^":
            out += rf"(?:\A|\Z|{_BREAK})"
        elif piece:
            before = pieces[k - 1] == "^" if k else left
            after = pieces[k + 1] == "^" if k + 1 < len(pieces) else at_end
            parts.append((piece, before, after))
            out += re.escape(piece)
    return Rule(text, verdict, False, out + (r"\Z" if at_end else ""), whole_tokens(parts))


def rules_of(sites: Iterable[tuple[str, str]], patterns: Iterable[str]) -> list[Rule]:
    return [site_rule(v, t) for v, t in sites] + [pattern_rule(t) for t in patterns]


class Index:
    """Rules filed under their rarest token (of equally frequent ones the longest, then the first)."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.rules = rules
        self.filed: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        self._compiled: dict[int, re.Pattern] = {}
        for k, rule in enumerate(rules):
            if rule.tokens:
                self.filed[min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))].append(k)
            else:
                self.always.append(k)

    def fits(self, k: int, where: str) -> bool:
        if k not in self._compiled:
            self._compiled[k] = re.compile(self.rules[k].expression, re.DOTALL)
        return self._compiled[k].search(where) is not None

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None, int]:
        """Host, path, the site rule that decides, verdict, the pattern that decides, and how many rules were tried."""
        host, path = split_url(url)
        address, lowered = host + path, low(url or "")
        candidates = list(self.always)
        for token in set(TOKEN.findall(lowered)):
            candidates += self.filed.get(token, ())
        rules = self.rules
        fitting = [k for k in sorted(candidates) if self.fits(k, address if rules[k].site else lowered)]
        sites = [rules[k] for k in fitting if rules[k].site]
        if sites:
            best = min(sites, key=lambda r: r.rank)
            return host, path, best.text, best.verdict, None, len(candidates)
        blocks = [rules[k] for k in fitting if rules[k].verdict == "block"]
        allows = [rules[k] for k in fitting if rules[k].verdict == "allow"]
        decides = (allows or blocks)[0].text if blocks else None
        return host, path, None, "block" if blocks and not allows else "allow", decides, len(candidates)


def counted(wanted: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(url) -> (token, n) for each task: in how many urls each token of the rules stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in batches:
            for url in batch.column("url").to_pylist():
                n.update(wanted.intersection(TOKEN.findall(low(url or ""))))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    return run


def judged(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, counts = shared.value
        index = Index(rules, counts)
        for batch in batches:
            rows = [index.judge(url) for url in batch.column("url").to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.string()] * 5 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["id", "host", "path", "rule", "verdict", "pattern", "tried"])

    return run


def judge_urls(pages: DataFrame, id_column: str = "page_id", sites=SITES, patterns=PATTERNS) -> DataFrame:
    """Every row's id, host, path, the site rule that fits (else null), verdict (``allow`` or ``block``), the pattern that decided (else null), and how many rules were tried."""
    rules = rules_of(sites, patterns)
    urls = pages.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col("url").cast("string").alias("url"))
    wanted = frozenset().union(*(r.tokens for r in rules))
    counts = urls.select("url").mapInArrow(counted(wanted), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    n = {r.token: r.n for r in counts.collect()}  # a row for each token of the rules
    shared = pages.sparkSession.sparkContext.broadcast((rules, n))
    return urls.mapInArrow(judged(shared), JUDGED).withColumnRenamed("id", id_column)


def op13_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("tried")
