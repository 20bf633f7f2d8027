import random
import re

import pytest

from sparkloom.llm import url_rules as u


def brute(url, sites, patterns):
    """All rules on the url; tokens play no part."""
    host, path = "", ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        end = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = re.split("[?#]", rest[end:])[0]
    fits = []
    for verdict, text in sites:
        at = text.index("/") if "/" in text else len(text)
        if (host == text[:at] or host.endswith("." + text[:at])) and path.startswith(text[at:]):
            fits.append((-len(text), -at, verdict == "allow", text, verdict))
    if fits:
        return host, path, min(fits)[3], min(fits)[4]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    hit = [p for p in patterns if glob(p.removeprefix("@@"), low)]
    return host, path, None, "block" if hit and not any(p.startswith("@@") for p in hit) else "allow"


def glob(pattern, url):
    """A pattern by trying, without regular expressions but for ``regex:``."""
    if pattern.startswith("regex:"):
        return re.search(pattern[6:], url) is not None
    part = lambda c: c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) >= 128

    def match(p, i):
        if not p:
            return True
        if p == "|":
            return i == len(url)
        if p[0] == "*":
            return any(match(p[1:], j) for j in range(i, len(url) + 1))
        if p[0] == "^":
            return i == len(url) and match(p[1:], i) or i == 0 and match(p[1:], i) or i < len(url) and not part(url[i]) and match(p[1:], i + 1)
        return i < len(url) and url[i] == p[0] and match(p[1:], i + 1)

    if pattern.startswith("||"):
        if "://" not in url or re.search("[/?#]", url[: url.index("://")]):
            return False
        a = url.index("://") + 3
        host = re.match("[^/?#]*", url[a:])[0]
        return any(match(pattern[2:], a + k) for k in range(len(host) + 1) if k == 0 or host[k - 1] == ".")
    if pattern.startswith("|"):
        return match(pattern[1:], 0)
    return any(match(pattern, i) for i in range(len(url) + 1))


SITES = (*u.SITES, ("block", "a.example.org"), ("allow", "example.org/fr/x"), ("block", "b.example.net/e"), ("allow", "co/"))
PATTERNS = (*u.PATTERNS, "ab*cd", "|http://x^", "||a.b^", "regex:q[0-9]{3}$", "@@^casino^y", "é^", "net/en|")


def urls():
    rng = random.Random(5)
    hosts = "net example.net www.example.net EXAMPLE.net notexample.net example.com m.Example.COM org a.org example.org a.example.org b.example.net x a.b c.a.b casino-win.example.com casino.x.org ads.y.org é.org user@example.net example.net:80 co".split()
    paths = ["", "/", "/en", "/en/", "/en/5", "/de/7", "/DE/7", "/fr/", "/fr/x", "/e", "/casino/y", "/casinos", "/a.zip", "/abxxcd", "/ads/track", "/q123", "/en/net/en"]
    tails = ["", "?a=1", "#top", "?u=http://casino.net/", "#a?b", "?phpsessid=1", "?é"]
    out = [f"{rng.choice(['http', 'https', 'HTTP', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(1500)]
    return out + [None, "", "no scheme casino here", "://", "http://", "casino", "x" * 100_000 + "://a.net/", "http://a.net/" + "é" * 50_000, "http://x\n.net/\nen", "a?b://ads.c/"]


@pytest.mark.parametrize("sites,patterns", [(SITES, PATTERNS), (u.SITES, u.PATTERNS)])
def test_against_brute_force(spark, sites, patterns):
    rows = [(None if k == 3 else k // 2, x, "h", "v") for k, x in enumerate(urls())]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string").repartition(3)
    got = u.judge_urls(df, sites=sites, patterns=patterns).collect()
    key = lambda r: str(r)
    want = sorted([(i, *brute(x, sites, patterns)) for i, x, *_ in rows], key=key)
    assert sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got], key=key) == want
    assert {r.verdict for r in got} == {"allow", "block"}
    assert 4 * sum(r.tried for r in got) < len(rows) * (len(sites) + len(patterns))  # of all pairs, though every url here holds tokens of rules
    assert u.judge_urls(df.limit(0)).count() == 0


def test_tokens_are_whole_and_rarest_one_files():
    rules = u.rules_of([("block", "example.net/en/fr")], ["^casino^win", "ab^cd^", "||ads.", "*x*", "regex:a|b"])
    assert [sorted(r.tokens) for r in rules] == [["en", "example", "net"], ["casino"], ["cd"], ["ads"], [], []]
    index = u.Index(rules, {"net": 5, "en": 2, "example": 2})
    assert dict(index.filed) == {"example": [0], "casino": [1], "cd": [2], "ads": [3]} and index.always == [4, 5]


def test_counts_decide_which_token_files(spark):
    df = spark.createDataFrame([(k, f"http://h{k}.example.net/en/{k}") for k in range(50)], "page_id long, url string")
    tried = {r.tried for r in u.judge_urls(df, sites=[("block", "h7.example.net/")], patterns=[]).collect() if r.page_id != 7}
    assert tried == {0}
