"""Text expressions: white space as JavaScript knows it, trimming, tokens and keywords.

All are Column expressions; nothing here leaves the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space (fixed values): ASCII white space and the Unicode spaces that a JavaScript \s matches.
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

#: Words that are no terms (fixed values).
STOP_WORDS = (
    "의 을 를 이 가 은 는 에 에서 로 으로 와 과 도 만 에게 부터 까지 하는 있는 되는 하여 하고 되고 있고 위한 따른 관한 "
    "the a an and or of in on at to for is are was were be been being have has that this with from by as it its"
).split()

#: Words that are no keywords of a claim (fixed values).
KEYWORD_STOP_WORDS = (
    "있어서 있는 하는 하여 포함하는 포함 구성 구성되는 방법 장치 시스템 단계 청구항 항 "
    "the a an of in is are for to and or wherein comprising claim method device system"
).split()

#: Characters that separate terms (fixed values); the hyphen is not one.
PUNCTUATION = r"[.,;:!?()\[\]{}\"'`]"
HANGUL = "[가-힯]"


#: What stands between terms: runs of punctuation and white space.
BETWEEN = PUNCTUATION[:-1] + WS[1:] + "+"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once (an expression that is named twice is computed twice)."""
    return F.get(F.transform(F.array(value), use), 0)


def trim(c) -> Column:
    """Without white space at both ends (Spark's own trim takes the space character only)."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def tokenize(c) -> Column:
    """Terms of a text, with repeats. Words with Hangul give their bigrams and themselves; null gives no terms.

    Others need two characters. A Hangul word of one character gives nothing, one of two counts twice.
    """
    text = F.coalesce(c, F.lit(""))
    words = F.filter(F.split(F.lower(text), BETWEEN, -1), lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS))

    def terms(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))
        return F.when(w.rlike(HANGUL), F.concat(pairs, F.array(w))).otherwise(F.array(w))

    return F.when(text.rlike(HANGUL), F.flatten(F.transform(words, terms))).otherwise(words)


def tokenize_literal(text: str | None) -> list[str]:
    """The same terms for a query known on the driver."""
    clean = re.sub(WS + "+", " ", re.sub(PUNCTUATION, " ", (text or "").lower())).strip(" ")
    out: list[str] = []
    for w in clean.split(" "):
        if len(w) < 2 or w in STOP_WORDS:
            continue
        if re.search(HANGUL, w):
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        out.append(w)
    return out


def keywords(c) -> Column:
    """Distinct keywords in the order in which they first occur."""
    clean = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"(?:(?![A-Za-z0-9_가-힣]|{WS}).)|[\\n\\r](?!.)", " ")
    words = F.split(F.regexp_replace(clean, f"{WS}+", " "), " ", -1)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(KEYWORD_STOP_WORDS)))


def paragraphs(c, least: int = 80) -> Column:
    """Parts between blank lines, on one line, of at least ``least`` characters."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "\n{2,}", -1), lambda p: trim(F.regexp_replace(p, "\n", " ")))
    return F.filter(parts, lambda p: F.length(p) >= least)


def sentences(c, least: int = 10) -> Column:
    """Sentences of at least ``least`` characters; the whole text if there are none.

    A sentence ends at ``.``, ``?`` or ``!`` before a space, or at an ideographic full stop unless that is the last
    character; the character after the end is skipped.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\n(?!\n)", " "), f"{WS}{{2,}}", " ")

    def cut(x: Column) -> Column:
        parts = F.split(x, "(?<=[.?!]) |(?<=。)(?s:.)", -1)
        good = F.filter(F.transform(parts, trim), lambda s: F.length(s) >= least)
        return let(good, lambda g: F.when(F.size(g) > 0, g).otherwise(F.array(trim(x))))

    return let(text, cut)


def first_match(c, pattern: str, group: int = 0) -> Column:
    """A group of the first match, null if there is none."""
    return F.when(F.coalesce(c, F.lit("")).rlike(pattern), F.regexp_extract(c, pattern, group))


def english_terms(query: str) -> str:
    """A query for an English index: up to 20 words that are mostly ASCII letters and digits, else the printable ASCII."""
    words = [w for w in re.split(WS + "+", query) if len(w) > 2 and len(re.findall("[a-zA-Z0-9-]", w)) / len(w) > 0.6]
    joined = " ".join(words[:20])
    if len(joined) >= 10:
        return joined[:300]
    return re.sub(WS + "+", " ", re.sub(r"[^\x20-\x7e]", " ", query)).strip()[:200]


def render(template: str, values: dict[str, str]) -> str:
    """Placeholders ``{{name}}`` replaced in the order of ``values``; a value may hold a later placeholder."""
    for name, value in values.items():
        template = template.replace("{{" + name + "}}", value)
    return template


def render_column(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return template


def bump_version(c: Column) -> Column:
    """A dotted version with its last part raised by one (a part that is no number counts as 0)."""
    parts = F.split(c, r"\.", -1)
    last = F.coalesce(F.element_at(parts, -1).try_cast("int"), F.lit(0)) + 1
    return F.array_join(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(last.cast("string"))), ".")


def uri_component(c: Column) -> Column:
    """Percent-encoded UTF-8 but for letters, digits and ``-_.!~*'()``."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out
