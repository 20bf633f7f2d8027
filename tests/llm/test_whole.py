"""Rows and texts that were left out before."""

import pytest

from sparkloom.llm import html_extract, language_id
from sparkloom.llm.wu_manber import contamination

from .test_wu_manber import brute


@pytest.mark.parametrize("pattern_words", [200_000, 4])
def test_items_without_an_id_are_patterns(spark, pattern_words):
    items = [(None, "one two three"), (None, "four five"), (1, "six seven"), (2, "one two three"), (None, None), (None, "...")]
    docs = [(1, "a four five b"), (2, "x one two three y six seven"), (3, "clean"), (4, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination(d, b, pattern_words=pattern_words).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    named = brute(docs, [x for x in items if x[0] is not None])
    assert got[1] == (4, 2, 0, named[1][3], True)
    assert {k: got[k] for k in (2, 3, 4)} == {k: named[k] for k in (2, 3, 4)} and len(got) == 4


def test_split_bodies_without_an_article_element():
    lead, body = "lead " * 20, "text " * 180
    page = f'<body><div class="content"><div class="lead"><p>{lead}</p></div><div class="text"><p>{body}</p></div></div><ul><li><a href="/">more</a></ul></body>'
    assert html_extract.article(page, None) == f"{lead.strip()}\n\n{body.strip()}"
    wrapped = f'<body><div class="a"><div class="b"><div class="c"><p>{body}</p></div></div></div><div class="d"><p>{"rest " * 60}</p></div></body>'
    assert "rest" in html_extract.article(wrapped, None)


def test_every_language_is_learned(spark):
    rows = [(k, f"{chr(97 + lang % 26) * 3} {chr(97 + lang // 26) * 4} word", f"l{lang:03}") for lang in range(205) for k in range(lang * 6, lang * 6 + 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.fit_on(docs).languages == [f"l{lang:03}" for lang in range(205)]
    # the bound on rows holds for each language that has more
    assert language_id.fit_on(docs.filter("doc_id < 12"), 2).languages
