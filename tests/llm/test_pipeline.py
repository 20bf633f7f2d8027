import corpus_pipeline
from sparkloom.llm import common, tokens

from .test_line_dedup import brute as brute_lines
from .test_minmax_dedup import brute as brute_groups
from .test_wu_manber import brute as brute_windows

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "s", 0), (900003, "... 12", "en", "s", 6)], docs.schema)
    docs = docs.unionByName(odd)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = {r.doc_id: r.text for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES:
        docs = common.stage(function(spark, docs, SF), name)
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            got = {r.doc_id: r.text for r in rows}
        if name == "language":
            assert len(now) - 12 <= len(got) <= len(now) - 3
            assert all(now[k] == t for k, t in got.items()) and not {900001, 900002, 900003} & set(got)
        elif name == "lines":
            want = brute_lines(list(now.items()), 80)
            assert got == {k: t for k, t in want.items() if t == now[k] or t.split()}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_duplicates":
            assert got == {k: now[k] for k, (_, root) in brute_groups(list(now.items()), 5, 80).items() if k == root}
        elif name == "contamination":
            assert got == {k: now[k] for k, r in brute_windows(list(now.items()), items).items() if not r[4]}
        else:
            lib = Tokenizer.from_file(tokens.public("byte_bpe_50k.json"))
            assert {r.doc_id: r.doc_tokens for r in rows} == {k: len(lib.encode(t, add_special_tokens=False).ids) + 1 for k, t in now.items()}
            assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
            break
        assert len(got) > 100
        now = got


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
