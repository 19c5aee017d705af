from itertools import groupby

import corpus_pipeline
from quarry.llm import quality_rules, toxicity
from quarry.llm.common import table
from quarry.llm.packing import ByteEncoder
from quarry.llm.queries import tokenizer_file
from test_simhash import brute_alike
from test_substring_dedup import brute as brute_substring


def test_stages_and_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "SimHash near-dedup", "substring dedup", "packing"]


def test_run_matches_brute_force(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect() if r.score >= 0.5}
    left = {i: r for i, r in rows.items() if i not in toxic}
    kept = {r.doc_id for r in quality_rules.judge(spark.createDataFrame(list(left.values()), docs.schema), labels).collect() if r.kept}
    left = {i: r for i, r in left.items() if i in kept}
    left = {d: left[d] for _, d in brute_alike([(r.doc_id, r.text) for r in left.values()])}
    removed = {d: n for d, _, n, _ in brute_substring([(r.doc_id, r.text) for r in left.values()], 35)}
    assert 0 < len(left) < len(rows)

    got = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in got} == set(left)
    encoder = ByteEncoder(tokenizer_file(), fast=False)
    for doc, pieces in groupby(sorted(got, key=lambda p: (p.doc_id, p.start)), key=lambda p: p.doc_id):
        ids = [x for p in pieces for x in p.ids]
        text = encoder.tokenizer.decode(ids[:-1])
        assert ids[-1] == 1
        assert len(left[doc].text.split()) - len(text.encode().split()) == removed[doc]
        if not removed[doc]:
            assert text == left[doc].text


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
