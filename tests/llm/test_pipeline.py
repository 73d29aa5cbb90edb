import os
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    import corpus_pipeline as cp
    from lexmesh.llm import mixing, ngram_join, quality_classifier, quality_rules
    from lexmesh.llm.shared import documents, materialise

    docs = documents(spark, SF)
    columns, labels = docs.columns, cp.labels(spark, SF)
    outs = []
    for i, (_, stage) in enumerate(cp.STAGES):
        before, docs = docs, materialise(stage(spark, docs, SF), f"test{i}")
        outs.append((before, docs))
        if i < 4:
            assert docs.columns == columns
    ids = [[Counter(r.doc_id for r in df.select("doc_id").collect()) for df in pair] for pair in outs]
    assert set(ids[0][1]) == {r.doc_id for r in quality_rules.judge(outs[0][0], labels).where("kept").collect()}
    assert set(ids[1][1]) == {r.doc_id for r in quality_classifier.classify(outs[1][0], labels).where("kept").collect()}
    assert set(ids[2][1]) == {r.component_id for r in ngram_join.classes(outs[2][0]).collect()}
    assert ids[3][1] == Counter({r.doc_id: r.copies for r in mixing.mix(outs[3][0]).where("copies > 0").collect()})
    lengths = {r.doc_id: r.n for r in outs[4][1].groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert set(lengths) == set(ids[3][1])
    tokens = {r.doc_id: r.doc_tokens for r in outs[4][1].select("doc_id", "doc_tokens").distinct().collect()}
    assert all(lengths[i] == tokens[i] * ids[3][1][i] for i in lengths)
    assert cp.run(spark, SF).columns == outs[4][1].columns


def test_registered_queries_have_the_contract_columns(spark):
    from lexmesh.llm import queries

    want = {
        "op3": "doc_id:bigint held_out:boolean score:double predicted:int", "op4": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
        "op5": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
        "op6": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint", "op7": "doc_id:bigint n_shingles:bigint component_id:bigint", "op8": "page_id:bigint host:string path:string rule:string verdict:string",
        "op9": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
        "op10": "doc_id:bigint n_chars:bigint edited_sha256:string fingerprint:string edited_fingerprint:string near_edited:double near_next:double",
        "op11": "doc_id:bigint n_a:bigint n_b:bigint n_groups:bigint n_links:bigint n_best:bigint count_sum:bigint groups_sha256:string",
        "op12": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
        "op13": "vec_id:bigint code:string error:bigint label_error:bigint codebooks_sha256:string",
    }
    for name, run in queries.queries().items():
        columns = {f.name: f.dataType.simpleString() for f in run(spark, SF).schema}
        for column in want.get(name.split("_")[0], "").split():
            assert column == f"{column.split(':')[0]}:{columns[column.split(':')[0]]}", name
