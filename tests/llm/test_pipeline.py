"""The pipeline's stages, each against brute force on its own input."""

import re
from collections import Counter

import corpus_pipeline
from tessera.llm import toxicity
from tessera.llm.common import materialize

from .test_line_dedup import brute as brute_lines
from .test_mixing import count, targets
from .test_near import brute as brute_near
from .test_packing import check as check_packing
from .test_packing import encoder_once

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "source_mix", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF))
        kept[name] = docs
        rows = before.collect()
        if name != "packing":
            assert docs.columns == before.columns
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
            good = {r.doc_id for r in toxicity.judge(before, model).where("not toxic").collect()}
            assert {r.doc_id for r in docs.collect()} == good and len(good) < len(rows)
        elif name == "line_dedup":
            want = Counter((i, t) for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in rows]))
            assert Counter((r.doc_id, r.text) for r in docs.collect()) == want
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "near_dedup":
            assert sorted(r.doc_id for r in docs.collect()) == [i for i, _, _, k in brute_near([(r.doc_id, r.text) for r in rows], 5, 80) if k]
        elif name == "source_mix":
            sizes = Counter()
            for r in rows:
                sizes[r.source] += count(r.text)
            got = Counter()
            for r in docs.collect():
                got[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
            assert all(abs(got[s] - t) <= 1 for s, t in targets(sizes).items())
        else:
            texts = {}
            for r in rows:
                texts.setdefault(r.doc_id, []).append(r.text)
            check_packing(docs.collect(), texts, encoder_once(), 1024)


def test_odd_rows_pass(spark, odd, nothing):
    for table in (odd, nothing):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF))
            if name != "packing":
                assert docs.columns == table.columns and {(r.kept_text, r.toxic) for r in docs.collect()} <= {("k", "t")}
