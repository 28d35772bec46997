"""The pipeline: its stages against plain Python, and awkward tables."""

from __future__ import annotations

import re

import corpus_pipeline
from marquee.llm import jaccard_join, pii, quality_rules, sentencepiece_codec
from marquee.llm.frames import read_table

from .conftest import awkward_rows, make_docs
from .test_exact_operators import brute_components, brute_contamination

SF0001 = "/root/testdata/sf0.001"


def test_run_against_plain_python(spark):
    docs = [tuple(r) for r in read_table(spark, SF0001, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in read_table(spark, SF0001, "benchmark").select("item_id", "text").collect()]
    verdict = quality_rules.apply_rules(read_table(spark, SF0001, "documents"), read_table(spark, SF0001, "labels"))
    kept = {r["doc_id"] for r in verdict.filter("kept").collect()}
    docs = [d for d in docs if d[0] in kept]
    first = {d for d, _, c in brute_components(docs) if d == c}
    docs = [d for d in docs if d[0] in first]
    dirty = {r[0] for r in brute_contamination(docs, items) if r[-1]}
    want = {d: pii.redacted(t, pii.find_spans(t)) for d, t in docs if d not in dirty}
    got = corpus_pipeline.run(spark, SF0001)
    back = {r["doc_id"]: r for r in sentencepiece_codec.decode(got).collect()}
    assert {d: r["decoded"] for d, r in back.items()} == want and got.count() == len(want) > 0
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in back.values())


def test_stages_on_awkward_rows(spark, tmp_path, labels):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing like it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make_docs(spark, awkward_rows())
    for rows in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, str(tmp_path))
            assert out.count() <= rows.count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == list(corpus_pipeline.COLUMNS)
    stays = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in stays]
    assert ids.count(1) == 1 and not {5, 6, 10, 11} & set(ids) and {2, 3, 4, 9} <= set(ids) and ids.count(None) == 1


def test_private_texts_lose_their_spans(spark):
    docs = make_docs(spark, [(1, "write to a.b@c.org now"), (2, None)])
    got = {r["doc_id"]: r for r in corpus_pipeline.private(spark, docs, "").collect()}
    assert got[1]["text"] == "write to <EMAIL> now" and got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] is None
    assert not re.search("@", got[1]["text"])


def test_names_and_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near duplicates", "decontamination", "personal data", "tokens"]
    assert jaccard_join.SHINGLE == 5
