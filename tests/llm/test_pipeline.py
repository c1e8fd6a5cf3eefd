"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quillstream.llm import quality, shared
from tests.llm.test_operators import near_brute, substring_brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = shared.table(spark, SF, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    frames, seen = [], [before]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.staged(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns, name
        frames.append(docs)
        seen.append({r.doc_id: r for r in docs.collect()})
    first, good, near, whole, clean = seen

    scores = {r.doc_id: r.predicted for r in quality.op7_quality(spark, SF).collect()}
    assert set(good) == {i for i in first if scores[i]}
    assert all(good[i] == first[i] for i in good)

    kept = near_brute({i: r.text for i, r in good.items()}, 5, 80)
    assert set(near) == {i for i in good if kept[i][3]}

    left = substring_brute({i: r.text for i, r in near.items()})
    assert set(whole) == set(near)
    for i, r in whole.items():
        assert hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() == left[i][3]
        assert r.n_chars == len(r.text)
        assert left[i][2] or r.text == near[i].text

    items = [r.text for r in shared.table(spark, SF, "benchmark").collect()]
    assert set(clean) == {i for i, r in whole.items() if not any(" ".join(y.split()) in " ".join(r.text.split()) for y in items)}

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(clean)
    for i, r in got.items():
        ids = t.encode(clean[i].text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and bytes(r.ids) == np.array(ids, "<u4").tobytes()
        assert r.decoded_sha256 == hashlib.sha256(clean[i].text.encode()).hexdigest()
