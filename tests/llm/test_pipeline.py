"""The pipeline's rows against the same five stages in plain Python."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from brute import classes, contamination, cut

from tidegate.llm import bpe, language_id, substring_dedup

SF = "/root/testdata/sf0.001"


def test_rows_by_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    # Language: the model of all labelled texts in order of their hash, equal texts once.
    known = {}
    for _, text, lang in docs:
        at = xxhash.xxh64_intdigest(text.encode(), seed=42)
        known[at - (at >> 63 << 64)] = (text, min(lang, known.get(at - (at >> 63 << 64), (text, lang))[1]))
    picked = [known[k] for k in sorted(known)]
    model = language_id.train([t.encode() for t, _ in picked], [v for _, v in picked])
    scores = model.scores([t.encode() for _, t, _ in docs]).max(axis=1)
    kept = [(i, t) for (i, t, _), s in zip(docs, scores, strict=True) if s >= model.threshold and language_id.has_letter(t)]

    of = classes(kept, percent=pipeline.NEAR)
    kept = [(i, t.encode()) for i, t in kept if of[i][1] == i]
    texts = cut(kept, substring_dedup.RUN)
    texts = {i: t for i, t in texts.items() if not contamination(t, items)[1]}

    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(pipeline.VOCABULARY)), special_tokens={})
    want = {}
    for i, t in texts.items():
        ids = np.array(encoder.encode_ordinary(t.decode()), dtype="<u4").tobytes()
        want[i] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, SF).collect()} == want
