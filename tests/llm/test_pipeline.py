"""The pipeline's stages on small tables, each against what it was given."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from queuelens.llm.common import documents
from queuelens.session import scratch_path


def test_stages(spark, data):
    docs = documents(spark, data)
    columns, steps = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        path = scratch_path(spark, f"test-{name}")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        steps.append((name, docs, out))
        docs = out
    assert [s[0] for s in steps] == ["quality", "lines", "near_duplicates", "mixing", "encoding"]
    for name, before, after in steps[:-1]:
        assert after.columns == columns
        ids = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert {r["doc_id"] for r in after.select("doc_id").collect()} <= ids
    (_, given, good), (_, _, lined), (_, _, single), (_, _, mixed), (_, _, encoded) = steps
    assert 0 < good.count() < given.count()
    assert lined.count() == good.count()
    texts = [r["text"] for r in single.collect()]
    assert len(texts) == len(set(texts)) <= lined.count()
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 3
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter((r["doc_id"], sha(",".join(map(str, tok.encode(r["text"] or "", add_special_tokens=False).ids)))) for r in mixed.collect())
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in encoded.collect()) == want


def test_empty_table(spark, data, tmp_path):
    import os
    for name in os.listdir(data):
        if name.endswith(".parquet") and name != "documents.parquet":
            os.symlink(os.path.join(data, name), tmp_path / name)
    documents(spark, data).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
