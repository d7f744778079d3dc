"""The stages one by one against brute force, and the whole."""

import hashlib
import struct

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, small):
    from sentencepiece import SentencePieceProcessor
    from test_decontaminate import expected as hits
    from test_neardup import expected as links
    from test_quality import base

    from kvstrata.llm import pii
    from kvstrata.llm.queries import PII_KEY, tokenizer_path

    docs = spark.read.parquet(f"{small}/documents.parquet")
    quality, dedup, decontaminate, private, encode = (f for _, f in corpus_pipeline.STAGES)
    now = quality(spark, docs, small)
    assert now.columns == docs.columns
    kept = {r.doc_id: r.text for r in now.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(not base(i, t)[-1] for i, t in kept.items()) and kept.items() <= texts.items()
    clean = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").collect()}
    assert not {i for i in clean if not base(i, texts[i])[-1]} - kept.keys()

    now = dedup(spark, now, small)
    assert now.columns == docs.columns
    ids = {r.doc_id for r in now.collect()}
    assert ids == {i for i, _, _, k in links(list(kept.items()), 5) if k}

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    now = decontaminate(spark, now, small)
    assert now.columns == docs.columns
    left = {r.doc_id for r in now.collect()}
    assert left == {i for i, _, _, n, *_ in hits([(i, kept[i]) for i in ids], bench) if n == 0}

    want = {r.doc_id: r.text for r in pii.pseudonymize(docs, PII_KEY).collect()}
    now = private(spark, now, small)
    assert now.columns == docs.columns
    assert {r.doc_id: r.text for r in now.collect()} == {i: want[i] for i in left}

    sp = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for rows in (encode(spark, now, small), corpus_pipeline.run(spark, small)):
        got = {r.doc_id: r for r in rows.collect()}
        assert got.keys() == left
        for i, r in got.items():
            ids = sp.encode(want[i], add_bos=True, add_eos=True)
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_empty(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0
        if out.columns == docs.columns:
            docs = out


def test_clashing_columns_and_odd_rows(spark, small):
    """Names that the operators use themselves, rows without ids, repeated and empty texts."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "a", 0), (7, " \n", "en", "a", 3)], docs.schema)
    docs = docs.unionByName(docs.limit(5)).unionByName(odd)
    extra = ["h1", "h2", "__h1", "__gone", "__row", "__key", "__items", "__text", "label", "rep", "kept", "n_words", "__c0", "id"]
    for name in extra:
        docs = docs.withColumn(name, docs.doc_id)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(r[c] == r.doc_id for r in rows for c in extra) and len(rows) > 20
        docs = spark.createDataFrame(rows, docs.schema)
    ids = [r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()]
    assert len(ids) == len(set(ids)) == docs.count()


def test_temporary_tables_go(spark, small, tmp_path, monkeypatch):
    from kvstrata.llm import common

    monkeypatch.setattr(common, "shared_root", lambda _: f"file://{tmp_path}")
    rows = corpus_pipeline.run(spark, small).count()
    left = [p.name for p in (tmp_path / "kvstrata").iterdir()]
    assert rows > 0 and len(left) == 1 and left[0].startswith("stage-4"), left
