"""The pipeline against the same decisions made without Spark."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from srcquarry.llm import bpe, decontamination, ngram_join, queries, secrets, toxicity


def test_pipeline(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect() if r.text is None or model.expected(r.text) < toxicity.CUT}
    components = ngram_join.brute(texts)
    texts = {k: t for k, t in texts.items() if components[k][1] == k}
    index = decontamination.Index([tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()])
    texts = {k: t for k, t in texts.items() if not index.hits([t or ""])[0]}
    scanner, codec = secrets.scanner(), bpe.codec(queries.BYTE_BPE)
    want = {k: hashlib.sha256(codec.encode(secrets.redact(t or "", scanner.spans(t or ""), "[SECRET]"))).hexdigest() for k, t in texts.items()}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf)
        assert (out.columns == docs.columns) == (name != "encoding") and out.count() == 0


def test_awkward_documents(spark, sf, tmp_path):
    """Null and repeated ids, null, empty and very long texts, repeated rows and extra columns, through all stages."""
    import os
    import shutil

    from pyspark.sql import functions as F

    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near), (2, near + " end"), (2, near + " end"), (2, "another text of id two, clean and short"), (None, near), (None, "no id at all, and clean"), (3, None), (4, ""), (5, " \n"), (6, "word " * 60_000), (7, "password = abcdefgh1 stays otherwise"), (7, "password = abcdefgh1 stays otherwise")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "node", "sig", "ids", "hits", "score", "doc")} | {"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stored(stage(spark, kept, str(tmp_path)), "awkward")
        assert kept.columns == docs.columns
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in kept.collect()), key=repr)
    # of the near copies the row with the least id stays, of equal rows one; nulls and texts without words are linked with nothing
    want = [(-1, "no id at all, and clean"), (1, near), (2, "another text of id two, clean and short"), (3, None), (4, ""), (5, " \n"), (6, "word " * 60_000), (7, "[SECRET] stays otherwise")]
    assert got == sorted(want, key=repr)
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(shared))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect()) == sorted(k for k, _ in want)
    assert [p.split("-")[0] for p in set(os.listdir(shared)) - before] == ["stage"]
