"""The corpus pipeline against its stages stated plainly."""

import base64
import hashlib

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers

from harrow.llm import decontam, pii, quality


def test_pipeline(spark, docs, sf_dir):
    import tiktoken

    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    bad = {r["doc_id"] for r in quality.classify(spark, docs, labels).where("predicted = 0").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in bad]
    component = brute.near_duplicates(rows, 5)
    rows = [(i, t) for i, t in rows if component[i][1] == i]
    left = docs.join(spark.createDataFrame([(i,) for i, _ in rows], "doc_id long"), "doc_id").select(*docs.columns)
    leaked = {r["doc_id"] for r in decontam.find_leaks(spark, left, benchmark).collect()}
    left = left.where(~left.doc_id.isin(list(leaked))) if leaked else left
    texts = {r["doc_id"]: r["text"] for r in pii.redact(spark, left).collect()}
    for i, t in texts.items():
        assert not {s[3] for s in brute.base_spans(t)} & {"email", "card"}
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in texts.items():
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and len(corpus_pipeline.STAGES) == 5


def test_pipeline_on_awkward_and_empty_tables(spark, edges, docs, sf_dir, tmp_path):
    """All stages over the awkward rows with a run of 1.2 MB among the documents, and over no documents at all."""
    import tiktoken

    long_run = (910001, "ab12" * 300_000, "en")
    columns = docs.columns
    odd = edges.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([long_run], "doc_id long, text string, lang string"))
    odd = odd.selectExpr("doc_id", "text", "lang", "'edge' as source", "cast(length(text) as long) as n_chars").select(columns)
    for name, table in (("odd", docs.limit(0).unionByName(odd).unionByName(docs)), ("empty", docs.limit(0))):
        folder = tmp_path / name
        table.write.parquet(f"file://{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"file://{folder}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/empty").count() == 0
    done = corpus_pipeline.run(spark, f"file://{tmp_path}/odd")
    assert 0 < done.count() <= docs.count() + odd.count() and done.where("n_tokens is null").count() == 0
    # Whatever the quality stage says of such a run, the others take it.
    left = docs.limit(0).unionByName(odd)
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.decontaminate, corpus_pipeline.redact_personal_data):
        left = stage(spark, left, sf_dir)
        assert left.columns == columns
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in left.where("doc_id is not null").collect()}
    assert long_run[0] in texts
    for r in corpus_pipeline.encode_tokens(spark, left, sf_dir).where("doc_id is not null").collect():
        assert r["n_tokens"] == len(library.encode_ordinary(texts[r["doc_id"]]))
