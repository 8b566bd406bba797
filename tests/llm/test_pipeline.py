import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from adquanta.llm.compression import CLASS_BYTES, CUT, PER_CLASS, fit_compression
from adquanta.llm.fit import labelled_sample, remainder
from adquanta.llm.registry import QUERIES

import brute
from test_tokens import check_packing


def test_stages_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = labelled_sample(docs, labels, "quality", remainder("doc_id", 5) != 0, PER_CLASS, CLASS_BYTES)
    model = fit_compression(sample)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    scores = model.score([t.encode() for _, t in texts])
    left = [x for x, s in zip(texts, scores) if s >= CUT]
    assert 0 < len(left) < len(texts)
    newest = {}
    for d, t in left:
        newest[brute.lower(t)] = max(d, newest.get(brute.lower(t), d))
    left = [(d, t) for d, t in left if newest[brute.lower(t)] == d]
    named, _ = brute.components(left)
    left = [x for x, c in zip(left, named) if x[0] == c]
    cut = brute.removed([t for _, t in left], 50)
    left = [(d, " ".join(ws) if n else t) for (d, t), (ws, n) in zip(left, cut)]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = {d: t.encode(x, add_special_tokens=False).ids + [0] for d, x in left}
    pieces = corpus_pipeline.run(spark, sf_dir).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(pieces, want)


def test_stages_keep_columns(spark, docs, sf_dir):
    for name, step in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            assert step(spark, frame, sf_dir).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "repeats", "packing"]


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
