import hashlib
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from adquanta.llm.bpe import ChunkWords, decode, encode, read_ranks
from adquanta.llm.packing import BITS, DIMENSIONS, Projection, hilbert_keys, pack
from adquanta.llm.words import mix


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(),
                             special_tokens={})


def test_bpe_is_the_library_s(docs, rows):
    want = library()
    for options in ({}, {"chunk_bytes": 2000, "shared_chunks": 2}):
        tokens = encode(docs, **options)
        ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in tokens.collect()}
        assert ids == {d: want.encode_ordinary(t or "") for d, t in rows}
    back = {r["doc_id"]: r["decoded"].decode() for r in decode(tokens).collect()}
    assert back == {d: t or "" for d, t in rows}
    for r in decode(tokens, digest=True).collect():
        text = " ".join(map(str, ids[r["doc_id"]]))
        assert r["n_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_odd_rows(odd, empty):
    assert encode(odd).count() == 7
    assert decode(encode(empty)).count() == 0


def test_words_of_a_chunk_are_the_pattern_s_matches():
    """Cut and counted in Arrow, whatever stands around the spaces, in slices and with empty batches."""
    parts = [" ", "  ", "a", "ab", "Z", "9", "'s", "'re", "'", "!", "%%", "(.", "\n", "\t", "\x1c", "\x85", "\xa0",
             "\u1680", "\u2003", "\u2014", "\u2028", "\u205f", "\u3000", "\u4e2d", "\u0301", "\xe9", "\U0001f600"]
    rng = random.Random(3)
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(20_000)] + [None, "", " ", "  "]
    column = pa.array(texts, pa.string()).slice(5)
    found = ChunkWords.of(iter([column.slice(0, 9000), pa.array([None, ""], pa.string()), column.slice(9000)]))
    assert len(set(found.words.to_pylist())) == len(found.words)
    got = [[found.words[w].as_py().decode() for r in run[a:b]
            for w in found.word[found.starts[r]:found.starts[r] + found.counts[r]].tolist()]
           for run, first in found.parts for a, b in zip(first[:-1], first[1:])]
    want = [regex.findall(public_tokenizers.PATTERN, t or "") for t in texts[5:]]
    assert got == want[:9000] + [[], []] + want[9000:]


def check_packing(pieces, want, length=1024):
    """Every id lies in one piece, sequences have no gaps, and nearly all are full."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert by_doc.keys() == want.keys()
    for d, ids in want.items():
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            raw = np.array(ids[at:at + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(raw)
            at += p["length"]
        assert at == len(ids)
    partly = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= length
        partly += at < length
    return partly


def test_packing(docs, rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = {d: t.encode(x or "", add_special_tokens=False).ids + [0] for d, x in rows}
    packed = pack(docs).withColumn("ids_crc32", F.crc32("ids"))
    pieces = packed.collect()
    assert check_packing(pieces, want) <= packed.rdd.getNumPartitions()
    # Equal texts are neighbours.
    order = {p["doc_id"]: i for i, p in enumerate(sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))) if p["start"] == 0}
    assert abs(order[10] - order[11]) <= 2


def test_packing_odd_rows(odd, empty):
    assert pack(odd).agg(F.sum(F.when(F.col("start") == 0, 1))).first()[0] == 7
    assert pack(empty).count() == 0


def test_hilbert_neighbours():
    points = np.array(np.meshgrid(*[range(8)] * 3)).reshape(3, -1).T
    keys = hilbert_keys(points, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_projection_counts_signs_in_little_memory():
    projection = Projection(5000)
    bits = mix(np.arange(5000, dtype=np.uint64) + np.uint64(1))
    plain = 2 * ((bits[:, None] >> np.arange(DIMENSIONS, dtype=np.uint64)) & np.uint64(1)).astype(np.int64) - 1
    for ids in (np.zeros(0, "<u2"), np.full(200_001, 7, "<u2"), np.arange(1_000_000).astype("<u2") % 5000):
        mean = plain[ids].sum(0) / max(1, len(ids))
        wanted = np.minimum(((mean + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        tracemalloc.start()
        got = projection.point(ids)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.array_equal(got, wanted) and peak < 2_000_000
