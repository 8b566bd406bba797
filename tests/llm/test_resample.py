"""Importance resampling against one document at a time, and the radix sort against sorted()."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from adquanta.llm import resample
from adquanta.llm.words import split_words

import brute
from brute import frame

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    ws = WORD.findall(brute.lower(text).encode())
    return len(ws), [zlib.crc32(b" ".join(ws[i:i + k])) % 10000 for k in (1, 2, 3) for i in range(len(ws) - k + 1)]


def plain(rows, target, percent=5, least=20):
    """(id, n_features, weight, score, rank) of every row."""
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    n, m = sum(s.values()), sum(t.values())
    out = []
    for d, text in rows:
        words, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000)))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[:len(able) * percent // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


TARGET = ["ra lo the mi", None, "", "w1 w2 w3 café", "THE ra"]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_resample_matches_brute_force(spark, docs, rows):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    for percent, options in ((5, {}), (40, {"digit_bits": 3, "slice_rows": 7}), (100, {"slice_rows": 20})):
        got = resample.resample(docs, target, percent=percent, **options)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert ordered(map(tuple, got.collect())) == ordered(plain(rows, TARGET, percent))


def test_resample_of_odd_tables(spark, odd, empty):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for percent in (50, 100):
        got = [tuple(r) for r in resample.resample(odd, target, percent=percent).collect()]
        want = plain(rows, TARGET, percent)
        # Rows of one id and score may take each other's rank.
        assert ordered(got) == ordered(want)
    assert resample.resample(empty, target).count() == 0
    assert len(resample.resample(odd, empty).collect()) == 7


def test_word_checksums():
    texts = ["", "a", "abc", "x" * 63 + " " + "y" * 64 + " " + "z" * 65, "Q" * 5000, "é中 naïve 9", "A b C", None]
    w = split_words(pa.array(texts), resample._BETWEEN)
    plain_words = [x for t in texts for x in WORD.findall(brute.lower(t).encode())]
    assert resample.word_sums(w).tolist() == [zlib.crc32(x) for x in plain_words]


def test_feature_buckets():
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 9, 70, 300])))
                      for _ in range(rng.randint(0, 9))) for _ in range(40)]
    doc, bucket = resample.feature_buckets(split_words(pa.array(texts), resample._BETWEEN))
    got = {}
    for d, b in zip(doc.tolist(), bucket.tolist()):
        got.setdefault(d, Counter())[b] += 1
    for i, t in enumerate(texts):
        assert got.get(i, Counter()) == Counter(features(t)[1])


@pytest.mark.parametrize("low,high", [(0, 0), (-5, 5), (-2**63, 2**63 - 1), (2**62, 2**62 + 9)])
def test_radix_sort(spark, low, high):
    rng = random.Random(1)
    rows = [(rng.choice([None, rng.randint(low, high), low, high]), rng.choice([None, rng.randint(-3, 3)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = resample.radix_positions(df, [("b", True), ("a", False)], "at", digit_bits=5, slice_rows=30).collect()
    assert sorted(r["at"] for r in got) == list(range(400))
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is None, r[0] or 0))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["at"])] == order


def test_radix_sort_of_nothing(spark):
    assert resample.radix_positions(spark.range(0), [("id", False)], "at").count() == 0


def test_gains_of_empty_sides():
    assert set(resample.bucket_gains(np.zeros(8, np.int64), np.zeros(8, np.int64)).tolist()) == {0}
