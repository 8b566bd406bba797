import itertools
import math
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from adquanta.llm.compression import fit_compression, quality_scores, score_quality
from adquanta.llm.crf import Chain
from adquanta.llm.fit import labelled_sample
from adquanta.llm.rules import apply_rules, tail, text_stats
from adquanta.llm.toxicity import toxicity_scores
from adquanta.llm.urls import RULES, build_cascade, build_levels, filter_urls, in_cascade

import brute
from brute import frame


def test_base_counts(docs, rows):
    got = {r["doc_id"]: r for r in text_stats(docs).collect()}
    for d, t in rows:
        for name, value in brute.base_counts(t).items():
            assert got[d][name] == value, (d, name)


@pytest.fixture(scope="module")
def labelled(spark):
    """Good prose, bad symbol soup, and texts with insults, with their labels."""
    rng = random.Random(9)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    pairs, labels = [], []
    for i in range(900):
        ws = [word() for _ in range(rng.randint(60, 150))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        if toxic:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(["Blorg,", "snark", "vexil."]))
        if bad:
            ws = [w + rng.choice(["###", "$$$", "&&&", "%%%"]) for w in ws]
        pairs.append((i, " ".join(ws)))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(0, 1 - labels[0][1], 1 - labels[0][2]), (None, 1, 0), (5, None, None), (10**6, 1, 1)]
    return frame(spark, pairs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), \
        dict(pairs), {d: (q, t) for d, q, t in labels[:900]}


def test_quality_held_out(labelled, empty):
    docs, labels, _, truth = labelled
    got = quality_scores(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == truth[r["doc_id"]][0] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality_scores(empty, labels).count() == 0
    none = quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_sample_holds_whole_texts_within_its_bounds(spark):
    """No text is cut; one that would pass the bytes is left out; repeated ids count once."""
    rng = random.Random(3)
    sizes = {i: rng.choice([5, 40, 3000]) for i in range(200)}
    pairs = [(i, "é" * n) for i, n in sizes.items()] + [(7, "b"), (7, "a")] * 300 + [(8, None), (None, "x")]
    labels = spark.createDataFrame([(i, i % 2) for i in sizes] + [(3, 0), (None, 1)], "doc_id long, quality int")
    for per_class, class_bytes in ((1000, 10**9), (20, 10**9), (1000, 9000), (1000, 0)):
        got = labelled_sample(frame(spark, pairs), labels, "quality", F.lit(True), per_class, class_bytes)
        for y in (0, 1):
            part = got[got["y"] == y]
            assert len(part) <= per_class and part["text"].str.encode("utf-8").str.len().sum() <= class_bytes
            assert all(t == ("a" if i == 7 else "é" * sizes[i]) for i, t in zip(part["id"], part["text"]))
        assert got["id"].is_unique and 3 not in set(got["id"])
        if class_bytes == 10**9:
            assert len(got) == (199 if per_class == 1000 else 40)
        elif class_bytes:
            assert len(got) > 3 and max(got["text"].str.len()) == 3000


def test_quality_scores_by_hand(labelled, spark):
    """Sizes from plain calls of the compressor, the score from its formula."""
    docs, labels, texts, _ = labelled
    sample = labelled_sample(docs, labels, "quality", F.lit(True), 300, 1 << 20)
    model = fit_compression(sample)
    some = [None, "", "a", "the therone " * 30, texts[1], texts[1], texts[2] * 40]
    got = sorted((r["doc_id"], r["score"]) for r in score_quality(frame(spark, list(enumerate(some))), model).select(
        "doc_id", F.col("score").cast("double").alias("score")).collect())

    def size(text, dictionary):
        data = zstandard.ZstdCompressionDict(dictionary)
        return len(zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_checksum=False,
                                            write_dict_id=False).compress(text))

    for (i, score), text in zip(got, some):
        raw = (text or "").encode()
        good, bad = size(raw, model.good), size(raw, model.bad)
        x = (good - bad) / (good + bad)
        density, short = math.log((good + bad) / 2 / (len(raw) + 1) + 1e-3), 1 / math.sqrt(len(raw) + 16)
        inputs = np.array([x, x * abs(x), density, density**2, short, x * short])
        c = model.calibration
        margin = c.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(c.weights[1:], inputs, c.mean, c.scale))
        assert score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9), i
    assert got[4][1] == got[5][1] and got[0][1] == got[1][1]


def test_scores_ignore_held_out_labels(labelled, spark):
    docs, labels, _, truth = labelled
    flipped = labels.selectExpr(
        "doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) quality",
        "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) toxic")
    for scores in (quality_scores, toxicity_scores):
        one, two = (sorted((r["doc_id"], r["score"]) for r in scores(docs, x).collect()) for x in (labels, flipped))
        assert one == two


def test_toxicity_held_out(labelled, empty, odd):
    docs, labels, texts, truth = labelled
    got = toxicity_scores(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == truth[r["doc_id"]][1] for r in held]) > 0.97
    spans = [texts[r["doc_id"]][x["start"]:x["stop"]].lower() for r in held for x in r["spans"]]
    insults = ("blorg", "snark", "vexil")
    assert np.mean([any(x in part for x in insults) for part in spans]) > 0.95
    meant = sum(texts[r["doc_id"]].lower().count(x) for r in held if truth[r["doc_id"]][1] for x in insults)
    assert sum(part.count(x) for part in spans for x in insults) > 0.95 * meant
    assert toxicity_scores(empty, labels).count() == 0
    assert all(0 <= r["score"] <= 1 for r in toxicity_scores(odd, labels).collect())
    assert toxicity_scores(docs, labels.limit(0)).where("score <> 0.5").count() == 0


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    first = np.array([0, 3, 3, 10, 300])
    chain = Chain(np.r_[rng.normal(size=4), 0.0], 0.3, rng.normal(size=(2, 2)), 0.7)
    features = rng.integers(0, 5, (2, 300))
    p = chain.marginals(features, first)[0]
    e = chain.emissions(features)
    for a, b in ((0, 3), (3, 10)):
        total, one = 0.0, np.zeros(b - a)
        for tags in itertools.product((0, 1), repeat=b - a):
            s = tags[0] * chain.start + sum(t * e[a + i] for i, t in enumerate(tags)) \
                + sum(chain.transition[x, y] for x, y in zip(tags, tags[1:]))
            total, one = total + np.exp(s), one + np.exp(s) * np.array(tags)
        assert np.allclose(p[a:b], one / total)
    step = np.exp(chain.transition)
    ahead, f = [], np.array([1, np.exp(chain.start + e[10])])
    for i in range(10, 300):
        f = f if i == 10 else (f @ step) * np.array([1, np.exp(e[i])])
        f = f / f.sum()
        ahead.append(f)
    back, want = np.ones(2), []
    for i in range(299, 9, -1):
        both = ahead[i - 10] * back
        want.append(both[1] / both.sum())
        back = step @ (np.array([1, np.exp(e[i])]) * back)
        back = back / back.sum()
    assert np.allclose(p[10:], want[::-1])


def test_binomial_tail():
    from math import comb
    for n, k, p in ((20, 0, 0.1), (50, 2, 0.1), (200, 3, 0.05)):
        assert abs(tail(n, k, p) - sum(comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1))) < 1e-12
    assert tail(0, 0, 0.1) == 1.0


def test_rules_limit_false_rejection(labelled, empty, odd):
    docs, labels, _, truth = labelled
    got = apply_rules(docs, labels, alpha=0.2).collect()
    bad = [r for r in got if truth[r["doc_id"]][0] == 0]
    good = [r for r in got if truth[r["doc_id"]][0] == 1]
    assert np.mean([not r["kept"] for r in bad]) > 0.9
    assert np.mean([not r["kept"] and not r["base_failed"] for r in good]) <= 0.2
    assert any("symbols_per_word" in r["rejected_by"] for r in bad)
    # Too few labels certify nothing.
    assert apply_rules(docs, labels.limit(20)).where("size(rejected_by) > 0").count() == 0
    assert apply_rules(docs, labels.limit(0)).where("kept").count() == len(truth)
    assert apply_rules(empty, labels).count() == 0
    assert apply_rules(odd, labels).count() == 7


def test_urls(spark, empty):
    urls = [None, "", "no scheme", "http://", "http://A.Example.ORG", "http://a.example.org/es/1", "x://example.org/es",
            "http://b.example.org/en/12?q=/es/", "http://spam-farm.example.org/en/1", "http://spam-farm.net/en",
            "http://WWW.casino.COM/fr/", "http://notcom/fr/", "http://a.com/de/x#y", "http://ads.track.net?x", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "c", "d") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.org", "", None, "allow")
    assert got[5] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[6] == ("example.org", "/es", "org/", "allow")
    assert got[7] == ("b.example.org", "/en/12", "example.org/en/1", "block")
    assert got[8][2:] == ("example.org/en/1", "block")
    assert got[9] == ("spam-farm.net", "/en", None, "block")
    assert got[10] == ("www.casino.com", "/fr/", "com/fr/", "allow")
    assert got[11] == ("notcom", "/fr/", None, "allow")
    assert got[12][2:] == ("com/de/", "block")
    assert got[13] == ("ads.track.net", "", None, "block")
    assert got[14] == ("b:", "//c/d", None, "allow")
    assert set(RULES.values()) == {"allow", "block"}
    assert filter_urls(pages.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) key", "id % 7 = 0 or id < 50 listed")
    keys = keys.union(spark.createDataFrame([("k1", False)] * 500, keys.schema))
    for shard_keys, round_bytes in ((10**6, 1 << 25), (1_500, 2_000)):
        cascade = build_cascade(keys, shard_keys)
        got = in_cascade(keys, "key", cascade, "found", round_bytes)
        want = keys.groupBy("key").agg({"listed": "max"}).toDF("key", "want")
        assert got.join(want, "key").where("found <> want").count() == 0
        assert cascade.agg({"level": "max"}).first()[0] >= 2
    assert in_cascade(keys, "key", build_cascade(keys.selectExpr("key", "false listed")), "found").where("found").count() == 0
    with pytest.raises(ValueError):
        one = np.array([1, 1], np.uint64)
        build_levels(one, one, np.array([True, False]))
