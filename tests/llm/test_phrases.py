"""Phrase mining against a count of every phrase of every text."""

import random
import re
from collections import Counter

import numpy as np

from adquanta.llm import phrases

import brute
from brute import SCHEMA


def plain(rows, least, top, percent=100):
    """(lang, rank, phrase, a, l, r, n, score) by counting each run of one to five words."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", brute.lower(text)):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            for k in range(1, 6):
                for i in range(len(ws) - k + 1):
                    f.setdefault(lang, Counter())[tuple(ws[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        longer = Counter()
        for p, c in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], c)
        scored = []
        for p, a in often.items():
            if longer[p] and 100 * longer[p] >= percent * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def frame(spark, rows):
    full = [(i, t, lang, "r", "i", "x", "k", "s", "n", "q") for i, (t, lang) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def mined(df, **options):
    return sorted(tuple(r) for r in phrases.mine_phrases(df, **options).collect())


def made():
    rng = random.Random(4)
    some = ["new york", "New York City hall", "a\tb  c", "the of and", "x", "é ß中 文", "to be or not to be"]
    rows = [(None, "en"), ("", None), (" \n\t. ,", "en"), ("one. two", None), ("w " * 400, "zz"), ("k\x01 l\x1f m", "en")]
    for i in range(150):
        ends = "".join(rng.choice(some) + rng.choice([" ", ". ", ", ", "\n", "? ", "\r", "  "]) for _ in range(12))
        rows.append((ends, rng.choice(["en", "fr", None, "und", ""])))
    return rows + rows[20:30]


def test_phrases_match_brute_force(spark):
    rows = made()
    for least, top, bits in ((5, 2000, 24), (20, 7, 16), (300, 2000, 12)):
        assert mined(frame(spark, rows), least=least, top=top, slots_log2=bits) == plain(rows, least, top)


def test_full_table_of_hashed_counts_hides_nothing(spark):
    """With 256 slots every slot is full, so nothing is padded away early."""
    rows = made()
    assert mined(frame(spark, rows), least=5, slots_log2=8) == plain(rows, 5, 2000)


def test_phrases_of_less_than_all_percent(spark):
    rows = made()
    assert mined(frame(spark, rows), least=5, percent=60) == plain(rows, 5, 2000, 60)


def test_slots_are_cut_off_at_a_byte(spark):
    """More occurrences in a task than a byte holds."""
    rows = [("a b " * 2000, "en")] * 3 + [("a c", "en")] * 150
    assert mined(frame(spark, rows), least=100) == plain(rows, 100, 2000)
    assert mined(frame(spark, rows), least=400) == plain(rows, 400, 2000)


def test_products_beyond_64_bits(spark):
    """Counts as of a corpus of 10**13 words."""
    n = 10**13
    windows = spark.createDataFrame(
        [("en", "a", "b", None, None, None, n // 10), ("en", "b", None, None, None, None, n // 10),
         ("en", None, None, None, None, None, n)],
        "lang string, w1 string, w2 string, w3 string, w4 string, w5 string, n bigint")
    got = {tuple(r["words"]): r["n"] for r in phrases.phrase_counts(windows, 100).collect()}
    assert got == {(): n + n // 5, ("a",): n // 10, ("b",): n // 10, ("a", "b"): n // 10}
    score = spark.sql(f"SELECT (1000BD * cast({n}L AS decimal(16, 0)) * cast({n}L AS decimal(17, 0)))"
                      f" div (cast({n // 7}L AS decimal(19, 0)) * cast({n // 3}L AS decimal(19, 0)))").first()[0]
    assert score == 1000 * n * n // ((n // 7) * (n // 3))


def test_phrases_of_odd_tables(spark, empty, odd):
    assert mined(empty) == []
    assert mined(odd, least=2) == plain([(r["text"], r["lang"]) for r in odd.collect()], 2, 2000)
    assert mined(frame(spark, [(None, None), ("", "en")])) == []


def test_one_long_text(spark):
    rng = np.random.default_rng(2)
    rows = [(" ".join(f"w{i}" for i in rng.zipf(1.3, 300_000) % 5000), "en"), ("z " * 10, "en")]
    assert mined(frame(spark, rows), least=400) == plain(rows, 400, 2000)
