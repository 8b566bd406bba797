"""SimHash classes against all pairs, the code against its definition."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash

from adquanta.llm import simhash
from adquanta.llm.components import connected
from adquanta.llm.words import split_words

import brute
from brute import frame


def fingerprint(text):
    ws = brute.words(brute.lower(text))
    runs = [ws[i:i + 3] for i in range(len(ws) - 2)] or ([ws] if ws else [])
    h = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def classes(prints, most=2):
    """Smallest index reachable by links of at most ``most`` bits."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= most:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_matches_brute_force(docs, rows):
    prints = [fingerprint(t) for _, t in rows]
    want = classes(prints)
    got = {r["doc_id"]: r for r in simhash.simhash_duplicates(docs).collect()}
    assert len(got) == len(rows)
    for (d, _), p, c in zip(rows, prints, want):
        assert (got[d]["fingerprint"], got[d]["component_id"]) == (f"{p:016x}", rows[c][0]), d


def test_simhash_odd_rows(odd, empty):
    got = simhash.simhash_duplicates(odd).collect()
    assert len(got) == 7
    text = " ".join(f"w{i}" for i in range(60))
    assert {r["component_id"] for r in got if r["fingerprint"] == f"{fingerprint(text):016x}"} == {3}
    alone = [r for r in got if r["fingerprint"] == "0" * 16]
    assert len(alone) == 1 and alone[0]["component_id"] is None
    assert simhash.simhash_duplicates(empty).count() == 0


def test_long_text_and_block_ends(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 2, 3, 5, 40, 9, 6, 0, 4)]
    got = simhash.fingerprints(split_words(pa.array(texts)))
    assert got.tolist() == [fingerprint(t) for t in texts]


def test_every_word_has_its_codewords():
    """Within three bits of any word lies exactly one codeword; codewords differ in seven bits or more."""
    code = np.flatnonzero(simhash.syndromes(np.arange(1 << 23)) == 0)
    assert len(code) == 1 << 12
    assert len(set((code >> 11).tolist())) == 1 << 12
    assert np.bitwise_count(code[1:]).min() == 7
    some = np.random.default_rng(1).integers(0, 1 << 23, 300)
    index, n = simhash.near_codewords(some)
    by_index = {int(c) >> 11: int(c) for c in code}
    for word, row, k in zip(some.tolist(), index.tolist(), n.tolist()):
        near = {c >> 11 for c in code.tolist() if (c ^ word).bit_count() <= 4}
        assert set(row[:k]) == near and 1 <= k <= 6
        assert min((by_index[i] ^ word).bit_count() for i in row[:k]) <= 3


def test_two_errors_always_share_a_key():
    rng = random.Random(3)
    for _ in range(40):
        x = rng.getrandbits(64)
        near = [x] + [x ^ 1 << i ^ 1 << j for i in range(64) for j in range(i + 1)]
        at, keys = simhash.fuzzy_keys(np.array(near, np.uint64))
        own = set(keys[at == 0].tolist())
        met = np.zeros(len(near), bool)
        met[at[np.isin(keys, list(own))]] = True
        assert met.all()


def linked(spark, prints, **options):
    nodes = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "node long").distinct()
    links = simhash.fuzzy_links(nodes, **options)
    assert links.count() < 70 * len(prints)
    roots = {r["node"]: r["root"] for r in connected(links).collect()}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    groups = {}
    for i, p in enumerate(signed):
        groups.setdefault(roots.get(p, p), []).append(i)
    return {frozenset(g) for g in groups.values()}


def wanted(prints):
    groups = {}
    for i, c in enumerate(classes(prints)):
        groups.setdefault(c, []).append(i)
    return {frozenset(g) for g in groups.values()}


def test_large_families_link_without_pairs(spark):
    """A family in one bucket: small buckets pair by pair, large ones over the fingerprints around them."""
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = set(base) | {0, 1 << 63, (1 << 64) - 1}
    for b in base:
        for _ in range(150):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    want = wanted(prints)
    assert 6 < len(want) < len(prints) - 100
    for full in (1, 8, 10_000):
        assert linked(spark, prints, full=full) == want


def test_component_of_copies_takes_the_smallest_id(spark):
    text = "same text of some words here " * 3
    got = simhash.simhash_duplicates(frame(spark, [(7, text), (4, text.upper()), (9, text), (2, "other words stand here now"), (5, ""), (6, None)])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {7: 4, 4: 4, 9: 4, 2: 2, 5: 5, 6: 5}
