import random

import numpy as np
import pyarrow as pa
import pytest

from adquanta.llm import exact, fm_index, minhash, repeats, suffixes
from adquanta.llm.components import connected
from adquanta.llm.fm_index import FMIndex
from adquanta.llm.words import split_words
from adquanta.session import stage

import brute
from brute import frame


def test_exact_matches_brute_force(docs, rows):
    got = {r["doc_id"]: r for r in exact.exact_duplicates(docs, capacity=3).collect()}
    groups = {}
    for d, t in rows:
        groups.setdefault(brute.lower(t), []).append(d)
    assert len(got) == len(rows)
    for d, t in rows:
        group = groups[brute.lower(t)]
        r = got[d]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(group), len(group), d == max(group))
        assert r["text_sha256"] == brute.sha(brute.lower(t))
    assert len({r["bucket"] for r in got.values()}) > 4
    assert {r["doc_id"] for r in exact.drop_exact(docs).collect()} == {max(g) for g in groups.values()}


def test_exact_odd_rows(odd, empty):
    got = sorted(exact.exact_duplicates(odd).collect(), key=str)
    by_text = {}
    for r in got:
        by_text.setdefault(r["text_sha256"], set()).add((r["keep_id"], r["group_size"]))
    assert len(got) == 7 and all(len(v) == 1 for v in by_text.values())
    text = " ".join(f"w{i}" for i in range(60))
    assert by_text[brute.sha(text)] == {(5, 4)}
    assert exact.exact_duplicates(empty).count() == 0
    assert exact.drop_exact(empty).columns == empty.columns


def test_directory_doubles_only_where_full():
    counts = {0: 1, 1: 1, 2: 9, 3: 9, 12: 1}
    entries = exact.split_directory(counts, 4, 9)
    assert len(entries) == 16
    assert entries[2] != entries[3] and len(set(entries[8:])) == 1
    assert exact.split_directory({}, 4, 9) == [0]
    assert exact.split_directory({5: 100}, 4, 9)[5] == 5  # one key can't be split further


@pytest.mark.parametrize("module,window", [(fm_index, 35), (suffixes, 50)])
def test_repeats_match_brute_force(docs, rows, module, window):
    remove = fm_index.remove_substrings if module is fm_index else suffixes.remove_repeats
    want = brute.removed([t for _, t in rows], window)
    assert sum(n for _, n in want) > 300
    for options in ({}, {"many": 1, "shard_bytes": 500}, {"many": 4}):
        got = {r["doc_id"]: r for r in remove(docs, digest=True, **options).collect()}
        for (d, t), (left, n) in zip(rows, want):
            assert (got[d]["n_words"], got[d]["n_removed"]) == (len(brute.words(t)), n), d
            assert got[d]["kept_sha256"] == brute.sha(" ".join(left)), d
    texts = remove(docs)
    assert texts.columns == docs.columns
    for r in texts.collect():
        left, n = want[r["doc_id"]]
        assert r["text"] == (" ".join(left) if n else rows[r["doc_id"]][1])


def test_repeats_odd_rows(odd, empty):
    for remove in (fm_index.remove_substrings, suffixes.remove_repeats):
        got = remove(odd, digest=True).collect()
        assert sorted(r["n_removed"] for r in got) == [0, 0, 0, 60, 60, 60, 60]
        assert remove(empty, digest=True).count() == 0
        assert remove(empty).count() == 0


def test_small_windows_on_few_words(spark):
    """Few different words: symbols and minimisers tie everywhere."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    want = brute.removed(texts, 12)
    for remove in (fm_index.remove_substrings, suffixes.remove_repeats):
        got = {r["doc_id"]: r for r in remove(frame(spark, list(enumerate(texts))), window=12, k=4, digest=True).collect()}
        assert [got[i]["kept_sha256"] for i in range(60)] == [brute.sha(" ".join(x)) for x, _ in want]


@pytest.mark.parametrize("remove,window", [(fm_index.remove_substrings, 35), (suffixes.remove_repeats, 50)])
def test_copies_of_a_passage_are_one_piece(spark, remove, window):
    """A passage in a third of the texts: no more pieces than different ones per block, in any mode."""
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randint(0, 10**7)}" for _ in range(n))
    passage = prose(100)
    texts = [f"{prose(60)} {passage} {prose(60)}" if i % 3 == 0 else prose(120) for i in range(600)]
    rows = frame(spark, list(enumerate(texts)))
    want = brute.removed(texts, window)
    named = repeats.with_rows(rows, "doc_id", "text")
    counts = {}
    for many in (1, repeats.VARIED):
        got = {r["doc_id"]: r["kept_sha256"] for r in remove(rows, digest=True, many=many).collect()}
        assert [got[i] for i in range(600)] == [brute.sha(" ".join(x)) for x, _ in want]
        pieces = stage(repeats._pieces(named, window, 8, many), "pieces")
        counts[many] = pieces.count()
        assert pieces.selectExpr("explode(ids)").count() >= 200
        # Ends of the passage meet other words in each text; inside it all pieces are copies.
        blocks = pieces.select("block").distinct().count()
        assert pieces.where("size(ids) > 1").count() >= 3
        assert pieces.where("size(ids) > 1").count() <= 100 * blocks
    assert counts[repeats.VARIED] <= counts[1]


def test_backward_search_counts():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 500).astype(np.uint8)
    index = FMIndex(text, 8)
    for _ in range(50):
        at, n = rng.integers(0, 480), rng.integers(1, 9)
        pattern = text[at:at + n]
        lo, hi = np.zeros(1, np.int64), np.full(1, len(text))
        for symbol in pattern[::-1]:
            lo, hi = index.step(np.array([symbol]), lo, hi)
        found = sum((text[i:i + n] == pattern).all() for i in range(len(text) - n + 1))
        # The suffix order wraps at the end of the text, where a pattern may be cut.
        assert abs(int(hi[0] - lo[0]) - found) <= 1


def test_near_matches_brute_force(docs, rows):
    want, sizes = brute.components(rows)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    for (d, _), component, n in zip(rows, want, sizes):
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (n, component, d == component), d
    assert {r["doc_id"] for r in minhash.drop_near(docs).collect()} == {d for (d, _), c in zip(rows, want) if d == c}


def test_near_links_that_no_centre_has(spark):
    """Copies far from each other but near one hub, and chains: no link hangs on a bucket's centre."""
    rng = random.Random(11)
    texts = []
    for family in range(6):
        hub = [f"f{family}w{rng.randint(0, 10**6)}" for _ in range(80)]
        members = [hub]
        for i in range(25):
            copy = list(hub)
            for spot in rng.sample(range(80), 2):
                copy[spot] = f"x{rng.randint(0, 10**9)}"
            members.append(copy)
        chain = list(hub)
        for i in range(10):
            chain = chain[3:] + [f"c{rng.randint(0, 10**9)}" for _ in range(3)]
            members.append(list(chain))
        texts += [" ".join(m) for m in members]
    rng.shuffle(texts)
    pairs = list(enumerate(texts))
    want, _ = brute.components(pairs)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, pairs)).collect()}
    assert [got[d] for d, _ in pairs] == want


def spanned(texts):
    """Pairs that spanning_links joins, and those of all pairs on full sets."""
    keys, bounds = minhash.shingle_sets(split_words(pa.array(texts)))
    links = minhash.spanning_links(keys, bounds, np.zeros(len(texts), np.int64), 75)
    sets = [set(keys[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
             if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return tuple(merged(len(texts), p) for p in (links, pairs))


def merged(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    return root


def test_pairs_of_short_sets_beside_a_hub():
    """Three of four shingles in common and fewer than 58% of the bins: 13 such seeds in 60000."""
    for seed in (752, 2040, 11851, 16066, 18106):
        rng = random.Random(seed)
        ws = [f"w{rng.randint(0, 10**9)}" for _ in range(8)]
        hub = [f"h{i}" for i in range(60)]
        got, want = spanned([" ".join(x) for x in (ws[:7], ws, hub, hub[1:])])
        assert got == want == [0, 0, 2, 2]


def test_chains_of_short_texts():
    """Three members of 5 to 16 words, and many sets that meet without a link."""
    rng = random.Random(9)
    for _ in range(40):
        ws = [f"w{rng.randint(0, 30)}" for _ in range(18)]
        texts = []
        for _ in range(rng.choice([1, 12])):
            at, n = rng.randint(0, 2), rng.randint(5, 16)
            texts += [" ".join(ws[at:at + n + i]) for i in range(3)]
        got, want = spanned(texts)
        assert got == want


def test_blocks_of_a_large_family_meet(docs):
    """Candidates of a centre dealt into pairs of blocks give the same classes as all in one place."""
    rows = docs.selectExpr("xxhash64(doc_id, text) row", "doc_id id", "text")
    sketch = stage(minhash._sketch(rows), "sketch")
    one, many = (sorted(map(tuple, connected(minhash.near_links(sketch, rows, block=block)).collect()))
                 for block in (10_000, 4))
    assert one == many and len(one) > 12


def test_short_sets_at_the_threshold(spark):
    """Three of four shingles in common: exactly 0.75."""
    rng = random.Random(5)
    pairs = []
    for i in range(150):
        ws = [f"s{rng.randint(0, 10**9)}" for _ in range(8)]
        pairs += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(ws[:7]))]
    got = minhash.near_duplicates(frame(spark, pairs)).where("kept").count()
    assert got == 150


def test_near_odd_rows(odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == 7
    assert {r["component_id"] for r in got if r["n_shingles"] == 56} == {3}
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.drop_near(empty).columns == empty.columns


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1000, 1002)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 1002: 1000}
