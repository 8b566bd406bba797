"""Near duplicates by one-permutation MinHash with optimal densification.

Each set of shingles gets one value a bin from a single hash; an empty bin
borrows from the first filled bin in an order drawn for that bin alone. Bands of
bins name buckets. Each bucket links its members to one centre, so it gives one
candidate a member. Candidates are confirmed on full sets. Members whose link to
the centre is refuted are then compared with the rest of their bucket, block by
block, so that no link hangs on the choice of the centre.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .components import connected
from .words import Words, chunks, mix, signed, split_words, unused

SHINGLE = 5
BANDS, ROWS = 48, 4   # at similarity 0.75 a pair misses all bands with chance 1e-8
BINS = BANDS * ROWS
PERCENT = 75
BLOCK = 4_096            # candidates of a centre that are compared in one place
BUNDLE_BYTES = 4 << 20   # text of small groups that share a task's call

# Where an empty bin looks for a value: an order of all bins for each bin.
_ORDER = np.argsort(mix(np.arange(BINS * BINS, dtype=np.uint64)).reshape(BINS, BINS), axis=1)


def shingle_sets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and their bounds."""
    h = w.hashes(lower=True)
    at, key = w.windows(h, SHINGLE)
    key = key.copy()
    short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    whole = np.zeros(len(short), np.uint64)
    for i in range(SHINGLE - 1):
        has = w.counts[short] > i
        whole[has] = mix(whole[has] * np.uint64(3) + h[w.first[short[has]] + i] + np.uint64(1))
    sizes = np.maximum(w.counts - SHINGLE + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    for a, b in zip(bounds[:-1], bounds[1:]):
        key[a:b].sort()
    doc = np.repeat(np.arange(w.n_docs), sizes)
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[fresh], doc[fresh]
    spot = np.searchsorted(doc, short)
    key, doc = np.insert(key, spot, whole), np.insert(doc, spot, short)
    return key, np.searchsorted(doc, np.arange(w.n_docs + 1))


def signatures(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One value a bin and text; texts without shingles have arbitrary values."""
    n = len(bounds) - 1
    none = ~np.uint64(0)
    out = np.full(n * BINS, none)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    value = mix(keys + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(1)
    np.minimum.at(out, doc * BINS + (keys % np.uint64(BINS)).astype(np.int64), value)
    first = out.reshape(n, BINS)
    full = first != none
    out = first.copy()
    row, column = np.nonzero(~full & (np.diff(bounds) > 0)[:, None])
    for turn in range(BINS):
        if not len(row):
            break
        donor = _ORDER[column, turn]
        hit = full[row, donor]
        out[row[hit], column[hit]] = first[row[hit], donor[hit]]
        row, column = row[~hit], column[~hit]
    return out


def _sketch(docs: DataFrame) -> DataFrame:
    """Per row: its id, set size, set digest ``node``, band keys, one byte a bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                keys, bounds = shingle_sets(split_words(part.column("text")))
                n = np.diff(bounds)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(keys))))
                node = mix((total[bounds[1:]] - total[bounds[:-1]]) + n.astype(np.uint64))
                values = signatures(keys, bounds)
                band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(n), BANDS))
                for i in range(ROWS):
                    band = mix(band * np.uint64(5) + values[:, i::ROWS])
                some = n > 0
                lists = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
                low = (values & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("id"), pa.array(n.astype(np.int64)),
                     pa.array(signed(node), mask=~some),
                     pa.ListArray.from_arrays(pa.array(lists), pa.array(signed(band[some].ravel()))),
                     pa.array([x.tobytes() for x in low], pa.binary())],
                    ["row", "id", "n", "node", "bands", "bins"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"row bigint, id {kind}, n bigint, node bigint, bands array<bigint>, bins binary")


def spanning_links(keys: np.ndarray, bounds: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join whatever confirmed links join among these sets.

    With two sides (0 and 1) links within a side are somebody else's business.
    All sets are compared with the one nearest to the commonest values first.
    Of the others, all pairs that are not joined yet are counted exactly unless
    their sizes and the hub's members rule them out; signatures never do, as in
    small sets one member can fill most bins.
    """
    n = len(bounds) - 1
    sets = [keys[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = np.diff(bounds)
    bins = (signatures(keys, bounds) & np.uint64(255)).astype(np.uint8)
    counts = np.zeros((BINS, 256), np.int64)
    np.add.at(counts, (np.arange(BINS), bins), 1)
    hub = int(counts[np.arange(BINS), bins].sum(1).argmax())
    # Which of the hub's members each set has, as bits, and how many others it has.
    shared = np.zeros((n, -(-len(sets[hub]) // 64) * 8), np.uint8)
    for i, one in enumerate(sets):
        at = np.searchsorted(sets[hub], one)
        at[at == len(sets[hub])] = 0
        has = np.zeros(len(sets[hub]), bool)
        has[at[sets[hub][at] == one]] = True
        bits = np.packbits(has)
        shared[i, :len(bits)] = bits
    shared = shared.view(np.uint64)
    both = np.bitwise_count(shared).sum(1, dtype=np.int64)
    others = sizes - both
    # Members that the hub lacks, numbered, and the sets that have each.
    owner = np.repeat(np.arange(n), sizes)
    rest = ~np.isin(keys, sets[hub])
    names, member = np.unique(keys[rest], return_inverse=True)
    spans = np.concatenate(([0], np.cumsum(others)))
    order = np.argsort(member, kind="stable")
    having = owner[rest][order]
    starts = np.searchsorted(member[order], np.arange(len(names) + 1))
    root = np.arange(n)
    links = [(i, hub) for i in np.flatnonzero(
        100 * both >= percent * (sizes + sizes[hub] - both)).tolist() if i != hub]
    root[[i for i, _ in links]] = hub
    number, cross = np.arange(n), side.any() and not side.all()
    for i in range(n):
        later = np.flatnonzero((root != root[i]) & (number > i) & ((side != side[i]) | (not cross)))
        if not len(later):
            continue
        # At most the common members of the hub and all of the smaller rest are shared.
        of_hub = np.bitwise_count(shared[later] & shared[i]).sum(1, dtype=np.int64)
        most = of_hub + np.minimum(others[later], others[i])
        open_ = 100 * most >= percent * (sizes[later] + sizes[i] - most)
        later, of_hub = later[open_], of_hub[open_]
        if not len(later):
            continue
        common = of_hub + _counts(having, starts, member[spans[i]:spans[i + 1]], n)[later]
        for j in later[100 * common >= percent * (sizes[later] + sizes[i] - common)].tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                links.append((i, j))
    return links


def _counts(having: np.ndarray, starts: np.ndarray, members: np.ndarray, n: int) -> np.ndarray:
    """How many of some members each of n sets has."""
    total = np.zeros(n, np.int64)
    for part in np.array_split(members, max(1, -(-int((starts[members + 1] - starts[members]).sum()) // 4_000_000))):
        lengths = starts[part + 1] - starts[part]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[part] - ends + lengths, lengths)
        total += np.bincount(having[at], minlength=n)
    return total


def near_links(sketch: DataFrame, docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Confirmed links (a, b) between the nodes of a sketch, enough to join each class.

    Two nodes of a bucket are both candidates of its centre, so the candidates
    of a centre meet in one place with their texts: whole, or for very many in
    pairs of blocks of about ``block`` nodes. What leaves is a spanning forest
    of confirmed links, never more rows than came.
    """
    known = sketch.where("node is not null")
    members = known.select(F.explode("bands").alias("key"), "node")
    # Equal sets share their node, so a bucket of copies only has one node and ends here.
    centres = members.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("_top")) \
        .where("centre < _top").drop("_top")
    stars = stage(
        members.join(centres.hint("merge"), "key").select("centre", "node").distinct(), "minhash-stars")
    chosen = stars.select("node").distinct()
    sample = known.join(chosen.hint("merge"), "node").groupBy("node").agg(F.min("row").alias("row"))
    texts = stage(docs.select("row", "text").join(sample.hint("merge"), "row")
                  .select("node", "text").dropDuplicates(["node"]), "minhash-texts", compression="zstd")
    sizes = stage(stars.groupBy("centre").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "minhash-sizes")
    size = texts.agg(F.avg(F.octet_length("text"))).first()[0] or 0
    bundles = max(1, int(stars.count() * size / BUNDLE_BYTES))
    own = F.pmod(F.hash("node"), F.col("blocks"))
    # A block meets every block once: as the first of a pair, or as the second.
    places = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    placed = stars.join(sizes.hint("merge"), "centre").select(
        "centre", "node", own.alias("own"), F.explode(places).alias("p"))
    rows = placed.select("centre", "node", "own", "p.i", "p.j").join(texts.hint("merge"), "node") \
        .withColumn("bundle", F.pmod(F.xxhash64("centre", "i", "j"), F.lit(bundles)))

    def run(table: pa.Table) -> pa.Table:
        centre, i, j, own, node = (np.asarray(table[c]) for c in ("centre", "i", "j", "own", "node"))
        order = np.lexsort((node, j, i, centre))
        table = table.take(pa.array(order))
        centre, i, j, own, node = (x[order] for x in (centre, i, j, own, node))
        cuts = np.flatnonzero((np.diff(centre) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        ends = np.concatenate(([0], cuts, [len(node)])) if len(node) else np.zeros(1, np.int64)
        found: list[tuple[int, int]] = []
        for lo, hi in zip(ends[:-1], ends[1:]):
            keys, bounds = shingle_sets(split_words(table["text"].slice(lo, hi - lo).combine_chunks()))
            side = (own[lo:hi] != i[lo:hi]).astype(np.int64)
            found += [(node[lo + x], node[lo + y]) for x, y in spanning_links(keys, bounds, side, percent)]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("bundle").applyInArrow(run, "a bigint, b bigint")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"),
                       F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketch = stage(_sketch(rows), "minhash-sketch")
    links = near_links(sketch, rows, percent)
    roots = connected(links)
    nodes = sketch.where("node is not null").groupBy("node").agg(F.min("id").alias("least")) \
        .join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.select("node", "root").join(classes.hint("merge"), "root").select("node", "component_id")
    alone = sketch.where("node is null").select("row", "id", "n", F.col("id").alias("component_id"))
    grouped = sketch.where("node is not null").select("row", "id", "n", "node") \
        .join(named.hint("merge"), "node").select("row", "id", "n", "component_id")
    return grouped.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """Per row: the id, n_shingles, component_id (smallest id reachable), kept.

    A text's set holds its distinct shingles of five words, A-Z lower-cased; of
    fewer words the whole sequence. Null and empty texts have an empty set, are
    linked with nothing and stay. Sets with 100 * intersection >= ``percent`` *
    union are linked. Null ids never name a component that has another id.
    Rows that repeat an id and its text get equal answers. An empty table gives
    no rows; other columns are not looked at.
    """
    return _verdicts(docs, id_col, text_col, percent).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns unchanged."""
    name = unused("_row", docs.columns)
    kept = _verdicts(docs, id_col, text_col, percent).where("kept").select(F.col("row").alias(name))
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    return docs.join(kept.hint("merge"), row == kept[name], "left_semi")
