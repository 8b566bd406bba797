"""Byte-level BPE: ranked merges folded over the distinct words of the whole table.

Texts are dealt by hash into chunks of bounded size. A chunk names its distinct
words (matches of the pattern) that are no tokens themselves, one packed list a
hash bucket; equal words of many chunks meet in their bucket, and Spark's
higher-order functions merge each once, as an array of its bytes' ids, against a
rank map that stands in the plan as a literal. The answers go back to the chunks
that asked, where texts are put together from them. Texts are shuffled once,
lists of words there and back; a task holds one chunk or one bucket.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
import zlib
from dataclasses import dataclass
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import chunks

RANKS = "byte_bpe_50k.tiktoken"
CHUNK_BYTES = 8 << 20     # text whose words are named together
STRETCH_BYTES = 2 << 20   # text that is split at once
SHARED_CHUNKS = 4096      # chunks that share one folded word
BUCKET_CHUNKS = 4         # a bucket holds as many words as that many chunks
ROW_WORDS = 10_000        # words that are folded in one row
LONG_WORD = 64            # longer words are merged with a heap, not by the fold
NONE = 1 << 17            # no rank is that large
ID_BITS, RANK_AT = 16, 40 # an id has 16 bits, the start of one in its word 24
END = (1 << ID_BITS) - 1  # no id; stands before and behind a word
REST = (1 << RANK_AT) - 1

_MATCH = regex.compile(public_tokenizers.PATTERN)
# Frequent forms: one match, or a word and marks, which start with no apostrophe.
_ONE_MATCH = "^ ?(?:[A-Za-z]+|[0-9]+)$"
_TWO_MATCHES = r"^(?P<word> ?[A-Za-z]+)(?P<marks>[!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)$"
# White space: single bytes, and what starts with one of four bytes.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE_BLANKS = np.array([int.from_bytes(chr(c).encode()) for c in (
    0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])


def read_ranks(name: str = RANKS) -> dict[bytes, int]:
    """Rank of every token of a public rank file."""
    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def offsets_of(values: pa.Array) -> np.ndarray:
    """Where each value begins in the bytes of a string, binary or list array, and the end."""
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    n = len(values)
    return np.frombuffer(values.buffers()[1], kind, n + 1 + values.offset)[values.offset:] if n else np.zeros(1, kind)


@functools.cache
def token_parts(name: str) -> tuple[pa.Array, pa.Array]:
    """The bytes of every id and its decimal number with a space; made once a worker, if it has rows."""
    ranks = read_ranks(name)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pa.array(pieces, pa.large_binary()), pa.array([b"%d " % i for i in range(len(pieces))], pa.large_binary())


def released(found: pa.Table) -> pa.Table:
    """The same; what Arrow keeps for later goes back, as idle workers share their executor's memory."""
    pa.default_memory_pool().release_unused()
    return found


def listed(values: pa.Array) -> list:
    """The values as Python objects, in a fraction of the time of ``to_pylist``."""
    return values.to_numpy(zero_copy_only=False).tolist()


def runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Parts of the texts whose matches of the pattern are those of the texts, and the first of each text.

    A text is cut before every space that no white space follows. Null is an
    empty text and has no part. Parts lie on the bytes of the texts.
    """
    texts = pc.fill_null(texts, "")
    bounds = offsets_of(texts)
    raw = texts.buffers()[2] if len(texts) else None
    if raw is None or bounds[0] == bounds[-1]:
        return pa.array([], pa.string()), np.zeros(len(bounds), np.int64)
    data = np.frombuffer(raw, np.uint8, bounds[-1])
    spaces = np.flatnonzero(data[bounds[0]:-1] == 0x20) + bounds[0]
    ends = np.zeros(len(data) + 1, bool)
    ends[bounds] = True
    after = data[spaces + 1]
    spaces = spaces[~_BLANK[after] & ~ends[spaces + 1]]
    wide = np.flatnonzero(_WIDE[data[spaces + 1]])
    at = spaces[wide] + 1
    two = data[at].astype(np.int64) << 8 | data[at + 1]
    code = np.where(data[at] == 0xC2, two, two << 8 | data[np.minimum(at + 2, len(data) - 1)])
    spaces = np.delete(spaces, wide[np.isin(code, _WIDE_BLANKS)])
    starts = ends[:-1]
    starts[:bounds[0]], starts[spaces] = False, True
    starts = np.flatnonzero(starts)
    offsets = np.append(starts, bounds[-1]).astype(np.int32)
    return (pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), raw),
            np.searchsorted(starts, bounds))


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``pool``, one behind the other."""
    at = np.cumsum(lengths) - lengths
    return pool[np.arange(lengths.sum()) + np.repeat(starts - at, lengths)]


@dataclass
class ChunkWords:
    """The distinct words of some texts, over the distinct runs that they are cut from.

    Occurrences of run ``r`` are words ``word[starts[r]:starts[r] + counts[r]]``.
    """

    words: pa.Array       # distinct, binary
    word: np.ndarray      # words of all distinct runs
    starts: np.ndarray
    counts: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]  # per batch: its runs, and the first of each text

    @staticmethod
    def of(texts: Iterator[pa.Array]) -> ChunkWords:
        cut = [runs(t) for t in texts]
        coded = pa.chunked_array([r for r, _ in cut], pa.string()).dictionary_encode()
        run = np.concatenate([np.zeros(0, np.int32), *(np.asarray(c.indices) for c in coded.chunks)])
        parts = list(zip(np.split(run, np.cumsum([len(r) for r, _ in cut])[:-1]), (first for _, first in cut)))
        distinct = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.string())
        one = np.asarray(pc.match_substring_regex(distinct, _ONE_MATCH))
        both = pc.extract_regex(distinct, _TWO_MATCHES)
        two = np.asarray(both.is_valid())
        pairs = both.drop_null().flatten()
        found = [_MATCH.findall(r) for r in listed(distinct.filter(pa.array(~one & ~two)))]
        counts = np.where(two, 2, 1)
        counts[~one & ~two] = [len(m) for m in found]
        # Words lie by form of their run: one match, two, others.
        form = np.argsort(np.where(one, 0, np.where(two, 1, 2)), kind="stable")
        starts = np.empty(len(distinct), np.int64)
        starts[form] = np.cumsum(counts[form]) - counts[form]
        words = pa.chunked_array([
            distinct.filter(pa.array(one)),
            pa.concat_arrays(pairs).take(pa.array(np.arange(2 * len(pairs[0])).reshape(2, -1).T.ravel())),
            pa.array([w for m in found for w in m], pa.string())])
        named = words.combine_chunks().cast(pa.binary()).dictionary_encode()
        return ChunkWords(named.dictionary, np.asarray(named.indices), starts, counts, parts)


def packed(rows: pa.Table | pa.RecordBatch) -> bytes:
    """The rows as one compressed piece."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(rows)
    return sink.getvalue().to_pybytes()


def unpacked(pieces: pa.ChunkedArray | pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of packed pieces."""
    for piece in pieces:
        yield from pa.ipc.open_stream(piece.as_buffer())


def dealt_out(rows: pa.RecordBatch, places: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Packed rows of each place, in their order."""
    order = np.argsort(places, kind="stable")
    found, starts = np.unique(places[order], return_index=True)
    rows = rows.take(pa.array(order))
    return found.tolist(), [packed(rows.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(places)])]


def given(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


class RankMap:
    """Ranks of pairs of ids, for Spark as a literal.

    Lookups in a Spark map read it from the front, so the map is dealt into
    buckets: lists of key, rank, key, rank, … after a first entry that an
    unsuccessful search finds.
    """

    def __init__(self, ranks: dict[bytes, int], buckets: int = 1 << 16):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        table = [[NONE] for _ in range(buckets)]
        for (left, right), rank in pairs.items():
            table[(left * 31 + right) % buckets] += [self.key(left, right), rank]
        self.buckets = buckets
        self.literal = F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<array<bigint>>")

    @staticmethod
    def key(left, right):
        return (1 << 33) + left * (1 << 16) + right

    def rank(self, table: Column, left: Column, right: Column) -> Column:
        """Rank of the pair in the table, or NONE."""
        bucket = F.get(table, ((left * 31 + right) % self.buckets).cast("int"))
        return given(bucket, lambda b: F.get(b, F.array_position(b, self.key(left, right)).cast("int")))

    def merged(self, ids: Column) -> Column:
        """The ids of a word after all merges, lowest rank first, leftmost of equals.

        A number of the folded array holds, from the highest bits on, the rank of an
        id with its right neighbour, the place where the id starts and the id. The
        smallest number is thus the leftmost merge of lowest rank. A merge replaces
        two numbers and looks up the two new pairs only. The literal stands in the
        plan once, as every task reads each copy of it.
        """
        return given(self.literal, lambda table: self._folded(table, ids))

    def _folded(self, table: Column, ids: Column) -> Column:
        def rank(left: Column, right: Column) -> Column:
            return self.rank(table, left, right)

        def id_of(number: Column) -> Column:
            return number.bitwiseAND(END)

        def step(word: Column, _: Column) -> Column:
            def merge(best: Column) -> Column:
                token = F.shiftright(best, RANK_AT)

                def at_place(at: Column) -> Column:
                    before = F.element_at(word, at - 1)
                    after = id_of(F.element_at(word, at + 2))
                    return F.concat(
                        F.slice(word, 1, at - 2),
                        F.array(F.shiftleft(rank(id_of(before), token), RANK_AT) + before.bitwiseAND(REST),
                                F.shiftleft(rank(token, after), RANK_AT) + best.bitwiseAND(REST - END) + token),
                        F.slice(word, at + 2, F.size(word)))

                return F.when(best >= NONE << RANK_AT, word).otherwise(
                    given(F.array_position(word, best).cast("int"), at_place))

            return given(F.array_min(word), merge)

        def fold(marked: Column) -> Column:
            n = F.size(marked)
            numbers = F.transform(marked, lambda x, i: F.shiftleft(F.when(i + 1 < n, rank(
                x, F.element_at(marked, i + 2))).otherwise(NONE), RANK_AT) + F.shiftleft(i, ID_BITS) + x)
            return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), numbers, step,
                               lambda word: F.transform(F.slice(word, 2, F.size(word) - 2), id_of))

        mark = F.array(F.lit(END).cast("bigint"))
        return given(F.concat(mark, ids, mark), fold)


def merged_long(ids: list[int], pieces: dict[int, bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same for one long word, in time that grows little faster than its length.

    A pair's rank is that of the token that its pieces form.
    """
    after = list(range(1, len(ids) + 1))
    before = list(range(-1, len(ids) - 1))
    ids, alive = list(ids), [True] * len(ids)
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(ids):
            rank = ranks.get(pieces[ids[i]] + pieces[ids[after[i]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[after[i]]))

    for i in range(len(ids) - 1):
        offer(i)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= len(ids) or ids[i] != left or ids[j] != right:
            continue
        ids[i], alive[j] = rank, False
        after[i] = after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [x for x, on in zip(ids, alive) if on]


def encode(docs: DataFrame, ranks_file: str = RANKS, chunk_bytes: int = CHUNK_BYTES,
           shared_chunks: int = SHARED_CHUNKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``ids``, the tokens as little-endian unsigned 32-bit numbers.

    Whole texts are encoded, each match of the pattern separately, without
    special tokens; a match that is a token itself stays whole. Null is an
    empty text and has no tokens. Repeated rows are encoded each; an empty table
    gives no rows; other columns are not looked at.

    Up to ``shared_chunks`` chunks share one folded word, so the list of a
    frequent word's chunks stays short at any size of the table.
    """
    ranks = read_ranks(ranks_file)
    merges = RankMap(ranks)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text")).alias("n")).first().n
    n_chunks = (total or 0) // chunk_bytes + 1
    n_buckets = min(n_chunks, shared_chunks) // BUCKET_CHUNKS + 1
    # Fixed by the rank file, whatever the corpus; an Arrow array takes little memory in every worker.
    shared = docs.sparkSession.sparkContext.broadcast((pa.array(ranks, pa.binary()), np.array(list(ranks.values()))))
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
    kind = docs.schema[id_col].dataType.simpleString()

    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, pieces = dealt_out(batch.select(["id", "text"]), np.asarray(batch.column("chunk")))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(pieces, pa.binary())],
                                                 ["chunk", "texts"])

    def texts_of(texts: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(texts.column("texts")):
            yield from chunks(batch, "text", STRETCH_BYTES)

    def to_merge(words: pa.Array, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A chunk's distinct words that have to be merged, by their bytes, and their buckets.

        A chunk always holds the same texts, so both times the list is the same.
        """
        known = np.asarray(pc.is_in(words, tokens))
        at = np.flatnonzero(~known & (np.asarray(pc.binary_length(words)) <= LONG_WORD))
        at = at[np.asarray(pc.array_sort_indices(words.take(pa.array(at))))]
        return at, np.array([zlib.crc32(w) % n_buckets for w in listed(words.take(pa.array(at)))], np.int64)

    def name_words(key: tuple, texts: pa.Table) -> pa.Table:
        """The words of a chunk that have to be merged, one list a bucket."""
        words = ChunkWords.of(b.column("text") for b in texts_of(texts)).words
        at, places = to_merge(words, shared.value[0])
        found, lists = dealt_out(pa.RecordBatch.from_arrays([words.take(pa.array(at))], ["word"]), places)
        chunk = key[0].as_py()
        del words
        return released(pa.table(
            [pa.array(len(found) * [chunk], pa.int64()), pa.array(len(found) * [chunk // shared_chunks], pa.int64()),
             pa.array(found, pa.int64()), pa.array(lists, pa.binary())], names=["chunk", "part", "bucket", "words"]))

    asked = pa.list_(pa.struct([("chunk", pa.int64()), ("bucket", pa.int64()), ("numbers", pa.binary())]))

    def meet(key: tuple, lists: pa.Table) -> pa.Table:
        """A bucket's distinct words as arrays of byte ids; the last row has who asked for which."""
        pieces = [pa.chunked_array([b.column("word") for b in unpacked([p])], pa.binary()).combine_chunks()
                  for p in lists.column("words")]
        coded = pa.chunked_array(pieces, pa.binary()).dictionary_encode().unify_dictionaries()
        asks = [{"chunk": chunk, "bucket": key[1].as_py(), "numbers": np.asarray(c.indices).astype("<i4").tobytes()}
                for chunk, c in zip(lists.column("chunk").to_pylist(), coded.chunks, strict=True)]
        words = coded.chunk(0).dictionary
        bounds = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(words))))).astype(np.int32)
        flat = byte_ids[np.frombuffer(b"".join(listed(words)), np.uint8)]
        firsts = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, pa.int64()))
        cuts = [*range(0, len(words), ROW_WORDS), len(words)]
        rows = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), firsts)
        return pa.table([rows, pa.array((len(rows) - 1) * [[]] + [asks], asked)], names=["firsts", "asks"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of a bucket's words for every chunk that asked for them."""
        merged: list[pa.Array] = []
        for batch in batches:
            for i in range(batch.num_rows):
                merged.append(batch.column("merged").slice(i, 1).flatten())
                asks = batch.column("asks")[i].as_py()
                if asks:
                    ids = pa.concat_arrays(merged).cast(pa.list_(pa.int32()))
                    merged = []
                    lists = [packed(pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(np.frombuffer(a["numbers"], "<i4")))], ["ids"])) for a in asks]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([a["chunk"] for a in asks], pa.int64()),
                         pa.array([a["bucket"] for a in asks], pa.int64()), pa.array(lists, pa.binary())],
                        ["chunk", "bucket", "ids"])

    def put_together(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, token_ids = shared.value
        batches = list(texts_of(texts))
        here = ChunkWords.of(b.column("text") for b in batches)
        at, places = to_merge(here.words, tokens)
        order = np.argsort(places, kind="stable")
        # Ids of all distinct words, one behind the other: tokens, answers, long words.
        token = np.asarray(pc.index_in(here.words, tokens).fill_null(-1))
        whole = np.flatnonzero(token >= 0)
        owners, lengths, pool = [whole], [np.ones(len(whole), np.int64)], [token_ids[token[whole]]]
        for bucket, lists in zip(answers.column("bucket").to_pylist(), unpacked(answers.column("ids"))):
            ids = lists.column("ids")
            a, b = np.searchsorted(places, [bucket, bucket + 1], sorter=order)
            if b - a != len(ids):
                raise ValueError(f"bucket {bucket}: {len(ids)} answers to {b - a} words")
            owners.append(at[order[a:b]])
            lengths.append(np.asarray(pc.list_value_length(ids), np.int64))
            pool.append(np.asarray(ids.flatten()))
        long = np.flatnonzero((token < 0) & (np.asarray(pc.binary_length(here.words)) > LONG_WORD))
        if len(long):
            ranked = dict(zip(listed(tokens), token_ids.tolist()))
            pieces = {rank: piece for piece, rank in ranked.items()}
        for i in long:
            raw = byte_ids[np.frombuffer(here.words[i].as_py(), np.uint8)].tolist()
            pool.append(np.array(merged_long(raw, pieces, ranked)))
            owners.append(np.array([i]))
            lengths.append(np.array([len(pool[-1])]))
        owner, length = np.concatenate(owners), np.concatenate(lengths)
        if len(owner) != len(here.words):
            raise ValueError(f"{len(here.words) - len(owner)} words without an answer")
        word_at, word_ids = np.empty((2, len(owner)), np.int64)
        word_at[owner], word_ids[owner] = np.cumsum(length) - length, length
        # The same for all distinct runs, then for the texts.
        flat = gathered(np.concatenate(pool).astype("<u4"), word_at[here.word], word_ids[here.word])
        ends = np.concatenate(([0], np.cumsum(word_ids[here.word])))
        run_at = ends[here.starts]
        run_ids = ends[here.starts + here.counts] - run_at
        made = []
        for run, first in here.parts:
            ids = gathered(flat, run_at[run], run_ids[run])
            bounds = 4 * np.concatenate(([0], np.cumsum(run_ids[run])))[first]
            made.append(pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [
                None, pa.py_buffer(bounds), pa.py_buffer(ids)]).cast(pa.binary()))
        del here, token, ids
        return released(pa.table(
            [pa.chunked_array([b.column("id") for b in batches]), pa.chunked_array(made, pa.binary())], names=["id", "ids"]))

    dealt = plain.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n_chunks))).mapInArrow(
        pack_texts, "chunk bigint, texts binary")
    named = dealt.groupBy("chunk").applyInArrow(name_words, "chunk bigint, part bigint, bucket bigint, words binary")
    met = named.groupBy("part", "bucket").applyInArrow(
        meet, "firsts array<array<bigint>>, asks array<struct<chunk: bigint, bucket: bigint, numbers: binary>>")
    folded = met.select(F.transform("firsts", merges.merged).alias("merged"), "asks")
    answers = folded.mapInArrow(answer, "chunk bigint, bucket bigint, ids binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        put_together, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks_file: str = RANKS, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """Concatenate the binary pieces of ``ids``: the id and ``decoded`` bytes.

    With ``digest`` the id, n_tokens, ids_sha256 (decimal ids joined by one
    space) and decoded_sha256. Null ids count as none.
    """
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(parts: pa.Array, ids: pa.Array, bounds: np.ndarray, cut: int) -> Iterator[memoryview]:
            """The parts of each text's ids, without the last ``cut`` bytes."""
            taken = parts.take(ids)
            raw = memoryview(taken.buffers()[2] or b"") if len(ids) else memoryview(b"")
            at = offsets_of(taken)[bounds].tolist()
            return (raw[a:max(a, b - cut)] for a, b in zip(at[:-1], at[1:]))

        for batch in (rows for b in batches for rows in chunks(b, "ids", STRETCH_BYTES)):
            column = pc.fill_null(batch.column("ids"), b"")
            bounds = offsets_of(column).astype(np.int64)
            raw = column.buffers()[2] if bounds[-1] > bounds[0] else b""
            ids = pa.array(np.frombuffer(raw, "<u4", (bounds[-1] - bounds[0]) // 4, bounds[0] if raw else 0))
            bounds = (bounds - bounds[0]) // 4
            pieces, decimals = token_parts(ranks_file)
            texts = joined(pieces, ids, bounds, 0)
            if digest:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(np.diff(bounds)),
                     pa.array([hashlib.sha256(t).hexdigest() for t in joined(decimals, ids, bounds, 1)]),
                     pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(bytes, texts), pa.binary())], ["id", "decoded"])

    rest = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "decoded binary"
    plain = tokens.select(F.col(id_col).alias("id"), "ids")
    return plain.mapInArrow(run, f"id {kind}, {rest}").withColumnRenamed("id", id_col)
