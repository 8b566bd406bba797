"""Toxic spans by a conditional random field, gathered to document scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import Chain
from .fit import Logistic, labelled_sample, remainder
from .words import Words, chunks, split_words

# Bounds of the sample the model is fitted on.
PER_CLASS = 2_000
CLASS_BYTES = 4 << 20
CUT = 0.3
# A token's features: the word, its first bytes.
PREFIXES = (None, 6, 7)

# Tokens are runs of ASCII letters and digits and of bytes beyond ASCII.
_BREAK = np.ones(256, bool)
_BREAK[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1),
        *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False


def _tokens(texts: pa.Array) -> tuple[Words, list[np.ndarray]]:
    w = split_words(texts, _BREAK)
    return w, [h ^ np.uint64(i) for i, h in enumerate(w.prefix_hashes(PREFIXES, lower=True))]


@dataclass
class ToxicityModel:
    """Known features (sorted hashes), the field over them, and the calibration."""

    known: np.ndarray
    chain: Chain | None
    calibration: Logistic | None
    base: float

    def numbers(self, hashes: list[np.ndarray]) -> np.ndarray:
        """Feature numbers of each token; the number after the last stands for unknown ones."""
        if not len(self.known):
            return np.zeros((len(hashes), len(hashes[0])), np.int64)
        at = np.searchsorted(self.known, np.stack(hashes))
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == np.stack(hashes), at, len(self.known))

    def marginals(self, w: Words, hashes: list[np.ndarray]) -> np.ndarray:
        if self.chain is None or not len(w.starts):
            return np.zeros(len(w.starts))
        return self.chain.marginals(self.numbers(hashes), w.first)[0]

    def scores(self, w: Words, p: np.ndarray) -> np.ndarray:
        if self.calibration is None:
            return np.full(w.n_docs, self.base)
        return self.calibration.predict(_evidence(w, p))


def _evidence(w: Words, p: np.ndarray) -> np.ndarray:
    """Expected toxic tokens, their density, and the chance of at least one."""
    total = np.bincount(w.doc, p, w.n_docs)
    any_of = 1 - np.exp(np.bincount(w.doc, np.log1p(-np.minimum(p, 1 - 1e-9)), w.n_docs))
    return np.stack([np.log1p(total), total / np.sqrt(w.counts + 25), any_of], 1)


def fit_toxicity(sample: pd.DataFrame) -> ToxicityModel:
    """Tag tokens from document labels, fit the field, calibrate document scores.

    Half of the sample teaches which features are toxic: those in a fair number
    of toxic texts and at least five times as often there as elsewhere. Their
    tokens in toxic texts carry tag 1, all other tokens tag 0. The other half
    calibrates. With fewer than four texts of a class every score is the share
    of label 1.
    """
    base = float(sample.attrs["share"])
    no_model = ToxicityModel(np.zeros(0, np.uint64), None, None, base)
    if min((sample["y"] == y).sum() for y in (0, 1)) < 4:
        return no_model
    rank = sample.groupby("y").cumcount()
    learn, check = sample[rank % 2 == 0], sample[rank % 2 == 1]
    w, hashes = _tokens(pa.array(learn["text"]))
    toxic = learn["y"].to_numpy() == 1
    keys = np.concatenate(hashes)
    owner = np.tile(w.doc, len(hashes))
    known, number = np.unique(keys, return_inverse=True)
    pairs = np.unique(number * len(toxic) + owner)          # a feature counts once a text
    feature, text = pairs // len(toxic), pairs % len(toxic)
    with_it = np.bincount(feature[toxic[text]], minlength=len(known))
    without = np.bincount(feature[~toxic[text]], minlength=len(known))
    lift = (with_it / toxic.sum()) / ((without + 0.5) / (~toxic).sum())
    enough = max(4, 0.005 * toxic.sum())
    seed = (with_it >= enough) & (lift >= 5)
    use = seed | (with_it + without >= 0.02 * len(toxic))   # others let the field learn contrast
    if not seed.any():
        return no_model
    tags = (seed[number].reshape(len(hashes), -1).any(0) & toxic[w.doc]).astype(np.int64)
    model = ToxicityModel(known[use], None, None, base)
    chain = Chain(np.zeros(int(use.sum()) + 1))
    model.chain = chain.fit(model.numbers(hashes), w.first, tags)
    w, hashes = _tokens(pa.array(check["text"]))
    y = check["y"].to_numpy(float)
    fitted = Logistic.fit(_evidence(w, model.marginals(w, hashes)), y)
    model.calibration = fitted.for_share(base, y.mean())
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id",
                   text_col: str = "text", span_cut: float = 0.5) -> DataFrame:
    """Per row: the id, ``score`` and ``spans``, (start, stop) in characters of toxic tokens.

    Whole texts are read; neighbouring toxic tokens form one span. Null and empty
    texts have no spans and the score of no evidence. Rows stay in their tasks;
    repeated rows each get their score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                w, hashes = _tokens(part.column("text"))
                p = model.marginals(w, hashes)
                hot = np.flatnonzero(p >= span_cut)
                new = np.ones(len(hot), bool)
                new[1:] = (hot[1:] != hot[:-1] + 1) | (w.doc[hot[1:]] != w.doc[hot[:-1]])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(hot)) - 1 if len(hot) else head
                char = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))
                doc = w.doc[hot[head]]
                offset = char[w.bounds[doc]]
                start = char[w.starts[hot[head]]] - offset
                stop = char[w.ends[hot[tail]]] - offset
                values = pa.StructArray.from_arrays(
                    [pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))],
                    fields=list(span))
                bounds = np.searchsorted(doc, np.arange(w.n_docs + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(model.scores(w, p)),
                     pa.ListArray.from_arrays(pa.array(bounds), values)], ["id", "score", "spans"])

    schema = f"id {kind}, score double, spans array<struct<start: int, stop: int>>"
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
                    class_bytes: int = CLASS_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, spans.

    Labels are learnt only from ids whose crc32 modulo 4 is not 2, from at most
    ``per_class`` whole texts a class of together at most ``class_bytes`` bytes.
    An empty table gives no rows.
    """
    sample = labelled_sample(docs, labels, "toxic", remainder("doc_id", 4) != 2,
                             per_class, class_bytes)
    scored = score_toxicity(docs, fit_toxicity(sample))
    return scored.select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"), "spans")
