"""Quality classifier: how much better a dictionary of good text compresses than one of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fit import Logistic, labelled_sample, remainder

LEVEL = 3
DICTIONARY_BYTES = 32_768
# Bounds of the sample the model is fitted on.
PER_CLASS = 3_000
CLASS_BYTES = 8 << 20
CUT = 0.3


@dataclass
class CompressionModel:
    """Two zstandard dictionaries and the calibration of their size difference."""

    good: bytes
    bad: bytes
    calibration: Logistic | None
    base: float

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        """Compressed size with the good and the bad dictionary, and the plain size."""
        made = [_compressor(self.good), _compressor(self.bad)]
        return np.array([[*(len(c.compress(t)) for c in made), len(t)] for t in texts],
                        float).reshape(-1, 3)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.calibration is None or not texts:
            return np.full(len(texts), self.base)
        return self.calibration.predict(_inputs(self.sizes(texts)))


def _inputs(sizes: np.ndarray) -> np.ndarray:
    """The normalised difference, and what its reliability depends on: size and density."""
    good, bad, plain = sizes.T
    x = (good - bad) / (good + bad)
    density = np.log((good + bad) / 2 / (plain + 1) + 1e-3)
    short = 1 / np.sqrt(plain + 16)
    return np.stack([x, x * np.abs(x), density, density**2, short, x * short], 1)


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False,
                                    write_checksum=False, write_dict_id=False)


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; too little text for training serves as it is."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


def fit_compression(sample: pd.DataFrame) -> CompressionModel:
    """Dictionaries from every other text of each class, calibration on the rest.

    Without two texts of each class there is nothing to compare: every score is
    then the share of label 1, or one half without labels.
    """
    base = float(sample.attrs["share"])
    sample = sample.assign(raw=sample["text"].str.encode("utf-8"))
    parts = {y: sample[sample["y"] == y] for y in (0, 1)}
    if min(map(len, parts.values())) < 2:
        return CompressionModel(b"", b"", None, base)
    first = {y: [t for t in p["raw"][::2] if t] for y, p in parts.items()}
    model = CompressionModel(_dictionary(first[1]), _dictionary(first[0]), None, base)
    rest = pd.concat([p[1::2] for p in parts.values()])
    x = _inputs(model.sizes(list(rest["raw"])))
    fitted = Logistic.fit(x, rest["y"].to_numpy(float))
    model.calibration = fitted.for_share(base, float(rest["y"].mean()))
    return model


def score_quality(docs: DataFrame, model: CompressionModel, text_col: str = "text",
                  out: str = "score") -> DataFrame:
    """Add a score from 0 to 1 for every whole text; null counts as empty text.

    A column already named like ``out`` is replaced. Rows pass one by one in
    their own partitions: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for part in parts:
            yield pd.Series(model.score([t.encode("utf-8") if t is not None else b"" for t in part]))

    return docs.withColumn(out, score(F.col(text_col)))


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
                   class_bytes: int = CLASS_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Labels are learnt only from ids whose crc32 modulo 5 is not 0, from at most
    ``per_class`` whole texts a class of together at most ``class_bytes`` bytes.
    Scores read whole texts and nothing but texts. Repeated rows each get their
    score; null ids are scored like others; an empty table gives no rows.
    """
    sample = labelled_sample(docs, labels, "quality", remainder("doc_id", 5) != 0,
                             per_class, class_bytes)
    scored = score_quality(docs.select("doc_id", "text"), fit_compression(sample))
    return scored.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))
