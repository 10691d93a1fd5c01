"""Quality classifier by compression.

Two zstandard dictionaries are built from good and from bad labelled text. A
text is compressed with each; the difference of the two sizes says which it
resembles more. It is a sum over the text, whose chance part grows as the root
of its length, so it is divided by that root. A logistic calibration of this one
number, fitted on labelled rows that built no dictionary, is the score.

Defined results: null and empty texts get the calibrated score of a text of no
bytes; without labelled rows of both classes every score is the labels' mean
(0.5 without labels); a label other than 0 and 1 is ignored; repeated rows are
scored each; null ids stay null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.tokens import text_slices

#: Labelled documents of each class that may be fetched for fitting: those with the smallest hashes of their ids.
TRAIN_DOCS_PER_CLASS = 1500
#: Bytes of labelled text of each class that may be fetched.
TRAIN_BYTES_PER_CLASS = 32 << 20
DICTIONARY_BYTES = 1 << 16
LEVEL = 3


def _dictionary(texts: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(texts)[-DICTIONARY_BYTES:]


class _Compressors:
    def __init__(self, bad: bytes, good: bytes):
        import zstandard

        trained = b"\x37\xa4\x30\xec"
        kind = lambda raw: zstandard.DICT_TYPE_FULLDICT if raw.startswith(trained) else zstandard.DICT_TYPE_RAWCONTENT
        make = lambda raw: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind(raw)) if raw else None, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.bad, self.good = make(bad).compress, make(good).compress

    def difference(self, text: bytes) -> float:
        """The normalised difference of the compressed sizes, above 0 where the good dictionary serves better."""
        return (len(self.bad(text)) - len(self.good(text))) / float(np.sqrt(len(text) + 8))


@dataclass
class CompressionModel:
    bad: bytes
    good: bytes
    #: Of the logistic function over the difference.
    intercept: float
    slope: float
    constant: float | None = None

    def compressors(self) -> _Compressors:
        return _Compressors(self.bad, self.good)

    def score(self, difference: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(difference), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * difference, -30, 30)))


def _logistic(terms: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    w = np.zeros(terms.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (len(w) - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(terms @ w, -30, 30)))
        step = np.linalg.solve((terms.T * (p * (1 - p) + 1e-9)) @ terms + penalty, terms.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", per_class: int = TRAIN_DOCS_PER_CLASS) -> CompressionModel:
    """Fit on a bounded sample of the labelled documents: half of each class builds its dictionary, all others calibrate.

    Labels are reduced to the sample before they meet the texts, so only the
    sample's texts are moved.
    """
    from marlstone.llm.common import maybe_broadcast

    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(sizes.values())
    rest = dict(intercept=0.0, slope=0.0)
    if len(sizes) < 2:
        return CompressionModel(b"", b"", **rest, constant=float(next(iter(sizes), 0.5)))
    drawn = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(11)), F.lit(1 << 30))
    share = F.when(F.col("y") == 1, F.lit(min(1.0, per_class / sizes[1]))).otherwise(F.lit(min(1.0, per_class / sizes[0])))
    sample = known.withColumn("draw", drawn).where(F.col("draw") < share * float(1 << 30))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(maybe_broadcast(sample, 4 * per_class), "id")
    by: dict[int, list[bytes]] = {0: [], 1: []}
    room = {0: TRAIN_BYTES_PER_CLASS, 1: TRAIN_BYTES_PER_CLASS}
    for row in texts.select("y", "draw", "id", "text").orderBy("draw", "id").toLocalIterator():
        raw = row["text"].encode()
        if room[row["y"]] > 0:
            room[row["y"]] -= len(raw)
            by[row["y"]].append(raw)
    if not by[0] or not by[1]:
        return CompressionModel(b"", b"", **rest, constant=sizes[1] / total)
    bad, good = (_dictionary(by[k][::2]) for k in (0, 1))
    both = _Compressors(bad, good)
    fit = [(raw, k) for k in (0, 1) for raw in (by[k][1::2] or by[k])]
    difference = np.array([both.difference(raw) for raw, _ in fit])
    y = np.array([k for _, k in fit], float)
    centre, scale = difference.mean(), difference.std() + 1e-6
    level, slope = _logistic(np.stack([np.ones_like(difference), (difference - centre) / scale], axis=1), y)
    # the sample has the classes in other proportions than the labels: the odds are set back
    drawn_odds, true_odds = y.mean() / (1 - y.mean()), sizes[1] / sizes[0]
    level += np.log(true_odds / drawn_odds)
    return CompressionModel(bad, good, float(level - slope * centre / scale), float(slope / scale))


def score(docs: DataFrame, model: CompressionModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, difference, score)`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        both = model.compressors()
        for batch in batches:
            found = np.array([both.difference(data[a:b].tobytes()) for _, _, data, at in text_slices(batch.column(1)) for a, b in zip(at[:-1], at[1:], strict=True)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(model.score(found))], names=["doc_id", "difference", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, difference double, score double")
