"""Language identification by multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every run of other characters becomes one space, and
n-grams of 1 to 3 characters (within words, with their border spaces) are
hashed to 2^16 buckets. The log-probability matrix (labels x buckets) is
broadcast and batches are scored with numpy: a batch's n-grams gather the rows of
the bucket-major matrix, which are summed by document.

Defined results: null texts and texts without a letter are ``und`` with score
0; without any training row every text is ``und``; of equally likely labels the
first in alphabetical order is taken; null ids stay null; repeated rows are
judged each; an empty table gives an empty result; other columns are not read;
label, source and id are never inputs of a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.tokens import text_slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labels that a model may have (64 MB of matrix); more are an error, none is dropped.
MAX_LABELS = 256
#: Training documents for each label: those with the smallest hashes of their ids.
TRAIN_DOCS_PER_LABEL = 4000
#: Numbers of the matrix that are gathered at once.
GATHERED = 1 << 21

_OTHER = re.compile(r"[\W\d_]+")
_M = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def ngram_buckets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of all n-grams, text after text, and where each text's begin (one more than texts)."""
    clean = [f" {t} " if any(map(str.isalpha, t := _OTHER.sub(" ", x.lower()).strip())) else "" for x in texts]
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in clean])])
    codes = np.frombuffer("".join(clean).encode("utf-32-le"), np.uint32)
    last = np.zeros(len(codes), bool)
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    space = codes == 32
    out, h = [], np.zeros(len(codes), np.uint32)
    for k in ORDERS:
        n = max(0, len(codes) - k + 1)
        h = h[:n] * _M[0] + codes[len(codes) - n :] * _M[1]
        if k == 1:
            inside = ~space
        else:  # no n-gram runs over a word's border or a text's end
            inside = ~last[:n]
            for j in range(1, k - 1):
                inside &= ~space[j : n + j]
                inside &= ~last[j : n + j]
        at = np.flatnonzero(inside)
        b = h[at]
        b ^= (b >> np.uint32(15)) ^ np.uint32(k * 0x2545)
        out.append((((b * _M[2]) >> np.uint32(16)).astype(np.int32), np.searchsorted(at, bounds)))
    return out


@dataclass
class LanguageModel:
    labels: list[str]
    prior: np.ndarray
    #: Bucket-major: a row for each bucket.
    log_prob: np.ndarray

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best label (index, -1: no letter) and its posterior, for each text."""
        total = np.tile(self.prior, (len(texts), 1))
        size = np.zeros(len(texts), np.int64)
        step = max(1, GATHERED // max(1, len(self.labels)))
        for buckets, starts in ngram_buckets(texts):
            size += np.diff(starts)
            some = np.flatnonzero(np.diff(starts))
            first, end = starts[some], starts[some + 1]
            for a in range(0, len(buckets), step):
                here = slice(*np.searchsorted(end, [a, a + step - 1], "right") + [0, 1])
                rows = self.log_prob[buckets[a : a + step]]
                total[some[here]] += np.add.reduceat(rows, np.maximum(first[here] - a, 0), axis=0, dtype=np.float64)
        best = total.argmax(1)
        odds = np.exp(total - total.max(1, keepdims=True))
        return np.where(size > 0, best, -1), np.where(size > 0, 1 / odds.sum(1), 0.0)


def train(docs: DataFrame, label: Column, text_col: str = "text", id_col: str = "doc_id", per_label: int = TRAIN_DOCS_PER_LABEL) -> LanguageModel:
    """Fit on at most ``per_label`` documents of each non-null label; counts are summed by Spark."""
    rows = docs.select(label.alias("label"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id")).where("label is not null and text is not null")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().limit(MAX_LABELS + 1).collect()}
    if len(sizes) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    labels = sorted(sizes)
    if not labels:
        return LanguageModel([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*(c for x in labels for c in (F.lit(x), F.lit(min(1.0, per_label / sizes[x])))))
    drawn = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30) < F.element_at(share, F.col("label"))
    rows = rows.where(F.col("label").isin(labels)).where(drawn).select("label", "text")
    index = {x: k for k, x in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, stop, data, at in text_slices(batch.column(1)):
                kinds = np.array([index[x] for x in names[first:stop]], np.int64)
                texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)]
                cells = np.concatenate([np.repeat(kinds, np.diff(starts)) * BUCKETS + buckets for buckets, starts in ngram_buckets(texts)])
                cells, counts = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((cells // BUCKETS).astype(np.int32)), pa.array((cells % BUCKETS).astype(np.int32)), pa.array(counts)], names=["k", "b", "n"])

    found = rows.mapInArrow(run, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.ones((len(labels), BUCKETS))
    counts[found["k"], found["b"]] += found["n"]
    weight = np.array([sizes[x] for x in labels], float)
    return LanguageModel(labels, np.log(weight / weight.sum()), np.ascontiguousarray(np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32).T))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every document; the score is the posterior of the predicted label."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for _, _, data, at in text_slices(batch.column(1), 1 << 19):
                texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)]
                best, score = model.score(texts) if model.labels else (np.full(len(texts), -1), np.zeros(len(texts)))
                names += [model.labels[k] if k >= 0 else "und" for k in best]
                scores += score.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, lang_pred string, score double")
